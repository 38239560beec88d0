"""Helpers shared by the corpus operators: row keys, joins that leave long texts where they are, Arrow row mapping, folds."""

from __future__ import annotations

import contextlib
import io
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.operators.scratch import Scratch, shared_root

__all__ = ["KeyFilter", "Scratch", "shared_root", "arrow_map", "batch", "column", "fold", "held_out", "join_rows", "numbered", "spare", "table", "without"]

#: Rows and bytes that a function sees at once (one row at least, however long).
BATCH_ROWS, BATCH_BYTES = 1024, 2 << 20
#: Keys up to which they are broadcast to the scan of a table (under 100 MB with what belongs to them), and keys up to
#: which a filter of theirs is (9 bits each, 64 MB).
BROADCAST_KEYS, SCREEN_KEYS = 400_000, 56_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, read by Spark (the folder can be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The top-level column of exactly that name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def spare(docs: DataFrame, name: str) -> str:
    """name, or with underscores behind it, so that no column of docs has it (case doesn't count)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4 (null for a null id)."""
    return F.crc32(doc_id.cast("string")) % 4


def held_out(doc_id: Column) -> Column:
    """True for rows from which no label may be learnt; a null id is never held out."""
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def _pieces(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if b.num_rows > BATCH_ROWS or b.num_rows > 1 and b.nbytes > BATCH_BYTES:
        half = b.num_rows // 2
        yield from _pieces(b.slice(0, half))
        yield from _pieces(b.slice(half))
    else:
        yield b


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow() with batches of bounded rows and bytes. What Spark hands to a worker at once is bounded by a setting of
    the session, 64 MB by default; it is lowered to BATCH_BYTES, because tasks of long texts else hold several such
    batches. A smaller setting stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(str(conf.get(key)).rstrip("bB")) <= BATCH_BYTES:
        conf.set(key, f"{BATCH_BYTES}b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(p for b in batches for p in _pieces(b))
        pa.default_memory_pool().release_unused()  # workers live on between tasks

    return df.mapInArrow(run, schema)


def batch(schema: pa.Schema, *columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


ROW = "struct<file:bigint,at:bigint>"
ROW_ARROW = pa.struct([("file", pa.int64()), ("at", pa.int64())])


def _is_scan(docs: DataFrame) -> bool:
    """Whether docs is a scan of Parquet files with columns and filters only, so that its rows are the files' rows."""
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        docs.explain()
    nodes = re.findall(r"^[\s:+*()\d-]*([A-Z]\w+(?: parquet)?)", text.getvalue(), re.MULTILINE)
    return "FileScan parquet" in nodes and set(nodes) <= {"FileScan parquet", "Project", "Filter", "ColumnarToRow"}


def numbered(docs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """docs with a key of each row in column name (see spare()): equal rows have different keys, and a row has the same
    key whenever the result is read again, on whatever executors.

    Rows of a scan of Parquet files are known by file (a 64-bit hash of its path) and place in it, so nothing is
    written. Other tables are written to scratch first.
    """
    if _is_scan(docs) and "_metadata" not in docs.columns:
        return docs.withColumn(name, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")))
    return scratch.table(docs.withColumn(name, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))), "numbered")


class KeyFilter:
    """Binary-fuse filters of a set of 64-bit keys, small enough to be broadcast: 9 bits a key, no key is missed, one
    other in 256 passes."""

    def __init__(self, keys: DataFrame, scratch: Scratch):
        """keys: column key (long), SCREEN_KEYS of them at most."""
        from seqlake.llm.exact import filters_of

        self.shards = max(1, keys.count() // 250_000)
        rows = scratch.table(filters_of(keys, self.shards), "screen").toLocalIterator()
        parts = {r["shard"]: (r["seed"], r["segment"], r["segments"], bytes(r["cells"])) for r in rows}
        self.shared = keys.sparkSession.sparkContext.broadcast(parts)

    def has(self, keys: np.ndarray) -> np.ndarray:
        from seqlake.llm.fuse import FuseFilter

        parts = self.shared.value
        if self.shards == 1:
            return FuseFilter.load(*parts[0]).has(keys) if parts else np.zeros(len(keys), bool)
        out, shard = np.zeros(len(keys), bool), keys % self.shards
        for s in np.unique(shard):
            if s in parts:
                at = shard == s
                out[at] = FuseFilter.load(*parts[s]).has(keys[at])
        return out


def _screen(keys: DataFrame, name: str, scratch: Scratch) -> Callable[[Column], Column]:
    from seqlake.llm.exact import membership

    hit = membership(KeyFilter(keys.select(F.xxhash64(name).alias("key")), scratch))
    return lambda c: hit(F.xxhash64(c))


def join_rows(docs: DataFrame, keyed: DataFrame, name: str, scratch: Scratch, how: str = "inner", broadcast_keys: int = BROADCAST_KEYS, screen_keys: int = SCREEN_KEYS) -> DataFrame:
    """docs joined with keyed (a written table whose key in column name is unique): "inner", "left_semi" or "left_anti".

    Long rows stay where they are as long as that can be done: up to broadcast_keys keys are sent to the scan of docs;
    up to screen_keys a filter of theirs is, and only rows that pass it are shuffled to meet the keys; beyond, all are.
    The result is the same.
    """
    n = keyed.count()
    if n <= broadcast_keys:
        return docs.join(F.broadcast(keyed), name, how)
    if n > screen_keys:
        return docs.join(keyed.hint("merge"), name, how)
    hit = _screen(keyed, name, scratch)(F.col(name))
    met = docs.where(hit).join(keyed.hint("merge"), name, how)
    return met.unionByName(docs.where(~hit)) if how == "left_anti" else met


def without(docs: DataFrame, gone: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """docs (numbered in column name) without the rows whose keys are in gone, and without the key column."""
    left = [c for c in docs.columns if c != name]
    return join_rows(docs, scratch.table(gone.select(name).distinct(), "gone"), name, scratch, "left_anti").select(*map(column, left))
