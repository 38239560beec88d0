"""Vector code compression: product codes with integer codebooks, entries found by Exponion search.

Components become integers, vectors are cut into equal consecutive parts, and every part position has a codebook of its
own. A part starts at its entry of the round before, at exact squared distance u from it. An entry that is as near as that
one lies within 2 sqrt(u) of it, so its list of the other entries, sorted by distance, is read up to squared distance 4u and no
further; distances are exact integers and ties go to the lower index, so the result is that of a full search.

Blocks of vectors carry their entries from round to round (a table in the shared folder, which the next round replaces),
with the sums of their parts by entry; a round's codebooks come from a sum over those, a fixed number of rows.

Rows whose vector is null or holds null or non-finite components are dropped, as are rows of another length than that of the
smallest id's vector. A null id stays, behind all others. Fewer rows than entries make shorter codebooks; no row gives no row. If
the length isn't a multiple of the parts, the first parts are longer by one. Equal ids and rows keep a row each. Distances that
could leave 64 bits are computed with Python's integers; an error that doesn't fit a long fails.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import Scratch, arrow_map, column
from seqlake.llm.vectors import finite, numbers, packed
from seqlake.operators.coords import dimension

BLOCK = "n int, ids binary, no_id binary, labels binary, no_label binary, vecs binary, codes binary"


def cuts(dim: int, parts: int) -> list[slice]:
    """Where the parts lie."""
    ends = np.cumsum([0] + [dim // parts + (k < dim % parts) for k in range(parts)])
    return [slice(a, b) for a, b in zip(ends.tolist(), ends[1:].tolist())]


def _exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """As int64, or as Python's integers where squared distances could leave 64 bits."""
    most, wide = max((int(np.abs(a).max()) for a in arrays if a.size), default=0), max(a.shape[-1] for a in arrays)
    return [a.astype(object if 4 * most * most * max(1, wide) >= 1 << 63 else np.int64) for a in arrays]


def exponion(x: np.ndarray, book: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, squared distance) of each row of x: the nearest row of book, the lower index of equals; and the number of
    distances computed. start: the entry to begin at, any will do."""
    x, book = _exact(x, book)
    between = ((book[:, None] - book[None]) ** 2).sum(2)
    lists = np.argsort(between, axis=1, kind="stable")  # an entry's list: itself or its equals, then ever farther ones
    away = np.take_along_axis(between, lists, 1)
    first = ((x - book[start]) ** 2).sum(1)
    entry, least, inside, made = start.copy(), first.copy(), np.arange(len(x)), len(x)
    for k in range(len(book)):
        inside = inside[(away[start[inside], k] <= 4 * first[inside]).astype(bool)]
        if not len(inside):
            break
        other = lists[start[inside], k]
        there, other = inside[other != start[inside]], other[other != start[inside]]
        d = ((x[there] - book[other]) ** 2).sum(1)
        made += len(there)
        better = ((d < least[there]) | (d == least[there]) & (other < entry[there])).astype(bool)
        entry[there[better]], least[there[better]] = other[better], d[better]
    return entry, least, made


def _pack(scale: int, parts: int):
    def pack(cols, m):
        ids, no_id, labels, no_label = cols
        v = np.floor(m * scale)
        v = v.astype(np.int16 if not v.size or np.abs(v).max() < 1 << 15 else np.int64)
        # 64-bit blocks are told from 16-bit ones by their size
        return {"n": len(v), "ids": ids.astype(np.int64), "no_id": no_id.astype(bool), "labels": labels.astype(np.int64), "no_label": no_label.astype(bool), "vecs": v, "codes": np.zeros((len(v), parts), np.uint8)}

    return pack


def _vectors(r: dict, dim: int) -> np.ndarray:
    return np.frombuffer(r["vecs"], np.int16 if len(r["vecs"]) == 2 * r["n"] * dim else np.int64).reshape(r["n"], dim)


def _assign(blocks: DataFrame, books: list[np.ndarray], dim: int) -> DataFrame:
    """Blocks with new codes, and sums: for each part and entry the count, then the sums of the components."""
    where = cuts(dim, len(books))

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                v, old, sums = _vectors(r, dim), numbers(r["codes"], np.uint8).reshape(r["n"], len(books)), []
                codes = np.empty_like(old)
                for k, (book, s) in enumerate(zip(books, where)):
                    codes[:, k], _, _ = exponion(v[:, s], book, old[:, k].astype(np.int64))
                    total = np.zeros((len(book), 1 + s.stop - s.start), np.int64)
                    np.add.at(total, codes[:, k], np.column_stack([np.ones(len(v), np.int64), v[:, s].astype(np.int64)]))
                    sums += total.ravel().tolist()
                out.append(r | {"codes": codes.tobytes(), "sums": sums})
            yield pa.RecordBatch.from_pylist(out, pa.schema([*b.schema, ("sums", pa.list_(pa.int64()))]))

    return arrow_map(blocks.select(*(x.split()[0] for x in BLOCK.split(", "))), run, BLOCK + ", sums array<bigint>")


def _updated(blocks: DataFrame, books: list[np.ndarray], dim: int) -> list[np.ndarray]:
    """Entries become the floors of their parts' means; unused ones stay. What is read back is a row for each component."""
    got = {r.pos: r.s for r in blocks.select(F.posexplode("sums").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("s")).collect()}
    at, out = 0, []
    for book, s in zip(books, cuts(dim, len(books))):
        wide = 1 + s.stop - s.start
        rows = [[got[at + e * wide + c] for c in range(wide)] for e in range(len(book))]
        out.append(np.array([[x // r[0] for x in r[1:]] if r[0] else old for r, old in zip(rows, book.tolist())], book.dtype).reshape(book.shape))
        at += len(book) * wide
    return out


def compress(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, codes, error) and the codebooks: codes has an entry's index for each part, error the squared
    distance to the entries, summed over parts. entries: 256 at most."""
    spark, v = df.sparkSession, column(vector)
    rows = df.select(column(id_col).cast("long").alias("vec_id"), column(label).cast("long").alias("label"), v.cast("array<double>").alias("v")).where(finite(F.col("v")))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    schema = "vec_id long, label long, codes array<int>, error long"
    if not first:
        return spark.createDataFrame([], schema), []
    dim = len(first[0].v)
    rows = rows.where(F.size("v") == dim)
    if any(len(r.v) != dim for r in first):
        first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    begin = np.floor(np.array([r.v for r in first], np.float64).reshape(len(first), dim) * scale).astype(np.int64)
    books, scratch = [begin[:, s] for s in cuts(dim, parts)], Scratch(spark, "codes")
    flat = rows.select(F.coalesce("vec_id", F.lit(0)).alias("i"), F.col("vec_id").isNull().alias("no_i"), F.coalesce("label", F.lit(0)).alias("l"), F.col("label").isNull().alias("no_l"), "v")
    blocks = scratch.table(packed(flat, _pack(scale, parts), BLOCK), "blocks")
    for _ in range(rounds):
        after = scratch.table(_assign(blocks, books, dim), "round")
        scratch.drop(blocks)
        blocks, books = after, _updated(after, books, dim)
    arrow = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("codes", pa.list_(pa.int32())), ("error", pa.int64())])

    def last(batches):
        for b in batches:
            for r in b.to_pylist():
                x, old = _vectors(r, dim), numbers(r["codes"], np.uint8).reshape(r["n"], parts)
                found = [exponion(x[:, s], book, old[:, k].astype(np.int64))[:2] for k, (book, s) in enumerate(zip(books, cuts(dim, parts)))]
                codes, error = np.stack([c for c, _ in found], 1), sum(e for _, e in found)
                one = lambda name, none: pa.array(numbers(r[name], np.int64), mask=numbers(r[none], bool))
                for k in range(0, r["n"], 1024):
                    at = slice(k, k + 1024)
                    yield pa.RecordBatch.from_arrays([one("ids", "no_id")[at], one("labels", "no_label")[at], pa.array(codes[at].tolist(), arrow.field("codes").type), pa.array(error[at].tolist(), pa.int64())], schema=arrow)

    return arrow_map(blocks, last, schema), books


def books_sha256(books: list[np.ndarray]) -> str:
    """Hex digest of all entries' components in decimal, by part, entry and position, parted by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def digests(df: DataFrame, **options) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256); label_error: the error of all rows of the label, nulls together."""
    coded, books = compress(df, **options)
    coded = Scratch(df.sparkSession, "coded").table(coded, "coded")
    key = [F.col("label").isNull().alias("no_label"), F.coalesce("label", F.lit(0)).alias("label_key")]
    totals = coded.groupBy(*key).agg(F.sum("error").alias("label_error"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    keyed = coded.select("vec_id", code.alias("code"), "error", *key)
    return keyed.join(dimension(totals), ["no_label", "label_key"]).select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
