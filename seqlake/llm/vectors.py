"""Vectors in blocks: what the operators on embeddings share.

Rows are packed where they are read, without a shuffle, into blocks of bounded size (arrays of numbers as bytes); the rows
of a stated query set are packed likewise, and each of their blocks meets each group of data blocks by an equi join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import arrow_map, column

#: Vectors of a block, and query vectors of a block.
BLOCK, QUERY_BLOCK = 4096, 1024


def finite(vector: Column) -> Column:
    """True for a vector that is not null and holds neither null nor a non-finite component."""
    return F.coalesce(~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def lists(array: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the rows of each length in a list array without nulls."""
    size = array.value_lengths().to_numpy(zero_copy_only=False)
    flat, start = array.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, flat[start[at, None] + np.arange(n)]


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(columns, matrix) of up to size rows with vectors of one length; the vector is the last column, the others are numbers."""
    kept: dict[int, list] = {}
    for b in batches:
        for at, m in lists(b.column(b.num_columns - 1)):
            part = [c.to_numpy(zero_copy_only=False)[at] for c in b.columns[:-1]]
            have = kept.setdefault(m.shape[1], [])
            have.append((part, m))
            if sum(len(x) for _, x in have) >= size:
                yield _joined(kept.pop(m.shape[1]))
    for have in kept.values():
        yield _joined(have)


def _joined(have: list) -> tuple[list[np.ndarray], np.ndarray]:
    return [np.concatenate(c) for c in zip(*(p for p, _ in have))], np.concatenate([m for _, m in have])


KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _table(made: list[dict], schema: str) -> pa.Table:
    """Rows of numbers and arrays (as bytes) by the columns of schema."""
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({n: pa.array([x[n].tobytes() if isinstance(x[n], np.ndarray) else x[n] for x in made], KINDS[t]) for n, t in fields})


def packed(rows: DataFrame, fn: Callable[[list[np.ndarray], np.ndarray], dict], schema: str, groups: int = 1, size: int = BLOCK) -> DataFrame:
    """A row for each block of rows (the vector is the last column): fn's values by the columns of schema; blocks are dealt
    into groups by a hash of their ids (column g)."""

    def run(batches):
        for cols, m in blocks(batches, size):
            yield from _table([fn(cols, m)], schema).to_batches()

    return arrow_map(rows, run, schema).withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))


def query_blocks(rows: DataFrame, count: int, fn: Callable[[list[np.ndarray], np.ndarray], dict], schema: str, groups: int) -> DataFrame:
    """Blocks of about QUERY_BLOCK rows (count of them in all; the first two columns say which they are) like packed(),
    with a number in column block, one copy for each of the groups in column g."""
    n = max(1, -(-count // QUERY_BLOCK))
    schema = "block long, " + schema

    def run(table: pa.Table) -> pa.Table:
        first = table.column("__b")[0].as_py() << 20
        made = blocks(iter(table.drop_columns(["__b"]).combine_chunks().to_batches()), QUERY_BLOCK)
        return _table([{"block": first + k} | fn(cols, m) for k, (cols, m) in enumerate(made)], schema)

    keyed = rows.select(F.pmod(F.xxhash64(*map(column, rows.columns[:2])), F.lit(n)).alias("__b"), *map(column, rows.columns))
    return keyed.groupBy("__b").applyInArrow(run, schema).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))


def groups_for(blocks_made: int, parallelism: int, most: int = 64) -> int:
    """Groups that data blocks are dealt into: as many as there are cores to use, and most blocks in each at most."""
    return max(1, min(blocks_made, max(2 * parallelism, -(-blocks_made // most))))


def numbers(x: bytes, kind=np.float64, width: int | None = None) -> np.ndarray:
    a = np.frombuffer(x, kind)
    return a if width is None else a.reshape(-1, width) if width else a.reshape(0, 0)


class Best:
    """The k best (score, id) of each of n queries so far, smaller ids first among equals."""

    def __init__(self, n: int, k: int, kind=np.float64):
        self.k, self.least = k, -np.inf if kind is np.float64 else np.iinfo(np.int64).min
        self.score, self.id, self.n = np.full((n, k), self.least, kind), np.full((n, k), np.iinfo(np.int64).max), np.zeros(n, np.int64)

    def bound(self, q: int):
        """What a score must reach to come in (equal scores may, by their ids)."""
        return self.score[q, -1]

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        fit = score >= self.score[q, -1] if self.n[q] == self.k else slice(None)
        score, ids = np.concatenate([self.score[q, : self.n[q]], score[fit]]), np.concatenate([self.id[q, : self.n[q]], ids[fit]])
        if len(score) > 4 * self.k:  # only what can stay is sorted
            stay = score >= np.partition(score, -self.k)[-self.k]
            score, ids = score[stay], ids[stay]
        order = np.lexsort((ids, -score))[: self.k]
        self.n[q] = len(order)
        self.score[q, : len(order)], self.id[q, : len(order)] = score[order], ids[order]
