"""Exact duplicates: static binary-fuse filters per immutable snapshot screen the digests of a new batch.

The filter (Graf and Lemire, "Binary Fuse Filters", 2022) never misses a digest of its snapshot and errs on about one
new digest in 256. Digests that pass the screen join the snapshot's exact buckets; those that do not are new and are
grouped among themselves. Rows of every bucket with more than one row are then compared with the bucket's first row
byte by byte, and rows that differ in spite of equal digests are regrouped by their bytes. A snapshot can be kept in a
folder (write_snapshot) and met by later batches (add_batch).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.llm.common import ROW, Scratch, column, join_rows, numbered, spare, without
from seqlake.llm.fuse import FuseFilter

#: Digests in a filter shard at most, about; and shards at least, so that small inputs are spread too.
SHARD_DIGESTS, LEAST_SHARDS = 250_000, 256


def normalised(text: Column) -> Column:
    """Each run of \\x20 and \\x09-\\x0D becomes one space; null counts as empty. (Single spaces need no change.)"""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\x20*[\x09-\x0D][\x20\x09-\x0D]*|\x20{2,}", " ")


def filters_of(keys: DataFrame, shards: int) -> DataFrame:
    """One row per shard of the keys (column key, long): the static filter."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = FuseFilter.build(pdf["key"].to_numpy(np.int64))
        return pd.DataFrame({"shard": [pdf["shard"].iat[0]], "seed": [np.uint64(f.seed).astype(np.int64)], "segment": [f.segment], "segments": [f.segments], "cells": [f.cells.tobytes()]})

    return keys.select(_shard(F.col("key"), shards).alias("shard"), "key").groupBy("shard").applyInPandas(build, "shard int, seed long, segment int, segments int, cells binary")


def membership(known):
    """A pandas function on 64-bit keys: known.has() of each."""

    @F.pandas_udf("boolean")
    def hit(key: pd.Series) -> pd.Series:
        return pd.Series(known.has(key.to_numpy(np.int64)))

    return hit


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(key, F.lit(shards)).cast("int")


class Snapshot:
    """An immutable set of digests in a folder of the shared store: exact buckets (digest, keep, n) and, by shard, their
    filters. It outlives the job that writes it; add_batch() meets it with new rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self.buckets = spark.read.schema("digest binary, keep long, n long").parquet(f"{path}/buckets")
        self.filters = spark.read.schema("shard int, seed long, segment int, segments int, cells binary, shards int").parquet(f"{path}/filters")

    @classmethod
    def write(cls, buckets: DataFrame, path: str, more: int = 0) -> Snapshot:
        """buckets: see by_digest(). more: distinct digests of a batch that will meet it at once; shards are cut so
        that neither side's share of one is large."""
        spark = buckets.sparkSession
        buckets.write.option("compression", "zstd").parquet(f"{path}/buckets")
        kept = spark.read.schema("digest binary, keep long, n long").parquet(f"{path}/buckets")
        shards = max(LEAST_SHARDS, math.ceil(max(kept.count(), more) / SHARD_DIGESTS))
        filters_of(kept.select(F.xxhash64("digest").alias("key")), shards).withColumn("shards", F.lit(shards)).write.parquet(f"{path}/filters")
        return cls(spark, path)

    def screen(self, batch: DataFrame) -> DataFrame:
        """batch (digest, keep, n) with hit: false means that the snapshot certainly lacks the digest."""
        first = self.filters.select("shards").first()
        if first is None:
            return batch.withColumn("hit", F.lit(False))

        def probe(news: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            hit = np.zeros(len(news), bool)
            for r in own.itertuples():
                hit |= FuseFilter.load(r.seed, r.segment, r.segments, r.cells).has(news["key"].to_numpy(np.int64))
            return news[["digest", "keep", "n"]].assign(hit=hit)

        key = F.xxhash64("digest")
        sharded = batch.withColumns({"key": key, "shard": _shard(key, first.shards)})
        return sharded.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(probe, "digest binary, keep long, n long, hit boolean")


def by_digest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.min("doc_id").alias("keep"), F.count("*").alias("n"))


def _read(docs: DataFrame, id_col: str, text_col: str, row: str) -> DataFrame:
    """(doc_id, row, norm) of numbered docs."""
    return docs.select(column(id_col).cast("long").alias("doc_id"), F.col(row).alias("row"), normalised(column(text_col).cast("string")).alias("norm"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", snapshot_share: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    The snapshot is the rows with the lower snapshot_share of the ids (so its rows stay before the new batch's), the
    new batch is the rest; the result does not depend on the share. Texts are equal when identical after each run of
    white space became one space; null is empty, and empty texts are equal. Of equal texts exactly one row stays: that
    with the smallest id (a null id stays only if its group has no other), of rows that share that id the first in the
    table. Rows of one id with different texts are different rows. An empty table gives no rows. Other columns are not
    read.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    row = spare(docs, "row")
    return _groups(numbered(docs, scratch, row), id_col, text_col, row, snapshot_share, scratch).drop("row")


def _groups(docs: DataFrame, id_col: str, text_col: str, row: str, snapshot_share: float, scratch: Scratch) -> DataFrame:
    """exact_groups() of numbered docs, with the row key (null where the text occurs once)."""
    texts = _read(docs, id_col, text_col, row)
    rows = scratch.table(texts.select("doc_id", "row", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest")), "rows")
    cut = rows.agg(F.percentile_approx("doc_id", snapshot_share)).first()[0]
    old = F.lit(False) if cut is None else F.coalesce(F.col("doc_id") <= F.lit(cut), F.lit(False))
    batch = scratch.table(by_digest(rows.where(~old)), "batch")
    snapshot = Snapshot.write(by_digest(rows.where(old)), scratch.path("snapshot"), batch.count())
    screened = scratch.table(snapshot.screen(batch), "screened")
    bucket = snapshot.buckets.withColumnsRenamed({"keep": "keep0", "n": "n0"}).join(screened.where("hit").drop("hit"), "digest", "full_outer")
    bucket = bucket.select("digest", F.coalesce("keep0", "keep").alias("keep"), (F.coalesce("n0", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n"))
    groups = scratch.table(bucket.unionByName(screened.where("not hit").drop("hit")), "groups")
    scratch.drop(batch, screened)

    # byte checks: the rows of shared buckets, and no others, are read again and compared with the bucket's first row
    met = scratch.table(rows.join(groups.where("n > 1"), "digest"), "met")
    first = met.where(F.col("doc_id").eqNullSafe(F.col("keep"))).groupBy("digest").agg(F.min("row").alias("row0"))
    shared = scratch.table(join_rows(texts.drop("doc_id"), met, "row", scratch).join(first, "digest"), "shared")
    norm0 = shared.where("row = row0").select("digest", F.col("norm").alias("norm0"))
    same = F.col("norm") == F.col("norm0")
    checked = shared.join(norm0, "digest").select("doc_id", "row", "digest", "keep", "n", same.alias("same"), (F.col("row") == F.col("row0")).alias("kept"), F.when(~same, F.col("norm")).alias("norm"))
    checked = scratch.table(checked, "checked")
    scratch.drop(met, shared, rows)
    out = ("doc_id", "row", "digest", "keep", "n", "kept")
    result = groups.where("n = 1").select(F.col("keep").alias("doc_id"), F.lit(None).cast(ROW).alias("row"), "digest", "keep", "n", F.lit(True).alias("kept"))
    unlike = checked.where("not same")  # equal digests of different bytes
    if unlike.limit(1).count():
        order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
        apart = unlike.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep"), F.count("*").alias("n"), F.min(order).alias("first"))
        fewer = unlike.groupBy("digest").agg(F.count("*").alias("less"))
        result = result.unionByName(checked.where("same").join(fewer, "digest", "left").withColumn("n", F.col("n") - F.coalesce("less", F.lit(0))).select(*out))
        result = result.unionByName(unlike.drop("keep", "n", "kept").join(apart, ["digest", "norm"]).withColumn("kept", F.col("first.row") == F.col("row")).select(*out))
    else:
        result = result.unionByName(checked.select(*out))
    return result.select("doc_id", F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"), "row")


def write_snapshot(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> Snapshot:
    """Writes the snapshot of a table of documents into a new folder; it is never changed afterwards."""
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(column(text_col).cast("string")).cast("binary"), 256)).alias("digest"))
    return Snapshot.write(by_digest(rows), path)


def add_batch(batch: DataFrame, snapshot: Snapshot, originals: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of a new batch: doc_id, keep_id, known, kept. known: a row of the snapshot has the same bytes
    (keep_id is its id; it stays, whatever the ids of the batch); other rows are grouped among themselves as by
    exact_groups(). originals: the documents that the snapshot was written of, for the byte checks."""
    scratch, row = Scratch(batch.sparkSession, "batch"), spare(batch, "row")
    news = numbered(batch, scratch, row)
    texts = _read(news, id_col, text_col, row)
    rows = scratch.table(texts.select("row", "doc_id", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest")), "rows")
    hits = snapshot.screen(by_digest(rows)).where("hit").select("digest").join(snapshot.buckets.select("digest", F.col("keep").alias("keep0")), "digest")
    hits = scratch.table(hits, "hits")
    old = originals.select(column(id_col).cast("long").alias("old_id"), normalised(column(text_col).cast("string")).alias("norm0"))
    old = join_rows(old.withColumn("digest", F.unhex(F.sha2(F.col("norm0").cast("binary"), 256))), hits, "digest", scratch)
    firsts = old.where(F.col("old_id").eqNullSafe(F.col("keep0"))).groupBy("digest").agg(F.min("norm0").alias("norm0"))
    met = scratch.table(rows.join(hits, "digest"), "met")
    known = join_rows(texts.drop("doc_id"), met, "row", scratch).join(firsts, "digest").where("norm = norm0").select("row", "doc_id", F.col("keep0").alias("keep_id"))
    known = scratch.table(known, "known")
    left = join_rows(news, known.select(F.col("row").alias(row)), row, scratch, "left_anti")
    rest = _groups(left, id_col, text_col, row, 0.0, scratch).select("doc_id", "keep_id", F.lit(False).alias("known"), "kept")
    return known.select("doc_id", "keep_id", F.lit(True).alias("known"), F.lit(False).alias("kept")).unionByName(rest)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that an equal text stands for: of each group the one row that exact_groups() keeps stays.
    Rows go by their place in the table, so rows that share an id but not a text all stay, and of fully equal rows (null
    ids too) one does."""
    scratch, row = Scratch(docs.sparkSession, "copies"), spare(docs, "row")
    rows = numbered(docs, scratch, row)
    gone = _groups(rows, id_col, text_col, row, 0.5, scratch).where("not kept").select(F.col("row").alias(row))
    return without(rows, gone, row, scratch)
