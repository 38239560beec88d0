"""Tandem repeats: scores, BED, greedy compression, exact copies and consensus."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.operators import coords
from seqlake.operators.scratch import Scratch


def score(diffs: Column, length: Column) -> Column:
    """Identity in thousandths, cut towards zero; 0 without a differences line."""
    return F.coalesce((F.lit(1000) * (F.lit(1.0) - diffs / length)).cast("int"), F.lit(0))


def to_bed(rows: DataFrame) -> DataFrame:
    """(name, start, end, unit, score) lines as one tab-separated column, for a text sink."""
    return rows.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in ("name", "start", "end", "unit", "score"))).alias("value"))


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("total"))


#: Bases of a bucket of greedy(), at whose borders the scan can be cut; rows between two cuts that one task reads.
BUCKET, DENSE = 1 << 16, 4_000_000


def greedy(rows: DataFrame, width: int = BUCKET, dense: int = DENSE) -> DataFrame:
    """Rows (seq, start, end, unit) accepted by one scan of each sequence in order: a row is accepted if it starts at or
    behind the end of the last accepted one.

    A row that starts at or behind the end of all before it is accepted whatever came first. So the scan is cut between
    buckets of positions over which nothing reaches; what lies between two cuts is sorted by Spark and read as a stream
    by one task, which holds one batch. Cuts are found on a table of one row a bucket. Where more than dense rows lie between
    two cuts, greedy_dense() cuts at every bucket.
    """
    order = ("start", "end", "unit")
    placed = rows.select("seq", *order).withColumn("bucket", F.floor(F.col("start") / width))
    per = placed.groupBy("seq", "bucket").agg(F.min("start").alias("lo"), F.max("end").alias("hi"), F.count("*").alias("n"))
    w = Window.partitionBy("seq").orderBy("bucket")
    clean = F.coalesce(F.col("lo") >= F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")
    cuts = per.withColumn("clean", clean).select("seq", "bucket", "n", F.sum("clean").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("segment"))
    cuts = Scratch(rows.sparkSession, "greedy").table(cuts, "cuts")
    if (cuts.groupBy("seq", "segment").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0) > dense:
        return greedy_dense(rows, width)
    dealt = placed.join(cuts.drop("n"), ["seq", "bucket"]).select("seq", *order, "segment").repartition("seq", "segment").sortWithinPartitions("seq", "segment", *order)

    def scan(batches):
        now, last = None, 0
        for b in batches:
            seqs, starts, ends, segments = (b.column(c).to_pylist() for c in ("seq", "start", "end", "segment"))
            keep = []
            for seq, start, end, segment in zip(seqs, starts, ends, segments):
                if (seq, segment) != now:
                    now, last = (seq, segment), start
                keep.append(start >= last)
                if start >= last:
                    last = end
            yield b.select(["seq", *order]).filter(pa.array(keep, pa.bool_()))

    return dealt.mapInArrow(scan, placed.select("seq", *order).schema)


def greedy_dense(rows: DataFrame, width: int = BUCKET) -> DataFrame:
    """greedy() with a cut at every bucket, for rows that overlap all along.

    Whatever a bucket is entered with, it is left with the end of the last row accepted in it. So each bucket, by itself, says
    for every start in it where the scan leaves that begins there (worked out backwards; neighbours that leave alike are one
    row, and scans soon run into each other, so these are few). The sequence's chain of entries is read off those rows, then
    every bucket is scanned from its entry. Of rows that start alike only the first can be accepted, but for empty ones,
    so a bucket holds no more than width rows and those that are empty.
    """
    order, kind = ("start", "end", "unit"), rows.select("seq").schema["seq"].dataType.simpleString()
    long = rows.select("seq", *order).where("end > start").groupBy("seq", "start").agg(F.min(F.struct("end", "unit")).alias("r")).select("seq", "start", "r.*")
    placed = long.unionByName(rows.select("seq", *order).where("end <= start")).withColumn("bucket", F.floor(F.col("start") / width))
    placed = Scratch(rows.sparkSession, "greedy").table(placed, "rows")
    dealt = lambda x: x.repartition("seq", "bucket").sortWithinPartitions("seq", "bucket", *order)

    def whole_buckets(batches):
        """(seq, bucket, columns) with all rows of a bucket, from batches in order."""
        kept, name = [], None
        for b in batches:
            seqs, buckets = b.column("seq").to_pylist(), b.column("bucket").to_pylist()
            at = 0
            for k in range(1, len(seqs) + 1):
                if k == len(seqs) or (seqs[k], buckets[k]) != (seqs[at], buckets[at]):
                    if name is not None and name != (seqs[at], buckets[at]):
                        yield *name, pa.Table.from_batches(kept)
                        kept = []
                    name = (seqs[at], buckets[at])
                    kept.append(b.slice(at, k - at))
                    at = k
        if name is not None:
            yield *name, pa.Table.from_batches(kept)

    def leave(batches):
        for seq, bucket, t in whole_buckets(batches):
            start, end = (t.column(c).to_numpy() for c in ("start", "end"))
            n = len(start)
            follow = np.maximum(np.searchsorted(start, end), np.arange(1, n + 1)).tolist()
            out = end.tolist()
            for k in range(n - 1, -1, -1):
                if follow[k] < n:
                    out[k] = out[follow[k]]
            first = np.flatnonzero(np.concatenate([[True], start[1:] != start[:-1]]))  # of the rows that start alike
            left = np.array(out)[first]
            runs = np.flatnonzero(np.concatenate([left[1:] != left[:-1], [True]]))  # up to this start one leaves so
            yield pa.RecordBatch.from_arrays([pa.array([seq] * len(runs), t.schema.field("seq").type), pa.array([bucket] * len(runs), pa.int64()), pa.array(start[first][runs].astype(np.int64)), pa.array(left[runs].astype(np.int64))], names=["seq", "bucket", "upto", "left"])

    def chain(batches):
        """The end with which each bucket is entered: the first run of a bucket that reaches it says how it is left."""
        seq = bucket = None
        entry, now = None, None
        for b in batches:
            out = []
            for s, k, upto, left in zip(*(c.to_pylist() for c in b.columns)):
                if s != seq:
                    entry = now = None
                if (s, k) != (seq, bucket):
                    entry = now
                    seq, bucket, done = s, k, False
                    out.append((s, k, entry))
                if not done and (entry is None or upto >= entry):
                    now, done = left, True
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], b.schema.field("seq").type), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], names=["seq", "bucket", "entry"])

    runs = dealt(placed).mapInArrow(leave, f"seq {kind}, bucket long, upto long, left long")
    entries = runs.repartition("seq").sortWithinPartitions("seq", "bucket", "upto").mapInArrow(chain, f"seq {kind}, bucket long, entry long")

    def scan(batches):
        name, last = None, None
        for b in batches:
            keep = []
            for s, k, start, end, entry in zip(*(b.column(c).to_pylist() for c in ("seq", "bucket", "start", "end", "entry"))):
                if (s, k) != name:
                    name, last = (s, k), entry
                keep.append(last is None or start >= last)
                if keep[-1]:
                    last = end
            yield b.select(["seq", *order]).filter(pa.array(keep, pa.bool_()))

    return dealt(placed.join(entries, ["seq", "bucket"])).mapInArrow(scan, rows.select("seq", *order).schema)


def splice(sequences: DataFrame, accepted: DataFrame) -> DataFrame:
    """(seq, dna): each accepted repeat is replaced by its first unit; sequences without one keep all bases. A unit of
    0 removes the array, a unit longer than it repeats the bases behind it, as the rule says literally.

    Each sequence is cut once, from left to right, in Arrow batches: Spark's substring() walks a string from its
    beginning at every cut, which takes the square of a chromosome's length.
    """
    per = accepted.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct(*(F.col(c).cast("long").alias(c) for c in ("start", "end", "unit"))))).alias("rows"))
    j = sequences.select("seq", "dna").join(per, "seq", "left")

    @F.pandas_udf("string")
    def cut(dna: pd.Series, rows: pd.Series) -> pd.Series:
        out = []
        for text, row in zip(dna, rows):
            if row is None or text is None:
                out.append(text)
                continue
            parts, at = [], 0
            for r in row:
                parts += (text[at : max(at, r["start"])], text[r["start"] : r["start"] + max(0, r["unit"])])
                at = r["end"]
            out.append("".join([*parts, text[at:]]))
        return pd.Series(out)

    return j.select("seq", F.when(F.col("rows").isNull(), F.col("dna")).otherwise(cut("dna", "rows")).alias("dna"))


def splice_pieces(parts: DataFrame, accepted: DataFrame, size: int, strip: int, width: int = BUCKET) -> DataFrame:
    """splice() for sequences of any length: (ctg, start, txt), pieces of the spliced sequences with their places in them,
    from a chunk table (sv.chunks) and accepted repeats (seq, start, end, unit); sv.chunks() makes a chunk table of them.

    What is kept lies between the end of one repeat and the first unit of the next; prefix sums of the kept lengths give
    each its place. No value is longer than a chunk. Empty repeats (end at start) change nothing.
    """
    from seqlake.operators import sv
    from seqlake.operators.ordinal import last_before, sum_before

    size_of = sv.lengths(parts, size)
    rows = accepted.where("end > start").select(F.col("seq").cast("long").alias("ctg"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("unit").cast("long").alias("unit"))
    before = last_before(rows, "start", rows, "end", "prev", ["ctg"], width).join(coords.dimension(size_of), "ctg")
    kept = before.select("ctg", F.coalesce("prev", F.lit(0)).alias("lo"), F.least(F.col("start") + F.greatest("unit", F.lit(0)), "len").alias("hi"))
    tail = coords.dimension(size_of).join(rows.groupBy("ctg").agg(F.max("end").alias("lo")), "ctg", "left").select("ctg", F.coalesce("lo", F.lit(0)).alias("lo"), F.col("len").alias("hi"))
    kept = kept.unionByName(tail).where("hi > lo").withColumns({"n": F.col("hi") - F.col("lo"), "b": F.floor(F.col("lo") / width)})
    placed = sum_before(kept, ["ctg"], "b", "lo", "n", "to").withColumn("chunk", F.explode(F.sequence(F.expr(f"lo div {size}"), F.expr(f"(hi - 1) div {size}"))))
    a, b = F.greatest("lo", F.col("chunk") * size), F.least("hi", (F.col("chunk") + 1) * size)
    met = placed.join(parts.hint("merge"), ["ctg", "chunk"])
    return met.select("ctg", (F.col("to") + a - F.col("lo")).alias("start"), sv.strip_cut(a % size, b - a, strip).alias("txt"))


def exact_copies(steps: DataFrame, unit: int, least: int = 20) -> DataFrame:
    """(arr, p): starts of copies exactly one unit long, from positions (arr, p); nothing for units below least."""
    nxt = F.lead("p").over(Window.partitionBy("arr").orderBy("p"))
    return steps.withColumn("d", nxt - F.col("p")).where((F.col("d") == unit) & F.lit(unit >= least)).select("arr", "p")


def starts_of(partition: Column, unit: Column) -> Column:
    """The same for a partition held as an array: the starts followed by exactly one unit."""
    return F.filter(F.transform(F.slice(partition, F.lit(1), F.greatest(F.size(partition) - 1, F.lit(0))), lambda p, i: F.when((F.get(partition, i + 1) - p == unit) & (unit >= 20), p)), lambda p: p.isNotNull())


def best_array(copies: DataFrame) -> DataFrame:
    """The array with most exact copies; the first of equals."""
    return copies.groupBy("arr").agg(F.count("*").alias("n")).agg(F.max_by(F.struct("arr", "n"), F.struct("n", -F.col("arr"))).alias("b")).where("b is not null").select("b.arr", "b.n")


def votes(copies: DataFrame, unit: int) -> DataFrame:
    """(arr, k, base, n): how many copies (arr, copy) have each base at each offset."""
    per = copies.select("arr", F.explode(F.sequence(F.lit(1), F.lit(unit))).alias("k"), "copy").select("arr", "k", F.lower(F.substr("copy", F.col("k"), F.lit(1))).alias("base"))
    return per.groupBy("arr", "k", "base").agg(F.count("*").alias("n"))


def consensus(copies: DataFrame, unit: int) -> DataFrame:
    """(arr, consensus, matched, count, score): the most frequent of a, c, g, t at each offset, the first of equals, n
    where no copy has one; score in thousandths, integer division in 64 bits."""
    acgt = F.when(F.col("base").isin("a", "c", "g", "t"), F.col("n")).otherwise(0)
    top = votes(copies, unit).groupBy("arr", "k").agg(
        F.max_by(F.when(acgt > 0, F.col("base")).otherwise("n"), F.struct(acgt, F.translate("base", "acgt", "3210"))).alias("base"), F.max(acgt).alias("n"), F.sum("n").alias("copies")
    )
    all_ = top.groupBy("arr").agg(F.array_sort(F.collect_list(F.struct("k", "base"))).alias("c"), F.sum("n").alias("matched"), F.max("copies").alias("count"))
    text = F.array_join(F.transform("c", lambda x: x.base), "")
    return all_.select("arr", text.alias("consensus"), "matched", "count", F.expr(f"(1000 * matched) div ({unit} * count)").alias("score"))


def fasta_header(unit: Column, name: Column, start: Column, end: Column, count: Column, score: Column) -> Column:
    return F.format_string(">cons%d#%s:%d-%d#%d#%.1f", unit, name, start, end, count, score * 0.1)


def copies_out_of_bounds(copies: DataFrame, unit: int) -> DataFrame:
    """Copies (p, len) that leave their sequence; strict mode fails on them: coords.checked(copies, ~leaves, ...)."""
    return copies.where(F.col("p") + unit > F.col("len"))


def first_hit(rows: DataFrame, wanted: Column, *order: str) -> DataFrame:
    """The first row in order that is wanted; no more than one row of each task is gathered."""
    return rows.where(wanted).orderBy(*order).limit(1)
