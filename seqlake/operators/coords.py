"""Contigs and scaffolds: coordinates, gaps, masks, totals. Intervals are 0-based and half-open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.operators.ordinal import dense_ordinal


def contig_table(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scaffold, contig) tables from lines (seq, ord, typ, len, name) of types S, G and C: S names a scaffold, G is a gap
    and C a contig on it. Adjacent to the ends a gap moves what follows; a trailing gap lengthens the scaffold."""
    w = Window.partitionBy("seq").orderBy("ord")
    run = F.coalesce(F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.where(F.col("typ").isin("G", "C")).withColumn("pos", run)
    contig = placed.where("typ = 'C'").select("seq", "ord", "len", "pos")
    size = lines.groupBy("seq").agg(F.max(F.when(F.col("typ") == "S", F.col("name"))).alias("name"), F.sum(F.when(F.col("typ") != "S", F.col("len")).otherwise(0)).alias("len"))
    return size, contig


def contig_positions(contigs: DataFrame, gap: int = 0) -> DataFrame:
    """Adds pos, the running offset of a contig on its scaffold, from (ctg, seq, len) and a gap behind each contig."""
    w = Window.partitionBy("seq").orderBy("ctg").rowsBetween(Window.unboundedPreceding, -1)
    return contigs.withColumn("pos", F.coalesce(F.sum(F.col("len") + gap).over(w), F.lit(0)))


def gaps(contigs: DataFrame, scaffolds: DataFrame | None = None) -> DataFrame:
    """(seq, ctg, gap): the gap before each contig where there is one; with scaffolds (seq, len) the trailing gap too
    (ctg null)."""
    w = Window.partitionBy("seq").orderBy("pos", "ctg")
    before = contigs.select("seq", "ctg", (F.col("pos") - F.coalesce(F.lag(F.col("pos") + F.col("len")).over(w), F.lit(0))).alias("gap"))
    if scaffolds is not None:
        ends = contigs.groupBy("seq").agg(F.max(F.col("pos") + F.col("len")).alias("end"))
        last = scaffolds.join(ends, "seq").select("seq", F.lit(None).cast("long").alias("ctg"), (F.col("len") - F.col("end")).alias("gap"))
        before = before.unionByName(last)
    return before.where("gap > 0")


def dimension(df: DataFrame, most: int = 128 << 20) -> DataFrame:
    """Marks a dimension table for broadcast if its rows, counted and measured, are within bounds; larger ones are
    joined by shuffle."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(sum(texts, F.lit(0))), F.lit(0))).first()
    return F.broadcast(df) if n * (32 + 16 * len(df.columns)) + size <= most else df


def lift(rows: DataFrame, contigs: DataFrame, *coords: str) -> DataFrame:
    """Adds seq and moves contig coordinates to the scaffold: a join on ctg. Unknown contigs have no row."""
    out = rows.join(dimension(contigs.select("ctg", "seq", "pos")), "ctg")
    return out.withColumns({c: F.col(c) + F.col("pos") for c in coords}).drop("pos")


def project_masks(bed: DataFrame, contigs: DataFrame) -> DataFrame:
    """Scaffold intervals (seq, start, end) cut to contigs: (ctg, start, end) in contig coordinates. An interval over a
    gap gives one piece on each side. Contigs of a scaffold are binned by BIN bases, so that an interval meets only
    contigs near it; a pair that shares several bins counts in the bin of its first common base."""
    size = 1 << 20
    spread = lambda df, a, b: df.withColumn("bin", F.explode(F.sequence(F.floor(F.col(a) / size), F.floor((F.greatest(F.col(b) - 1, F.col(a))) / size))))
    c = spread(contigs.select("ctg", "seq", "pos", (F.col("pos") + F.col("len")).alias("stop")), "pos", "stop")
    m = spread(bed.select("seq", F.col("start").alias("lo"), F.col("end").alias("hi")), "lo", "hi")
    both = m.join(c, ["seq", "bin"]).where("lo < stop and hi > pos").where(F.col("bin") == F.floor(F.greatest("lo", "pos") / size))
    return both.select("ctg", (F.greatest("lo", "pos") - F.col("pos")).alias("start"), (F.least("hi", "stop") - F.col("pos")).alias("end"))


def masks_as_written(bed: DataFrame) -> DataFrame:
    """The compatible form: scaffold number and coordinates stand as they are for contig number and coordinates."""
    return bed.select(F.col("seq").alias("ctg"), "start", "end")


def bed_violations(bed: DataFrame, scaffolds: DataFrame) -> DataFrame:
    """BED rows whose name is unknown or whose interval isn't within 0 <= start <= end <= len."""
    j = bed.join(dimension(scaffolds.select("name", "len")), "name", "left")
    ok = F.col("len").isNotNull() & (F.col("start") >= 0) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.col("len"))
    return j.where(~F.coalesce(ok, F.lit(False)))


def checked(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """df, failing when a row breaks the rule (strict mode)."""
    return df.where(F.coalesce(F.assert_true(ok, message).isNull(), F.lit(True)))


def gdb_totals(contigs: DataFrame, trailing: int = 0) -> DataFrame:
    """n_seq, n_ctg, n_gap, tot_ctg, tot_seq: summary of a scaffold and contig system."""
    per = contigs.groupBy("seq").agg(F.count("*").alias("n"), F.sum("len").alias("bases"), F.max(F.col("pos") + F.col("len")).alias("end"))
    base = per.agg(F.count("*").alias("n_seq"), F.sum("n").alias("n_ctg"), F.sum("bases").alias("tot_ctg"), F.sum(F.col("end") + trailing).alias("tot_seq"))
    return base.crossJoin(gaps(contigs).agg(F.count("*").alias("n_gap")))


def name_and_length_mismatches(sequences: DataFrame, scaffolds: DataFrame) -> DataFrame:
    """Sequences whose name the scaffolds lack or whose length differs."""
    j = sequences.join(scaffolds.withColumnRenamed("len", "scaffold_len"), "name", "left")
    return j.where(~F.coalesce(F.col("len") == F.col("scaffold_len"), F.lit(False)))


def name_dictionary(rows: DataFrame, name: str, order: str) -> DataFrame:
    """(name, id): names numbered from 0 in the order in which they first occur (by an integer column), densely."""
    first = rows.groupBy(name).agg(F.min(order).alias("__first"))
    return dense_ordinal(first, F.floor(F.col("__first") / (1 << 14)), ["__first", name], "id", 0).select(F.col(name).alias("name"), F.col("id").cast("long").alias("id"))
