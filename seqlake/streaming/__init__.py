"""Streaming use of the stateless operators. The operators' source material is batch files only, so there is no stateful
operator here: contig lifting, scoring and filters run on a streaming DataFrame as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.operators import coords, tandem


def lift_stream(rows: DataFrame, contigs: DataFrame) -> DataFrame:
    """Lifts and scores a stream of tandem rows (ctg, beg, fin, unit, diffs) against a static contig table."""
    t = coords.lift(rows.withColumn("len", F.col("fin") - F.col("beg")), contigs, "beg", "fin")
    return t.withColumn("score", tandem.score(F.col("diffs"), F.col("len"))).drop("len")
