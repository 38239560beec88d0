"""Dense numbers and running sums over a whole table without one task for all rows.

Rows are put into buckets that follow the order; only the buckets' counts or sums, one small row each, meet in a single
window. Object ordinals (a running count of object lines), parent and child lines, and positions by ordinal build on it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(per_bucket: DataFrame) -> DataFrame:
    w = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    return per_bucket.select("__b", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))


def dense_ordinal(df: DataFrame, bucket: Column, order: Sequence[str], name: str, start: int = 1, dealt: Sequence[str] = ()) -> DataFrame:
    """Adds name: start, start + 1, ... in the order given; bucket has to grow with the first columns of the order. dealt:
    columns by which rows are dealt already and which are the same in all of a bucket; rows then stay in their tasks."""
    df = df.withColumn("__b", bucket)
    if dealt:
        counts = df.groupBy(*dealt, "__b").agg(F.count("*").alias("__n"))
        placed = df.withColumn("__i", F.row_number().over(Window.partitionBy(*dealt, "__b").orderBy(*order)))
        return placed.join(F.broadcast(_before(counts)), "__b").withColumn(name, F.col("__before") + F.col("__i") + (start - 1)).drop("__b", "__i", "__before")  # a row a bucket
    inside = F.row_number().over(Window.partitionBy("__b").orderBy(*order))
    return df.withColumn("__i", inside).join(_before(df.groupBy("__b").agg(F.count("*").alias("__n"))), "__b").withColumn(name, F.col("__before") + F.col("__i") + (start - 1)).drop("__b", "__i", "__before")


def running_sum(df: DataFrame, value: Column, order: str, name: str, bucket_rows: int = 1 << 14) -> DataFrame:
    """Adds name: the sum of value up to and with each row, in the order of a dense integer column."""
    df = df.withColumn("__b", F.floor(F.col(order) / bucket_rows)).withColumn("__v", value)
    inside = F.sum("__v").over(Window.partitionBy("__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__i", inside).join(_before(df.groupBy("__b").agg(F.sum("__v").alias("__n"))), "__b").withColumn(name, F.col("__before") + F.col("__i")).drop("__b", "__i", "__v", "__before")


def sum_before(df: DataFrame, keys: Sequence[str], bucket: str, order: str, value: str, name: str) -> DataFrame:
    """Adds name: the sum of value over the rows of the same keys that come before by order; bucket (a column) has to grow
    with order. Buckets are summed inside; their sums, one small row each, meet in one window a key."""
    inside = F.sum(value).over(Window.partitionBy(*keys, bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("__n"))
    before = sums.withColumn("__before", F.sum("__n").over(Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))).drop("__n")
    joined = df.withColumn("__i", inside).join(before, [*keys, bucket])
    return joined.withColumn(name, F.coalesce("__i", F.lit(0)) + F.coalesce("__before", F.lit(0))).drop("__i", "__before")


def last_before(positions: DataFrame, at: str, starts: DataFrame, start: str, name: str, keys: Sequence[str] = (), width: int = 1 << 16, salts: int = 4) -> DataFrame:
    """Adds name: the greatest start at or before each position (of the same keys, if any); null before the first. The
    starts are another table, without a shared key.

    Both are put into buckets of width. Inside a bucket the last start is carried along the order; a position before its
    bucket's first start takes the last one of the nearest bucket before that has any, found among one row a bucket. A
    bucket's positions are dealt over salts, so that one with very many is not one task's.
    """
    own, every = [F.col(k) for k in positions.columns], F.sequence(F.lit(0), F.lit(salts - 1))
    salt = F.pmod(F.xxhash64(*own), F.lit(salts)).cast("int")
    row = positions.select(*keys, F.col(at).cast("long").alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast("long").alias("__start"), F.struct(*own).alias("__row"), salt.alias("__salt"))
    kind = positions.select(F.struct(*own).alias("s")).schema["s"].dataType
    known = starts.where(F.col(start).isNotNull()).select(*keys, F.col(start).cast("long").alias("__at")).distinct()
    begin = known.select(*keys, "__at", F.lit(0).alias("__side"), F.col("__at").alias("__start"), F.lit(None).cast(kind).alias("__row"), F.explode(every).alias("__salt"))
    both = row.unionByName(begin).withColumn("__b", F.floor(F.col("__at") / width))
    order = Window.partitionBy(*keys, "__b", "__salt").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("__last", F.last("__start", True).over(order)).where("__side = 1")
    buckets = positions.select(*keys, F.floor(F.col(at) / width).alias("__b"), F.lit(None).cast("long").alias("__start")).distinct().unionByName(known.select(*keys, F.floor(F.col("__at") / width).alias("__b"), F.col("__at").alias("__start")))
    per = buckets.groupBy(*keys, "__b").agg(F.max("__start").alias("__start"))
    carried = per.withColumn("__carried", F.last("__start", True).over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).drop("__start")
    return inside.join(carried, [*keys, "__b"], "left").select("__row.*", F.coalesce("__last", "__carried").alias(name))


def object_ordinal(lines: DataFrame, object_type: str, type_col: str = "typ", order: str = "line_no", name: str = "obj") -> DataFrame:
    """Adds the number of object lines up to each line: 0 before the first object, then 1, 2, ..."""
    return running_sum(lines, F.when(F.col(type_col) == object_type, 1).otherwise(0), order, name)


def children(lines: DataFrame, object_type: str, child_types: Sequence[str], type_col: str = "typ", order: str = "line_no", value: str = "val") -> DataFrame:
    """One row per object with its own value and that of its last child line of each type (null where it has none)."""
    n = object_ordinal(lines, object_type, type_col, order).where("obj > 0")
    last = [F.max_by(F.when(F.col(type_col) == t, F.col(value)), F.when(F.col(type_col) == t, F.col(order))).alias(t) for t in child_types]
    return n.groupBy("obj").agg(F.max(F.when(F.col(type_col) == object_type, F.col(value))).alias("own"), *last)


def ordinal_ranges(lines: DataFrame, ranges: Sequence[tuple[int, int]], obj: str = "obj") -> DataFrame:
    """Lines of objects in any of the half-open ranges; ordinal 0 is what stands before the first object."""
    keep = F.lit(False)
    for lo, hi in ranges:
        keep = keep | ((F.col(obj) >= lo) & (F.col(obj) < hi))
    return lines.where(keep)


def line_stats(lines: DataFrame, type_col: str = "typ", size: str = "val") -> DataFrame:
    """count, max and total of list lengths by line type."""
    return lines.groupBy(F.col(type_col).alias("type")).agg(F.count("*").alias("count"), F.max(size).alias("max"), F.sum(size).alias("total"))


def nested_stats(lines: DataFrame, object_type: str, type_col: str = "typ", size: str = "val", order: str = "line_no") -> DataFrame:
    """The most lines, and the most list elements, of each type inside one object."""
    inside = object_ordinal(lines, object_type, type_col, order).where(F.col("obj") > 0)
    per = inside.groupBy("obj", F.col(type_col).alias("type")).agg(F.count("*").alias("n"), F.sum(size).alias("t"))
    return per.groupBy("type").agg(F.max("n").alias("max_count"), F.max("t").alias("max_total"))


def count_until_next(lines: DataFrame, group_type: str, member_type: str, type_col: str = "typ", order: str = "line_no") -> DataFrame:
    """Member lines of each group object, up to the next group object."""
    g = object_ordinal(lines, group_type, type_col, order, "grp").where("grp > 0")
    return g.groupBy("grp").agg(F.sum(F.when(F.col(type_col) == member_type, 1).otherwise(0)).alias("n"))


def contained_lines(lines: DataFrame, letters: set[str], type_col: str = "typ") -> DataFrame:
    """Lines of the types that an object type contains (Schema.contained())."""
    return lines.where(F.col(type_col).isin(*sorted(letters))).select("line_no", type_col)


def concatenate(shards: Sequence[DataFrame], bucket: Column, order: Sequence[str], name: str) -> DataFrame:
    """Shards one behind the other, each in the order given: adds shard (its number) and name (1, 2, ... through all)."""
    numbered = [s.withColumn("shard", F.lit(k)) for k, s in enumerate(shards)]
    whole = numbered[0]
    for s in numbered[1:]:
        whole = whole.unionByName(s)
    return dense_ordinal(whole, F.struct("shard", bucket.alias("b")), ["shard", *order], name)


def edit_set(have: DataFrame, more: DataFrame, less: DataFrame, key: str) -> DataFrame:
    """The keys of have and more, each once, without those of less."""
    return have.select(key).unionByName(more.select(key)).distinct().join(less.select(key).distinct(), key, "left_anti")
