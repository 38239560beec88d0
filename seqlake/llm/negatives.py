"""Hard negatives by a pivot table.

Vectors get one more component that makes all norms equal, so that the inner product with an anchor is a falling function
of Euclidean distance. Each block of vectors stores its distances to PIVOTS pivots. The triangle inequality over them
brackets the distance of a vector from an anchor, and so its score, from both sides: for positives, vectors whose upper bound
misses the anchor's k-th best are passed over; for negatives, those whose bracket misses the wanted range of every positive, or
whose upper bound misses the best that are found. Scores of the others are computed exactly, in integers. Pivots are
chosen farthest first from SAMPLE rows (those of the smallest ids); the choice changes speed only.

Rows with a null id, a null label, a null vector, or any null or non-finite component take no part. Vectors of different
lengths don't meet. Rows with the anchor's id are neither positives nor negatives of it. Equal anchor rows count once, rows with
one id and another vector or label each; repeated other rows are each a positive or negative. Anchors without a positive, and
positives without a negative, have no row. Scores of over 53 bits are computed in 64 bits, beyond in Python's integers; a score that
doesn't fit a long fails.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.llm.common import Scratch, arrow_map, column
from seqlake.llm.vectors import Best, finite, groups_for, lists, numbers, packed, query_blocks

PIVOTS, SAMPLE = 16, 1024
#: Scores that are computed first, those of the greatest upper bounds, to raise the bar for the others.
HEAD = 32
DATA = "dim int, ids binary, labels binary, vecs binary, away binary"
ANCHOR = "dim int, ids binary, keys binary, labels binary, scores binary, vecs binary"
GONE = np.iinfo(np.int64).min


def whole(m: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as int64 or, where that is too small, as Python's integers."""
    v = np.floor(m.astype(np.float64) * scale)
    return v.astype(np.int64) if not v.size or np.abs(v).max() < 1 << 62 else np.array([[int(x) for x in r] for r in v], object)


def products(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of x with a."""
    most = int(np.abs(x).max(initial=0)) * int(np.abs(a).max(initial=0)) * max(1, x.shape[1])
    kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object
    return (x.astype(kind) @ a.astype(kind)).astype(np.int64)


def widened(m: np.ndarray, square: float) -> np.ndarray:
    m = m.astype(np.float64)
    return np.column_stack([m, np.sqrt(np.maximum(0, square - (m * m).sum(1)))])


def spans(wide: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of each row to each pivot."""
    return np.stack([np.sqrt(((wide - p) ** 2).sum(1)) for p in pivots], 1) if len(pivots) else np.zeros((len(wide), 0))


def farthest_first(wide: np.ndarray, count: int) -> np.ndarray:
    """Up to count different rows, each as far from those before it as can be."""
    if not len(wide):
        return wide
    picked = [0]
    gap = ((wide - wide[0]) ** 2).sum(1)
    while len(picked) < count and gap.max() > 0:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, ((wide - wide[picked[-1]]) ** 2).sum(1))
    return wide[picked]


def brackets(square: float, norm2: float, own: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) inner product of an anchor with each vector that its distances to the pivots (own, and away by row)
    allow; square: the squared norm of all widened vectors, norm2: the anchor's. Rounding is allowed for."""
    gap = np.abs(away - own)
    near, far = (gap.max(1), (away + own).min(1)) if away.shape[1] else (np.zeros(len(away)), np.full(len(away), np.inf))
    slack = 1e-9 * (square + norm2) + 1e-6
    return (norm2 + square - far * far) / 2 - slack, (norm2 + square - near * near) / 2 + slack


class Miner:
    """Scores a block of anchors against blocks of vectors. ranges: for each anchor the (least, most) scores wanted of
    vectors of other labels, each with a list of its own; None: of the same label, any score, one list."""

    def __init__(self, ids, labels, vecs, pivots, square, keep, ranges=None):
        self.ids, self.labels, self.vecs, self.square, self.ranges = ids, labels, vecs, square, ranges
        self.norm2 = (vecs.astype(np.float64) ** 2).sum(1)
        self.own = spans(np.column_stack([vecs.astype(np.float64), np.zeros(len(vecs))]), pivots)
        self.best = [Best(len(ids), keep, np.int64) for _ in range(1 if ranges is None else max((len(r) for r in ranges), default=0))]
        self.checked = 0

    def block(self, ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray, away: np.ndarray) -> None:
        of = {v: np.flatnonzero(labels == v) for v in np.unique(labels).tolist()}
        for a in range(len(self.ids)):
            if self.ranges is None:
                at = of.get(int(self.labels[a]))
                wanted = [(None, None)] if at is not None else []
            else:
                at = np.flatnonzero(labels != self.labels[a])
                wanted = self.ranges[a]
            if not wanted or not len(at):
                continue
            at = at[ids[at] != self.ids[a]]
            least, most = brackets(self.square, self.norm2[a], self.own[a], away[at])
            known = np.full(len(at), GONE)  # exact scores so far
            for k, (low, high) in enumerate(wanted):
                best = self.best[k]
                fits = np.ones(len(at), bool) if low is None else (most >= low) & (least <= high)
                for head in (True, False):
                    bar = best.bound(a) if best.n[a] == best.k else -np.inf
                    left = np.flatnonzero(fits & (most >= bar))
                    if head and len(left) > HEAD:
                        left = left[np.argpartition(-most[left], HEAD)[:HEAD]]
                    ask = left[known[left] == GONE]
                    known[ask] = products(vecs[at[ask]], self.vecs[a])
                    self.checked += len(ask)
                    fits[left] = False
                    if low is not None:
                        left = left[(known[left] >= low) & (known[left] <= high)]
                    best.add(a, known[left], ids[at[left]])


def _search(met: DataFrame, keep: int, pivots: dict[int, np.ndarray], square: float, share: tuple[int, int] | None) -> DataFrame:
    """(anchor_id, key, place, score_of, hits): each anchor block against each of its group's vector blocks. share: the
    percentages of the positives' scores (given by place) between which negatives are wanted."""
    hit = pa.list_(pa.struct([("id", pa.int64()), ("score", pa.int64())]))

    def run(batches):
        states: dict[tuple, Miner] = {}

        def flush():
            for (_, _), (m, keys, scores) in states.items():
                for k, best in enumerate(m.best):
                    has = np.flatnonzero(best.n > 0)
                    hits = [[{"id": i, "score": s} for i, s in zip(best.id[a, : best.n[a]].tolist(), best.score[a, : best.n[a]].tolist())] for a in has]
                    of = scores[has, k] if share else np.zeros(len(has), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(m.ids[has]), pa.array(keys[has]), pa.array([k] * len(has), pa.int32()), pa.array(of, pa.int64()), pa.array(hits, hit)], names=["anchor_id", "key", "place", "score_of", "hits"])
            states.clear()

        for b in batches:
            for r in b.to_pylist():
                name = (r["block"], r["dim"])
                if name not in states:
                    if len(states) >= 4:
                        yield from flush()
                    ids = numbers(r["ids"], np.int64)
                    scores = numbers(r["scores"], np.int64).reshape(len(ids), -1)
                    ranges = None
                    if share:  # 100 * score within the two shares of the positive's score, in integers
                        ranges = [[(-(-share[0] * s // 100), share[1] * s // 100) for s in row if s != GONE] for row in scores.tolist()]
                    states[name] = Miner(ids, numbers(r["labels"], np.int64), numbers(r["a"], np.int64).reshape(len(ids), r["dim"]), pivots.get(r["dim"], np.zeros((1, r["dim"] + 1))), square, keep, ranges), numbers(r["keys"], np.int64), scores
                ids = numbers(r["vec_ids"], np.int64)
                states[name][0].block(ids, numbers(r["vec_labels"], np.int64), numbers(r["vecs"], np.int64).reshape(len(ids), r["dim"]), numbers(r["away"]).reshape(len(ids), -1))
        yield from flush()

    return arrow_map(met, run, "anchor_id long, key long, place int, score_of long, hits array<struct<id:bigint,score:bigint>>")


def _first(found: DataFrame, keep: int) -> DataFrame:
    """The keep best of each list, over all groups of blocks."""
    rows = found.select("anchor_id", "key", "place", "score_of", F.explode("hits").alias("h")).select("anchor_id", "key", "place", "score_of", "h.*")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "key", "place").orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= keep)


def mine(df: DataFrame, anchors: Column, id_col: str = "vec_id", vector: str = "embedding", label: Column | None = None, scale: int = 256, positives: int = 5, negatives: int = 3, share: tuple[int, int] = (50, 95)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows for which anchors holds. A vector's score is its inner product with the anchor after components
    have become floor(scale * x); higher comes first, of equals the smaller id. A negative has another label and a score
    of share[0] to share[1] hundredths of the positive's. label: the label to use (column label by default).
    """
    spark, v = df.sparkSession, column(vector)
    tag = column("label") if label is None else label
    rows = df.where(column(id_col).isNotNull() & tag.isNotNull() & finite(v))
    rows = rows.select(column(id_col).cast("long").alias("id"), tag.cast("long").alias("label"), F.xxhash64(tag, v).alias("key"), F.coalesce(anchors, F.lit(False)).alias("asks"), v.cast("array<double>").alias("v"))
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.floor(x * scale).cast("double") * F.floor(x * scale).cast("double"))
    size = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.max(norm2).alias("square")).first()
    if not size.q:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    scratch, square = Scratch(spark, "negatives"), size.square * (1 + 1e-12)
    sample = [r.v for r in rows.orderBy("id", "key").select("v").limit(SAMPLE).collect()]
    pivots = {m.shape[1]: farthest_first(widened(whole(m, scale), square), PIVOTS) for _, m in lists(pa.array(sample, pa.list_(pa.float64())))}
    groups = groups_for(-(-size.n // 1024), spark.sparkContext.defaultParallelism)

    def pack(cols, m):
        x = whole(m, scale)
        away = spans(widened(x, square), pivots.get(m.shape[1], np.zeros((1, m.shape[1] + 1))))
        return {"dim": m.shape[1], "ids": cols[0].astype(np.int64), "labels": cols[1].astype(np.int64), "vecs": x.astype(np.int64), "away": away}

    def anchor_block(cols, m):
        ids, keys, labels, *scores = cols
        score = np.stack(scores, 1).astype(np.int64) if scores else np.zeros((len(ids), 0), np.int64)
        return {"dim": m.shape[1], "ids": ids.astype(np.int64), "keys": keys.astype(np.int64), "labels": labels.astype(np.int64), "scores": score, "vecs": whole(m, scale).astype(np.int64)}

    data = scratch.table(packed(rows.select("id", "label", "v"), pack, DATA, groups), "vectors").withColumnsRenamed({"ids": "vec_ids", "labels": "vec_labels"})
    asked = rows.where("asks").dropDuplicates(["id", "key"]).select("id", "key", "label", "v")
    meet = lambda blocks: blocks.withColumnRenamed("vecs", "a").join(data.hint("merge"), ["g", "dim"])
    good = scratch.table(_first(_search(meet(query_blocks(asked, size.q, anchor_block, ANCHOR, groups)), positives, pivots, square, None), positives), "positives")
    at = lambda k: F.coalesce(F.max(F.when(F.col("rank") == k + 1, F.col("score"))), F.lit(GONE)).alias(f"s{k}")
    scored = good.groupBy(F.col("anchor_id").alias("id"), "key").agg(*map(at, range(positives)))
    both = asked.join(scored, ["id", "key"]).select("id", "key", "label", *[f"s{k}" for k in range(positives)], "v")
    bad = _first(_search(meet(query_blocks(both, size.q, anchor_block, ANCHOR, groups)), negatives, pivots, square, share), negatives)
    named = good.select("anchor_id", "key", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = bad.select("anchor_id", "key", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["anchor_id", "key", "place"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")
