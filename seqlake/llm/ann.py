"""Approximate nearest neighbours by largest inner product: collision counting on query-centred windows.

Vectors get one more component that makes all norms equal, so that the largest inner product is the smallest distance.
Each block of vectors keeps one sorted array for each of PROJECTIONS random lines. A query opens a window around its own
place on every line; a vector collides on a line when the window holds it. Windows widen by virtual rehashing (a larger
radius on the same arrays; only the margins are read), a vector with at least `threshold()` collisions is verified by its
exact score, and a query ends in a block when the radius reaches the distance of its k-th best so far. At that radius every
vector that is nearer collides on a line with probability erf(WIDTH/sqrt(2)) or more, so it is verified with probability
CERTAINTY or more. Nothing caps windows, collisions or candidates: where vectors are too few, or all alike, the windows
grow until they hold all.

Rows with a null id, and vectors that are null, zero, or hold null or non-finite components take no part. Vectors of
different lengths don't meet. A vector with the id of the query is not its neighbour. Equal query rows ask once; query rows
with one id and different vectors ask each. Repeated candidate rows are each a neighbour. An empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.llm.common import Scratch, arrow_map, column
from seqlake.llm.vectors import Best, finite, groups_for, numbers, packed, query_blocks

#: Lines; half a window's width at radius 1; chance that a vector inside the last radius is verified; growth of the radius.
PROJECTIONS, WIDTH, CERTAINTY, GROWTH = 48, 1.25, 0.985, 3.0
INDEX = "dim int, ids binary, vecs binary, places binary, sorted binary"
QUERY = "dim int, ids binary, keys binary, vecs binary"


@lru_cache(8)
def lines(dim: int, count: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((count, dim + 1))


@lru_cache(8)
def threshold(count: int) -> int:
    """Greatest number of collisions that a vector inside the radius has with probability CERTAINTY or more."""
    p, tail = math.erf(WIDTH / math.sqrt(2)), 0.0
    for k in range(count, 0, -1):
        tail += math.comb(count, k) * p**k * (1 - p) ** (count - k)
        if tail >= CERTAINTY:
            return k
    return 1


def _index_block(count: int, most: float):
    """Packs a block: ids, vectors, and for each line the block's rows in order and where they lie. most: the largest norm."""

    def pack(cols, m):
        m = m.astype(np.float64)
        wide = np.column_stack([m, np.sqrt(np.maximum(0, most**2 - (m * m).sum(1)))])
        on = lines(m.shape[1], count) @ wide.T
        order = on.argsort(1, kind="stable")
        return {"dim": m.shape[1], "ids": cols[0].astype(np.int64), "vecs": m, "places": np.take_along_axis(on, order, 1), "sorted": order.astype(np.int32)}

    return pack


def _query_block(cols, m):
    return {"dim": m.shape[1], "ids": cols[0].astype(np.int64), "keys": cols[1].astype(np.int64), "vecs": m.astype(np.float64)}


def search_block(queries: np.ndarray, own: np.ndarray, best: Best, vecs: np.ndarray, ids: np.ndarray, places: np.ndarray, order: np.ndarray, most: float) -> int:
    """Brings best up to date with one block of vectors; gives the number of vectors that were verified.

    queries: vectors, own: their ids; vecs, ids: the block's; places, order: its sorted arrays, a row for each line; most: the largest norm.
    """
    count, n = places.shape
    norm = np.sqrt((queries * queries).sum(1))
    at = np.column_stack([queries * (most / norm)[:, None], np.zeros(len(queries))]) @ lines(queries.shape[1], count).T  # on each line
    enough, slack, verified = threshold(count), 1e-9 * most, 0
    far = lambda q: math.sqrt(max(0.0, 2 * most * (most - best.bound(q) / norm[q]))) if best.n[q] == best.k else math.inf
    lo = np.stack([np.searchsorted(p, at[:, i]) for i, p in enumerate(places)], 1)
    hi, k = lo.copy(), best.k
    near = np.minimum(*(np.abs(np.take_along_axis(places.T, np.clip(lo + s, 0, n - 1), 0) - at) for s in (k, -k - 1)))
    start = np.median(near, 1) / WIDTH + slack  # a radius at which windows hold about k vectors
    goal = np.array([far(q) for q in range(len(queries))])
    radius = np.where(np.isfinite(goal), goal, start)
    seen, left = np.zeros((len(queries), n), np.int16), np.arange(len(queries))
    while len(left):
        half = WIDTH * radius[left] + slack
        down = np.stack([np.searchsorted(p, at[left, i] - half, "left") for i, p in enumerate(places)], 1)
        up = np.stack([np.searchsorted(p, at[left, i] + half, "right") for i, p in enumerate(places)], 1)
        down, up = np.minimum(down, lo[left]), np.maximum(up, hi[left])  # windows only grow
        more, inside, before = [], (up - down).sum(1), (hi[left] - lo[left]).sum(1)
        for x, q in enumerate(left):
            out = count * n - inside[x] < inside[x] - before[x]  # fewer places lie outside than come in: those are counted
            down_x, up_x = down[x].tolist(), up[x].tolist()
            if out:
                margins = [order[i, :a] for i, a in enumerate(down_x) if a] + [order[i, b:] for i, b in enumerate(up_x) if b < n]
            else:
                margins = [order[i, a:b] for i, (a, b) in enumerate(zip(down_x, lo[q].tolist())) if a < b]
                margins += [order[i, a:b] for i, (a, b) in enumerate(zip(hi[q].tolist(), up_x)) if a < b]
            if out or margins:
                hits = np.bincount(np.concatenate(margins), minlength=n) if margins else np.zeros(n, np.int64)
                now = (count - hits if out else seen[q] + hits).astype(np.int16)
                found = np.flatnonzero((now >= enough) & (seen[q] < enough))
                seen[q] = now
                found = found[ids[found] != own[q]]
                verified += len(found)
                if len(found):  # scores that can't come in aren't summed exactly; equal vectors have equal sums, wherever they lie
                    near = (vecs @ queries[q])[found] if 4 * len(found) > n else vecs[found] @ queries[q]
                    found = found[near >= best.bound(q) - 1e-9 * most * norm[q]] if best.n[q] == best.k else found
                    best.add(q, (vecs[found] * queries[q]).sum(1), ids[found])
            goal = far(q)
            if radius[q] < goal and not (down[x].max() == 0 and up[x].min() == n):
                radius[q] = min(radius[q] * GROWTH, goal)
                more.append(q)
        lo[left], hi[left] = down, up
        left = np.array(more, np.int64)
    return verified


def nearest(df: DataFrame, asks: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = 20, projections: int = PROJECTIONS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which asks holds, the k vectors with the largest inner products
    that were found, ties to the smaller id; the score is exact."""
    spark, v = df.sparkSession, column(vector)
    rows = df.where(column(id_col).isNotNull() & finite(v) & F.exists(v, lambda x: x != 0))
    keyed = rows.select(column(id_col).cast("long").alias("id"), F.xxhash64(v).alias("key"), F.coalesce(asks, F.lit(False)).alias("asks"), v.cast("array<double>").alias("v"))
    size = keyed.agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("most")).first()
    if not size.q:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    scratch, most = Scratch(spark, "ann"), size.most * (1 + 1e-12)
    groups = groups_for(-(-size.n // 1024), spark.sparkContext.defaultParallelism)
    index = scratch.table(packed(keyed.select("id", "v"), _index_block(projections, most), INDEX, groups), "index")
    asked = keyed.where("asks").drop("asks").dropDuplicates(["id", "key"])
    blocks = query_blocks(asked, size.q, _query_block, QUERY, groups)
    schema = "query_id long, key long, hits array<struct<vec_id:bigint,score:double>>"
    hit = pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        states: dict[tuple[int, int], tuple] = {}

        def flush():
            for _, own, keys, best in states.values():
                hits = [[{"vec_id": i, "score": s} for i, s in zip(best.id[q, :n].tolist(), best.score[q, :n].tolist())] for q, n in enumerate(best.n)]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(keys), pa.array(hits, hit)], names=["query_id", "key", "hits"])
            states.clear()

        for b in batches:
            for r in b.to_pylist():  # a block of queries and a block of vectors
                name = (r["block"], r["dim"])
                if name not in states:
                    if len(states) >= 4:  # blocks of queries come one after the other, as a rule
                        yield from flush()
                    own = numbers(r["ids"], np.int64)
                    states[name] = (numbers(r["q"], width=r["dim"]), own, numbers(r["keys"], np.int64), Best(len(own), k))
                queries, own, _, best = states[name]
                ids = numbers(r["vec_ids"], np.int64)
                search_block(queries, own, best, numbers(r["vecs"], width=r["dim"]), ids, numbers(r["places"], width=len(ids)), numbers(r["sorted"], np.int32, len(ids)).astype(np.intp), most)
        yield from flush()

    met = blocks.withColumnRenamed("vecs", "q").join(index.withColumnRenamed("ids", "vec_ids").hint("merge"), ["g", "dim"])
    hits = arrow_map(met, run, schema).select("query_id", "key", F.explode("hits").alias("h")).select("query_id", "key", "h.*")
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
