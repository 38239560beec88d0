"""Weighted global and circular alignment distance of sequence pairs, in Arrow batches.

All pairs of a table are scored two blocks of rows at a time (score_pairs): a task gets the two blocks, each text once with the
ids that have it, fills one table for every two different texts, and hands over the pairs of ids in batches. Tables hold
differences of neighbouring cells, which for a gap of g lie between -g and g, so that a byte is enough.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlake.functions.sequence import COMPLEMENT


@dataclass(frozen=True)
class Costs:
    transition: int = 1
    transversion: int = 2
    gap: int = 3
    loop: bool = False

    def matrix(self) -> np.ndarray:
        """5 x 5 for a, c, g, t and anything else, which differs from all but its like."""
        m = np.full((5, 5), self.transversion)
        m[0, 2] = m[2, 0] = m[1, 3] = m[3, 1] = self.transition
        np.fill_diagonal(m, 0)
        return m


_CODE = np.full(256, 4, np.uint8)
for _k, _c in enumerate("acgt"):
    _CODE[[ord(_c), ord(_c.upper())]] = _k


#: Cells of a row of the tables that are filled at once.
CELLS = 1 << 21


def _codes(texts: list[str], fill: int) -> np.ndarray:
    out = np.full((len(texts), max(map(len, texts), default=0)), fill, np.uint8)
    for k, s in enumerate(texts):
        out[k, : len(s)] = _CODE[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]
    return out


def _block(longer: list[str], shorter: list[str], costs: Costs) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ends) of pairs, one row of every pair's table at a time. Cells behind a pair's own width never reach
    those inside it, and a pair whose letters are used up keeps its last row."""
    m, n = np.array([len(s) for s in longer]), np.array([len(s) for s in shorter])
    a, b, gap, at = _codes(longer, 4), _codes(shorter, 4), costs.gap, np.arange(len(m))
    cost, wide = costs.matrix().astype(np.int32), b.shape[1]
    ramp = (gap * np.arange(wide + 1)).astype(np.int32)
    last = np.zeros((len(m), wide + 1), np.int32) if costs.loop else np.repeat(ramp[None], len(m), 0)
    row = np.empty_like(last)
    for i in range(a.shape[1]):
        c = cost[a[:, i : i + 1], b]
        row[:, 0] = np.minimum(last[at, n - 1] + c[at, n - 1], gap + last[at, n]) if costs.loop else (i + 1) * gap
        np.minimum(last[:, :-1] + c, last[:, 1:] + gap, out=row[:, 1:])
        now = np.minimum.accumulate(row - ramp, axis=1) + ramp  # gaps along the row: a running minimum
        last = np.where((i < m)[:, None], now, last)
    if not costs.loop:
        return last[at, n], np.zeros(len(m), np.int64)
    inside = np.where(np.arange(wide + 1) < n[:, None], last, np.iinfo(np.int32).max)
    end = inside.argmin(1)
    score, most = inside[at, end], 3 * m
    return np.where(score < most, score, most), np.where(score < most, end, 0)


def distances(s1: list[str], s2: list[str], costs: Costs = Costs()) -> tuple[list[int], list[int]]:
    """(scores, ends): the least cost of each pair; circular alignment starts anywhere on the shorter sequence and wraps
    around its end, and end is the first column with the least cost (0 otherwise, and 0 if none is below three per
    base). Pairs are aligned many at a time, those of like lengths together."""
    turned = [(x, y) if len(x) >= len(y) else (y, x) for x, y in zip(s1, s2, strict=True)]
    score, end = [0] * len(turned), [0] * len(turned)
    order = sorted(range(len(turned)), key=lambda k: (len(turned[k][1]), len(turned[k][0])))
    while order and not turned[order[0]][1]:
        k = order.pop(0)
        score[k] = len(turned[k][0]) * (min(3, costs.gap) if costs.loop else costs.gap)
    at = 0
    while at < len(order):
        many = max(1, CELLS // (len(turned[order[min(len(order), at + 256) - 1]][1]) + 1))
        part = order[at : at + min(many, 1 << 14)]
        while len(part) > 1 and len(part) * (len(turned[part[-1]][1]) + 1) > CELLS:
            part = part[: len(part) // 2]
        got = _block([turned[k][0] for k in part], [turned[k][1] for k in part], costs)
        for k, v, e in zip(part, got[0].tolist(), got[1].tolist()):
            score[k], end[k] = v, e
        at += len(part)
    return score, end


def distance(s1: str, s2: str, costs: Costs = Costs()) -> tuple[int, int]:
    """(score, end) of one pair, see distances()."""
    score, end = distances([s1], [s2], costs)
    return score[0], end[0]


def _banded(longer: list[str], shorter: list[str], most: np.ndarray, costs: Costs) -> np.ndarray:
    """Scores of pairs, -1 where they are above most: a row of every pair's band at a time. A place k off the diagonal costs
    k gaps, so cells further off than most / gap never count; a pair whose row is all above most is left at once."""
    m, n = np.array([len(x) for x in longer]), np.array([len(x) for x in shorter])
    wide = int(max(0, (most // costs.gap).max(initial=0)))
    a, b, gap = _codes(longer, 4), _codes(shorter, 4), costs.gap
    cost, far = costs.matrix().astype(np.int32), np.int32(1 << 29)
    b = np.pad(b, ((0, 0), (wide + 1, 2 * wide + 2 + max(0, a.shape[1] - b.shape[1]))), constant_values=4)
    shift = np.arange(-wide, wide + 1)
    ramp = (gap * np.arange(2 * wide + 1)).astype(np.int32)
    row = np.where(shift >= 0, gap * shift, far).astype(np.int32)
    row = np.where(shift[None] <= n[:, None], row, far)
    out = np.full(len(m), -1)
    at = np.flatnonzero(n >= m - most // gap)  # pairs still worked on; row belongs to them
    row = row[at]
    for i in range(int(m.max(initial=0)) + 1):
        done = m[at] == i
        if done.any():
            end = at[done]
            score = row[done, n[end] - i + wide]
            out[end] = np.where(score <= most[end], score, -1)
        go = ~done & (row.min(1) <= most[at]) if len(at) else done
        at, row = at[go], row[go]
        if not len(at):
            break
        j = i + 1 + shift  # columns of the next row
        c = cost[a[at, i][:, None], b[at, i + 1 : i + 2 + 2 * wide]]  # b's letter j - 1 lies at j + wide
        new = np.minimum(row + c, np.concatenate([row[:, 1:], np.full((len(at), 1), far)], 1) + gap)
        new[:, j < 1] = far
        if wide >= i + 1:
            new[:, wide - i - 1] = gap * (i + 1)  # column 0
        new = np.minimum.accumulate(new - ramp, axis=1) + ramp
        row = np.where((j[None] >= 0) & (j[None] <= n[at][:, None]), new, far).astype(np.int32)
    return out


def distances_within(s1: list[str], s2: list[str], most: list[int], costs: Costs = Costs()) -> list[int]:
    """Global scores that are at most most, -1 for the others, in bands: for pairs that may be far apart."""
    if costs.loop or min(costs.transition, costs.transversion, costs.gap) < 1:
        raise ValueError("bands need a global distance in which every edit costs")
    out = [-1] * len(s1)
    order = sorted((k for k in range(len(s1)) if most[k] >= 0), key=lambda k: (most[k], len(s1[k]) + len(s2[k])))
    at = 0
    while at < len(order):
        part = order[at : at + 4096]
        while len(part) > 1 and len(part) * (2 * most[part[-1]] // costs.gap + 1) > CELLS:
            part = part[: len(part) // 2]
        turned = [(s1[k], s2[k]) if len(s1[k]) >= len(s2[k]) else (s2[k], s1[k]) for k in part]
        for k, v in zip(part, _banded([x for x, _ in turned], [y for _, y in turned], np.array([most[k] for k in part], np.int64), costs).tolist()):
            out[k] = v
        at += len(part)
    return out


def within_udf(costs: Costs = Costs()):
    """(s1, s2, most) -> score, -1 above most."""

    @F.pandas_udf("int")
    def nw(s1: pd.Series, s2: pd.Series, most: pd.Series) -> pd.Series:
        return pd.Series(distances_within(s1.tolist(), s2.tolist(), most.tolist(), costs), dtype="int32")

    return nw


def distance_udf(costs: Costs = Costs()):
    """(s1, s2) -> struct(score, end), whole Arrow batches at a time."""

    @F.pandas_udf("score int, end int")
    def nw(s1: pd.Series, s2: pd.Series) -> pd.DataFrame:
        score, end = distances(s1.tolist(), s2.tolist(), costs)
        return pd.DataFrame({"score": score, "end": end})

    return nw


def tasks(seqs: DataFrame) -> int:
    """Tasks for work that takes long for its bytes, which adaptive execution would put into a few."""
    spark = seqs.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


#: Rows of a block at most, and letters; rows of one unit (a text and ids that have it); units and pairs of a table filled at once.
BLOCK_ROWS, BLOCK_LETTERS, UNIT, SLICE, PAIRS = 4096, 1 << 22, 64, 512, 4096
#: Edges of tables that are held at once.
TABLES = 1 << 22
#: Rows of a batch that is handed over.
BATCH = 1 << 16


def block_count(seqs: DataFrame, rows: int = BLOCK_ROWS) -> int:
    """Blocks so that none has many more than rows rows or BLOCK_LETTERS letters, and there is work for all tasks."""
    n, letters = seqs.agg(F.count("*"), F.coalesce(F.sum(F.length("s")), F.lit(0))).first()
    return max(1, min(n, max(-(-n // rows), -(-letters // BLOCK_LETTERS), math.isqrt(2 * tasks(seqs)) + 1)))


def pairs(seqs: DataFrame, rows: int = BLOCK_ROWS, block: int | None = None) -> DataFrame:
    """(i, s_i, j, s_j) for all i < j of (seq_id, s).

    Rows are dealt into blocks of about rows each; every two blocks x <= y meet once by an equi join, so that each task
    holds two blocks and no side is sent everywhere. A row is sent once for each block.
    """
    return block_pairs(seqs.withColumn("__blocks", F.lit(block_count(seqs, rows) if block is None else block)))


def block_pairs(seqs: DataFrame, *keys: str) -> DataFrame:
    """pairs() within the groups of keys, each dealt into the number of blocks that its rows name in column __blocks."""
    x = F.pmod(F.xxhash64("seq_id"), F.col("__blocks")).cast("int")
    own = seqs.select(*keys, "seq_id", "s", x.alias("__own"), F.col("__blocks").cast("int").alias("__blocks"))
    n, cell = tasks(seqs), [*keys, "x", "y"]
    left = own.select(*keys, F.col("seq_id").alias("i"), F.col("s").alias("s_i"), F.col("__own").alias("x"), F.explode(F.sequence("__own", F.col("__blocks") - 1)).alias("y"))
    right = own.select(*keys, F.col("seq_id").alias("j"), F.col("s").alias("s_j"), F.col("__own").alias("y"), F.explode(F.sequence(F.lit(0), F.col("__own"))).alias("x"))
    met = left.repartition(n, *cell).join(right.repartition(n, *cell), cell).where("x < y or i < j")
    turn = F.col("i") > F.col("j")
    either = lambda a, b, name: F.when(turn, F.col(a)).otherwise(F.col(b)).alias(name)
    return met.select(*keys, either("j", "i", "i"), either("s_j", "s_i", "s_i"), either("i", "j", "j"), either("s_i", "s_j", "s_j"))


def strand_minimum(forward: Column, reverse: Column) -> Column:
    """struct(score, strand): the lesser of two scores, + on a tie."""
    return F.struct(F.least(forward, reverse).alias("score"), F.when(forward <= reverse, "+").otherwise("-").alias("strand"))


def score_matrix(a: list[str], b: list[str], costs: Costs = Costs()) -> np.ndarray:
    """Global scores of every text of a with every text of b, whose tables are filled along their diagonals, PAIRS at a time.

    With h and v the differences to the left and upper neighbour plus the gap, and c the cost of a cell's letters, m = min(c,
    h, v) gives the differences of the next row and column: m + 2 gap - h and m + 2 gap - v.
    """
    g, cost = costs.gap, costs.matrix()
    out = np.zeros((len(a), len(b)), np.int32)
    len_a, len_b = np.array([len(s) for s in a], np.int64), np.array([len(s) for s in b], np.int64)
    kind = np.uint8 if 4 * g < 256 else np.int32
    plain = costs.transition == 1 and costs.transversion in (1, 2)
    by_b = np.argsort(len_b, kind="stable")
    parts, at = [], 0
    while at < len(by_b):
        part = by_b[at : at + max(1, min(PAIRS, TABLES // (int(len_b[by_b[min(at + PAIRS, len(by_b)) - 1]]) + 1)))]
        parts.append((part, _bits([b[k] for k in part]).astype(kind)))
        at += len(part)
    for m in map(int, np.unique(len_a)):
        own = np.flatnonzero(len_a == m)
        code_a = _bits([a[k] for k in own]).astype(kind)
        cap = [(part[k : k + step], code[k : k + step]) for part, code in parts for step in [max(1, TABLES // (m + code.shape[1] + 1))] for k in range(0, len(part), step)]
        for part, code_b in cap:
            wide = int(len_b[part[-1]])
            many = max(1, min(len(own), PAIRS // len(part), TABLES // (m + wide + 1) // len(part)))
            turned = np.tile(np.ascontiguousarray(code_b[:, :wide].T[::-1]), (1, many))
            inside = np.arange(wide)[::-1, None] < np.tile(len_b[part], many)
            most = np.full((min(m, wide), turned.shape[1]), costs.transversion, kind)
            for first in range(0, len(own), many):
                some = own[first : first + many]
                if not m or not wide:
                    out[np.ix_(some, part)] = g * np.maximum(m, len_b[part])
                    continue
                size = len(some) * len(part)
                x, y = np.empty((m, len(some), len(part)), kind), turned[:, :size]
                x[:] = code_a[first : first + many].T[:, :, None]
                x = x.reshape(m, size)
                h, v = np.full((wide, size), 2 * g, kind), np.full((m, size), 2 * g, kind)
                next_v, room, double = v.copy(), np.empty((min(m, wide), size), kind), np.full((min(m, wide), size), 2 * g, kind)
                for d in range(m + wide - 1):
                    lo, hi = max(0, d - wide + 1), min(m - 1, d) + 1
                    up, left, w = v[lo:hi], h[wide - 1 - d + lo : wide - 1 - d + hi], room[: hi - lo]
                    there = y[wide - 1 - d + lo : wide - 1 - d + hi]
                    if plain:
                        np.bitwise_xor(x[lo:hi], there, out=w)
                        np.minimum(w, most[: hi - lo, :size], out=w)
                    else:
                        w[:] = cost[_PLAIN[x[lo:hi]], _PLAIN[there]]
                    np.minimum(w, left, out=w)
                    np.minimum(w, up, out=w)
                    w += double[: hi - lo]
                    np.subtract(w, left, out=next_v[lo:hi])
                    np.subtract(w, up, out=left)
                    v, next_v = next_v, v
                steps = np.where(inside[:, :size], h, kind(g)).sum(0, dtype=np.int64) - g * wide
                out[np.ix_(some, part)] = (m * g + steps).reshape(len(some), len(part))
    return out


def _bits(texts: list[str]) -> np.ndarray:
    """Codes of letters that differ in the lowest bit alone for a transition."""
    return _XOR[_codes(texts, 4)]


#: Codes a 0, g 1, c 2, t 3, others 4, of those of _CODE, and back.
_XOR, _PLAIN = np.array([0, 2, 1, 3, 4], np.uint8), np.array([0, 2, 1, 3, 4])


def loop_scores(texts: list[str], longer: np.ndarray, shorter: np.ndarray, costs: Costs) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ends) of circular alignments of pairs, named by their places in texts, see distances(): pairs with equally
    long shorter ones together, a cell of all their tables at a time, as differences."""
    length = np.array([len(s) for s in texts], np.int64)
    m, n = length[longer], length[shorter]
    score, end, g, cost = np.zeros(len(m), np.int64), np.zeros(len(m), np.int64), costs.gap, costs.matrix()
    order = np.lexsort((m, n))
    at = 0
    while at < len(order):
        wide = int(n[order[at]])
        same = int(np.searchsorted(n[order], wide, "right"))
        part = order[at : min(same, at + max(1, min(1 << 13, TABLES // (wide + int(m[order[min(same, at + (1 << 13)) - 1]]) + 1))))]
        at += len(part)
        if not wide:
            score[part] = m[part] * min(3, g)
            continue
        kind = np.int16 if (wide + 4) * g < 1 << 14 else np.int32
        x, y = (np.ascontiguousarray(_bits([texts[k] for k in some])[place].astype(kind).T) for some, place in (np.unique(who[part], return_inverse=True) for who in (longer, shorter)))
        plain = costs.transition == 1 and costs.transversion in (1, 2)
        h, zero, last, tall = np.full((wide, len(part)), g, kind), np.zeros(len(part), np.int32), np.zeros(len(part), np.int32), m[part]
        w, v, left = (np.empty(len(part), kind) for _ in range(3))
        most, double = np.full(len(part), costs.transversion, kind), np.full(len(part), 2 * g, kind)
        for i in range(int(tall[-1])):
            begin = np.minimum(last - (h[-1] - g) + cost[_PLAIN[x[i]], _PLAIN[y[-1]]].astype(np.int32), last + g)
            v[:] = begin - zero + g
            zero = begin
            for j in range(wide):
                if plain:
                    np.bitwise_xor(x[i], y[j], out=w)
                    np.minimum(w, most, out=w)
                else:
                    w[:] = cost[_PLAIN[x[i]], _PLAIN[y[j]]]
                np.minimum(w, h[j], out=w)
                np.minimum(w, v, out=w)
                w += double
                left[:] = h[j]
                np.subtract(w, v, out=h[j])
                np.subtract(w, left, out=v)
            last += v
            last -= g
            if (done := np.flatnonzero(tall == i + 1)).size:
                cells = np.concatenate([zero[None, done], zero[done] + np.cumsum(h[:-1, done].astype(np.int64) - g, 0)])
                best, highest = cells.min(0), 3 * tall[done]
                score[part[done]] = np.minimum(best, highest)
                end[part[done]] = np.where(best < highest, cells.argmin(0), 0)
    return score, end


def _units(seqs: DataFrame) -> DataFrame:
    """(s, ids): each text with up to about UNIT of the ids that have it."""
    known = seqs.where("s is not null").select("seq_id", "s")
    often = known.groupBy("s").agg(F.ceil(F.count("*") / UNIT).alias("__parts"))
    dealt = known.join(often, "s").withColumn("__part", F.pmod(F.xxhash64("seq_id"), F.col("__parts")))
    return dealt.groupBy("s", "__part").agg(F.collect_list("seq_id").alias("ids"))


def _cells(seqs: DataFrame, block: int | None) -> DataFrame:
    """(x, y, left, right): every two blocks x <= y of units (s, ids), each cell a row. A block is sent once for each block."""
    block = block_count(seqs) if block is None else block
    units = _units(seqs).select(F.pmod(F.xxhash64("s", "__part"), F.lit(block)).cast("int").alias("__own"), F.struct("s", "ids").alias("unit"))
    blocks = units.groupBy("__own").agg(F.collect_list("unit").alias("units"))
    n = max(tasks(seqs), min(2 * block * (block + 1), 2048))
    left = blocks.select(F.col("__own").alias("x"), F.explode(F.sequence("__own", F.lit(block - 1))).alias("y"), F.col("units").alias("left"))
    right = blocks.select(F.col("__own").alias("y"), F.explode(F.sequence(F.lit(0), F.col("__own"))).alias("x"), F.col("units").alias("right"))
    return left.repartition(n, "x", "y").join(right.repartition(n, "x", "y"), ["x", "y"]).select("x", "y", "left", "right")


class _Side:
    """A block's texts by length, and ids by text: unit has the text's place of each id."""

    def __init__(self, units: pa.StructArray):
        texts, ids = units.field("s").to_pylist(), units.field("ids")
        order = sorted(range(len(texts)), key=lambda k: len(texts[k]))
        ids = ids.take(pa.array(order, pa.int64()))
        self.texts = [texts[k] for k in order]
        self.rows = np.array([len(x) for x in ids], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.rows)])
        self.ids = ids.flatten().to_numpy(zero_copy_only=False)
        self.unit = np.repeat(np.arange(len(order)), self.rows)
        self.length = np.array([len(s) for s in self.texts], np.int32)


def _opposite(texts: list[str]) -> list[str]:
    letters, others = COMPLEMENT["standard"]
    table = str.maketrans(letters + letters.lower(), others + others.lower())
    return [s.translate(table)[::-1] for s in texts]


def _tables(x: list[str], y: list[str], costs: Costs, strands: bool) -> list[tuple[np.ndarray, ...]]:
    """[(score, minus, end)] of every text of x with every one of y, once as the first of the pair and once as the second
    (None if that is the same)."""

    def ways(first: list[str], second: list[str]) -> tuple[np.ndarray, ...]:
        forward = one(first, second)
        if not strands:
            return forward[0], None, forward[1]
        reverse = one(first, _opposite(second))
        minus = reverse[0] < forward[0]
        return np.minimum(forward[0], reverse[0]), minus, np.where(minus, reverse[1], forward[1])

    def one(first: list[str], second: list[str]):
        if not costs.loop:
            return score_matrix(first, second, costs), np.int32(0)
        long, short = (np.repeat(np.arange(len(first)), len(second)), np.tile(np.arange(len(second)) + len(first), len(first)))
        size = np.array([len(s) for s in (*first, *second)])
        turn = size[long] < size[short]
        score, end = loop_scores([*first, *second], np.where(turn, short, long), np.where(turn, long, short), costs)
        return score.astype(np.int32).reshape(len(first), len(second)), end.astype(np.int32).reshape(len(first), len(second))

    out = [ways(x, y)]
    if costs.loop:
        out.append(tuple(None if k is None else k.T for k in ways(y, x)))
    return out


def _each_cell(batches, work):
    for b in batches:
        for x, y, left, right in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), b.column("left"), b.column("right")):
            yield from work(x == y, _Side(left.values), _Side(right.values))


def score_pairs(seqs: DataFrame, costs: Costs = Costs(), block: int | None = None, strands: bool = True, within: int | None = None) -> DataFrame:
    """(i, len_i, j, len_j, score, strand, end_col) of all pairs i < j of (seq_id, s), the better of both strands; without
    strands (i, len_i, j, len_j, score). within: only scores of at most so many thousandths of the longer length (cut down).
    Null texts have no pair."""
    kind = seqs.schema["seq_id"].dataType.simpleString()
    names = ["i", "len_i", "j", "len_j", "score", *(["minus", "end_col"] if strands else [])]

    def work(same: bool, x: _Side, y: _Side):
        step = max(1, BATCH // max(1, len(y.ids)))
        for low in range(0, len(x.texts), SLICE):
            some = x.texts[low : low + SLICE]
            got = _tables(some, y.texts, costs, strands)
            top = int(x.first[min(low + SLICE, len(x.texts))])
            for p in range(int(x.first[low]), top, step):
                a, u = x.ids[p : min(p + step, top), None], x.unit[p : min(p + step, top)]
                turn = a > y.ids[None]
                keep = ~turn & (a != y.ids[None]) if same else a != y.ids[None]

                def of(k: int):
                    cell = [None if t[k] is None else t[k] if not np.ndim(t[k]) else t[k][u - low][:, y.unit] for t in got]
                    return cell[0] if len(cell) == 1 else np.where(turn, cell[1], cell[0])

                score = of(0)
                long = np.broadcast_to(x.length[u][:, None], turn.shape), np.broadcast_to(y.length[y.unit][None], turn.shape)
                if within is not None:
                    keep &= score <= np.maximum(*long).astype(np.int64) * within // 1000
                columns = [np.where(turn, y.ids[None], a), np.where(turn, long[1], long[0]), np.where(turn, a, y.ids[None]), np.where(turn, long[0], long[1]), score]
                if strands:
                    columns += [of(1), np.broadcast_to(of(2), turn.shape)]
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names=names)

    schema = f"i {kind}, len_i int, j {kind}, len_j int, score int" + (", minus boolean, end_col int" if strands else "")
    out = _cells(seqs, block).mapInArrow(lambda batches: _each_cell(batches, work), schema)
    return out.select("i", "len_i", "j", "len_j", "score", F.when(F.col("minus"), "-").otherwise("+").alias("strand"), "end_col") if strands else out


def threshold(factor: float, len_i: Column, len_j: Column) -> Column:
    """Greatest linking score of a pair, cut towards zero."""
    return (F.lit(factor) * F.greatest(len_i, len_j) - 10).cast("int")


def random_sequences(lengths: DataFrame, seed: int = 1) -> DataFrame:
    """(seq_id, s): a reproducible pseudo-random sequence for each row (seq_id, len), each base by the first digit of
    md5("id:place:seed"); what real sequences of those lengths are compared with."""
    base = lambda k: F.translate(F.substring(F.md5(F.concat_ws(":", F.col("seq_id").cast("string"), k.cast("string"), F.lit(str(seed)))), 1, 1), "0123456789abcdef", "acgt" * 4)
    return lengths.select("seq_id", F.when(F.col("len") > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.col("len"), F.lit(1))), base), "")).otherwise("").alias("s"))


def estimate_factor(seqs: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """(mean, factor): mean score of all pairs, on one strand, per 100 bases of the longer one, and 0.9 % of it as the
    linking factor; seqs are random sequences (random_sequences). Scores are summed by length, in integers."""

    def work(same: bool, x: _Side, y: _Side):
        for low in range(0, len(x.texts), SLICE):
            score = _tables(x.texts[low : low + SLICE], y.texts, costs, False)[0][0].astype(np.int64)
            many = x.rows[low : low + SLICE, None]
            rows = many * y.rows[None]
            if same:  # every two texts once, and the pairs inside one unit
                own, other = np.arange(low, low + len(rows))[:, None], np.arange(len(y.texts))[None]
                rows = np.where(own < other, rows, np.where(own == other, many * (many - 1) // 2, 0))
            long = np.maximum(x.length[low : low + SLICE, None], y.length[None]).ravel()
            total, n = np.bincount(long, (score * rows).ravel()), np.bincount(long, rows.ravel())
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64)), pa.array(n[at].astype(np.int64))], names=["long", "total", "n"])

    got = _cells(seqs, None).mapInArrow(lambda batches: _each_cell(batches, work), "long int, total long, n long")
    sums = got.groupBy("long").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    mean = F.sum(F.col("total") * 100 / F.col("long")) / F.sum("n")
    return sums.agg(mean.alias("mean"), (mean * 0.009).alias("factor"))
