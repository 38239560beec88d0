"""Similarity join of sequences: all pairs whose edit distance is at most a share of the longer one's length.

Exact candidates without all pairs. If a shorter sequence r has at most k edits to a longer one, and r is cut into k + 2
parts, two parts at least are untouched and stand in the longer one, at most k places from where they stand in r. k is the
most that any partner of r may have, so r is cut alike whoever meets it. The first q letters of every part of r meet all
stretches of q letters of the other sequences by their hashes (equi join), which also hold the place in buckets of more than 2k letters;
the length and the shift filter what meets, and a banded distance verifies pairs that two parts share. Where k + 2 parts would
be short there are k + 1, of which one is enough. q is the largest of STRETCHES that r's parts have room for; a longer sequence gives
the stretches of those q that sequences within its reach use.

Nearly all stretches meet nothing but their own sequence's part, so only those are sent whose key a broadcast filter (_Keys) has:
one of all parts' keys, for a stretch that is its own sequence's part one of the keys of several parts. Of the parts only those are
sent whose key the stretches that are left have.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.functions.sequence import revcomp
from seqlake.operators.align import Costs, tasks, within_udf
from seqlake.operators.coords import dimension
from seqlake.operators.scratch import Scratch

#: Letters of a part that are hashed.
STRETCHES = (1, 2, 3, 4, 6, 8, 10, 12, 14, 16)
#: Odd multiplier of the rolling hash (any will do).
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Letters whose stretches are handed over at once.
LETTERS = 1 << 16


def most_edits(length: int, per_mille: int) -> int:
    return length * per_mille // 1000


#: Least letters of a part where two parts have to meet; least width of a bucket of places; filters of keys in so many shards, bits of
#: a key and of a shard at most, keys that are handed over at once.
ROOM, WIDTH, SHARDS, BITS, MOST_BITS, KEYS = 12, 64, 256, 16, 1 << 22, 1 << 20


@lru_cache(1 << 16)
def parts_of(length: int, per_mille: int) -> tuple[int, int, int, int]:
    """(parts, q, parts that have to meet, width of a bucket of places) of a sequence of that length; no parts if only an
    equal one could be its partner."""
    other = length * 1000 // (1000 - per_mille) + 2
    while other - most_edits(other, per_mille) > length:
        other -= 1
    k = most_edits(other, per_mille)
    if k == 0:
        return 0, 0, 0, 0
    need = 2 if length // (k + 2) >= ROOM else 1
    return k + need, max((q for q in STRETCHES if q <= length // (k + need)), default=0), need, max(WIDTH, 1 << (2 * k).bit_length())


@lru_cache(1 << 16)
def stretches_of(length: int, per_mille: int) -> tuple[tuple[int, int], ...]:
    """The (q, width) of all sequences that are no longer than this one and may be its partners."""
    known = (parts_of(n, per_mille) for n in range(length - most_edits(length, per_mille), length + 1))
    return tuple(sorted({(q, width) for count, q, _, width in known if count}))


def _hashes(codes: np.ndarray, q: int) -> np.ndarray:
    n = len(codes) - q + 1
    h = np.full(max(0, n), np.uint64(q))
    for t in range(q if n > 0 else 0):
        h = h * _BASE + codes[t : t + n]
    return h


def _keyed(h: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    x = (h + bucket.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of counts, one behind the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _stretches(texts: list[str], per_mille: int, of_parts: bool):
    """Yields (keys, places of texts, places in them, own) of the parts of texts (of_parts), or of all stretches that may meet
    those; own marks stretches that are parts of their own text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = np.array([len(s) for s in texts], np.int64)
    first = np.cumsum(n) - n
    classes: dict[tuple[int, int], list[int]] = {}
    for k, m in enumerate(n.tolist()):
        count, q, _, width = parts_of(m, per_mille)
        for c in [(q, width)] * (count > 0) if of_parts else stretches_of(m, per_mille) if most_edits(m, per_mille) else ():
            classes.setdefault(c, []).append(k)
    hashes = {q: _hashes(codes, q) for q in {q for q, _ in classes} - {0}}
    for (q, width), who in classes.items():
        who = np.array(who)
        own_parts = np.array([parts_of(m, per_mille)[0] if parts_of(m, per_mille)[1::2] == (q, width) else 0 for m in n[who].tolist()], np.int64)
        if not q:  # parts without a letter: anything near enough in length may match
            yield _keyed(np.zeros(len(who), np.uint64), np.zeros(len(who), np.int64)), who, np.zeros(len(who), np.int64), own_parts > 0
            continue
        part_of = np.repeat(np.arange(len(who)), own_parts)
        part_at = _within(own_parts) * n[who[part_of]] // own_parts[part_of]
        if of_parts:
            reach = np.array([parts_of(m, per_mille)[0] - parts_of(m, per_mille)[2] for m in n[who].tolist()], np.int64)[part_of]
            h, low, high = hashes[q][first[who[part_of]] + part_at], np.maximum(part_at - reach, 0) // width, (part_at + reach) // width
            yield _keyed(h, low), who[part_of], part_at, None
            more = np.flatnonzero(high > low)  # a bucket is wider than what a part reaches, so there are two at most
            yield _keyed(h[more], high[more]), who[part_of[more]], part_at[more], None
            continue
        times = np.maximum(n[who] - q + 1, 0)
        begin = np.cumsum(times) - times
        own = np.zeros(times.sum(), bool)
        own[begin[part_of] + part_at] = True
        at, text = _within(times), np.repeat(who, times)
        yield _keyed(hashes[q][first[text] + at], at // width), text, at, own


class _Keys:
    """Which keys there are, and which more than once: a Bloom filter of each shard. Others are found there now and then."""

    def __init__(self, shards: dict[int, bytes]):
        sizes = np.array([8 * len(shards.get(k, b"")) for k in range(SHARDS)], np.uint64)
        self.sizes, self.first = sizes, np.cumsum(sizes) - sizes
        self.bits = np.frombuffer(b"".join(shards.get(k, b"") for k in range(SHARDS)) + b"\0", np.uint8)

    @staticmethod
    def places(top: np.ndarray, size) -> list[np.ndarray]:
        """Bits of keys (their 32 top bits) in a shard of size bits."""
        mixed = [(top * np.uint64(odd) & np.uint64(0xFFFFFFFF)) * size >> np.uint64(32) for odd in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
        return [m.astype(np.int64) for m in mixed]

    @staticmethod
    def shard(top: np.ndarray) -> bytes:
        size = min(MOST_BITS, -(-len(top) * BITS // 8) * 8)
        bits = np.zeros(size, bool)
        for at in _Keys.places(top, np.uint64(size)):
            bits[at] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def has(self, keys: np.ndarray) -> np.ndarray:
        top = keys >> np.uint64(32)
        shard = (top * SHARDS >> np.uint64(32)).astype(np.int64)
        out = np.flatnonzero(self.sizes[shard] > 0)
        for k in range(3):
            own = shard[out]
            at = self.first[own].astype(np.int64) + self.places(top[out], self.sizes[own])[k]
            out = out[self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0]
        found = np.zeros(len(keys), bool)
        found[out] = True
        return found


def _known_keys(blobs: DataFrame) -> tuple[_Keys, _Keys]:
    """(all, those that came more than once) of (shard, tops)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        top, times = np.unique(np.frombuffer(b"".join(pdf["tops"]), np.uint32), return_counts=True)
        top = top.astype(np.uint64)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "once": [_Keys.shard(top)], "more": [_Keys.shard(top[times > 1])]})

    found = blobs.groupBy("shard").applyInPandas(build, "shard int, once binary, more binary").collect()
    return _Keys({r.shard: bytes(r.once) for r in found}), _Keys({r.shard: bytes(r.more) for r in found})


def _tops(keys) -> pa.RecordBatch:
    """Keys' top bits by shard."""
    top = np.sort((np.concatenate(keys) >> np.uint64(32)).astype(np.uint32))
    ends = np.searchsorted(top, [(k << 32) // SHARDS for k in range(1, SHARDS)])
    blobs = [x.tobytes() for x in np.split(top, ends)]
    some = [k for k, x in enumerate(blobs) if x]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([blobs[k] for k in some], pa.binary())], names=["shard", "tops"])


def _gathered(arrays, make, most: int):
    """make() of what arrays yields, at least most keys at once."""
    kept, size = [], 0
    for x in arrays:
        kept.append(x)
        size += len(x)
        if size >= most:
            yield make(kept)
            kept, size = [], 0
    if kept and size:
        yield make(kept)


def _texts(batches):
    """(ids, texts) of about LETTERS letters."""
    for b in batches:
        texts, begin, size = [s or "" for s in b.column(1).to_pylist()], 0, 0
        for k, s in enumerate(texts):
            size += len(s)
            if size >= LETTERS or k == len(texts) - 1:
                yield b.column(0).slice(begin, k + 1 - begin), texts[begin : k + 1]
                begin, size = k + 1, 0


def candidates(seqs: DataFrame, per_mille: int, strands: bool = False) -> DataFrame:
    """(i, j, strand), each once: the pairs of (seq_id, s) that have to be verified; i is the shorter, of equals the
    smaller id. Strand - (with strands only): j is reverse complemented."""
    if not 0 <= per_mille < 1000:
        raise ValueError("the share is below one")
    seqs = seqs.select("seq_id", "s").repartition(tasks(seqs), "seq_id") if not hasattr(seqs, "_scratch_path") else seqs.select("seq_id", "s")
    context, kind = seqs.sparkSession.sparkContext, seqs.schema["seq_id"].dataType.simpleString()

    def part_keys(batches):
        yield from _gathered((keys for _, texts in _texts(batches) for keys, *_ in _stretches(texts, per_mille, True)), _tops, KEYS)

    def rows(ids, texts, keys, who, at, keep, *more):
        keep = np.flatnonzero(keep)
        n = np.array([len(s) for s in texts], np.int32)[who[keep]]
        return pa.RecordBatch.from_arrays([pa.array(keys[keep].view(np.int64)), ids.take(pa.array(who[keep])), pa.array(n), pa.array(at[keep].astype(np.int32)), *(pa.array(x[who[keep]]) for x in more)], names=["key", "id", "n", "at", "need"][: 4 + len(more)])

    every, several = (context.broadcast(k) for k in _known_keys(seqs.mapInArrow(part_keys, "shard int, tops binary")))

    def some_rows(batches):
        for ids, texts in _texts(batches):
            for keys, who, at, own in _stretches(texts, per_mille, False):
                keep = every.value.has(keys)
                keep[keep] = ~own[keep] | several.value.has(keys[keep])
                yield rows(ids, texts, keys, who, at, keep)

    schema = f"key long, id {kind}, n int, at int"
    some = seqs.mapInArrow(some_rows, schema).withColumn("strand", F.lit("+"))
    if strands:
        some = some.unionByName(seqs.select("seq_id", revcomp(F.col("s")).alias("s")).mapInArrow(lambda batches: _other_rows(batches, per_mille, every, rows), schema).withColumn("strand", F.lit("-")))
    some = Scratch(seqs.sparkSession, "stretches").table(some, "stretches")

    def some_keys(batches):
        yield from _gathered((b.column(0).to_numpy().view(np.uint64) for b in batches), _tops, KEYS)

    hit = context.broadcast(_known_keys(some.select("key").mapInArrow(some_keys, "shard int, tops binary"))[0])

    def part_rows(batches):
        for ids, texts in _texts(batches):
            need = np.array([parts_of(len(s), per_mille)[2] for s in texts], np.int32)
            for keys, who, at, _ in _stretches(texts, per_mille, True):
                yield rows(ids, texts, keys, who, at, hit.value.has(keys), need)

    parts = seqs.mapInArrow(part_rows, schema + ", need int").select("key", F.col("id").alias("i"), F.col("n").alias("n_i"), F.col("at").alias("at_i"), "need")
    met = parts.join(some.withColumnsRenamed({"id": "j", "n": "n_j"}), "key")
    most = F.expr(f"n_j * {per_mille} div 1000")
    shorter = (F.col("n_i") < F.col("n_j")) | (F.col("n_i") == F.col("n_j")) & (F.col("i") < F.col("j"))
    near = (F.col("n_j") - F.col("n_i") <= most) & (F.abs(F.col("at") - F.col("at_i")) <= most)
    found = met.where(shorter & near).groupBy("i", "j", "strand").agg(F.min("at_i").alias("first"), F.max("at_i").alias("last"), F.max("need").alias("need"))
    return found.where("need = 1 or first < last").select("i", "j", "strand")


def _other_rows(batches, per_mille: int, every, rows):
    """Stretches of opposite strands, of which none is its own sequence's part."""
    for ids, texts in _texts(batches):
        for keys, who, at, _ in _stretches(texts, per_mille, False):
            yield rows(ids, texts, keys, who, at, every.value.has(keys))


def similar_pairs(seqs: DataFrame, per_mille: int, strands: bool = False, costs: Costs | None = None) -> DataFrame:
    """(i, j, score, strand): all pairs i < j of (seq_id, s) with an edit distance of at most per_mille thousandths of
    the longer length (cut down), and that distance. With strands the better of both, + of equals. With costs the
    weighted global distance; a pair within it has no more edits than it over the least cost.

    Sequences with one text all pair with each other; give such texts once (distinct_texts) where they may be many. Null
    texts have no pair, empty ones pair with each other.
    """
    least = min(costs.transition, costs.transversion, costs.gap) if costs else 1
    filled = seqs.where("length(s) > 0")
    if hasattr(seqs, "_scratch_path"):
        filled._scratch_path = seqs._scratch_path
    pairs = Scratch(seqs.sparkSession, "candidates").table(candidates(filled, -(-per_mille // least), strands), "candidates")
    equal = _equal(seqs, strands)
    few = seqs.join(dimension(pairs.select(F.explode(F.array("i", "j")).alias("seq_id")).distinct()), "seq_id", "left_semi")
    text = lambda k: few.select(F.col("seq_id").alias(k), F.col("s").alias(f"s_{k}"))
    n = tasks(seqs)
    both = pairs.join(text("i"), "i").repartition(n, "j").join(text("j").repartition(n, "j"), "j")
    other = F.when(F.col("strand") == "-", revcomp(F.col("s_j"))).otherwise(F.col("s_j")) if strands else F.col("s_j")
    scored = both.withColumn("most", F.expr(f"cast(greatest(length(s_i), length(s_j)) * {per_mille} div 1000 as int)")).withColumn("s_j", other).withColumn("score", within_udf(costs)("s_i", "s_j", "most") if costs else F.expr("levenshtein(s_i, s_j, most)")).where("score > 0")  # equal texts come from _equal()
    ordered = scored.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "score", "strand").unionByName(equal)
    if not strands:
        return ordered
    return ordered.groupBy("i", "j").agg(F.min(F.struct("score", F.when(F.col("strand") == "+", 0).otherwise(1).alias("s"), "strand")).alias("b")).select("i", "j", "b.score", "b.strand")


def _equal(seqs: DataFrame, strands: bool) -> DataFrame:
    """Pairs at distance 0; the shortest have no room for an edit and so no candidates. Only texts whose hash several have meet."""
    hashed = seqs.where("s is not null").select("seq_id", F.xxhash64("s").alias("h"))
    if strands:
        hashed = hashed.unionByName(seqs.where("s is not null").select("seq_id", F.xxhash64(revcomp(F.col("s"))).alias("h")))
    often = hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    few = hashed.join(dimension(often), "h", "left_semi").select("seq_id").distinct()
    a = seqs.where("s is not null").join(dimension(few), "seq_id", "left_semi")
    near = lambda b, sign: a.select(F.col("seq_id").alias("i"), "s").join(b, "s").where("i < j").select("i", "j", F.lit(0).alias("score"), F.lit(sign).alias("strand"))
    out = near(a.select(F.col("seq_id").alias("j"), "s"), "+")
    return out.unionByName(near(a.select(F.col("seq_id").alias("j"), revcomp(F.col("s")).alias("s")), "-")) if strands else out


def distinct_texts(rows: DataFrame, id_col: str = "seq_id", text: str = "s") -> tuple[DataFrame, DataFrame]:
    """(classes, members) of rows (id_col, text): (seq_id, s), one of each text with the smallest id; (seq_id, member)."""
    first = rows.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("s")).agg(F.min(id_col).alias("seq_id"))
    return first.select("seq_id", "s"), rows.select(F.col(id_col).alias("member"), F.col(text).alias("s")).join(first, "s").select("seq_id", "member")
