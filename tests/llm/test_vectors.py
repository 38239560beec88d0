"""The operators on embeddings against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlake.llm import ann, codes, negatives
from seqlake.llm.vectors import Best

SCHEMA = "vec_id long, embedding array<float>, label int, `vec.id` string, hits int, ids int"
BAD = [None, [float("nan")] * 4, [1.0, None, 1.0, 1.0], [float("inf"), 0.0, 0.0, 0.0]]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, y, "x", 1, 2) for i, v, y in rows], SCHEMA).repartition(parts)


def vectors(n, dim, seed, spread=1.0):
    r = np.random.default_rng(seed)
    return (r.standard_normal((n, dim)) * r.uniform(0.5, 0.5 + spread, (n, 1))).astype(np.float32).tolist()


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


# nearest neighbours


def exact_nearest(rows, asks, k):
    good = [(i, np.array(v, np.float64)) for i, v, _ in rows if i is not None and usable(v) and any(v)]
    out = {}
    for i, q in good:
        if asks(i):
            scored = sorted((-(q * v).sum(), j) for j, v in good if j != i and len(v) == len(q))
            out[i, tuple(q)] = [(r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return out


def found_nearest(df, asks, k):
    out = {}
    for r in ann.nearest(df, asks, k=k).collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {i: sorted(x) for i, x in out.items()}


def recall(got, want, k):
    pairs = [(len({x[1] for x in got.get(i, [])} & {x[1] for x in w}), len(w)) for (i, _), w in want.items()]
    return sum(a for a, _ in pairs) / max(1, sum(b for _, b in pairs))


def test_ann_recall_on_the_test_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got, want = found_nearest(df, F.col("vec_id") % 20 == 0, 20), exact_nearest(rows, lambda i: i % 20 == 0, 20)
    assert got.keys() == {i for i, _ in want} and all(len(x) == 20 for x in got.values())
    assert recall(got, want, 20) >= 0.95
    table = {i: np.array(v, np.float64) for i, v, _ in rows}
    for i, hits in got.items():
        assert [h[0] for h in hits] == list(range(1, 21)) and hits == sorted(hits, key=lambda h: (-h[2], h[1]))
        assert all(h[2] == pytest.approx(float((table[i] * table[h[1]]).sum()), abs=1e-12) for h in hits)


def test_ann_with_unequal_norms_and_a_third_of_copies(spark):
    v = vectors(700, 16, 3, 4.0)
    v += [v[5]] * 350
    rows = [(i, x, 0) for i, x in enumerate(v)]
    got, want = found_nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, 10), exact_nearest(rows, lambda i: i % 20 == 0, 10)
    assert recall(got, want, 10) >= 0.95
    copy = got[760]  # of equal scores the smaller ids
    assert all(a[1] < b[1] for a, b in zip(copy, copy[1:]) if a[2] == b[2])


def test_ann_verifies_a_part_of_the_block_only():
    r = np.random.default_rng(1)
    centre = r.standard_normal((20, 32))
    m = np.repeat(centre, 100, 0) + 0.1 * r.standard_normal((2000, 32))
    most = float(np.sqrt((m * m).sum(1)).max())
    pack = ann._index_block(ann.PROJECTIONS, most)([np.arange(2000)], m)
    best = Best(20, 10)
    verified = ann.search_block(m[::100], np.arange(0, 2000, 100), best, m, pack["ids"], pack["places"], pack["sorted"], most)
    assert verified < 0.5 * 20 * 2000
    want = [set(np.argsort(-np.where(np.arange(2000) == 100 * q, -np.inf, m @ m[100 * q]))[:10].tolist()) for q in range(20)]
    assert sum(len(w & set(best.id[q].tolist())) for q, w in enumerate(want)) >= 190


def test_ann_edges(spark):
    rows = [(20 * k, x, 1) for k, x in enumerate(BAD)] + [(100, [0.0] * 4, 1), (None, [1.0] * 4, 1), (200, [1.0, 0.0, 0.0, 0.0], None), (201, [0.5] * 4, 2), (202, [0.5] * 4, 2), (202, [0.5] * 4, 2), (220, [1.0, 2.0], 3), (240, [], 3)]
    got = found_nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, 20)
    assert got == {200: [(1, 201, 0.5), (2, 202, 0.5), (3, 202, 0.5)]}
    assert found_nearest(frame(spark, []), F.col("vec_id") % 20 == 0, 20) == {}
    assert found_nearest(frame(spark, [(1, [1.0], 1)]), F.col("vec_id") % 20 == 0, 20) == {}
    equal = [(40, [1.0, 1.0], 1)] * 2 + [(40, [1.0, -1.0], 1), (41, [2.0, 0.0], 1)]
    asked = ann.nearest(frame(spark, equal), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in asked) == [(40, 1, 41, 2.0)] * 2  # one row each for the two vectors


def test_best_keeps_small_ids_of_equal_scores():
    random.seed(4)
    best, seen = Best(1, 5), []
    for _ in range(30):
        part = [(random.randrange(6), random.randrange(1000)) for _ in range(random.randrange(40))]
        seen += part
        best.add(0, np.array([s for s, _ in part], float), np.array([i for _, i in part], np.int64))
    want = sorted(seen, key=lambda x: (-x[0], x[1]))[:5]
    assert list(zip(best.score[0].tolist(), best.id[0].tolist())) == want


# codes


def exact_codes(rows, scale=4096, parts=8, entries=16, rounds=6):
    kept = sorted(((i is None, i or 0, v, y) for i, v, y in rows if usable(v)), key=lambda r: r[:3])
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    whole = [[math.floor(float(np.float32(x)) * scale) for x in r[2]] for r in kept]
    cut = codes.cuts(len(whole[0]), parts)
    books = [[v[s] for v in whole[:entries]] for s in cut]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for k, s in enumerate(cut):
            to = [[] for _ in books[k]]
            for v in whole:
                to[best(v[s], books[k])[1]].append(v[s])
            books[k] = [[sum(c) // len(g) for c in zip(*g)] if g else old for g, old in zip(to, books[k])]
    found = [[best(v[s], books[k]) for k, s in enumerate(cut)] for v in whole]
    text = ",".join(str(x) for b in books for e in b for x in e)
    rows = [(None if none else i, y, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for (none, i, _, y), f in zip(kept, found)]
    total = {}
    for _, y, _, e in rows:
        total[y] = total.get(y, 0) + e
    return sorted([(i, c, e, total[y], hashlib.sha256(text.encode()).hexdigest()) for i, y, c, e in rows], key=repr)


def found_codes(df, **options):
    return sorted(map(tuple, codes.digests(df, **options).collect()), key=repr)


def test_codes_equal_brute_force(spark):
    v = vectors(120, 16, 8) + [[1.0] * 16] * 60
    rows = [(i, x, None if i % 9 == 0 else i % 4) for i, x in enumerate(v)] + [(None, v[3], 1), (7, v[9], 2), (7, v[9], 2), (300, v[0][:8], 1), (-5, None, 1), (-6, [float("nan")] * 16, 1)]
    assert found_codes(frame(spark, rows)) == exact_codes(rows)
    assert found_codes(frame(spark, rows), parts=3, entries=5, rounds=2) == exact_codes(rows, parts=3, entries=5, rounds=2)
    assert found_codes(frame(spark, rows), scale=3, rounds=0) == exact_codes(rows, scale=3, rounds=0)  # many ties


def test_codes_edges(spark):
    assert found_codes(frame(spark, [])) == [] and found_codes(frame(spark, [(1, x, 1) for x in BAD])) == []
    few = [(3, [0.5] * 8, 1), (4, [0.25] * 8, None)]  # fewer rows than entries
    assert found_codes(frame(spark, few)) == exact_codes(few)
    long = [(k, [2.0**13 + k] * 8, 1) for k in range(5)]  # beyond 16 bits
    assert found_codes(frame(spark, long)) == exact_codes(long)


@pytest.mark.parametrize("scale", [3, 1 << 12, 1 << 40])
def test_exponion_equals_a_full_search(scale):
    r = np.random.default_rng(scale % 97)
    for wide in (1, 3, 8):
        book = np.floor(r.standard_normal((16, wide)) * scale).astype(np.int64)
        book[7] = book[2]  # equal entries
        x = np.concatenate([np.floor(r.standard_normal((200, wide)) * scale).astype(np.int64), book])
        entry, least, made = codes.exponion(x, book, r.integers(0, 16, len(x)))
        full = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(row, c)), e) for e, c in enumerate(book)) for row in x]
        assert list(zip(least.tolist(), entry.tolist())) == full
        again = codes.exponion(x, book, entry)
        assert again[0].tolist() == entry.tolist() and again[2] < made


# hard negatives


def exact_negatives(rows, asks, positives=5, negatives=3, share=(50, 95), scale=256):
    good = [(i, tuple(math.floor(float(x) * scale) for x in v), y) for i, v, y in rows if i is not None and y is not None and usable(v)]
    out = []
    for i, a, y in set(r for r in good if asks(r[0])):
        scored = sorted((-sum(p * q for p, q in zip(a, v)), j, z) for j, v, z in good if j != i and len(v) == len(a))
        for s, p, _ in [x for x in scored if x[2] == y][:positives]:
            fit = [x for x in scored if x[2] != y and share[0] * -s <= 100 * -x[0] <= share[1] * -s][:negatives]
            out += [(i, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(fit)]
    return sorted(out)


def found_negatives(df, **options):
    return sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 50 == 0, **options).collect()))


def test_negatives_equal_brute_force(spark):
    v = vectors(600, 8, 5, 3.0)
    v += [v[50]] * 200
    rows = [(i, x, i % 3 if i % 11 else None) for i, x in enumerate(v)] + [(150, v[151], 2), (150, v[150], 0), (150, v[150], 0), (None, v[1], 1), (100, v[7][:5], 1), (104, v[8][:5], 1), (105, v[9][:5], 2)]
    assert found_negatives(frame(spark, rows)) == exact_negatives(rows, lambda i: i % 50 == 0)
    assert found_negatives(frame(spark, rows), positives=2, negatives=9, share=(0, 200)) == exact_negatives(rows, lambda i: i % 50 == 0, 2, 9, (0, 200))


def test_negatives_edges(spark):
    assert found_negatives(frame(spark, [])) == [] and found_negatives(frame(spark, [(50, x, 1) for x in BAD])) == []
    zero = [(0, [0.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 2), (50, [1.0, 1.0], 2)]  # scores of zero; no positive for some
    assert found_negatives(frame(spark, zero)) == exact_negatives(zero, lambda i: i % 50 == 0)
    large = [(0, [2.0**18, 2.0**17], 1), (1, [2.0**18, 1.0], 1), (2, [2.0**17, 3.0], 2), (3, [2.0**17, 2.0**17], 2)]  # beyond 53 bits
    assert found_negatives(frame(spark, large)) == exact_negatives(large, lambda i: i % 50 == 0)


def test_negatives_check_few_scores():
    r = np.random.default_rng(2)
    m = np.floor(256 * (np.repeat(r.standard_normal((10, 6)), 200, 0) + 0.05 * r.standard_normal((2000, 6)))).astype(np.int64)
    square = float((m * m).sum(1).max())
    wide = negatives.widened(m, square)
    pivots = negatives.farthest_first(wide, negatives.PIVOTS)
    miner = negatives.Miner(np.arange(0, 2000, 50), np.repeat(np.arange(2), 20), m[::50], pivots, square, 5)  # five groups of like vectors a label
    miner.block(np.arange(2000), np.arange(2000) // 1000, m, negatives.spans(wide, pivots))
    assert miner.checked < 0.5 * 40 * 1000
    for a in range(40):
        s = m[a // 20 * 1000 : a // 20 * 1000 + 1000] @ m[50 * a]
        s[50 * a % 1000] = np.iinfo(np.int64).min
        assert sorted(miner.best[0].score[a].tolist()) == sorted(s.tolist())[-5:]


def test_brackets_hold_the_score():
    r = np.random.default_rng(6)
    m = np.floor(256 * r.standard_normal((300, 12)) * r.uniform(0.1, 3, (300, 1))).astype(np.int64)
    square = float((m * m).sum(1).max())
    wide = negatives.widened(m, square)
    pivots = negatives.farthest_first(wide, 8)
    away, own = negatives.spans(wide, pivots), negatives.spans(np.column_stack([m.astype(float), np.zeros(300)]), pivots)
    for a in range(300):
        least, most = negatives.brackets(square, float((m[a] ** 2).sum()), own[a], away)
        s = m @ m[a]
        assert (least <= s).all() and (s <= most).all()

