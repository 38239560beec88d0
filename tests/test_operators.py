"""Small fixtures with results worked out by hand, and slow restatements on random input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlake.functions import sequence as sq
from seqlake.functions.parse import index_list
from seqlake.operators import align, cluster, coords, ordinal, similar, sv, tandem


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


def test_contigs_gaps_and_masks(spark):
    lines = spark.createDataFrame(
        [(0, 0, "S", 0, "chr1"), (0, 1, "C", 100, None), (0, 2, "G", 10, None), (0, 3, "C", 50, None), (0, 4, "G", 5, None), (1, 0, "S", 0, "chr2"), (1, 1, "C", 7, None)],
        "seq long, ord long, typ string, len long, name string",
    )
    scaffold, contig = coords.contig_table(lines)
    assert rows(scaffold, "name", "len") == [("chr1", 165), ("chr2", 7)]
    assert rows(contig, "seq", "len", "pos") == [(0, 50, 110), (0, 100, 0), (1, 7, 0)]
    c = spark.createDataFrame([(0, 0, 100, 0), (1, 0, 50, 110), (2, 1, 7, 0)], "ctg long, seq long, len long, pos long")
    assert sorted(r.gap for r in coords.gaps(c, scaffold).collect()) == [5, 10]
    bed = spark.createDataFrame([(0, 90, 120)], "seq long, start long, end long")
    assert rows(coords.project_masks(bed, c)) == [(0, 90, 100), (1, 0, 10)]
    assert rows(coords.masks_as_written(bed)) == [(0, 90, 120)]
    totals = coords.gdb_totals(c).first()
    assert (totals.n_seq, totals.n_ctg, totals.n_gap, totals.tot_ctg, totals.tot_seq) == (2, 3, 1, 157, 167)


def test_bed_rules(spark):
    s = spark.createDataFrame([("chr1", 100)], "name string, len long")
    bed = spark.createDataFrame([("chr1", 0, 100), ("chr1", 5, 101), ("chrX", 0, 1), ("chr1", 7, 6), ("chr1", -1, 3)], "name string, start long, end long")
    assert coords.bed_violations(bed, s).count() == 4
    with pytest.raises(Exception, match="bad interval"):
        coords.checked(bed, F.col("start") <= F.col("end"), "bad interval").collect()


def test_score(spark):
    df = spark.createDataFrame([(3, 7), (None, 7), (0, 10)], "d long, n long")
    assert [r[0] for r in df.select(tandem.score(F.col("d"), F.col("n"))).collect()] == [571, 0, 1000]


def test_greedy_and_splice(spark):
    r = [(0, 100, 160, 10), (0, 120, 140, 5), (0, 160, 200, 8), (0, 190, 230, 4), (0, 230, 240, 3)]
    got = tandem.greedy(spark.createDataFrame(r, "seq long, start long, end long, unit long"))
    assert rows(got) == [(0, 100, 160, 10), (0, 160, 200, 8), (0, 230, 240, 3)]
    seqs = spark.createDataFrame([(0, "acgt" * 75), (1, "ttt")], "seq long, dna string")
    out = dict(rows(tandem.splice(seqs, got)))
    s = "acgt" * 75
    assert len(out[0]) == 211 and out[0] == s[:110] + s[160:168] + s[200:230] + s[230:233] + s[240:] and out[1] == "ttt"


@pytest.mark.parametrize("seed", range(3))
def test_greedy_against_scan(spark, seed):
    rng = random.Random(seed)
    data = sorted({(rng.randrange(3), s := rng.randrange(500), s + rng.randrange(1, 40), rng.randrange(1, 9)) for _ in range(300)})
    want, last = [], {}
    for q, s, e, u in data:
        if s >= last.get(q, -1):
            want.append((q, s, e, u))
            last[q] = e
    assert rows(tandem.greedy(spark.createDataFrame(rng.sample(data, len(data)), "seq long, start long, end long, unit long"))) == want


@pytest.mark.parametrize("width", [1, 16, 1 << 16])
def test_greedy_whatever_the_buckets(spark, width):
    """Dense overlaps, long rows over many buckets, equal rows, empty rows."""
    rng = random.Random(7)
    data = sorted((rng.choice("xy"), s := rng.randrange(900), s + rng.choice([0, 1, 5, 30, 400]), 1) for _ in range(400))
    want, last = [], {}
    for q, s, e, u in data:
        if s >= last.get(q, -1):
            want.append((q, s, e, u))
            last[q] = e
    mixed = spark.createDataFrame(rng.sample(data, len(data)), "seq string, start long, end long, unit long")
    got = tandem.greedy(mixed, width)
    assert rows(got) == want
    assert rows(tandem.greedy(mixed, width, dense=0)) == want  # a cut at every bucket
    assert rows(tandem.greedy(got.where("start < 0"), width)) == [] == rows(tandem.greedy_dense(got.where("start < 0"), width))


def test_a_dense_stretch_is_dealt_out(spark):
    """One sequence without a clean cut: its buckets are read by many tasks, and give what one scan gives."""
    n = 60_000
    made = spark.range(n).select(F.lit(1).alias("seq"), (F.col("id") * 7).alias("start"), (F.col("id") * 7 + 1 + F.col("id") * 2654435761 % 3000).alias("end"), F.lit(1).cast("long").alias("unit"))
    got = tandem.greedy(made, 1 << 12, dense=1000)
    want, last = [], 0
    for k in range(n):
        if 7 * k >= last:
            last = 7 * k + 1 + k * 2654435761 % 3000
            want.append((1, 7 * k, last, 1))
    assert rows(got) == want and rows(tandem.greedy(made, 1 << 12)) == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tasks = tandem.greedy(made, 1 << 12, dense=1000).select(F.spark_partition_id()).distinct().count()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 1


def test_splice_takes_linear_time(spark):
    """Two million bases with 20,000 repeats: each is cut out once."""
    n = 2_000_000
    seq = spark.range(1).select(F.col("id").alias("seq"), F.repeat(F.lit("acgt"), n // 4).alias("dna"))
    rep = spark.range(20_000).select(F.lit(0).cast("long").alias("seq"), (F.col("id") * 100 + 7).alias("start"), (F.col("id") * 100 + 57).alias("end"), F.lit(9).cast("long").alias("unit"))
    got = tandem.splice(seq, rep).first().dna
    text = "acgt" * (n // 4)
    assert got == text[:7] + "".join(text[k : k + 9] + text[k + 50 : k + 100] for k in range(7, n, 100))
    odd = tandem.splice(spark.createDataFrame([(1, None), (2, ""), (3, "acgtacgt")], "seq long, dna string"), spark.createDataFrame([(3, 2, 4, 0), (3, 6, 90, 5), (2, 0, 3, 2)], "seq long, start long, end long, unit long"))
    assert {r.seq: r.dna for r in odd.collect()} == {1: None, 2: "", 3: "acacgt"}


def test_consensus(spark):
    c = spark.createDataFrame([(0, x) for x in ("acgt", "acga", "tcga", "ncgc")] + [(1, "nann"), (1, "ntnn")], "arr long, copy string")
    got = {r.arr: r for r in tandem.consensus(c, 4).collect()}
    assert (got[0].consensus, got[0].matched, got[0].score) == ("acga", 12, 750)
    assert (got[1].consensus, got[1].matched) == ("nann", 1)
    head = spark.range(1).select(tandem.fasta_header(F.lit(4), F.lit("s"), F.lit(1), F.lit(9), F.lit(2), F.lit(750))).first()[0]
    assert head == ">cons4#s:1-9#2#75.0"


def test_exact_copies(spark):
    p = spark.createDataFrame([([0, 20, 40, 61, 81],)], "p array<long>")
    assert p.select(tandem.starts_of(F.col("p"), F.lit(20))).first()[0] == [0, 20, 61]
    assert p.select(tandem.starts_of(F.col("p"), F.lit(19))).first()[0] == []
    steps = p.select(F.lit(1).alias("arr"), F.explode("p").alias("p"))
    assert rows(tandem.exact_copies(steps, 20)) == [(1, 0), (1, 20), (1, 61)]
    assert rows(tandem.best_array(tandem.exact_copies(steps, 20))) == [(1, 3)]
    assert rows(tandem.best_array(tandem.exact_copies(steps, 19))) == []


def overlap(spark, *r):
    return spark.createDataFrame(r, "aread long, bread long, comp int, ab long, ae long, bb long, be long")


def test_insertions(spark):
    i, j = (0, 0, 0, 0, 2000, 0, 2000), (0, 0, 0, 2500, 4500, 2010, 4010)
    got = sv.insertions(overlap(spark, i, j)).first()
    assert (got.a_begin, got.a_end, got.b_match_begin, got.b_match_end, got.lflank, got.rflank) == (2000, 2500, 2000, 2010, 2000, 2000)
    assert sv.insertions(overlap(spark, i, (0, 0, 0, 2500, 4500, 2051, 4051))).count() == 0
    assert sv.insertions(overlap(spark, i, (0, 0, 0, 2000, 4000, 2010, 4010))).count() == 0
    back = overlap(spark, (0, 0, 1, 2500, 4500, 0, 2000), (0, 0, 1, 0, 2000, 2010, 4010))
    got = sv.insertions(back)
    assert rows(got, "a_begin", "a_end") == [(2000, 2500)]
    text = spark.createDataFrame([(0, "ac" * 2000)], "ctg long, txt string")
    term = sv.with_terminal(got, sv.chunks(sv.pieces(text), 512, 64), size=512, strip=64).first().term_seq
    s = ("ac" * 2000)[1970 : 1970 + 70]
    assert term == s[::-1].translate(str.maketrans("acgt", "tgca"))
    assert rows(sv.flip(sv.flip(back))) == rows(back.select("aread", "bread", "comp", "bb", "be", "ab", "ae"))
    for bad in ({"min_size": 9, "max_size": 1}, {"min_flank": 10}):
        with pytest.raises(ValueError):
            sv.SvOptions(**bad)


@pytest.mark.parametrize(("size", "strip", "most"), [(8, 4, 0), (64, 64, 1 << 20), (60, 20, 0), (1 << 14, 1 << 12, 1 << 20)])
def test_pieces_across_chunks(spark, monkeypatch, size, strip, most):
    """Pieces of every length, far longer than a chunk, out of bounds and repeated, from chunks that don't overlap."""
    monkeypatch.setattr(sv, "BROADCAST", most)
    rng = random.Random(2)
    texts = {k: "".join(rng.choice("acgt") for _ in range(n)) for k, n in enumerate((0, 1, 500, 1300))}
    want = [(k, a, a + n, x) for k, t in [*texts.items(), (9, "")] for a in range(-2, len(t) + 2, 17) for n in (-1, 0, 1, 20, 40, 333) for x in (1, 1, 2)]
    df = spark.createDataFrame(want, "ctg long, a long, e long, x int")
    parts = sv.chunks(sv.pieces(spark.createDataFrame(list(texts.items()), "ctg long, txt string"), 50), size, strip)
    assert sum(r.n for r in parts.collect()) == 1801 and rows(sv.lengths(parts, size)) == [(1, 1), (2, 500), (3, 1300)]
    got = sv.cut_pieces(df, "ctg", F.col("a"), F.col("e") - F.col("a"), parts, "piece", size, strip)
    piece = lambda k, a, e: texts[k][a:e] if texts.get(k) and 0 <= a <= e <= len(texts[k]) else None
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((k, a, e, x, piece(k, a, e)) for k, a, e, x in want), key=repr)


def test_sequences_of_several_rows(spark):
    rng = random.Random(8)
    docs = [(k % 3, k, "".join(rng.choice("acgt") for _ in range(rng.randrange(90)))) for k in range(300)] + [(1, 300, None)]
    placed = sv.joined_pieces(spark.createDataFrame(docs, "ctg long, k long, txt string"), F.floor(F.col("k") / 16), "k")
    whole = {c: "".join(t or "" for x, _, t in docs if x == c) for c in range(3)}
    assert all(whole[r.ctg][r.start : r.start + len(r.txt)] == r.txt for r in placed.collect())
    made = {c: "".join(s for r in sorted((r for r in sv.chunks(placed, 512, 64).collect() if r.ctg == c), key=lambda r: r.chunk) for s in r.strips) for c in range(3)}
    assert made == whole


def test_whole_variants(spark):
    """Two alignments with an insertion between them: sequences, extensions, names and the lines of the file."""
    rng = random.Random(5)
    a, b = ("".join(rng.choice("acgt") for _ in range(9000)) for _ in range(2))
    texts = spark.createDataFrame([(0, a), (1, b)], "ctg long, txt string")
    contigs = spark.createDataFrame([(0, "chrA", 100, 9000), (1, "chrB", 5, 9000)], "ctg long, name string, pos long, len long")
    ov = overlap(spark, (0, 1, 0, 10, 2010, 100, 2100), (0, 1, 0, 2500, 4500, 2110, 4110), (0, 1, 0, 2500, 4500, 2111, 4111))
    parts = sv.chunks(sv.pieces(texts))
    got = sv.variants(ov, parts, parts, contigs, contigs)
    r = got.first()
    assert got.count() == 1 and r.id == "chrA:2110-2600_chrB:2105-2115" and (r.lext, r.rext) == (30, 30)
    assert r.ins_seq == a[1980:2530] and r.term_seq == b[2070:2140] and sv.out_of_bounds(got).count() == 0
    lines = sorted(sv.variant_lines(got).collect(), key=lambda x: x.line_no)
    assert "".join(x.type for x in lines) == "osmfxqVBFXQSI" and lines[6].list_str == "chrA" and lines[6].fields[1].i == 2110
    assert lines[-2].list_str == r.ins_seq and lines[0].fields[0].i == 50


def test_insertions_against_loop(spark):
    rng = random.Random(4)
    data = []
    for _ in range(300):
        bb, ab = rng.randrange(0, 20000), rng.randrange(0, 20000)
        data.append((rng.randrange(2), 0, rng.randrange(2), ab, ab + rng.randrange(900, 3000), bb, bb + rng.randrange(900, 3000)))
    want = []
    for a, b, c, ab, ae, bb, be in data:
        for a2, b2, c2, ab2, ae2, bb2, be2 in data:
            if (a, b, c) == (a2, b2, c2) and min(ae - ab, be - bb) >= 1000 and min(ae2 - ab2, be2 - bb2) >= 1000 and abs(bb2 - be) <= 50:
                lo, hi = (ae, ab2) if c == 0 else (ae2, ab)
                if 0 < hi - lo < 50000:
                    want.append((a, b, c, lo, hi, be, bb2))
    got = rows(sv.insertions(overlap(spark, *rng.sample(data, len(data)))), "a", "b", "comp", "a_begin", "a_end", "b_match_begin", "b_match_end")
    assert got == sorted(want) and want


@pytest.mark.parametrize(
    ("a", "b", "want", "unit", "loop"),
    [("acgt", "acgt", 0, 0, (0, 0)), ("acgt", "gcgt", 1, 1, (1, 0)), ("acgt", "ccgt", 2, 1, (2, 0)), ("acgtacgt", "acgacgt", 3, 1, (2, 4)), ("gtac", "acgt", 4, 4, (0, 2))],
)
def test_distance(a, b, want, unit, loop):
    assert align.distance(a, b)[0] == align.distance(b, a)[0] == want
    assert align.distance(a, b, align.Costs(1, 1, 1))[0] == unit
    assert align.distance(a, b, align.Costs(loop=True)) == loop


def slow_distance(s1, s2, c):
    if len(s2) > len(s1):
        s1, s2 = s2, s1
    n = len(s2)
    cost = lambda x, y: 0 if x == y else c.transition if {x, y} in ({"a", "g"}, {"c", "t"}) else c.transversion
    prev = [0 if c.loop else j * c.gap for j in range(n + 1)]
    for i, x in enumerate(s1, 1):
        row = [min(prev[n - 1] + cost(x, s2[-1]), c.gap + prev[n]) if c.loop else i * c.gap]
        for j in range(1, n + 1):
            row.append(min(prev[j - 1] + cost(x, s2[j - 1]), c.gap + min(prev[j], row[j - 1])))
        prev = row
    if not c.loop:
        return prev[n], 0
    best = min(prev[:n])
    return (best, prev.index(best)) if best < 3 * len(s1) else (3 * len(s1), 0)


def test_distance_against_loop():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ("".join(rng.choice("acgt") for _ in range(rng.randint(1, 25))) for _ in range(2))
        for c in (align.Costs(), align.Costs(loop=True), align.Costs(2, 2, 5), align.Costs(1, 1, 1, True)):
            assert align.distance(a, b, c) == slow_distance(a, b, c)


def test_distances_in_blocks(monkeypatch):
    """Pairs of all lengths at once, whatever the size of a block; empty sequences too."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("acgtn") for _ in range(rng.choice([0, 1, 2, 9, 30])))
    a, b = [word() for _ in range(120)], [word() for _ in range(120)]
    for cells in (8, 1 << 21):
        monkeypatch.setattr(align, "CELLS", cells)
        for c in (align.Costs(), align.Costs(loop=True)):
            got = list(zip(*align.distances(a, b, c)))
            for x, y, g in zip(a, b, got):
                if x and y:
                    assert g == slow_distance(x, y, c), (x, y, c)
                else:
                    assert g == (3 * max(len(x), len(y)), 0)


def test_distances_in_bands(monkeypatch):
    """The scores of the whole table up to the threshold, whatever the lengths and the size of a block."""
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("acgtn") for _ in range(rng.choice([0, 1, 2, 9, 30])))
    a = [word() for _ in range(200)]
    b = [mutated(rng, x, rng.randrange(5)) if rng.random() < 0.7 else word() for x in a]
    most = [rng.choice([-1, 0, 1, 2, 5, 9, 200]) for _ in a]
    for cells in (8, 1 << 21):
        monkeypatch.setattr(align, "CELLS", cells)
        for c in (align.Costs(), align.Costs(1, 1, 1), align.Costs(2, 3, 2)):
            whole = align.distances(a, b, c)[0]
            assert align.distances_within(a, b, most, c) == [v if v <= k else -1 for v, k in zip(whole, most)]
    with pytest.raises(ValueError):
        align.distances_within(["a"], ["a"], [1], align.Costs(loop=True))


def test_score_matrix_against_loop(monkeypatch):
    """Tables of all pairs of two blocks as differences, whatever the lengths, the costs and how many are filled at once."""
    rng = random.Random(61)
    word = lambda: "".join(rng.choice("acgtn") for _ in range(rng.choice([0, 1, 2, 9, 30])))
    a, b = [word() for _ in range(25)], [word() for _ in range(30)]
    for pairs, tables in ((1, 1), (7, 200), (4096, 1 << 22)):
        monkeypatch.setattr(align, "PAIRS", pairs)
        monkeypatch.setattr(align, "TABLES", tables)
        for c in (align.Costs(), align.Costs(1, 1, 1), align.Costs(2, 3, 4), align.Costs(1, 2, 90)):
            got = align.score_matrix(a, b, c).tolist()
            assert got == [[slow_distance(x, y, c)[0] if x and y else c.gap * max(len(x), len(y)) for y in b] for x in a]


def test_loop_scores_against_loop(monkeypatch):
    rng = random.Random(62)
    texts = ["".join(rng.choice("acgtn") for _ in range(rng.choice([1, 2, 9, 30]))) for _ in range(40)]
    both = [(i, j) for i, s in enumerate(texts) for j, t in enumerate(texts) if len(s) >= len(t)]
    for tables in (1, 1 << 22):
        monkeypatch.setattr(align, "TABLES", tables)
        for c in (align.Costs(loop=True), align.Costs(1, 1, 1, True), align.Costs(2, 3, 4, True)):
            score, end = align.loop_scores(texts, *map(np.array, zip(*both)), c)
            assert list(zip(score.tolist(), end.tolist())) == [slow_distance(texts[i], texts[j], c) for i, j in both]


@pytest.mark.parametrize("costs", [align.Costs(), align.Costs(1, 1, 1), align.Costs(loop=True)])
def test_score_pairs_against_loop(spark, monkeypatch, costs):
    """Many ids of one text, equally long texts, empty and null ones, in one block and in several."""
    rng, comp = random.Random(63), str.maketrans("acgt", "tgca")
    texts = ["".join(rng.choice("acgt") for _ in range(n)) for n in (1, 6, 6, 7, 7, 12)] + ["", None]
    data = [(k * 7 % 61 - 20, rng.choice(texts)) for k in range(61)]
    score = lambda s, t: slow_distance(s, t, costs) if s and t else (costs.gap * max(len(s), len(t)), 0)
    want, near = [], []
    for i, s in data:
        for j, t in data:
            if i < j and s is not None and t is not None:
                f, r = score(s, t), score(s, t[::-1].translate(comp))
                want.append((i, len(s), j, len(t), min(f[0], r[0]), "+" if f[0] <= r[0] else "-", (f if f[0] <= r[0] else r)[1]))
                if f[0] <= max(len(s), len(t)) * 600 // 1000:
                    near.append((i, len(s), j, len(t), f[0]))
    seqs = spark.createDataFrame(data, "seq_id long, s string")
    monkeypatch.setattr(align, "UNIT", 3)
    for block in (1, 4):
        assert rows(align.score_pairs(seqs, costs, block)) == sorted(want)
        assert rows(align.score_pairs(seqs, costs, block, strands=False, within=600)) == sorted(near)


def test_all_pairs_of_few_texts(spark):
    """What is sent grows with the blocks, and a text is aligned once whatever the ids that have it: 2 million pairs of 40 texts."""
    rng = random.Random(64)
    texts = ["".join(rng.choice("acgt") for _ in range(60)) for _ in range(40)]
    seqs = spark.createDataFrame([(k, texts[k % 40]) for k in range(2000)], "seq_id long, s string")
    units = align._units(seqs)
    assert units.count() <= 40 and units.select(F.explode("ids")).count() == 2000
    assert align.block_count(spark.range(40000).select(F.lit("acgt").alias("s"))) <= 10
    got = align.score_pairs(seqs).agg(F.count("*"), F.sum(F.when(F.col("i") % 40 == F.col("j") % 40, F.col("score"))), F.sum("score")).first()
    one = {(s, t): min(align.distance(s, t)[0], align.distance(s, t[::-1].translate(str.maketrans("acgt", "tgca")))[0]) for s in texts for t in texts}
    assert tuple(got) == (2000 * 1999 // 2, 0, sum(one[s, t] * 2500 for i, s in enumerate(texts) for t in texts[i + 1 :]))


def test_estimate_factor_against_loop(spark):
    rng = random.Random(65)
    data = [(k, "".join(rng.choice("ac") for _ in range(rng.randrange(1, 5)))) for k in range(60)]
    got = align.estimate_factor(spark.createDataFrame(data, "seq_id long, s string")).first()
    each = [align.distance(s, t)[0] * 100 / max(len(s), len(t)) for i, s in data for j, t in data if i < j]
    assert got.mean == pytest.approx(sum(each) / len(each)) and got.factor == pytest.approx(0.009 * got.mean)


@pytest.mark.parametrize("strands", [False, True])
def test_similar_pairs_by_weight(spark, strands):
    rng, comp, c = random.Random(33), str.maketrans("acgt", "tgca"), align.Costs(2, 4, 3)
    data = ["".join(rng.choice("acgt") for _ in range(n)) for n in (8, 20, 33, 50)]
    data += [mutated(rng, s, rng.randrange(4)) for s in data for _ in range(5)]
    data += [s[::-1].translate(comp) for s in data[::4]]
    want = []
    for i, s in enumerate(data):
        for j, t in enumerate(data[:i]):
            score, strand = min((align.distance(s, x, c)[0], n) for n, x in enumerate([t, t[::-1].translate(comp)][: 1 + strands]))
            if score <= max(len(s), len(t)) * 200 // 1000:
                want.append((j, i, score, "+-"[strand]))
    seqs = spark.createDataFrame(list(enumerate(data)), "seq_id long, s string")
    assert rows(similar.similar_pairs(seqs, 200, strands, c)) == sorted(want) and want


def test_cluster_report(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (8, 7), (7, 7)], "node long, label long")
    seqs = spark.createDataFrame([(1, "aaaaaaaac"), (2, "aaaaaagtc"), (3, "aaaaaaaa"), (7, "aaaa"), (8, "aaac")], "seq_id long, s string")
    sums = cluster.inner_sums(labels, seqs)
    assert rows(sums) == [(1, 1, 3), (1, 2, 5), (1, 3, 4), (7, 7, 1), (7, 8, 1)]
    medoid = cluster.medoids(sums, seqs.select(F.col("seq_id").alias("node"), F.length("s").alias("len")))
    got = cluster.report(labels, medoid, seqs)
    assert rows(got) == [(1, 1, 9, 1, False), (1, 2, 9, 3, False), (1, 3, 8, 0, True), (2, 7, 4, 0, True), (2, 8, 4, 1, False)]
    assert rows(cluster.representative_fasta(got, seqs)) == [(">sat-1-8\naaaaaaaa",), (">sat-2-4\naaaa",)]


def test_pairs_and_sums_in_blocks(spark, monkeypatch):
    rng = random.Random(12)
    data = [(k, "".join(rng.choice("ac") for _ in range(rng.randrange(5)))) for k in range(60)]
    seqs = spark.createDataFrame(data, "seq_id long, s string")
    for block in (1, 3, 7):
        assert rows(align.pairs(seqs, block=block)) == sorted((i, s, j, t) for i, s in data for j, t in data if i < j)
    monkeypatch.setattr(cluster, "BLOCK", 4)
    labels = seqs.select(F.col("seq_id").alias("node"), (F.col("seq_id") % 3).alias("label"))
    want = {k: sum(edits(s, t) for j, t in data if j % 3 == k % 3) for k, s in data}
    assert rows(cluster.inner_sums(labels, seqs)) == sorted((k % 3, k, v) for k, v in want.items())


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return row[-1]


def mutated(rng, s, n):
    for _ in range(n):
        k = rng.randrange(len(s) + 1)
        s = s[:k] + rng.choice(["", rng.choice("acgt"), rng.choice("acgt") + s[k : k + 1]]) + s[k + 1 :]
    return s


@pytest.mark.parametrize(("per_mille", "strands"), [(0, False), (50, True), (120, False), (300, True), (900, False)])
def test_similar_pairs_equal_all_pairs(spark, per_mille, strands):
    rng = random.Random(per_mille)
    word = lambda n: "".join(rng.choice("acgt") for _ in range(n))
    data = ["", "", "a", "a", "t", "ac"] + [word(n) for n in (3, 9, 20, 21, 40, 60, 90)]
    comp = str.maketrans("acgt", "tgca")
    data += [mutated(rng, s, rng.randrange(1 + len(s) // 8)) for s in data for _ in range(4)]
    data += [s[::-1].translate(comp) for s in data[::5]]
    seqs = spark.createDataFrame([(k, s) for k, s in enumerate(data)] + [(999, None)], "seq_id long, s string")
    want = []
    for i, s in enumerate(data):
        for j, t in enumerate(data[:i]):
            score, strand = min((edits(s, x), n) for n, x in enumerate([t, t[::-1].translate(comp)][: 1 + strands]))
            if score <= max(len(s), len(t)) * per_mille // 1000:
                want.append((j, i, score, "+-"[strand]))
    assert rows(similar.similar_pairs(seqs, per_mille, strands)) == sorted(want) and want


def test_similar_candidates_are_few(spark):
    """Families of like sequences: hardly more candidates than links, and as many again for ten times the families."""
    rng = random.Random(3)
    made = {}
    for families in (20, 200):
        data = [mutated(rng, s, 3) for s in ("".join(rng.choice("acgt") for _ in range(150)) for _ in range(families)) for _ in range(4)]
        seqs = spark.createDataFrame(list(enumerate(data)), "seq_id long, s string")
        made[families] = similar.candidates(seqs, 50).count()
        assert similar.similar_pairs(seqs, 50).count() >= 5 * families
    assert made[20] <= 6 * 20 * 1.2 and made[200] <= 6 * 200 * 1.2


def test_distinct_texts(spark):
    seqs = spark.createDataFrame([(3, "ac"), (1, "ac"), (2, "g"), (4, None)], "seq_id long, s string")
    classes, members = similar.distinct_texts(seqs)
    assert rows(classes) == [(1, "ac"), (2, "g")] and rows(members) == [(1, 1), (1, 3), (2, 2)]


def test_placed_insertions(spark, monkeypatch):
    """The rows of insertions(), over borders of places too, of which none is sent again when they are counted, numbered or thinned out."""
    rng, o = random.Random(73), sv.SvOptions(max_size=3000)
    data = []
    for _ in range(600):
        comp, ab, bb, n = rng.randrange(2), rng.randrange(12000), rng.randrange(2000), rng.randrange(1000, 1200)
        data.append((rng.randrange(2), rng.randrange(2), comp, ab, ab + n, bb, bb + n + rng.randrange(3)))
    ovl = spark.createDataFrame(data, "aread long, bread long, comp int, ab long, ae long, bb long, be long")
    got, want = sv.placed_insertions(ovl, o), sv.insertions(ovl, o)
    assert rows(got.drop("__place")) == rows(want) and got.count() > 100
    key = ["a", "__place", "a_begin", "a_end"]
    assert rows(sv.dedup(got, *key).drop("__place")) == rows(sv.dedup(want).select("a", "a_begin", "a_end", "b", "comp", "b_match_begin", "b_match_end", "lflank", "rflank"))
    order = ["a", "a_begin", "a_end", "b", "comp", "b_match_begin", "b_match_end"]
    n = ordinal.dense_ordinal(got, F.col("a") * 1000 + F.floor(F.col("a_begin") / 1500), order, "n", dealt=["a", "__place"])
    assert [tuple(r) for r in n.orderBy("n").select(*order).collect()] == rows(want.select(*order)) and rows(n, "n") == [(k + 1,) for k in range(got.count())]
    for df in (got.groupBy(*key).count(), sv.dedup(got, *key)):
        df.collect()
        assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 2


def test_pieces_across_one_border(spark, monkeypatch):
    """Pieces up to a stated length are cut from one chunk and the beginning of the next, without a written table."""
    rng, text = random.Random(74), "".join(random.Random(75).choice("acgt") for _ in range(200))
    parts = similar.Scratch(spark, "t").table(sv.chunks(spark.createDataFrame([(0, 0, text), (1, 0, text[:37])], "ctg long, start long, txt string"), 32, 8), "c")
    data = [(rng.randrange(3), rng.randrange(-3, 205), rng.randrange(-1, 20)) for _ in range(300)] + [(0, 200, 0), (1, 32, 5), (0, 192, 8)]
    want = [(c, at, n, {0: text, 1: text[:37]}[c][at : at + n] if c < 2 and at >= 0 and n >= 0 and at + n <= (200, 37)[c] else None) for c, at, n in data]
    df = spark.createDataFrame(data, "ctg long, a long, k long")
    monkeypatch.setattr(sv, "Scratch", None)
    for most in (sv.BROADCAST, 0):
        monkeypatch.setattr(sv, "BROADCAST", most)
        assert sorted(rows(sv.cut_pieces(df, "ctg", F.col("a"), F.col("k"), parts, "piece", 32, 8, 20)), key=repr) == sorted(want, key=repr)
    with pytest.raises(Exception, match="longer than 4"):
        sv.cut_pieces(df, "ctg", F.col("a"), F.col("k"), parts, "piece", 32, 8, 4).collect()


@pytest.mark.parametrize("strands", [False, True])
def test_similar_stretches_are_few(spark, monkeypatch, strands):
    """Of unlike texts next to nothing is sent; of like ones what two of them share."""
    rng, kept = random.Random(71), []
    table = similar.Scratch.table
    monkeypatch.setattr(similar.Scratch, "table", lambda self, df, name: (kept.append((name, t := table(self, df, name))), t)[1])
    data = ["".join(rng.choice("acgt") for _ in range(rng.choice([45, 300, 1100]))) for _ in range(60)]
    seqs = spark.createDataFrame(list(enumerate(data)), "seq_id long, s string")
    assert similar.similar_pairs(seqs, 50, strands).count() == 0
    assert dict(kept)["stretches"].count() < 0.02 * sum(map(len, data)) and dict(kept)["candidates"].count() == 0  # every letter before
    like = spark.createDataFrame(list(enumerate(data)) + [(100 + k, mutated(rng, s, len(s) // 40)) for k, s in enumerate(data)], "seq_id long, s string")
    assert rows(similar.similar_pairs(like, 50, strands), "i", "j") == [(k, 100 + k) for k in range(60)]


def test_known_keys():
    """A filter finds all of its keys, and few others."""
    rng = np.random.default_rng(72)
    keys, others = rng.integers(0, 1 << 64, 20000, np.uint64), rng.integers(0, 1 << 64, 20000, np.uint64)
    blobs = similar._tops([keys[:7000], keys[7000:]])
    known = similar._Keys({k: similar._Keys.shard(np.unique(np.frombuffer(b, np.uint32)).astype(np.uint64)) for k, b in zip(blobs.column(0).to_pylist(), blobs.column(1).to_pylist())})
    assert known.has(keys).all() and known.has(others).mean() < 0.02
    assert not similar._Keys({}).has(keys).any()


def test_components_and_medoids(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (9, 8), (8, 7), (7, 6), (3, 3)], "i long, j long")
    assert rows(cluster.components(links)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 6), (8, 6), (9, 6)]
    chain = spark.range(40).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"))
    assert {r.label for r in cluster.components(chain).collect()} == {0}
    assert cluster.components(links.where("i > 99")).count() == 0
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "node long, label long")
    scores = spark.createDataFrame([(1, 2, 5), (1, 3, 5), (2, 3, 9)], "i long, j long, score int")
    sums = cluster.member_sums(scores, labels)
    assert rows(sums) == [(1, 1, 10), (1, 2, 14), (1, 3, 14)]
    sizes = lambda *n: spark.createDataFrame(list(zip((1, 2, 3), n)), "node long, len int")
    assert cluster.medoids(sums, sizes(10, 10, 10)).first().medoid == 1
    assert cluster.medoids(sums, sizes(12, 10, 11)).first().medoid == 2  # 1 is too long


def test_ordinals(spark):
    lines = spark.createDataFrame([(k, t, v) for k, (t, v) in enumerate([("U", 9), ("A", 1), ("D", 2), ("D", 3), ("A", 4), ("U", 5)], 1)], "line_no long, typ string, val long")
    assert rows(ordinal.object_ordinal(lines, "A"), "line_no", "obj") == [(1, 0), (2, 1), (3, 1), (4, 1), (5, 2), (6, 2)]
    assert rows(ordinal.children(lines, "A", ["D", "U"]), "obj", "own", "D") == [(1, 1, 3), (2, 4, None)]
    assert rows(ordinal.ordinal_ranges(ordinal.object_ordinal(lines, "A"), [(0, 2)]), "line_no") == [(1,), (2,), (3,), (4,)]
    many = spark.range(5000).select((4999 - F.col("id")).alias("k"))
    got = ordinal.dense_ordinal(many, F.floor(F.col("k") / 700), ["k"], "n", start=0)
    assert got.where("n <> k").count() == 0 and got.count() == 5000


def test_names_bounds_and_first_hits(spark):
    o = spark.createDataFrame([(5, "b"), (1, "c"), (9, "a"), (2, "b"), (1, "d")], "k long, name string")
    assert rows(coords.name_dictionary(o, "name", "k"), "name", "id") == [("a", 3), ("b", 2), ("c", 0), ("d", 1)]
    c = spark.createDataFrame([(0, 10, 29), (0, 9, 29)], "arr long, p long, len long")
    assert rows(tandem.copies_out_of_bounds(c, 20), "p") == [(10,)]
    with pytest.raises(Exception, match="leaves its sequence"):
        coords.checked(c, F.col("p") + 20 <= F.col("len"), "a copy leaves its sequence").collect()
    assert rows(tandem.first_hit(o, F.col("name") == "b", "k"), "k") == [(2,)]
    both = ordinal.concatenate([o, o.where("k = 9")], F.floor(F.col("k") / 2), ["k", "name"], "n")
    assert [r.n for r in both.orderBy("shard", "k", "name").collect()] == [1, 2, 3, 4, 5, 6]


def test_sequence_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(sq.revcomp(F.lit("ACGTNacgtnRYSWKMBDHV-"))) == "-BDHVKMWSRYnacgtNACGT"
    assert one(sq.revcomp(F.lit("SW"), "reference")) == "SW" and one(sq.revcomp(F.lit("SW"))) == "WS"
    assert one(sq.dna_text(F.lit("ARCGxTn-"))) == "ACGTn" and one(sq.ambiguous_to_n(F.lit("ARcgy"))) == "ANcgn"
    assert one(sq.to_index(F.lit("ACGTN"))) == "01234" and one(sq.from_index(F.lit("01234"))) == "acgtn"
    assert one(sq.first_mismatch(F.lit("acgt"), F.lit("acct"))) == 2 and one(sq.first_mismatch(F.lit("acgt"), F.lit("acgt"))) == 0
    assert one(sq.cut(F.lit("acgtacgt"), F.lit(2), F.lit(5))) == "gta"
    odd = ["nnACgtNtt", "", None, "a", "é☃acé", "acgt", "gt", "n", "tn☃"]
    spans = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "k int, t string").coalesce(1).select("k", "t", sq.contig_spans("t").alias("r"), sq.contig_runs("t").alias("w")).collect()
    assert all((r.r is None and r.t is None) or [(x["pos"], x["len"]) for x in r.r] == [(x["pos"], len(x["run"])) for x in r.w] for r in spans) and len(spans) == 9
    assert [(r.pos, r.run) for r in one(sq.contig_runs(F.lit("nnACgtNtt")))] == [(2, "ACgt"), (7, "tt")] and one(sq.contig_runs(F.lit(""))) == []
    assert one(sq.symbol_runs(F.lit("nnnab"))) == ["nnn", "a", "b"]
    assert one(sq.phred(F.lit("!I"))) == [0, 40] and one(sq.quality_bits(F.array(F.lit(3), F.lit(30)), 20)) == [0, 1]
    assert tuple(one(sq.parse_coordinates(F.lit("chr\\:1:5-90")))) == ("chr\\:1", 5, 90) and tuple(one(sq.parse_coordinates(F.lit("c:5")))) == ("c", 5, None)
    assert [one(sq.leading_integer(F.lit(x))) for x in ("23bp", " -4", "x", "")] == [23, -4, 0, 0]
    assert one(sq.short_name(F.lit("chr1 a"))) == "chr1" and one(sq.unescape_newlines(F.lit("a\\nb"))) == "a\nb"
    assert one(sq.to_four_bits(F.lit("acgtNr-x"))) == [1, 2, 4, 8, 15] and one(sq.to_four_bits(F.lit("acgtNr-x"), True)) == [1, 2, 4, 8, 15, 5, 0]
    assert one(sq.amino_text(F.lit("acbZ*o x"))) == "ACXXX" and one(sq.amino_index(F.lit("ACYbz-"))) == [0, 1, 19, 20, 20] and one(sq.to_index4(F.lit("acgtn"))) == "01230"
    rng = random.Random(3)
    for n in range(40):
        t = "".join(rng.choice("acgt") for _ in range(n))
        assert sq.packed_revcomp(sq.pack_bases(t), n) == sq.pack_bases(t[::-1].translate(str.maketrans("acgt", "tgca"))), n
    packed = spark.range(1).select(sq.pack2bit(F.lit("acgtTGn")).alias("p")).select("p", sq.unpack2bit("p", F.lit(7)).alias("u")).first()
    assert packed.u == "acgttga" and sq.packed_revcomp(bytes(packed.p), 7) == sq.pack_bases("tcaacgt")
    assert sq.unpack_bits(sq.pack_bits([1, 0, 1, 1, 0, 0, 0, 0, 1]), 9) == [1, 0, 1, 1, 0, 0, 0, 0, 1]


def test_index_list():
    assert index_list("0-10,5") == [(0, 10), (5, 6)]
    for bad in ("3-3", "a", "4-2", ""):
        with pytest.raises(ValueError):
            index_list(bad)


def test_streaming_lift(spark, tmp_path):
    from seqlake.streaming import lift_stream

    t = spark.createDataFrame([(0, 1, 11, 5, 1)], "ctg long, beg long, fin long, unit long, diffs long")
    t.write.parquet(str(tmp_path / "in"))
    c = spark.createDataFrame([(0, 3, 100, 50)], "ctg long, seq long, len long, pos long")
    s = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    q = lift_stream(s, c).writeStream.format("memory").queryName("lifted").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("select seq, beg, fin, score from lifted").collect()] == [(3, 51, 61, 900)]
