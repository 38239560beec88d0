"""Compressed lists, statistics of stretches of a file, joined parts, pushed filters, templates."""

import json
import random

import pytest
from pyspark.sql import functions as F

from seqlake.sources import huffman
from seqlake.sources import onefile as of
from seqlake.sources import oneschema as os_
from test_sources import SCHEMA, lines


def schema():
    return os_.parse_schemas(SCHEMA)["tst"]


HISTOGRAMS = {
    "one symbol": {65: 7}, "two": {0: 1, 255: 10**12}, "all bytes": {k: 1 + k % 5 for k in range(256)}, "all bytes, skewed": {k: 1 << min(k, 60) for k in range(256)},
    "fibonacci": {k: [1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987, 1597, 2584, 4181, 6765][k] for k in range(20)}, "text": {ord(c): n for c, n in zip("etaoin shrdlu", range(130, 0, -10))},
}


@pytest.mark.parametrize("name", HISTOGRAMS)
def test_codes(name):
    """Prefix codes of 12 bits at most, as short as can be, serial and back, and any bytes through them."""
    counts = [HISTOGRAMS[name].get(k, 0) for k in range(256)]
    codec = huffman.Codec.of_histogram(counts)
    every = [format(c, f"0{n}b") for n, c in codec.codes.values()] + ([format(codec.escape[2], f"0{codec.escape[1]}b")] if codec.escape else [])
    assert max(map(len, every)) <= 12 and not any(a != b and b.startswith(a) for a in every for b in every) and len(set(every)) == len(every)
    assert set(codec.codes) == set(HISTOGRAMS[name]) and (codec.escape is None) == (len(codec.codes) == 256)
    back = huffman.Codec.load(codec.dump())
    assert back.codes == codec.codes and back.escape == codec.escape
    rng = random.Random(name)
    known = list(HISTOGRAMS[name])
    for n in (0, 1, 7, 8, 9, 31, 64, 65, 1000):
        for data in (bytes(rng.choices(known, k=n)), bytes(rng.choices(range(256), k=n)), bytes([known[-1]] * n)):
            raw, bits = codec.encode(data)
            assert len(raw) == (bits + 7) // 8 and back.decode(raw, bits, n) == data


def test_code_lengths_are_the_best():
    """Against all lengths that a prefix code can have, for few symbols and few bits."""
    rng = random.Random(9)

    def best(weights, most):
        def go(k, room, low):  # heavier symbols get no longer codes
            if k == len(weights):
                return 0
            return min((weights[k] * n + go(k + 1, room - (1 << most - n), n) for n in range(low, most + 1) if room >= (1 << most - n) * 1), default=float("inf"))

        weights = sorted(weights, reverse=True)
        return go(0, 1 << most, 1)

    for _ in range(60):
        weights = [rng.choice([1, 2, 3, 50, 1000]) for _ in range(rng.randrange(2, 8))]
        lengths = huffman.code_lengths(weights, 3)
        assert sum(2.0**-n for n in lengths) <= 1 and sum(w * n for w, n in zip(weights, lengths)) == best(weights, 3)
    with pytest.raises(ValueError):
        huffman.code_lengths([1] * 9, 3)


def test_bytes_by_a_hand_written_code():
    """a = 0, b = 10, escape = 11: 00 0 10 11+01111010 0, worked out on paper."""
    codec = huffman.Codec({0x61: (1, 0), 0x62: (2, 2)}, (0, 2, 3))
    assert codec.encode(b"abza") == (bytes([0b00010110, 0b11110100]), 16)
    assert codec.encode(b"zz") == (b"\xffzz", 24)  # no shorter: as it is
    assert huffman.Codec.load(codec.dump()).decode(bytes([0b00010110, 0b11110100]), 16, 4) == b"abza"


def test_compressed_files(spark, tmp_path):
    """Codes trained by Spark on all lines: the same lines come back, also lazily and through joined parts, from fewer bytes."""
    spark.dataSource.register(of.OneSource)
    s = schema()
    data = lines(60) + [of.Line("I", ["the same words again and again " * 40]), of.Line("T", [list(range(0, 9000, 7))]), of.Line("R", [[0.5, 0.25] * 300])] * 9
    (tmp_path / "x").write_bytes(of.encode_file(s, data, True))
    df = spark.read.format("one").option("object", "A").load(str(tmp_path / "x"))
    counts = {(r.type, r.byte): r.n for r in of.byte_histograms(df, s).collect()}
    want = {}
    for x in data:
        kind = s.lines[x.type].fields
        for f, v in zip(kind, x.values):
            if f in ("STRING", "INT_LIST", "REAL_LIST"):
                for b in of.list_body(f, v)[1]:
                    want[x.type, b] = want.get((x.type, b), 0) + 1
    assert counts == want
    parts = df.repartitionByRange(3, "line_no").sortWithinPartitions("line_no")
    of.write_compressed(parts, str(tmp_path / "out"), SCHEMA)
    files = sorted((tmp_path / "out").iterdir())
    codecs = [of.read_header(str(f)).codecs for f in files]
    assert len(files) == 3 and all({k: c.dump() for k, c in x.items()}.items() <= {k: c.dump() for k, c in of.train_codecs(df, s).items()}.items() for x in codecs)
    back = [x for f in files for _, x in of.Parser(f.read_bytes()).lines()]
    assert back == data and sum(f.stat().st_size for f in files) < 0.6 * (tmp_path / "x").stat().st_size
    of.merge_files([str(f) for f in files], str(tmp_path / "all"))
    p = of.Parser((tmp_path / "all").read_bytes())
    assert [x for _, x in p.lines()] == data and p.header.counts == of.read_header(str(tmp_path / "x")).counts
    lazy = of.Parser((tmp_path / "all").read_bytes())
    lazy.wanted = {"A"}
    assert [x.values for _, x in lazy.lines() if x.type == "A"] == [x.values for x in data if x.type == "A"]
    h = of.Header(s, codecs={"I": huffman.Codec.of_histogram([1] * 256)})
    (tmp_path / "other").write_bytes(of.encode_file(s, data, True, h))
    with pytest.raises(ValueError, match="different codes"):
        of.merge_files([str(files[-1]), str(tmp_path / "other")], str(tmp_path / "bad"))


def test_stretches_cut_anywhere(tmp_path):
    """Parts cut at every place of a file, in two and in three, join to its statistics and index."""
    s, rng = schema(), random.Random(6)
    L = of.Line
    data = [rng.choice([L("A", [1, 1.0, "x"]), L("B", ["acgt"[: rng.randrange(4)]]), L("T", [[1] * rng.randrange(5)]), L("I", ["q" * rng.randrange(3)]), L("F", [])]) for _ in range(14)]
    whole = of.encode_file(s, data, True)
    for a in range(1, len(data)):
        for b in range(a, len(data)):
            made, nested = [], []
            for k, part in enumerate(x for x in (data[:a], data[a:b], data[b:]) if x):
                e = of.Encoder(str(tmp_path / f"p{k}"), s, True)
                for x in part:
                    e.add(x)
                e.close()
                made.append(str(tmp_path / f"p{k}"))
                nested.append(e.nested)
            of.merge_files(made, str(tmp_path / "all"), nested)
            assert (tmp_path / "all").read_bytes() == whole, (a, b)
    empty = of.Nested(s)
    assert of.joined([empty, nested[0], empty]).maxima() == nested[0].maxima()


def test_a_single_file_of_crossing_parts(spark, tmp_path):
    """The writer joins parts that end inside an object; tasks copy the bytes of merge_parts()."""
    spark.dataSource.register(of.OneSource)
    s, data = schema(), lines(50)
    (tmp_path / "x").write_bytes(of.encode_file(s, data, True))
    df = spark.read.format("one").option("object", "A").load(str(tmp_path / "x")).repartitionByRange(4, "line_no").sortWithinPartitions("line_no")
    write = lambda name, **o: [df.write.format("one").mode("append").options(schema_text=SCHEMA, binary="true", **o).save(str(tmp_path / name))]
    write("one", single="true")
    assert (tmp_path / "one" / "all.1tst").read_bytes() == (tmp_path / "x").read_bytes()
    write("many")
    parts = [str(f) for f in sorted((tmp_path / "many").iterdir())]
    for block in (100, 1 << 20):
        of.merge_parts(spark, parts, str(tmp_path / "joined"), block=block)
        assert [x for _, x in of.Parser((tmp_path / "joined").read_bytes()).lines()] == data
    of.merge_files(parts, str(tmp_path / "plain"))
    assert (tmp_path / "joined").read_bytes() == (tmp_path / "plain").read_bytes()


def test_pushed_filters(spark, tmp_path):
    spark.dataSource.register(of.OneSource)
    s, data = schema(), lines(500)
    (tmp_path / "x").write_bytes(of.encode_file(s, data, True))
    (tmp_path / "t").write_bytes(of.encode_file(s, data))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        plain = {f: spark.read.format("one").option("object", "A").load(str(tmp_path / f)) for f in "xt"}
        pushing = lambda f: spark.read.format("one").option("object", "A").option("pushdown", "true").load(str(tmp_path / f))
        columns = ["type", "list_str", "list_int", "object_ord"]
        conditions = ["object_ord = 7", "object_ord > 490 and type = 'I'", "object_ord in (3, 4, 77, 900)", "object_ord >= 10 and object_ord < 12 and length(list_str) > 0", "object_ord <= 0", "object_ord = 7 and object_ord = 8", "type in ('A', 'B')", "object_ord = 5 or type = 'F'"]
        for c in conditions:
            for f in "xt":
                want, got = plain[f].where(c), pushing(f).where(c)
                assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, want.select(columns).collect())), (c, f)
        plan = pushing("x").where("object_ord = 7 and list_str is not null")._jdf.queryExecution().executedPlan().toString()
        above = [x for x in plan.splitlines() if "Filter " in x]  # what the reader left to Spark
        assert above and all("list_str" in x and "object_ord" not in x for x in above)
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize("block", [7, 100, 1 << 20])
def test_ascii_files_by_many_tasks(spark, tmp_path, block):
    """Any block size gives the lines, in their order, and the object numbers of one task, without reading the file twice over."""
    spark.dataSource.register(of.OneSource)
    data = lines(12 if block == 7 else 60)
    raw = of.encode_file(schema(), data)
    for name, text in (("x", raw), ("y", raw.rstrip(b"\n"))):  # with and without a last line end
        (tmp_path / name).write_bytes(text)
        one = spark.read.format("one").option("object", "A").load(str(tmp_path / name)).orderBy("line_no").collect()
        many = of.read_ascii(spark, str(tmp_path / name), block, object="A").orderBy("line_no").collect()
        assert [tuple(r)[2:] for r in many] == [tuple(r)[2:] for r in one] and len(many) == len(data)
        assert all(text[r.line_no : r.line_no + 1] == r.type.encode() for r in many)
    some = of.read_ascii(spark, str(tmp_path / "x"), block, object="A", lines="I").collect()
    assert {r.type for r in some} == {"I"} and max(r.object_ord for r in some) == (12 if block == 7 else 60)
    parts = of.OneReader({"path": str(tmp_path / "x"), "object": "A", "ascii_block": str(block)}).partitions()
    assert len(parts) >= (len(raw) - of.read_header(str(tmp_path / "x")).data_start) // block
    with pytest.raises(ValueError, match="numbered after"):
        of.read_ascii(spark, str(tmp_path / "x"), **{"from": "3"})


def test_pushed_objects_are_all_that_is_read(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains

    (tmp_path / "x").write_bytes(of.encode_file(schema(), lines(500), True))
    size = (tmp_path / "x").stat().st_size
    read = lambda *fs: (r := of.PushingReader({"path": str(tmp_path / "x"), "object": "A"}), list(r.pushFilters(list(fs))), sum(p.end - p.start for p in r.partitions()))[1:]
    left, whole = read()
    assert left == [] and 0.8 * size < whole <= size
    left, some = read(EqualTo(("object_ord",), 250), StringContains(("list_str",), "x"))
    assert [type(f).__name__ for f in left] == ["StringContains"] and some < size / 100
    assert read(In(("object_ord",), (3, 499)))[1] < size / 50 and read(GreaterThan(("object_ord",), 500))[1] == 0


def test_headers_from_a_template(spark, tmp_path):
    """Texts, provenance, references and deferred files of the template stay, the writer's own come behind them."""
    spark.dataSource.register(of.OneSource)
    s = schema()
    h = of.Header(s, subtype="sub", text=["about"], provenance=[("p", "1", "p -x", "today")], references=[("a", 1)], deferred=["d"])
    (tmp_path / "x").write_bytes(of.encode_file(s, lines(4), True, h))
    df = spark.read.format("one").load(str(tmp_path / "x")).coalesce(1).sortWithinPartitions("line_no")
    more = json.dumps([["q", "2", "q x", "later"]])
    for binary in ("true", "false"):
        df.write.format("one").mode("append").options(template=str(tmp_path / "x"), binary=binary, provenance=more, references="b", deferred="e").save(str(tmp_path / binary))
        got = of.read_header(str(next((tmp_path / binary).iterdir())))
        assert (got.subtype, got.text, got.provenance) == ("sub", ["about"], [*h.provenance, ("q", "2", "q x", "later")])
        assert (got.references, got.deferred) == ([("a", 1), ("b", 2)], ["d", "e"]) and got.schema.lines == s.lines
    with pytest.raises(Exception, match="provenance"):
        df.write.format("one").mode("append").options(schema_text=SCHEMA, provenance='[["x"]]').save(str(tmp_path / "z"))


def test_spliced_sequences_in_chunks(spark):
    """Pieces no longer than a chunk make up what splice() gives, wherever repeats lie."""
    from seqlake.operators import sv, tandem

    rng = random.Random(21)
    texts = {k: "".join(rng.choice("acgt") for _ in range(n)) for k, n in enumerate((900, 64, 5, 333))}
    rows = [(k, a, a + n, u) for k, t in texts.items() for a, n, u in ((rng.randrange(len(t) + 20), rng.randrange(1, 60), rng.choice([0, 1, 7, 90])) for _ in range(9))]
    seqs = spark.createDataFrame(list(texts.items()), "seq long, dna string")
    accepted = tandem.greedy(spark.createDataFrame(rows, "seq long, start long, end long, unit long"))
    want = {r.seq: r.dna for r in tandem.splice(seqs, accepted.where("unit <= end - start")).collect()}
    parts = sv.chunks(sv.pieces(seqs.select(F.col("seq").alias("ctg"), F.col("dna").alias("txt"))), 32, 8)
    pieces = tandem.splice_pieces(parts, accepted.where("unit <= end - start"), 32, 8, 16).collect()
    assert max(len(p.txt) for p in pieces) <= 32
    got = {k: "".join(p.txt for p in sorted((p for p in pieces if p.ctg == k), key=lambda p: p.start)) for k in texts}
    assert got == want


def test_last_start_before(spark):
    from seqlake.operators import ordinal

    rng = random.Random(13)
    starts = [(k % 2, rng.randrange(100, 5000)) for k in range(40)] + [(0, None), (1, 700), (1, 700)]
    positions = [(k % 3, rng.randrange(0, 6000), f"p{k}") for k in range(400)] + [(1, 700, "same")] * 2 + [(0, None, "none")]
    p, s = spark.createDataFrame(positions, "k int, x long, name string"), spark.createDataFrame(starts, "k int, start long")
    for width in (1, 64, 1 << 20):
        got = sorted((r.k, r.x or -1, r.name, r.found) for r in ordinal.last_before(p.where("x is not null"), "x", s, "start", "found", ["k"], width).collect())
        assert got == sorted((k, x, n, max((b for j, b in starts if j == k and b is not None and b <= x), default=None)) for k, x, n in positions if x is not None)
        alone = ordinal.last_before(p.where("x is not null").select("x"), "x", s, "start", "found", width=width).collect()
        assert all(r.found == max((b for _, b in starts if b is not None and b <= r.x), default=None) for r in alone) and len(alone) == 402


def test_bytes_of_a_column(spark):
    from seqlake.operators.byte_counts import byte_histogram

    texts = ["aab", "é☃", None, "", "\n"] * 3
    want = {}
    for b in "".join(t or "" for t in texts).encode():
        want[b] = want.get(b, 0) + 1
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    assert {r.byte: r.n for r in byte_histogram(df, "t").collect()} == want and byte_histogram(df.where("t = ''"), "t").count() == 0
