"""Typed line files, FASTA, FASTQ and BED."""

import gzip
import random
import struct

import pytest

from seqlake.sources import formats
from seqlake.sources import onefile as of
from seqlake.sources import oneschema as os_
from seqlake.sources import seqfiles

ASCII = b"1 3 seq 2 1\n~ O S 1 3 DNA\n~ D I 1 6 STRING\n.\nS 8 acgtacgt\nI 2 s1\nS 4 ttga\nI 2 s2 named\n"
SCHEMA = "P 3 tst\nO A 3 3 INT 4 REAL 4 CHAR words\nG B\nD T 1 8 INT_LIST\nD R 1 9 REAL_LIST\nD Z 1 11 STRING_LIST\nD F 0\nO B 1 3 DNA\nD I 1 6 STRING\n"


def lines(n=40):
    rng, out = random.Random(1), []
    for i in range(n):
        v = rng.choice([0, 5, -3, 63, 64, 8191, 8192, -64, -65, -70000, 1 << 40, -(1 << 62)])
        out += [
            of.Line("A", [v, 1.5, "x"], "hi there" if i % 3 == 0 else None), of.Line("T", [[rng.randint(-(10**9), 10**9) for _ in range(i % 4)]]), of.Line("R", [[0.25] * (i % 3)]),
            of.Line("Z", [["a b", "", "xyz"][: i % 4]]), of.Line("F", []), of.Line("B", ["".join(rng.choice("acgt") for _ in range(i))]), of.Line("I", [f"ü{i}"]),
        ]
    return out


def test_ascii_example():
    p = of.Parser(ASCII)
    got = [x for _, x in p.lines()]
    assert [(x.type, x.values) for x in got] == [("S", ["acgtacgt"]), ("I", ["s1"]), ("S", ["ttga"]), ("I", ["s2"])] and got[-1].comment == "named"
    assert of.statistics(p.header.schema, got)["S"] == (2, 8, 12)


@pytest.mark.parametrize("binary", [False, True])
def test_round_trip(binary):
    s = os_.parse_schemas(SCHEMA)["tst"]
    h = of.Header(s, subtype="sub", provenance=[("p", "1", "p -x", "today")], references=[("a.1gdb", 2)], deferred=["x"])
    p = of.Parser(of.encode_file(s, lines(), binary, h))
    assert [x for _, x in p.lines()] == lines()
    assert p.header.schema.lines == s.lines and p.header.schema.groups == {"A": ["B"]} and p.header.counts["A"] == 40
    assert (p.header.subtype, p.header.provenance, p.header.references, p.header.deferred) == ("sub", h.provenance, h.references, ["x"])
    assert list(os_.parse_schemas(s.to_text())["tst"].lines) == list(s.lines)
    if binary:
        assert len(p.header.index["A"]) == 41
        at = p.header.index["A"]
        assert next(p.lines(at[7]))[1].values == lines()[6 * 7].values


def test_nested_statistics():
    """The most lines and list elements inside one object; a B inside an A belongs to both."""
    s = os_.parse_schemas(SCHEMA)["tst"]
    L = of.Line
    data = [L("B", ["acg"]), L("A", [1, 1.0, "x"]), L("T", [[1, 2]]), L("T", [[3]]), L("B", ["ac"]), L("I", ["q"]), L("B", [""]), L("A", [2, 1.0, "x"]), L("T", [[1, 2, 3, 4]]), L("B", ["acgta"]), L("I", ["qqq"])]
    for binary in (False, True):
        got = of.Parser(of.encode_file(s, data, binary)).header.nested
        assert got == {("A", "#", "B"): 2, ("A", "+", "B"): 5, ("A", "#", "I"): 1, ("A", "+", "I"): 3, ("A", "#", "T"): 2, ("A", "+", "T"): 4, ("B", "#", "I"): 1, ("B", "+", "I"): 3}


def test_varints():
    for v in [*range(-200, 9000), 1 << 31, -(1 << 31), (1 << 63) - 1, -(1 << 63)]:
        b = of.varint(v)
        assert of.read_varint(b, 0) == (v, len(b))


def huffman(data: bytes) -> tuple[bytes, bytes, int]:
    """A serial codec of 3-bit codes for six letters and an escape, and data encoded as a little-endian writer does."""
    codes = {c: k for k, c in enumerate(b"abcdef")}
    serial = b"\0" + struct.pack("<ii", 0, 3)
    for s in range(256):
        serial += bytes([3 if s in codes else 0]) + (struct.pack("<H", codes[s]) if s in codes else struct.pack("<H", 7) if s == 0 else b"")
    bits = "00" + "".join(f"{codes[c]:03b}" if c in codes else f"111{c:08b}" for c in data)
    n = len(bits)
    raw = bytearray(int((bits + "0" * (-n % 8)) or "0", 2).to_bytes((n + 7) // 8, "big"))
    for k in range(n // 64):
        raw[8 * k : 8 * k + 8] = raw[8 * k : 8 * k + 8][::-1]
    if n >= 64:
        raw[0], raw[7] = raw[7], raw[0]
    return serial, bytes(raw), n


@pytest.mark.parametrize("data", [b"abc", b"abcdefabcdefabcdefabcdefxyzabc", b"", b"f" * 200 + b"!"])
def test_huffman(data):
    serial, raw, n = huffman(data)
    assert of.Codec.load(serial).decode(raw, n, len(data)) == data
    assert of.Codec.load(serial).decode(b"\xff" + data, 8 * len(data) + 8, len(data)) == data


def test_bad_files():
    s = os_.parse_schemas(SCHEMA)["tst"]
    for bad in (b"1 3 seq 3 1\n", b"1 3 seq 2 9\n", b"A 1 1.0 x\n", ASCII.replace(b"S 8", b"S  8"), ASCII.replace(b"S 4 ttga", b"S 9 ttga"), ASCII + b"Q 1\n"):
        with pytest.raises(ValueError):
            list(of.Parser(bad).lines())
    assert [x.values for _, x in of.Parser(b"A 1 1.0 x\n", "tst", s).lines()] == [[1, 1.0, "x"]]
    for bad in ("O A 1 3 INT\n", "P 1 x\nO A 2 6 STRING 3 DNA\n", "P 1 x\nD AA 0\n", "P 1 x\nD A 1 3 FOO\n", "P 1 x\nD A 0\nG B\n"):
        with pytest.raises(ValueError):
            os_.parse_schemas(bad)
    other = os_.parse_schemas(SCHEMA.replace("D I 1 6 STRING", "D I 1 3 INT"))["tst"]
    with pytest.raises(ValueError, match="line type I"):
        s.check_against(other)
    s.check_against(other, {"A"})
    assert s.contained("A") == set("ATRZFBI") and s.contained("B") == set("BI")


def test_data_source(spark, tmp_path):
    spark.dataSource.register(of.OneSource)
    s = os_.parse_schemas(SCHEMA)["tst"]
    (tmp_path / "x.1tst").write_bytes(of.encode_file(s, lines(), True))
    df = spark.read.format("one").option("type", "tst").option("object", "A").option("splits", "4").load(str(tmp_path / "x"))
    rows = sorted(df.collect(), key=lambda r: r.line_no)
    assert len(rows) == 280 and [r.object_ord for r in rows if r.type == "A"] == list(range(1, 41)) and rows[0].comment == "hi there"
    assert spark.read.format("one").option("lines", "BI").load(str(tmp_path / "x.1tst")).count() == 80
    part = spark.read.format("one").option("object", "A").option("from", "10").option("to", "13").load(str(tmp_path / "x.1tst"))
    assert sorted({r.object_ord for r in part.collect()}) == [10, 11, 12] and part.count() == 21
    lazy = spark.read.format("one").option("object", "A").option("splits", "4").option("lines", "AI").load(str(tmp_path / "x.1tst"))
    assert sorted(tuple(r) for r in lazy.select("line_no", "type", "list_str", "comment").collect()) == sorted((r.line_no, r.type, r.list_str, r.comment) for r in rows if r.type in "AI")
    df = df.repartitionByRange(3, "line_no").sortWithinPartitions("line_no")
    df.coalesce(1).write.format("one").mode("append").option("schema_text", SCHEMA).option("binary", "true").save(str(tmp_path / "out"))
    back = spark.read.format("one").load(str(tmp_path / "out"))
    assert sorted((r.type, r.list_str or "", str(r.list_int)) for r in back.collect()) == sorted((r.type, r.list_str or "", str(r.list_int)) for r in rows)


def test_sequence_files(spark, tmp_path):
    with gzip.open(tmp_path / "a.fa.gz", "wt") as f:
        f.write(">s1 first one\nacgt\nac\n>s2\n\nNNa\n")
    fa = seqfiles.read_fasta(spark, str(tmp_path / "a.fa.gz"))
    assert sorted(tuple(r) for r in fa.collect()) == [("s1", "first one", "acgtac"), ("s2", None, "NNa")]
    seqfiles.write_fasta(fa, str(tmp_path / "b"), width=4)
    assert sorted(tuple(r) for r in seqfiles.read_fasta(spark, str(tmp_path / "b")).collect()) == [("s1", "first one", "acgtac"), ("s2", None, "NNa")]
    (tmp_path / "c.fq").write_text("@r1 x\nacg\n+\n!I5\n@r2\nt\n+\nI\n")
    fq = seqfiles.read_fastq(spark, str(tmp_path / "c.fq"))
    assert [tuple(r)[2:] for r in fq.orderBy("n").collect()] == [("r1", "x", "acg", [0, 40, 20]), ("r2", None, "t", [40])]
    with gzip.open(tmp_path / "z.fq.gz", "wt") as f:
        f.write("@r1\nac\n+\n!I\n")
    assert [tuple(r)[2:] for r in seqfiles.read_fastq(spark, str(tmp_path / "z.fq.gz")).collect()] == [("r1", None, "ac", [0, 40])]
    many = "".join(f"@r{k}\n{'acgt' * (k % 9)}\n+\n{'@I+!' * (k % 9)}\n" for k in range(4000))
    (tmp_path / "many.fq").write_text(many)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # records cross the splits
    got = seqfiles.read_fastq(spark, str(tmp_path / "many.fq")).orderBy("n").collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.id, r.seq) for r in got] == [(f"r{k}", "acgt" * (k % 9)) for k in range(4000)]
    assert sorted(r[0] for r in seqfiles.fastq_lines(fq).collect())[0] == "@r1\nacg\n+\n!I5"
    (tmp_path / "d.fq").write_text("@r1\nacg\n+\n!I\n")
    with pytest.raises(Exception, match="malformed"):
        seqfiles.read_fastq(spark, str(tmp_path / "d.fq")).collect()
    (tmp_path / "e.bed").write_text("chr1\t0\t10\t5\t900\nchr1\tx\t1\t2\t3\n")
    assert seqfiles.read_bed(spark, str(tmp_path / "e.bed"), strict=False).count() == 1
    with pytest.raises(Exception):
        seqfiles.read_bed(spark, str(tmp_path / "e.bed")).collect()
    assert [seqfiles.sniff(x) for x in (b">a", b"@", b"1 ", b"b", b"?")] == ["fasta", "fastq", "one", "packed", "unknown"]
    assert seqfiles.default_output("/x.y/a.fa.gz", "-short.fa.gz") == "/x.y/a-short.fa.gz" and seqfiles.default_output("a", "-z") == "a-z"


def test_reading_looks_at_its_own_bytes(tmp_path):
    """Header and footer are read without the data between; an ASCII file block by block, lines and comments whole."""
    s = os_.parse_schemas(SCHEMA)["tst"]
    big = [of.Line("A", [k, 0.5, "y"], f"note {k}" * 30) for k in range(20_000)]
    for binary in (True, False):
        path = tmp_path / f"x{binary}"
        path.write_bytes(of.encode_file(s, big, binary))
        with open(path, "rb") as f:
            data = of.FileBytes(f)
            h = of.Parser(data).header
            assert h.counts["A"] == 20_000 and len(data.blocks) < 10 and len(data) > 2_000_000
            p = of.Parser(of.FileBytes(f))
            got = [x for _, x in p.read_range(f, h.data_start, h.data_end, block=1000)]
        assert got == big


def test_lazy_lists_are_stepped_over(monkeypatch):
    s = os_.parse_schemas(SCHEMA)["tst"]
    p = of.Parser(of.encode_file(s, lines(), True))
    p.wanted = {"A", "F"}
    monkeypatch.setattr(of, "expand_ints", None)
    monkeypatch.setattr(of, "unpack_bases", None)
    assert [x.values for _, x in p.lines() if x.type == "A"] == [x.values for x in lines() if x.type == "A"]


def test_parts_are_merged_in_order(spark, tmp_path):
    s, all_lines = os_.parse_schemas(SCHEMA)["tst"], lines(60)
    at = [k for k, x in enumerate(all_lines) if x.type == "A"]
    for k, (a, b) in enumerate(((0, at[20]), (at[20], at[21]), (at[21], None))):
        (tmp_path / f"p{k}").write_bytes(of.encode_file(s, all_lines[a:b], True))
    of.merge_files([str(tmp_path / f"p{k}") for k in range(3)], str(tmp_path / "all"))
    assert (tmp_path / "all").read_bytes() == of.encode_file(s, all_lines, True)
    spark.dataSource.register(of.OneSource)
    df = spark.read.format("one").option("object", "A").load(str(tmp_path / "all")).repartitionByRange(3, "line_no").sortWithinPartitions("line_no")
    df.write.format("one").mode("append").option("schema_text", SCHEMA).option("binary", "true").option("single", "true").save(str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["all.1tst"] and (tmp_path / "out" / "all.1tst").read_bytes() == (tmp_path / "all").read_bytes()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(of.OneSource)
    (tmp_path / "x").write_bytes(of.encode_file(os_.parse_schemas(SCHEMA)["tst"], lines(), True))
    df = spark.read.format("one").load(str(tmp_path / "x"))
    with pytest.raises(Exception, match="order of line_no"):
        df.coalesce(1).orderBy("type").coalesce(1).write.format("one").mode("append").option("schema_text", SCHEMA).save(str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or not list((tmp_path / "out").iterdir())


def test_huffman_by_hand():
    """Bytes worked out on paper, not by an encoder of ours: a = 1, b = 01, c = 000, escape = 001."""
    serial = bytearray(b"\0" + struct.pack("<ii", 0, 3))
    for s in range(256):
        n, code = {0x61: (1, 1), 0x62: (2, 1), 0x63: (3, 0), 0: (0, 1)}.get(s, (0, None))
        serial += bytes([n]) + (struct.pack("<H", code) if code is not None else b"")
    # 00 then a b c escape+'z' (0x7a = 01111010) a: 00 1 01 000 001 01111010 1 -> 00101000 00101111 0101 0000
    assert of.Codec.load(bytes(serial)).decode(bytes([0b00101000, 0b00101111, 0b01010000]), 20, 5) == b"abcza"


def test_packed_files(spark, tmp_path):
    spark.dataSource.register(seqfiles.PackedSource)
    rng = random.Random(1)
    data = [(f"s{k}", f"d{k}" if k % 2 else None, "".join(rng.choice("acgt") for _ in range(n)), [rng.randrange(40) for _ in range(n)]) for k, n in enumerate((0, 1, 3, 4, 5, 8, 9, 301))]
    df = spark.createDataFrame(data, "id string, desc string, seq string, qual array<int>").coalesce(1)
    df.write.format("packed").mode("append").option("quality", "20").save(str(tmp_path / "q"))
    back = spark.read.format("packed").load(str(tmp_path / "q")).orderBy("n").collect()
    assert [(r.id, r.desc, r.seq, r.qual) for r in back] == [(i, d, s, [20 * (x >= 20) for x in q]) for i, d, s, q in data]
    df.write.format("packed").mode("append").save(str(tmp_path / "p"))
    file = next((tmp_path / "p").iterdir())
    raw = file.read_bytes()
    assert raw[:2] == b"b\0" and struct.unpack("<Q", raw[8:16])[0] == 8 and len(raw) % 4 == 0
    assert {tuple(r) for r in seqfiles.read_sequences(spark, str(file)).collect()} == {(i, d, s) for i, d, s, _ in data}


def test_typed_sequence_files(spark, tmp_path):
    """Letters that two bits can't hold survive by the exception lines; ids, comments and qualities too."""
    spark.dataSource.register(of.OneSource)
    data = [(1, "s1", "first one", "acgtNNNNacRgt", None), (2, None, None, "nnn", None), (3, "s3", None, "acgt", [1, 2, 3, 40]), (4, "s4", None, "", None)]
    df = spark.createDataFrame(data, "n long, id string, desc string, seq string, qual array<int>")
    lines_ = seqfiles.dna_lines(df).coalesce(1).sortWithinPartitions("line_no")
    for binary in ("true", "false"):
        lines_.write.format("one").mode("append").option("schema_text", formats.SCHEMAS["dna"]).option("binary", binary).save(str(tmp_path / binary))
        back = seqfiles.read_dna(spark, str(tmp_path / binary)).orderBy("n").collect()
        assert [(r.n, r.id, r.desc, r.seq, r.qual) for r in back] == data, binary


def test_sequence_source(tmp_path):
    (tmp_path / "a.fa").write_text(">s\nacgt\n")
    h = of.Header(os_.parse_schemas(formats.SCHEMAS["gdb"])["gdb"], references=[("other", 2), ("a.fa", 1)])
    (tmp_path / "g").write_bytes(of.encode_file(h.schema, [], True, h))
    assert seqfiles.sequence_source("a.fa", str(tmp_path)) == seqfiles.sequence_source(str(tmp_path / "g"), str(tmp_path)) == f"{tmp_path}/a.fa"
    with pytest.raises(FileNotFoundError):
        seqfiles.sequence_source("b.fa", str(tmp_path))
