"""Files of alignments, contig skeletons and annotations: written from the driver's tables, read back, and compared."""

import duckdb
import pytest
from pyspark.sql import functions as F

from seqlake.plans.proxies import view, with_views
from seqlake.sources import formats
from seqlake.sources import onefile as of
from seqlake.sources import oneschema as os_


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=repr)


def save(spark, lines, kind, path, **options):
    spark.dataSource.register(of.OneSource)
    w = lines.repartitionByRange(3, "line_no").sortWithinPartitions("line_no").write.format("one").mode("append").option("schema_text", formats.SCHEMAS[kind]).option("binary", "true").option("single", "true")
    for k, v in options.items():
        w = w.option(k, v)
    w.save(str(path))
    return f"{path}/all.1{formats.SCHEMAS[kind].split()[2]}"


@pytest.fixture(scope="module")
def overlaps(spark, sf):
    o = view(spark, sf, "px_ovl").select("aread", "ab", "ae", "bread", "bb", "be", "comp")
    key = F.xxhash64("aread", "ab", "ae", "bread", "bb", "be", "comp")
    o = o.where("ab >= 0").distinct().withColumn("ord", F.row_number().over(formats.Window.orderBy(key)))
    trace = F.transform(F.sequence(F.lit(1), F.col("ord") % 4), lambda k: (k * 7 + F.col("ord")).cast("long"))
    return o.withColumns({"diffs": F.col("ord") % 50, "unit": F.when(F.col("ord") % 3 == 0, F.col("ord") % 60), "trace": trace, "trace_diffs": F.transform(trace, lambda x: x % 5)}).cache()


def test_alignments(spark, tmp_path, overlaps):
    path = save(spark, formats.alignment_lines(overlaps, 125), "aln", tmp_path / "a", references="a.fa,b.fa,/data")
    n = overlaps.count()
    assert formats.alignment_info(path) == {"n_overlaps": n, "spacing": 125, "a_source": "a.fa", "b_source": "b.fa", "folder": "/data"}
    cols = ("ord", "aread", "ab", "ae", "bread", "bb", "be", "comp", "diffs", "unit", "trace", "trace_diffs")
    got = formats.alignments(spark, path, splits=5)
    assert rows(got, *cols) == rows(overlaps, *cols)
    plain = formats.alignments(spark, path, traces=False)
    assert "trace" not in plain.columns and rows(plain, *cols[:10]) == rows(overlaps, *cols[:10])
    part = formats.alignments(spark, path, from_=5, to=9)
    assert sorted(r.ord for r in part.collect()) == [5, 6, 7, 8]


def test_alignment_errors(spark, tmp_path, overlaps):
    bad = overlaps.where("ord < 9").withColumn("trace_diffs", F.when(F.col("ord") != 3, F.col("trace_diffs")).otherwise(F.array(*map(F.lit, (1, 2, 3, 4, 5, 6))).cast("array<bigint>")))
    path = save(spark, formats.alignment_lines(bad), "aln", tmp_path / "a")
    with pytest.raises(Exception, match="different lengths"):
        formats.alignments(spark, path).collect()
    with pytest.raises(ValueError, match="no references"):
        formats.alignment_info(path)
    with pytest.raises(Exception, match="two sequences"):
        formats.tandems(formats.alignments(spark, path, traces=False), spark.createDataFrame([(0, 0, 9, 0)], "ctg_id long, seq_id long, len long, pos long")).collect()


SKELETON = (
    "S 10 chr1 first\nG 5\nC 100\nM 4 10 20 30 35\nG 10\nC 50\nG 7\nS 4 chr2\nC 9\nS 5 empty\nS 3 gap\nG 4\n"
)


def test_skeletons(spark, tmp_path):
    s = os_.parse_schemas(formats.SCHEMAS["gdb"])["gdb"]
    text = "1 3 gdb 2 1\n" + "".join(f"~ {x}\n" for x in s.definition_lines()) + ".\n" + SKELETON
    (tmp_path / "g").write_text(text)
    tables = formats.skeleton(formats.read_lines(spark, str(tmp_path / "g"), "gdb", "S"))
    scaffold, contig, mask = tables
    assert rows(scaffold, "seq_id", "name", "len") == [(0, "chr1", 172), (1, "chr2", 9), (2, "empty", 0), (3, "gap", 4)]
    assert rows(contig, "ctg_id", "seq_id", "len", "pos") == [(0, 0, 100, 5), (1, 0, 50, 115), (2, 1, 9, 0)]
    assert rows(mask) == [(0, 10, 20), (0, 30, 35)]
    path = save(spark, formats.skeleton_lines(*tables), "gdb", tmp_path / "w")
    again = formats.skeleton(formats.read_lines(spark, path, "gdb", "S"))
    assert [rows(t) for t in again] == [rows(t) for t in tables]
    written = [(r.type, r.fields[0].i if r.type in "GC" else r.list_str) for r in formats.read_lines(spark, path, "gdb", "S").orderBy("line_no").collect()]
    assert written == [("S", "chr1"), ("G", 5), ("C", 100), ("M", None), ("G", 10), ("C", 50), ("G", 7), ("S", "chr2"), ("C", 9), ("S", "empty"), ("S", "gap"), ("G", 4)]


def test_embedded_skeletons(spark, tmp_path):
    """The second of two skeletons; it ends where the alignments begin. Tandem rows are lifted by it."""
    s = os_.parse_schemas(formats.SCHEMAS["aln"])["aln"]
    text = "1 3 aln 2 1\n" + "".join(f"~ {x}\n" for x in s.definition_lines()) + ".\nt 100\ng\nS 1 x\nC 5\ng\nS 4 chr1\nC 100\nG 10\nC 60\n"
    text += "A 1 12 50 1 10 40\nD 8\nU 6\nA 0 5 20 0 0 15\n"
    (tmp_path / "t").write_text(text)
    lines = formats.read_lines(spark, str(tmp_path / "t"), "aln", "A")
    assert rows(formats.skeleton(lines, 1)[0], "name", "len") == [("x", 5)]
    scaffold, contig, _ = formats.skeleton(lines, 2)
    assert rows(scaffold, "name", "len") == [("chr1", 170)] and rows(contig, "ctg_id", "pos", "len") == [(0, 0, 100), (1, 110, 60)]
    got = formats.tandems(formats.alignments(spark, str(tmp_path / "t"), traces=False), contig)
    assert rows(got, "start", "end", "unit", "score") == [(0, 20, 0, 1000), (120, 160, 6, 800)]
    bad = "1 3 gdb 2 1\n" + "".join(f"~ {x}\n" for x in os_.parse_schemas(formats.SCHEMAS["gdb"])["gdb"].definition_lines()) + ".\nC 5\nS 1 x\n"
    (tmp_path / "b").write_text(bad)
    with pytest.raises(Exception, match="before the first scaffold"):
        formats.skeleton(formats.read_lines(spark, str(tmp_path / "b"), "gdb", "S"))[1].collect()


def test_annotations(spark, tmp_path, sf):
    """Copies counted from a written file are those that SQL counts on the table."""
    steps = view(spark, sf, "px_step")
    arr = steps.groupBy("arr").agg(F.array_sort(F.collect_list("p")).alias("partition"))
    w = formats.Window.orderBy("arr")
    ano = arr.select(F.row_number().over(w).alias("ord"), F.col("arr").alias("seq"), F.get("partition", F.lit(0)).alias("start"), F.element_at("partition", -1).alias("end"), F.when(F.col("arr") % 7 != 1, F.lit("20 bp")).alias("label"), F.when(F.col("arr") % 2 == 0, F.col("arr")).alias("score"), "partition")
    path = save(spark, formats.annotation_lines(ano), "ano", tmp_path / "a")
    got = formats.annotations(spark, path)
    cols = ("ord", "seq", "start", "end", "label", "score", "partition")
    assert rows(got, *cols) == rows(ano, *cols)
    c = duckdb.connect()
    c.sql(f"create view events as from '{sf}/events.parquet'")
    sql = with_views("px_step") + " select arr, count(*) filter (d=20) from (select arr, lead(p) over (partition by arr order by p)-p d from px_step) where arr%7<>1 group by arr"
    want = sorted((a, n) for a, n in c.sql(sql).fetchall())
    assert sorted((r.seq, r["count"]) for r in got.where("unit = 20").collect()) == want
    most = max(n for _, n in want)
    first = min(a for a, n in want if n == most)
    assert rows(formats.select_arrays(got, unit=20), "seq", "count") == [(first, most)]
    assert rows(formats.select_arrays(got, min_count=most), "seq") == [(a,) for a, n in want if n == most]
    r = got.where("count > 0").first()
    assert rows(formats.select_arrays(got, locus=(r.seq, r.start, None)), "seq") == [(r.seq,)] and formats.select_arrays(got, locus=(r.seq, r.start, r.end + 1)).count() == 0
    assert formats.select_arrays(got, unit=19).count() == 0
