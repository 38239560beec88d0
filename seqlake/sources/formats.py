"""Tables of typed line files: contig skeletons, alignments and annotations as DataFrames, and their lines for the writer.

Readers take the lines of a file (spark.read.format("one")) and group an object's lines by its ordinal, which the source
gives with each line, so nothing depends on one task seeing a whole file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlake.functions.sequence import leading_integer, short_name
from seqlake.operators import coords, ordinal, tandem
from seqlake.sources.onefile import OneSource, Parser, read_header, resolve

_SKELETON = "O g 0\nG S\nO S 1 6 STRING\nD G 1 3 INT\nD C 1 3 INT\nD M 1 8 INT_LIST\n"
#: Schemas of the file types (fixed by the formats).
SCHEMAS = {
    "gdb": "P 3 gdb\nD f 4 4 REAL 4 REAL 4 REAL 4 REAL\nD u 0\nO S 1 6 STRING\nD G 1 3 INT\nD C 1 3 INT\nD M 1 8 INT_LIST\n",
    "aln": "P 3 aln\nD t 1 3 INT\n" + _SKELETON + "O a 0\nG A\nD p 2 3 INT 3 INT\nO A 6 3 INT 3 INT 3 INT 3 INT 3 INT 3 INT\nD L 2 3 INT 3 INT\nD R 0\nD D 1 3 INT\nD T 1 8 INT_LIST\nD X 1 8 INT_LIST\n"
    "D Q 1 3 INT\nD E 1 3 INT\nD Z 1 6 STRING\nD U 1 3 INT\n",
    "ano": "P 3 ano\n" + _SKELETON.replace("D M 1 8 INT_LIST\n", "") + "O M 3 3 INT 3 INT 3 INT\nD L 1 6 STRING\nD X 1 3 INT\nD P 1 8 INT_LIST\n",
    "seq": "P 3 seq\nS 2 sv\nD o 1 3 INT\nD s 1 3 INT\nD m 1 3 INT\nD x 1 3 INT\nD f 1 3 INT\nD q 1 3 INT\nO V 3 6 STRING 3 INT 3 INT\nG S\nD O 1 3 INT\nD B 3 6 STRING 3 INT 3 INT\nD C 0\nD F 2 3 INT 3 INT\nD X 2 3 INT 3 INT\n"
    "D Q 1 3 DNA\nD D 1 3 DNA\nD R 2 3 INT 3 INT\nD T 2 3 INT 3 INT\nO S 1 3 DNA\nD I 1 6 STRING\n",
    "dna": "P 3 seq\nO S 1 3 DNA\nD I 1 6 STRING\nD Q 1 6 STRING\nD N 3 3 INT 4 CHAR 3 INT\n",
}


def read_lines(spark: SparkSession, path: str, kind: str, object_type: str, **options) -> DataFrame:
    """Lines of files of one kind (a key of SCHEMAS), numbered by object_type."""
    spark.dataSource.register(OneSource)
    name = SCHEMAS[kind].split()[2]
    reader = spark.read.format("one").option("type", name).option("schema_text", SCHEMAS[kind]).option("object", object_type)
    for k, v in options.items():
        reader = reader.option(k.rstrip("_"), str(v))
    return reader.load(path)


def field(k: int) -> Column:
    """The k-th field of a line, as an integer."""
    return F.get("fields", F.lit(k)).getField("i")


def _last(letter: str, value: Column, name: str) -> Column:
    """The value of an object's last line of a type: later lines win."""
    mine = F.col("type") == letter
    return F.max_by(F.when(mine, value), F.when(mine, F.col("line_no"))).alias(name)


def skeleton(lines: DataFrame, k: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scaffold, contig, mask) of one file's lines: of a standalone file, or of its k-th embedded skeleton (from 1).

    scaffold: (seq_id, name, len), contig: (ctg_id, seq_id, len, pos), mask: (ctg_id, start, end). An embedded skeleton
    ends at the first line that isn't part of one. A name ends at its first blank. Gaps and contigs before the first
    scaffold, and mask lists of odd length, are errors.
    """
    own = ("f", "u", "S", "G", "C", "M")
    if k is not None:
        lines = ordinal.object_ordinal(lines, "g", "type", "line_no", "skeleton").where(F.col("skeleton") == k).where("type <> 'g'")
        stop = lines.where(~F.col("type").isin(*own)).agg(F.min("line_no").alias("stop"))
        lines = lines.crossJoin(stop).where("stop is null or line_no < stop")  # one row
    lines = lines.where(F.col("type").isin("S", "G", "C", "M"))
    seq = ordinal.running_sum(lines, F.when(F.col("type") == "S", 1).otherwise(0), "line_no", "seq")
    seq = ordinal.running_sum(seq, F.when(F.col("type") == "C", 1).otherwise(0), "line_no", "ctg")
    seq = seq.withColumns({"seq": F.col("seq") - 1, "ctg": F.col("ctg") - 1})
    seq = coords.checked(seq, F.col("seq") >= 0, "a gap or contig stands before the first scaffold")
    seq = coords.checked(seq, (F.col("type") != "M") | ((F.size("list_int") % 2 == 0) & (F.col("ctg") >= 0)), "a mask list has an odd length or no contig")
    rows = seq.where("type <> 'M'").select("seq", F.col("line_no").alias("ord"), F.col("type").alias("typ"), F.coalesce(field(0), F.lit(0)).alias("len"), short_name(F.col("list_str")).alias("name"), "ctg")
    size, contig = coords.contig_table(rows)
    numbered = contig.join(rows.where("typ = 'C'").select("ord", F.col("ctg").alias("ctg_id")), "ord")
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("list_int") / 2).cast("int") - 1), lambda i: F.struct(F.get("list_int", 2 * i).alias("start"), F.get("list_int", 2 * i + 1).alias("end")))
    mask = seq.where("type = 'M' and size(list_int) > 0").select(F.col("ctg").alias("ctg_id"), F.inline(pairs))
    return size.select(F.col("seq").alias("seq_id"), "name", "len"), numbered.select("ctg_id", F.col("seq").alias("seq_id"), "len", "pos"), mask


def _line(no: Column, letter: str, values: list[Column], text: Column | None = None, ints: Column | None = None) -> Column:
    """A line for the writer; a list field is an empty place among the values."""
    cells = [F.struct(v.cast("long").alias("i"), F.lit(None).cast("double").alias("r"), F.lit(None).cast("string").alias("c")) for v in values]
    fields = F.array(*cells) if cells else F.array().cast("array<struct<i:bigint,r:double,c:string>>")
    empty = F.lit(None)
    return F.struct(
        no.alias("line_no"), F.lit(letter).alias("type"), fields.alias("fields"), (text if text is not None else empty.cast("string")).alias("list_str"),
        (ints if ints is not None else empty.cast("array<bigint>")).alias("list_int"), empty.cast("array<double>").alias("list_real"), empty.cast("array<string>").alias("list_strs"), empty.cast("string").alias("comment"),
    )


def _none() -> Column:
    return F.lit(None).cast("long")


def skeleton_lines(scaffold: DataFrame, contig: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """S, G, C and M lines in order, for the writer; gaps, the trailing one too, come from the contigs' positions."""
    w = Window.partitionBy("seq_id").orderBy("pos", "ctg_id")
    before = F.col("pos") - F.coalesce(F.lag(F.col("pos") + F.col("len")).over(w), F.lit(0))
    c = contig.withColumn("gap", before)
    if mask is None:
        c = c.withColumn("masks", F.lit(None).cast("array<bigint>"))
    else:
        spans = mask.groupBy("ctg_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "end"))), lambda m: F.array(m.start, m.end))).alias("masks"))
        c = c.join(spans, "ctg_id", "left")
    inner = F.array_sort(F.collect_list(F.struct("pos", "ctg_id", "len", "gap", "masks")))
    per = scaffold.withColumnRenamed("len", "total").join(c.groupBy("seq_id").agg(inner.alias("contigs"), F.max(F.col("pos") + F.col("len")).alias("stop")), "seq_id", "left")
    zero = F.lit(0).cast("long")
    one = F.transform(F.coalesce("contigs", F.array().cast("array<struct<pos:bigint,ctg_id:bigint,len:bigint,gap:bigint,masks:array<bigint>>>")), lambda x: F.array(
        F.when(x.gap > 0, _line(zero, "G", [x.gap])), _line(zero, "C", [x.len]), F.when(F.coalesce(F.size(x.masks) > 0, F.lit(False)), _line(zero, "M", [_none()], None, x.masks))))
    rest = F.col("total") - F.coalesce("stop", zero)
    lines = F.concat(F.array(_line(zero, "S", [_none()], F.col("name"))), F.flatten(one), F.array(F.when(rest > 0, _line(zero, "G", [rest]))))
    placed = per.select("seq_id", F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("k", "x"))
    return ordinal.dense_ordinal(placed, F.floor(F.col("seq_id") / 256), ["seq_id", "k"], "n").select(F.col("n").alias("line_no"), "x.type", "x.fields", "x.list_str", "x.list_int", "x.list_real", "x.list_strs", "x.comment")


def alignment_info(path: str) -> dict:
    """n_overlaps, trace spacing and the names of both sources and their folder, from header, footer and the first lines;
    a file without alignments, references or trace spacing is an error."""
    file = resolve(path, "aln")[0]
    h = read_header(file)
    if not h.counts.get("A"):
        raise ValueError("no alignments found")
    if not h.references:
        raise ValueError("no references found")
    names = {n: f for f, n in h.references}
    spacing = 0
    with open(file, "rb") as f:
        from seqlake.sources.onefile import FileBytes

        for _, x in Parser(FileBytes(f)).lines():
            if x.type == "t":
                spacing = x.values[0]
            if x.type == "A" or spacing:
                break
    if not spacing:
        raise ValueError("no trace spacing before the first alignment")
    return {"n_overlaps": h.counts["A"], "spacing": spacing, "a_source": names.get(1), "b_source": names.get(2), "folder": names.get(3, "")}


def alignments(spark: SparkSession, path: str, traces: bool = True, **options) -> DataFrame:
    """(file, ord, aread, ab, ae, bread, bb, be, comp, diffs, unit, a_len, b_len[, trace, trace_diffs]): one row for each
    alignment. comp is 1 on the reverse strand; diffs is 0 and unit null where a file doesn't say. Without traces their
    lists are never decoded; with them, lists of unequal lengths, or only one, are an error."""
    lines = read_lines(spark, path, "aln", "A", lines="ARDLU" + "TX" * traces, **options).where("object_ord > 0")
    value = [field(k).alias(n) for k, n in enumerate(("aread", "ab", "ae", "bread", "bb", "be"))]
    a = F.max(F.when(F.col("type") == "A", F.struct(*value))).alias("a")
    more = [_last("T", F.col("list_int"), "trace"), _last("X", F.col("list_int"), "trace_diffs")] if traces else []
    got = lines.groupBy("file", F.col("object_ord").alias("ord")).agg(
        a, F.max(F.when(F.col("type") == "R", 1).otherwise(0)).alias("comp"), F.coalesce(_last("D", field(0), "d"), F.lit(0)).alias("diffs"), _last("U", field(0), "unit"),
        _last("L", field(0), "a_len"), _last("L", field(1), "b_len"), *more,
    )
    if traces:
        ok = (F.col("trace").isNull() & F.col("trace_diffs").isNull()) | F.coalesce(F.size("trace") == F.size("trace_diffs"), F.lit(False))
        got = coords.checked(got, ok, "trace lists have different lengths")
    return got.select("file", "ord", "a.*", "comp", "diffs", "unit", "a_len", "b_len", *(["trace", "trace_diffs"] if traces else []))


def tandems(aligned: DataFrame, contig: DataFrame) -> DataFrame:
    """(seq, start, end, unit, score) of a tandem file's alignments, which align a sequence with itself: from the begin
    on b to the end on a, lifted to the scaffold. An alignment of two sequences is an error."""
    own = coords.checked(aligned, F.col("aread") == F.col("bread"), "a tandem alignment is of two sequences")
    t = own.select(F.col("aread").alias("ctg"), F.col("bb").alias("start"), F.col("ae").alias("end"), F.coalesce("unit", F.lit(0)).alias("unit"), "diffs")
    t = t.withColumn("len", F.col("end") - F.col("start"))
    lifted = coords.lift(t, contig.select(F.col("ctg_id").alias("ctg"), F.col("seq_id").alias("seq"), "pos"), "start", "end")
    return lifted.select("seq", "start", "end", "unit", tandem.score(F.col("diffs"), F.col("len")).alias("score"))


def alignment_lines(rows: DataFrame, spacing: int = 100) -> DataFrame:
    """Lines of an alignment file for the writer, from (ord, aread, ab, ae, bread, bb, be, comp, diffs[, unit, trace,
    trace_diffs]): the spacing once, then A, R, D, U, T and X of each."""
    have = set(rows.columns)
    no = F.col("ord").cast("long") * 8
    opt = lambda c, line: F.when(F.col(c).isNotNull(), line) if c in have else None
    lines = [
        _line(no, "A", [F.col(c) for c in ("aread", "ab", "ae", "bread", "bb", "be")]), F.when(F.col("comp") != 0, _line(no + 1, "R", [])), _line(no + 2, "D", [F.col("diffs")]),
        opt("unit", _line(no + 3, "U", [F.col("unit")] if "unit" in have else [])), opt("trace", _line(no + 4, "T", [_none()], None, F.col("trace") if "trace" in have else None)),
        opt("trace_diffs", _line(no + 5, "X", [_none()], None, F.col("trace_diffs") if "trace_diffs" in have else None)),
    ]
    body = rows.select(F.explode(F.array(*[x for x in lines if x is not None])).alias("x")).where("x is not null").select("x.*")
    first = rows.sparkSession.range(1).select(_line(F.lit(-1).cast("long"), "t", [F.lit(spacing)]).alias("x")).select("x.*")
    return first.unionByName(body)


def annotations(spark: SparkSession, path: str, **options) -> DataFrame:
    """(file, ord, seq, start, end, label, unit, score, partition, starts, count): one row for each annotation. unit is
    the number that the label begins with (0 without one), starts are the places followed by exactly one unit, of units
    of 20 or more."""
    lines = read_lines(spark, path, "ano", "M", lines="MLXP", **options).where("object_ord > 0")
    m = F.max(F.when(F.col("type") == "M", F.struct(field(0).alias("seq"), field(1).alias("start"), field(2).alias("end")))).alias("m")
    got = lines.groupBy("file", F.col("object_ord").alias("ord")).agg(m, _last("L", F.col("list_str"), "label"), _last("X", field(0), "score"), _last("P", F.col("list_int"), "partition"))
    got = got.withColumn("unit", F.coalesce(leading_integer(F.col("label")), F.lit(0)))
    none = F.array().cast("array<bigint>")
    got = got.withColumn("starts", F.coalesce(tandem.starts_of(F.col("partition"), F.col("unit")), none))
    return got.select("file", "ord", "m.*", "label", "unit", "score", "partition", "starts", F.size("starts").alias("count"))


def annotation_lines(rows: DataFrame) -> DataFrame:
    """Lines of an annotation file for the writer, from (ord, seq, start, end, label, score, partition)."""
    no = F.col("ord").cast("long") * 4
    lines = F.array(
        _line(no, "M", [F.col(c) for c in ("seq", "start", "end")]), F.when(F.col("label").isNotNull(), _line(no + 1, "L", [_none()], F.col("label"))),
        F.when(F.col("score").isNotNull(), _line(no + 2, "X", [F.col("score")])), F.when(F.col("partition").isNotNull(), _line(no + 3, "P", [_none()], None, F.col("partition"))),
    )
    return rows.select(F.explode(lines).alias("x")).where("x is not null").select("x.*")


def select_arrays(rows: DataFrame, unit: int | None = None, locus: tuple[int, int, int | None] | None = None, min_count: int = 100) -> DataFrame:
    """Arrays for a consensus: the first one at a locus (seq, start and, if not None, end) that has an exact copy; or of
    a unit the one with most exact copies, the first of equals; or all with min_count exact copies or more."""
    some = rows.where("count > 0")
    if locus is not None:
        seq, start, end = locus
        return tandem.first_hit(some, (F.col("seq") == seq) & (F.col("start") == start) & (F.lit(True) if not end else F.col("end") == end), "file", "ord")
    if unit is not None:
        return some.where(F.col("unit") == unit).orderBy(F.desc("count"), "file", "ord").limit(1)
    return some.where(F.col("count") >= min_count)
