"""Queries over the driver's tables, one per operator, each with the same question in DuckDB's SQL."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlake.functions import sequence as sq
from seqlake.operators import align, cluster, coords, ordinal, similar, sv, tandem
from seqlake.operators.byte_counts import byte_histogram
from seqlake.operators.scratch import Scratch
from seqlake.plans.proxies import table, text_chunks, view, with_views
from seqlake.sources.oneschema import parse_schemas

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: DuckDB forms of what several oracles share.
LIFT = "select t.*, c.seq, t.beg+c.pos sbeg, t.fin+c.pos send, c.pos from px_tan t join px_contig c using (ctg)"
SCORE = "cast(trunc(1000*(1e0-cast(diffs as double)/(fin-beg))) as integer)"
OVL = "(least(ae-ab,be-bb))"
SV = f"""select i.aread a, i.bread b, i.comp, case when i.comp=0 then i.ae else j.ae end a_begin, case when i.comp=0 then j.ab else i.ab end a_end,
    i.be b_match_begin, j.bb b_match_end, case when i.comp=0 then i.sz else j.sz end lflank, case when i.comp=0 then j.sz else i.sz end rflank
    from (select *, {OVL} sz from px_ovl) i join (select *, {OVL} sz from px_ovl) j on i.aread=j.aread and i.bread=j.bread and i.comp=j.comp
    and j.bb between i.be-50 and i.be+50 and i.sz>=1000 and j.sz>=1000
    where (case when i.comp=0 then j.ab-i.ae else i.ab-j.ae end) > 0 and (case when i.comp=0 then j.ab-i.ae else i.ab-j.ae end) < {{size}}"""


def query(name: str, oracle: str | None, *views: str):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = (with_views(*views) + " " if views else "") + oracle
        return f

    return add


def lifted(spark: SparkSession, d: str) -> DataFrame:
    t = view(spark, d, "px_tan").withColumn("len", F.col("fin") - F.col("beg"))
    return coords.lift(t, view(spark, d, "px_contig"), "beg", "fin").withColumn("score", tandem.score(F.col("diffs"), F.col("len")))


@query("j02_lift_bed", f"select cast(seq as varchar) as name, sbeg as start, send as \"end\", unit, {SCORE} as score from ({LIFT}) order by 1,2,3", "px_tan", "px_contig")
def _(spark, d):
    return lifted(spark, d).select(F.col("seq").cast("string").alias("name"), F.col("beg").alias("start"), F.col("fin").alias("end"), "unit", "score").orderBy("name", "start", "end")


@query("k11_bed_lines", f"select concat_ws(chr(9), seq, sbeg, send, unit, {SCORE}) as value from ({LIFT})", "px_tan", "px_contig")
def _(spark, d):
    return tandem.to_bed(lifted(spark, d).select(F.col("seq").alias("name"), F.col("beg").alias("start"), F.col("fin").alias("end"), "unit", "score"))


@query("a07_tandem_totals", "select count(*) as n, cast(sum(fin-beg) as bigint) as total, round(100e0*sum(fin-beg)/(select sum(len) from px_contig),6) as percent from px_tan", "px_tan", "px_contig")
def _(spark, d):
    t = tandem.totals(view(spark, d, "px_tan").select(F.col("beg").alias("start"), F.col("fin").alias("end")))
    genome = view(spark, d, "px_contig").agg(F.sum("len").alias("g"))
    return t.crossJoin(genome).select("n", "total", F.round(100.0 * F.col("total") / F.col("g"), 6).alias("percent"))  # two single rows


@query("p03_score", f"select {SCORE} as score, count(*) as n from px_tan group by 1", "px_tan")
def _(spark, d):
    return view(spark, d, "px_tan").groupBy(tandem.score(F.col("diffs"), F.col("fin") - F.col("beg")).alias("score")).agg(F.count("*").alias("n"))


@query("p01_contig_to_scaffold", "select t.ctg, t.beg, t.fin, t.unit, c.seq from px_tan t join px_contig c using (ctg)", "px_tan", "px_contig")
def _(spark, d):
    return coords.lift(view(spark, d, "px_tan"), view(spark, d, "px_contig")).select("ctg", "beg", "fin", "unit", "seq")


@query("w01_contig_pos", "select ctg, seq, len, pos from px_contig", "px_contig")
def _(spark, d):
    return coords.contig_positions(view(spark, d, "px_contig").drop("pos"), gap=200)


@query("w03_gaps", "select * from (select seq, ctg, pos-coalesce(lag(pos+len) over (partition by seq order by pos, ctg),0) gap from px_contig) where gap>0 union all select seq, null, 75 from px_contig group by seq", "px_contig")
def _(spark, d):
    c = view(spark, d, "px_contig")
    return coords.gaps(c, c.groupBy("seq").agg((F.max(F.col("pos") + F.col("len")) + 75).alias("len")))


@query("a05_gdb_totals", """select count(distinct seq) as n_seq, count(*) as n_ctg, cast(sum(len) as bigint) as tot_ctg,
    (select cast(sum(e) as bigint) from (select max(pos+len) e from px_contig group by seq)) as tot_seq,
    (select count(*) from (select pos-coalesce(lag(pos+len) over (partition by seq order by pos),0) g from px_contig) where g>0) as n_gap from px_contig""", "px_contig")
def _(spark, d):
    return coords.gdb_totals(view(spark, d, "px_contig"))


@query("a06_seq_len", "select seq, max(pos+len) as len from px_contig group by seq", "px_contig")
def _(spark, d):
    return view(spark, d, "px_contig").groupBy("seq").agg(F.max(F.col("pos") + F.col("len")).alias("len"))


@query("a09_max_len", "select max(length(dna)) as len from px_seq", "px_seq")
def _(spark, d):
    return view(spark, d, "px_seq").agg(F.max(F.length("dna")).cast("long").alias("len"))


@query("j01_name_lookup", """with names as (select o_orderpriority as name, min(o_orderkey) first from orders group by 1), dict as (select name, row_number() over (order by first, name)-1 as id from names)
    select o_orderkey, cast(id as bigint) as id from orders join dict on o_orderpriority=name""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("name"))
    names = coords.name_dictionary(o, "name", "o_orderkey")
    return o.join(coords.dimension(names), "name").select("o_orderkey", "id")


@query("j09_unknown_names", "select count(*) as n from supplier where s_nationkey not in (select n_nationkey from nation where n_nationkey%2=0)")
def _(spark, d):
    known = table(spark, d, "nation").where("n_nationkey % 2 = 0")
    return table(spark, d, "supplier").join(known, F.col("s_nationkey") == F.col("n_nationkey"), "left_anti").agg(F.count("*").alias("n"))


BED = "select cast(seq as varchar) as name, sbeg as s, send + ctg*997 as e from (" + LIFT + ")"


@query("fl12_bed_violations", f"select count(*) as n from ({BED}) b left join (select cast(seq as varchar) as name, max(pos+len) len from px_contig group by 1) c using (name) where not coalesce(s>=0 and s<=e and e<=len, false)", "px_tan", "px_contig")
def _(spark, d):
    bed = lifted(spark, d).select(F.col("seq").cast("string").alias("name"), F.col("beg").alias("start"), (F.col("fin") + F.col("ctg") * 997).alias("end"))
    size = view(spark, d, "px_contig").groupBy(F.col("seq").cast("string").alias("name")).agg(F.max(F.col("pos") + F.col("len")).alias("len"))
    return coords.bed_violations(bed, size).agg(F.count("*").alias("n"))


@query("fl13_self_alignments", "select count(*) as n from px_ovl where aread=bread", "px_ovl")
def _(spark, d):
    return view(spark, d, "px_ovl").where("aread = bread").agg(F.count("*").alias("n"))


@query("fl14_name_length", "select count(*) as n from px_seq s left join (select seq_id, length(dna)-(seq_id%3) len from px_seq where seq_id%5<>0) c using (seq_id) where not coalesce(length(dna)=len,false)", "px_seq")
def _(spark, d):
    s = view(spark, d, "px_seq").select(F.col("seq_id").alias("name"), F.length("dna").cast("long").alias("len"))
    return coords.name_and_length_mismatches(s, s.where("name % 5 <> 0").select("name", (F.col("len") - F.col("name") % 3).alias("len"))).agg(F.count("*").alias("n"))


MASK = f"select seq, sbeg s, sbeg+(send-sbeg)*300 e from ({LIFT})"


def _bed(spark, d):
    return lifted(spark, d).select("seq", F.col("beg").alias("start"), (F.col("beg") + (F.col("fin") - F.col("beg")) * 300).alias("end"))


@query("j10_mask_project", f"select ctg, greatest(s,pos)-pos as start, least(e,pos+len)-pos as \"end\" from ({MASK}) m join px_contig c on m.seq=c.seq and s<pos+len and e>pos", "px_tan", "px_contig")
def _(spark, d):
    return coords.project_masks(_bed(spark, d), view(spark, d, "px_contig"))


@query("a08_mask_totals", f"select cast(sum(e-s) as bigint) as total, count(*) as n from ({MASK})", "px_tan", "px_contig")
def _(spark, d):
    return _bed(spark, d).agg(F.sum(F.col("end") - F.col("start")).alias("total"), F.count("*").alias("n"))


ACGT = "abcdghkmnrstvwy"


@query("f01_revcomp", "select seq_id, reverse(translate(dna,'acgt','tgca')) as rc from px_seq", "px_seq")
def _(spark, d):
    return view(spark, d, "px_seq").select("seq_id", sq.revcomp(F.col("dna")).alias("rc"))


@query("f02_normalise", "select doc_id, regexp_replace(text,'[^ACGTNacgtn]','','g') as dna, translate(lower(regexp_replace(text,'[^ACGTNacgtn]','','g')),'acgtn','01234') as idx from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", sq.dna_text(F.col("text")).alias("dna"), sq.to_index(F.col("text")).alias("idx"))


@query("f05_first_mismatch", "select seq_id, greatest(coalesce(list_position(list_transform(list_zip(string_split(dna,''),string_split(reverse(dna),'')), lambda p: p[1]<>p[2]), true),0)-1,0) as pos from px_seq", "px_seq")
def _(spark, d):
    return view(spark, d, "px_seq").select("seq_id", sq.first_mismatch(F.col("dna"), F.reverse("dna")).cast("long").alias("pos"))


@query("f06_qual_pack", "select seq_id, translate(dna,'acgt','0011') as bits from px_seq", "px_seq")
def _(spark, d):
    q = F.transform(F.filter(F.split("dna", ""), lambda c: c != ""), F.ascii)
    return view(spark, d, "px_seq").select("seq_id", F.array_join(F.transform(sq.quality_bits(q, 103), lambda b: b.cast("string")), "").alias("bits"))


@query("f07_substring", "select seq_id, substring(dna, cast(seq_id%50+1 as integer), 25) as part from px_seq", "px_seq")
def _(spark, d):
    return view(spark, d, "px_seq").select("seq_id", sq.cut(F.col("dna"), F.col("seq_id") % 50, F.col("seq_id") % 50 + 25).alias("part"))


@query("f10_coordinates", "select ctg, seq, pos as start, pos+len as \"end\" from px_contig", "px_contig")
def _(spark, d):
    t = view(spark, d, "px_contig").withColumn("c", sq.parse_coordinates(F.format_string("%d:%d-%d", "seq", "pos", F.col("pos") + F.col("len"))))
    return t.select("ctg", F.col("c.id").cast("long").alias("seq"), "c.start", "c.end")


@query("f14_base_index", "select seq_id, translate(dna,'acgt','0123') as idx from px_seq", "px_seq")
def _(spark, d):
    return view(spark, d, "px_seq").select("seq_id", sq.to_index(F.col("dna")).alias("idx"))


@query("p09_short_name", "select doc_id, regexp_extract(text,'^[^ \\t]*',0) as name from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", sq.short_name(F.col("text")).alias("name"))


@query("p12_unit_label", "select p_partkey, coalesce(try_cast(regexp_extract(cast(p_size as varchar)||' bp','^\\s*([+-]?\\d+)',1) as bigint),0) as unit from part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", sq.leading_integer(F.concat(F.col("p_size").cast("string"), F.lit(" bp"))).alias("unit"))


@query("s24_contig_runs", """, letters as (select seq_id, i, f, lag(f,1,0) over (partition by seq_id order by i) before, lead(f,1,0) over (partition by seq_id order by i) after
        from (select seq_id, i, case when c in ('a','g','t') then 1 else 0 end f from (select seq_id, unnest(string_split(dna,'')) c, unnest(range(0,length(dna))) i from px_seq where length(dna)>0))),
    edges as (select seq_id, count(*) filter (f>before) n_runs, cast(sum(f) as bigint) bases, min(i) filter (f=1) first, cast(sum(case when f>before then i end) as bigint) starts, cast(sum(case when f>after then i+1 end) as bigint) ends from letters group by seq_id)
    select seq_id, coalesce(n_runs,0) as n_runs, coalesce(bases,0) as bases, coalesce(first,length(dna)) as first, coalesce(starts,0) as starts, coalesce(ends,0) as ends,
        coalesce(list_max(list_transform(regexp_extract_all(translate(dna,'c','n'),'[ACGTacgt]+'), lambda r: length(r))),0) as longest from px_seq left join edges using (seq_id)""", "px_seq")
def _(spark, d):
    r = view(spark, d, "px_seq").select("seq_id", F.length("dna").cast("long").alias("n"), sq.contig_spans(F.translate("dna", "c", "n")).alias("r"))
    total = lambda x: F.aggregate(F.transform("r", x), F.lit(0).cast("long"), lambda a, b: a + b)
    first = F.coalesce(F.get("r", F.lit(0)).getField("pos"), F.col("n"))  # a sequence without a run ends before its first
    return r.select(
        "seq_id", F.size("r").cast("long").alias("n_runs"), total(lambda x: x["len"]).alias("bases"), first.alias("first"), total(lambda x: x["pos"]).alias("starts"),
        total(lambda x: x["pos"] + x["len"]).alias("ends"), F.coalesce(F.array_max(F.transform("r", lambda x: x["len"])), F.lit(0)).alias("longest"),
    )


RANDOM = "select seq_id, coalesce(string_agg(translate(substring(md5(seq_id||':'||k||':1'),1,1),'0123456789abcdef','acgtacgtacgtacgt'),'' order by k),'') s from px_rand left join range(1,10000) b(k) on k<=len group by seq_id"


@query("s26_random_sequences", RANDOM, "px_rand")
def _(spark, d):
    return align.random_sequences(view(spark, d, "px_rand"))


@query("w02_differences", "select user_id, event_id, lead(event_id) over (partition by user_id order by ts, event_id) - event_id as diff from events")
def _(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", (F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - F.col("event_id")).alias("diff"))


@query("w08_runs", """select seq_id, count(*) as n_runs, max(n) as longest from (select seq_id, g, count(*) n from (
    select seq_id, i, sum(f) over (partition by seq_id order by i) g from (select seq_id, i, case when c is distinct from lag(c) over (partition by seq_id order by i) then 1 else 0 end f
    from (select seq_id, unnest(string_split(dna,'')) c, unnest(range(1,length(dna)+1)) i from px_seq where length(dna)>0))) group by 1,2) group by 1""", "px_seq")
def _(spark, d):
    r = view(spark, d, "px_seq").where("length(dna) > 0").select("seq_id", F.transform(sq.symbol_runs(F.col("dna")), F.length).alias("r"))
    return r.select("seq_id", F.size("r").cast("long").alias("n_runs"), F.array_max("r").cast("long").alias("longest"))


GREEDY = f"""lift as (select seq, sbeg s, send e, unit, row_number() over (partition by seq order by sbeg, send, unit) rn from ({LIFT})),
    acc as (select seq, rn, e from lift where rn=1 union all select seq, n.rn, n.e from (select a.seq, min(struct_pack(rn:=l.rn, e:=l.e)) n from acc a join lift l on l.seq=a.seq and l.s>=a.e group by a.seq))"""


def _accepted(spark, d):
    return tandem.greedy(lifted(spark, d).select("seq", F.col("beg").alias("start"), F.col("fin").alias("end"), "unit"))


@query("w04_greedy", f", {GREEDY} select l.seq, l.s as start, l.e as \"end\", l.unit from acc join lift l using (seq, rn)", "px_tan", "px_contig")
def _(spark, d):
    return _accepted(spark, d)


@query("f08_splice_lengths", f""", {GREEDY} select c.seq, c.len - coalesce(r.less,0) as len from (select seq, max(pos+len) len from px_contig group by seq) c
    left join (select l.seq, cast(sum(l.e-l.s-l.unit) as bigint) less from acc join lift l using (seq, rn) group by l.seq) r using (seq)""", "px_tan", "px_contig")
def _(spark, d):
    size = view(spark, d, "px_contig").groupBy("seq").agg(F.max(F.col("pos") + F.col("len")).alias("len"))
    less = _accepted(spark, d).groupBy("seq").agg(F.sum(F.col("end") - F.col("start") - F.col("unit")).alias("less"))
    return size.join(less, "seq", "left").select("seq", (F.col("len") - F.coalesce("less", F.lit(0))).alias("len"))


ARR = "select event_id%997 seq, (event_id*37)%12000 s, (event_id*37)%12000+10+event_id%40 e, 3+event_id%5 unit from events"


SPLICED = f""", lift as (select *, row_number() over (partition by seq order by s,e,unit) rn from ({ARR})),
    acc as (select seq, rn, e from lift where rn=1 union all select seq, n.rn, n.e from (select a.seq, min(struct_pack(rn:=l.rn, e:=l.e)) n from acc a join lift l on l.seq=a.seq and l.s>=a.e group by a.seq)),
    ok as (select l.*, row_number() over (partition by l.seq order by l.rn) k, lag(l.e,1,0) over (partition by l.seq order by l.rn) pe from acc join lift l using (seq, rn)),
    parts as (select seq, string_agg(substring(dna,cast(pe+1 as integer),cast(s-pe as integer))||substring(dna,cast(s+1 as integer),cast(unit as integer)),'' order by k) p, max(e) e from ok join px_seq on seq=seq_id group by seq),
    spliced as (select seq_id as seq, coalesce(p||substring(dna,cast(e+1 as integer)),dna) as dna from px_seq left join parts on seq=seq_id)"""


def _arrays(spark, d):
    s = (F.col("event_id") * 37) % 12000
    return table(spark, d, "events").select((F.col("event_id") % 997).alias("seq"), s.alias("start"), (s + 10 + F.col("event_id") % 40).alias("end"), (3 + F.col("event_id") % 5).alias("unit"))


@query("f08_splice", SPLICED + " select seq, dna from spliced", "px_seq")
def _(spark, d):
    return tandem.splice(view(spark, d, "px_seq").withColumnRenamed("seq_id", "seq"), tandem.greedy(_arrays(spark, d)))


@query("f08_splice_chunks", SPLICED + " select seq, cast(k as bigint) as chunk, substring(dna, cast(k*4096+1 as integer), 4096) as txt from (select *, unnest(range(0,(length(dna)+4095)//4096)) k from spliced)", "px_seq")
def _(spark, d):
    docs = view(spark, d, "px_seq").select(F.col("seq_id").alias("ctg"), F.lit(0).cast("long").alias("start"), F.col("dna").alias("txt"))
    parts = Scratch(spark, "splice").table(sv.chunks(docs, 4096, 1024), "chunks")
    made = sv.chunks(tandem.splice_pieces(parts, tandem.greedy(_arrays(spark, d)), 4096, 1024), 4096, 1024)
    return made.select(F.col("ctg").alias("seq"), "chunk", F.array_join("strips", "").alias("txt"))


STEP = "select arr, p from (select arr, p, lead(p) over (partition by arr order by p)-p d from px_step) where d=20"


@query("a10_exact_copies", f"select arr, count(*) as n from ({STEP}) group by arr", "px_step")
def _(spark, d):
    return tandem.exact_copies(view(spark, d, "px_step"), 20).groupBy("arr").agg(F.count("*").alias("n"))


@query("a11_best_array", f"select arr, n from (select arr, count(*) n from ({STEP}) group by arr) order by n desc, arr limit 1", "px_step")
def _(spark, d):
    return tandem.best_array(tandem.exact_copies(view(spark, d, "px_step"), 20))


@query("fl07_units", "select count(*) as n from px_tan where unit>=20", "px_tan")
def _(spark, d):
    return view(spark, d, "px_tan").where("unit >= 20").agg(F.count("*").alias("n"))


@query("fl08_min_copies", f"select arr, count(*) as n from ({STEP}) group by arr having count(*)>=60", "px_step")
def _(spark, d):
    return tandem.exact_copies(view(spark, d, "px_step"), 20).groupBy("arr").agg(F.count("*").alias("n")).where("n >= 60")


@query("fl09_locus", f"select ctg, beg, fin from px_tan where ctg=3 and beg>=100 and beg<50000", "px_tan")
def _(spark, d):
    return view(spark, d, "px_tan").where("ctg = 3 and beg >= 100 and beg < 50000").select("ctg", "beg", "fin")


@query("fl10_unit", "select ctg, beg, fin from px_tan where unit=17", "px_tan")
def _(spark, d):
    return view(spark, d, "px_tan").where("unit = 17").select("ctg", "beg", "fin")


COPIES = f"copies as (select arr, substring(dna,cast(p+1 as integer),20) copy from ({STEP}) join px_seq on seq_id=arr where p+20<=length(dna))"
VOTE = f""", {COPIES}, vote as (select arr, k, c base, count(*) n from (select arr, k, substring(copy,cast(k as integer),1) c from (select arr, copy, unnest(range(1,21)) k from copies)) group by all),
    top as (select arr, k, base, n from vote qualify row_number() over (partition by arr, k order by n desc, base)=1),
    cns as (select arr, string_agg(base,'' order by k) consensus, cast(sum(n) as bigint) matched from top group by arr)"""


def _copies(spark, d):
    s = tandem.exact_copies(view(spark, d, "px_step"), 20).join(view(spark, d, "px_seq"), F.col("arr") == F.col("seq_id"))
    return s.where("p + 20 <= length(dna)").select("arr", sq.cut(F.col("dna"), F.col("p"), F.col("p") + 20).alias("copy"))


@query("a12_consensus", VOTE + " select arr, consensus, matched from cns", "px_step", "px_seq")
def _(spark, d):
    return tandem.consensus(_copies(spark, d), 20).select("arr", "consensus", "matched")


@query("a13_identity", VOTE + " select arr, (1000*matched)//(20*n) as score from cns join (select arr, count(*) n from copies group by arr) using (arr)", "px_step", "px_seq")
def _(spark, d):
    return tandem.consensus(_copies(spark, d), 20).select("arr", "score")


@query("k12_consensus_fasta", VOTE + " select '>cons20#s'||arr||':0-20#'||n||'#'||printf('%.1f', 0.1*((1000*matched)//(20*n))) as header, consensus from cns join (select arr, count(*) n from copies group by arr) using (arr)", "px_step", "px_seq")
def _(spark, d):
    c = tandem.consensus(_copies(spark, d), 20)
    return c.select(tandem.fasta_header(F.lit(20), F.format_string("s%d", "arr"), F.lit(0), F.lit(20), F.col("count"), F.col("score")).alias("header"), "consensus")


@query("j03_sv_theta_self_join", SV.format(size=50000), "px_ovl")
def _(spark, d):
    return sv.insertions(view(spark, d, "px_ovl"))


@query("fl03_min_flank", "select count(*) as n from px_ovl where least(ae-ab,be-bb)>=2000", "px_ovl")
def _(spark, d):
    return view(spark, d, "px_ovl").where(F.least(F.col("ae") - F.col("ab"), F.col("be") - F.col("bb")) >= 2000).agg(F.count("*").alias("n"))


@query("p04_alignment_size", "select aread, bread, comp, bb, ab, least(ae-ab,be-bb) as size, abs((ae-ab)-(be-bb)) as unequal from px_ovl", "px_ovl")
def _(spark, d):
    a, b = F.col("ae") - F.col("ab"), F.col("be") - F.col("bb")
    return view(spark, d, "px_ovl").select("aread", "bread", "comp", "bb", "ab", F.least(a, b).alias("size"), F.abs(a - b).alias("unequal"))


#: Places of the coordinates on texts of length {n}: all over the text, and so that what is cut lies in it where the text is
#: longer than the longest insertion with its extensions.
TERM_AT, INS_AT = "(least(b_match_begin,b_match_end)%greatest({n}-160,1))", "(a_begin%greatest({n}-50090,1)+30)"


def _piece(at: str, length: str) -> str:
    return f"case when {at}+{length}<=length(txt) then substring(txt, cast({at}+1 as integer), cast({length} as integer)) end"


TERM, INS = _piece(TERM_AT.format(n="length(txt)"), "abs(b_match_begin-b_match_end)+60"), _piece(INS_AT.format(n="length(txt)"), "a_end-a_begin")
TERM_SEQ = f"case when comp=0 then {TERM} else reverse(translate({TERM},'acgt','tgca')) end"
EXT_SEQ = _piece(INS_AT.format(n="length(txt)") + "-lext", "a_end-a_begin+lext+rext")


def _on_texts(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Insertions of sequences that have a text, with their places on it: a_at and b_at."""
    n = sv.lengths(chunks)
    for key, at, place in (("a", "a_at", INS_AT), ("b", "b_at", TERM_AT)):
        size = coords.dimension(n.select(F.col("ctg").alias(key), F.col("len").alias("__n")))
        rows = rows.join(size, key).withColumn(at, F.expr(place.format(n="__n"))).drop("__n")
    return rows


@query("j04_term_seq", f"select a,b,comp,a_begin,a_end,b_match_begin,b_match_end, {TERM_SEQ} as term_seq from ({SV.format(size=50000)}) join px_part on ctg=b where length(txt)>0 and a in (select ctg from px_part where length(txt)>0)", "px_ovl", "px_seq", "px_part")
def _(spark, d):
    chunks = text_chunks(spark, d)
    rows = _on_texts(sv.insertions(view(spark, d, "px_ovl")).drop("lflank", "rflank"), chunks)
    return sv.with_terminal(rows, chunks, at=F.col("b_at"), most=sv.SvOptions().longest_terminal).drop("a_at", "b_at")


@query("j05_ins_seq", f"select a,b,comp,a_begin,a_end,b_match_begin,b_match_end, {INS} as ins_seq from ({SV.format(size=50000)}) join px_part on ctg=a where length(txt)>0 and b in (select ctg from px_part where length(txt)>0)", "px_ovl", "px_seq", "px_part")
def _(spark, d):
    chunks = text_chunks(spark, d)
    rows = _on_texts(sv.insertions(view(spark, d, "px_ovl")).drop("lflank", "rflank"), chunks)
    return sv.with_insert(rows, chunks, at=F.col("a_at"), most=sv.SvOptions().longest_insert).drop("a_at", "b_at")


@query("k13_variants", f"""select an.name||':'||(an.pos+a_begin)||'-'||(an.pos+a_end)||'_'||bn.name||':'||(bn.pos+b_match_begin)||'-'||(bn.pos+b_match_end) as id,
    an.name as a_name, an.pos+a_begin as a_start, an.pos+a_end as a_stop, bn.name as b_name, bn.pos+b_match_begin as b_start, bn.pos+b_match_end as b_stop, comp, lflank, rflank, lext, rext,
    (select {TERM_SEQ} from px_part where ctg=b) as term_seq, (select {EXT_SEQ} from px_part where ctg=a) as ins_seq
    from (select *, least(a_begin,30) lext, least(2100000-a_end,30) rext from ({SV.format(size=50000)})
    qualify row_number() over (partition by a,a_begin,a_end order by b,comp,b_match_begin,b_match_end,lflank,rflank)=1) v join px_scaf an on an.ctg=v.a join px_scaf bn on bn.ctg=v.b""", "px_ovl", "px_seq", "px_part", "px_scaf")
def _(spark, d):
    scaf, chunks = view(spark, d, "px_scaf"), text_chunks(spark, d)
    rows = _on_texts(sv.variant_rows(view(spark, d, "px_ovl"), scaf, scaf), chunks)
    return sv.with_sequences(rows, chunks, chunks, a_at=F.col("a_at"), b_at=F.col("b_at"))


@query("o03_variant_order", f"select a,b,a_begin,a_end,b_match_begin,b_match_end,comp, row_number() over (order by a,a_begin,a_end,b,comp,b_match_begin,b_match_end) as place from ({SV.format(size=50000)})", "px_ovl")
def _(spark, d):
    rows = sv.placed_insertions(view(spark, d, "px_ovl")).drop("lflank", "rflank")
    return ordinal.dense_ordinal(rows, F.col("a") * (1 << 20) + F.floor(F.col("a_begin") / 5000), ["a", "a_begin", "a_end", "b", "comp", "b_match_begin", "b_match_end"], "place", dealt=["a", "__place"]).drop("__place")  # 5000 divides a place


@query("k19_variant_counts", f"select comp, count(*) as n, count(distinct a||':'||a_begin||'-'||a_end) as places, cast(sum(a_end-a_begin) as bigint) as bases from ({SV.format(size=50000)}) group by comp", "px_ovl")
def _(spark, d):
    places = sv.placed_insertions(view(spark, d, "px_ovl")).groupBy("a", "__place", "comp", "a_begin", "a_end").agg(F.count("*").alias("k"))
    return places.groupBy("comp").agg(F.sum("k").alias("n"), F.count("*").alias("places"), F.sum(F.col("k") * (F.col("a_end") - F.col("a_begin"))).alias("bases"))


@query("u01_self_union", "select aread,bread,comp,bb,be,ab,ae from px_ovl union all select bread,aread,comp,ab,ae,bb,be from px_ovl", "px_ovl")
def _(spark, d):
    return sv.both_roles(view(spark, d, "px_ovl")).select("aread", "bread", "comp", "bb", "be", "ab", "ae")


BUCKET = f"select a, a_begin//1000 x, a_end//1000 y, b, comp, b_match_begin, b_match_end from ({SV.format(size=50000)})"


@query("a14_dedup", f"select a, x, y, b, comp, b_match_begin, b_match_end from ({BUCKET}) qualify row_number() over (partition by a,x,y order by b,comp,b_match_begin,b_match_end)=1", "px_ovl")
def _(spark, d):
    rows = sv.insertions(view(spark, d, "px_ovl")).select("a", F.expr("a_begin div 1000").alias("x"), F.expr("a_end div 1000").alias("y"), "b", "comp", "b_match_begin", "b_match_end")
    return sv.dedup(rows, "a", "x", "y")


@query("p06_flip", "select bread as aread, aread as bread, comp, ab as bb, ae as be, bb as ab, be as ae from px_ovl", "px_ovl")
def _(spark, d):
    return sv.flip(view(spark, d, "px_ovl"))


@query("p07_extensions", f"select a,b,a_begin,a_end,b_match_begin, least(a_begin,30) as lext, least(2100000-a_end,30) as rext from ({SV.format(size=50000)})", "px_ovl")
def _(spark, d):
    return sv.with_extensions(sv.insertions(view(spark, d, "px_ovl")), F.lit(2100000)).select("a", "b", "a_begin", "a_end", "b_match_begin", "lext", "rext")


@query("p08_sv_id", f"select a||':'||a_begin||'-'||a_end||'_'||b||':'||b_match_begin||'-'||b_match_end as id from ({SV.format(size=50000)})", "px_ovl")
def _(spark, d):
    return sv.with_id(sv.insertions(view(spark, d, "px_ovl"))).select("id")


ALL_PAIRS = "px_name x join px_name y on x.seq_id<y.seq_id"


@query("j06_pairs", f"select x.seq_id i, y.seq_id j from {ALL_PAIRS}", "px_name")
def _(spark, d):
    return align.pairs(view(spark, d, "px_name")).select("i", "j")


@query("f20_nw_unit_cost", f"select x.seq_id i, y.seq_id j, cast(levenshtein(x.s,y.s) as integer) as score from {ALL_PAIRS}", "px_name")
def _(spark, d):
    return align.score_pairs(view(spark, d, "px_name"), align.Costs(1, 1, 1), strands=False).select("i", "j", "score")


@query("f22_strand_min", f"select i, j, cast(least(f,r) as integer) as score, case when f<=r then '+' else '-' end as strand from (select x.seq_id i, y.seq_id j, levenshtein(x.s,y.s) f, levenshtein(x.s,reverse(translate(y.s,'acgt','tgca'))) r from {ALL_PAIRS})", "px_name")
def _(spark, d):
    return align.score_pairs(view(spark, d, "px_name"), align.Costs(1, 1, 1)).select("i", "j", "score", "strand")


#: Weighted distance of pairs (i, j, p, q), p the longer: a row of the table a step, gaps along it by a running minimum.
COST = "case when substring(p,cast(k+1 as integer),1)=substring(q,cast(c as integer),1) then 0 when substring(p,cast(k+1 as integer),1)||substring(q,cast(c as integer),1) in ('ag','ga','ct','tc') then 1 else 2 end"


def nw_rows(name: str, pairs: str, loop: bool) -> str:
    """CTEs: {name}_r with the rows of each pair's table, {name} with (i, j, score, ends)."""
    edge = COST.replace("substring(q,cast(c as integer),1)", "substring(q,cast(length(q) as integer),1)")
    left = f"least(prev[length(q)]+{edge}, 3+prev[length(q)+1])" if loop else "(k+1)*3"
    start = "list_transform(range(0,length(q)+1), lambda x: 0)" if loop else "list_transform(range(0,length(q)+1), lambda x: 3*x)"
    best = "list_min(prev[1:length(q)])" if loop else "prev[length(q)+1]"
    ends = f"case when {best} < 3*length(p) then list_position(prev[1:length(q)], {best})-1 else 0 end" if loop else "0"
    score = f"least({best}, 3*length(p))" if loop else best
    return f""", {name}_p as ({pairs}), {name}_r as (select i, j, p, q, cast(0 as bigint) k, cast({start} as bigint[]) prev from {name}_p union all
        select i, j, any_value(p), any_value(q), any_value(k)+1, list(cast(m+3*c as bigint) order by c) from (select i, j, p, q, k, c, min(t-3*c) over (partition by i, j order by c) m from (
        select i, j, p, q, k, c, case when c=0 then {left} else least(prev[c]+{COST}, 3+prev[c+1]) end t from (select *, unnest(range(0,length(q)+1)) c from {name}_r where k<length(p)))) group by i, j),
    {name} as (select i, j, cast({score} as integer) score, cast({ends} as integer) ends from {name}_r where k=length(p))"""


LONGER = "case when length(y.s)>length(x.s) then y.s else x.s end p, case when length(y.s)>length(x.s) then x.s else y.s end q"
REVERSE = "(select seq_id, reverse(translate(s,'acgt','tgca')) s, length(s) n from px_name)"
FORWARD_PAIRS = f"select x.seq_id i, y.seq_id j, {LONGER} from px_name x join px_name y on x.seq_id<y.seq_id"
REVERSE_PAIRS = f"select x.seq_id i, y.seq_id j, {LONGER} from px_name x join {REVERSE} y on x.seq_id<y.seq_id"
BOTH = "select i, x.len as len_i, j, y.len as len_j, least(f.score,r.score) as score, case when f.score<=r.score then '+' else '-' end as strand, case when f.score<=r.score then f.ends else r.ends end as end_col from f join r using (i,j) join (select seq_id, cast(length(s) as integer) len from px_name) x on x.seq_id=i join (select seq_id, cast(length(s) as integer) len from px_name) y on y.seq_id=j"


@query("k14_pair_scores", nw_rows("f", FORWARD_PAIRS, False) + nw_rows("r", REVERSE_PAIRS, False) + " " + BOTH, "px_name")
def _(spark, d):
    return align.score_pairs(view(spark, d, "px_name"))


@query("f20_nw_default", nw_rows("f", FORWARD_PAIRS, False) + " select i, j, score from f", "px_name")
def _(spark, d):
    return align.score_pairs(view(spark, d, "px_name"), strands=False).select("i", "j", "score")


@query("f20_nw_within", nw_rows("f", FORWARD_PAIRS, False) + " select i, j, score from f join f_p using (i,j) where score<=length(p)*250//1000", "px_name")
def _(spark, d):
    return align.score_pairs(view(spark, d, "px_name"), strands=False, within=250).select("i", "j", "score")  # so wide a bound has nearly all pairs as candidates


@query("f21_nw_loop", nw_rows("f", FORWARD_PAIRS, True) + nw_rows("r", REVERSE_PAIRS, True) + " " + BOTH, "px_name")
def _(spark, d):
    return align.score_pairs(view(spark, d, "px_name"), align.Costs(loop=True))


@query("a15_threshold", f", rnd as ({RANDOM})" + nw_rows("f", f"select x.seq_id i, y.seq_id j, {LONGER} from rnd x join rnd y on x.seq_id<y.seq_id", False) + " select avg(score*100e0/length(p)) as mean, avg(score*100e0/length(p))*0.009e0 as factor from f join f_p using (i,j)", "px_rand")
def _(spark, d):
    return align.estimate_factor(align.random_sequences(view(spark, d, "px_rand")))


#: Linking distance in thousandths of the longer line.
NEAR = 50
def _words(n: int) -> str:
    """How often each word of n letters stands in s, for words that can't overlap themselves."""
    words = map("".join, itertools.product("acgt", repeat=n))
    return "[" + ",".join(f"(length(s)-length(replace(s,'{w}','')))//{n}" for w in words if not any(w[:k] == w[-k:] for k in range(1, n))) + "]"


#: One edit changes 2n counts of words of n letters at most, so lines that differ in more aren't compared letter by letter.
LINKS = f""", ln as materialized (select seq_id, s, length(s) n, {_words(2)} c, {_words(4)} w from px_line),
    by_len as materialized (select x.seq_id i, y.seq_id j, y.n*{NEAR}//1000 k from ln x join ln y on x.n<=y.n and x.n>=y.n-y.n*{NEAR}//1000 where (x.n<y.n or x.seq_id<y.seq_id) and {'+'.join(f'abs(x.c[{n}]-y.c[{n}])' for n in range(1, 13))}<=4*(y.n*{NEAR}//1000)),
    by_count as materialized (select i, j, x.s p, y.s q, k from by_len join ln x on x.seq_id=i join ln y on y.seq_id=j where list_sum(list_transform(list_zip(x.w,y.w), lambda z: abs(z[1]-z[2])))<=8*k),
    scored as materialized (select i, j, k, cast(levenshtein(p,q) as integer) score from by_count), lk as materialized (select i, j, score from scored where score<=k)"""


@query("fl11_similar", LINKS + " select least(i,j) i, greatest(i,j) j, score from lk", "px_line")
def _(spark, d):
    return similar.similar_pairs(Scratch(spark, "lines").table(view(spark, d, "px_line"), "lines"), NEAR).select("i", "j", "score")


REACH = LINKS + """, b as (select i x, j y from lk union all select j, i from lk),
    r as (select x, y from b union select r.x, b.y from r join b on r.y=b.x), comp as materialized (select x node, least(x,min(y)) label from r group by x)"""


def _labels(spark, d):
    """The lines, and (node, label) of those with a link, both written once."""
    scratch = Scratch(spark, "lines")
    lines = scratch.table(view(spark, d, "px_line"), "lines")
    return lines, scratch.table(cluster.components(similar.similar_pairs(lines, NEAR).select("i", "j")), "labels")


@query("g01_components", f"{REACH} select node, label from comp", "px_line")
def _(spark, d):
    return _labels(spark, d)[1]


SUMS = "sums as (select a.label, a.node, cast(sum(levenshtein(p.s,q.s)) as bigint) total from comp a join comp b on a.label=b.label and a.node<>b.node join px_line p on p.seq_id=a.node join px_line q on q.seq_id=b.node group by all)"


def _sums(spark, d):
    lines, labels = _labels(spark, d)
    return lines, labels, cluster.inner_sums(labels, lines)


@query("a16_cluster_sum", f"{REACH}, {SUMS} select label, node, total from sums", "px_line")
def _(spark, d):
    return _sums(spark, d)[2]


MEDOID = """sized as (select s.*, cast(length(p.s) as integer) len, min(length(p.s)) over (partition by s.label) short from sums s join px_line p on p.seq_id=s.node),
    picked as (select label, count(*) as count, cast(min(short) as integer) as min_len, case when arg_min(len, struct_pack(t:=total,n:=node)) > 1.1e0*min(short) then arg_min(node, struct_pack(t:=total,n:=node)) filter (len<=1.1e0*short) else arg_min(node, struct_pack(t:=total,n:=node)) end as medoid
    from sized group by label)"""


@query("a17_medoid", f"{REACH}, {SUMS}, {MEDOID} select label, count, min_len, medoid from picked", "px_line")
def _(spark, d):
    lines, _, sums = _sums(spark, d)
    return cluster.medoids(sums, lines.select(F.col("seq_id").alias("node"), F.length("s").alias("len")))


REPORT = f"""{REACH}, {SUMS}, {MEDOID}, report as (select dense_rank() over (order by label) as cluster, node as member, cast(length(p.s) as integer) as len,
    case when node=medoid then 0 else levenshtein(p.s, q.s) end as score, node=medoid as is_representative
    from comp join picked using (label) join px_line p on p.seq_id=node join px_line q on q.seq_id=medoid)"""


def _report(spark, d):
    lines, labels, sums = _sums(spark, d)
    medoid = cluster.medoids(sums, lines.select(F.col("seq_id").alias("node"), F.length("s").alias("len")))
    return cluster.report(labels, medoid, lines), lines


@query("k15_cluster_report", f"{REPORT} select cluster, member, len, cast(score as bigint) as score, is_representative from report", "px_line")
def _(spark, d):
    return _report(spark, d)[0]


@query("k15_representatives", f"{REPORT} select '>sat-'||cluster||'-'||len||chr(10)||s as value from report join px_line on seq_id=member where is_representative", "px_line")
def _(spark, d):
    return cluster.representative_fasta(*_report(spark, d))


@query("a01_line_stats", "select typ as type, count(*) as count, max(val) as max, cast(sum(val) as bigint) as total from px_lines group by typ", "px_lines")
def _(spark, d):
    return ordinal.line_stats(view(spark, d, "px_lines"))


OBJ = "obj as (select *, cast(sum(case when typ='A' then 1 else 0 end) over (order by line_no) as bigint) obj from px_lines)"


@query("w06_object_ordinal", f", {OBJ} select line_no, obj from obj", "px_lines")
def _(spark, d):
    return ordinal.object_ordinal(view(spark, d, "px_lines"), "A").select("line_no", "obj")


@query("a02_nested_stats", f", {OBJ} select typ as type, max(n) as max_count, cast(max(t) as bigint) as max_total from (select obj, typ, count(*) n, sum(val) t from obj where obj>0 group by all) group by typ", "px_lines")
def _(spark, d):
    return ordinal.nested_stats(view(spark, d, "px_lines"), "A")


@query("a03_until_next", f", {OBJ} select obj as grp, count(*) filter (typ='U') as n from obj where obj>0 group by obj", "px_lines")
def _(spark, d):
    return ordinal.count_until_next(view(spark, d, "px_lines"), "A", "U")


@query("j07_children", f", {OBJ} select obj, max(val) filter (typ='A') as own, arg_max(val, line_no) filter (typ='D') as \"D\", arg_max(val, line_no) filter (typ='U') as \"U\" from obj where obj>0 group by obj", "px_lines")
def _(spark, d):
    return ordinal.children(view(spark, d, "px_lines"), "A", ["D", "U"])


@query("fl01_ordinal_ranges", f", {OBJ} select line_no, typ, val, obj from obj where obj<10 or (obj>=100 and obj<105)", "px_lines")
def _(spark, d):
    return ordinal.ordinal_ranges(ordinal.object_ordinal(view(spark, d, "px_lines"), "A"), [(0, 10), (100, 105)])


@query("fl02_contained_lines", "select line_no, typ from px_lines where typ in ('A','D')", "px_lines")
def _(spark, d):
    schema = parse_schemas("P 3 tst\nO A 1 3 INT\nD D 1 3 INT\nO U 1 3 INT\n")["tst"]  # a U line is an object that A doesn't contain
    return ordinal.contained_lines(view(spark, d, "px_lines"), schema.contained("A"))


@query("fl15_copy_bounds", f"select arr, p, p+20-length(dna) as beyond from ({STEP}) join px_seq on seq_id=arr where p+20>length(dna)", "px_step", "px_seq")
def _(spark, d):
    s = tandem.exact_copies(view(spark, d, "px_step"), 20).join(view(spark, d, "px_seq").select("seq_id", F.length("dna").cast("long").alias("len")), F.col("arr") == F.col("seq_id"))
    return tandem.copies_out_of_bounds(s, 20).select("arr", "p", (F.col("p") + 20 - F.col("len")).alias("beyond"))


#: Starts are far apart and begin late, so many positions lie in buckets without a start, or before the first.
POSITIONS = "select l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_orderkey*7919+l_linenumber*104729+l_partkey*31)*11%60000000 x from lineitem"
STARTS = "select 1000000+(s_suppkey*1000003)%50000000 as start from supplier"


@query("w07_enclosing", f"select p.*, s.start as obj_start from ({POSITIONS}) p asof left join ({STARTS}) s on p.x>=s.start")
def _(spark, d):
    x = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729 + F.col("l_partkey") * 31) * 11 % 60000000
    positions = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", x.alias("x"))
    starts = table(spark, d, "supplier").select((F.lit(1000000) + (F.col("s_suppkey") * 1000003) % 50000000).alias("start"))
    return ordinal.last_before(positions, "x", starts, "start", "obj_start")


@query("w05_first_row", f"select seq, sbeg as start, send as \"end\", unit, ctg, diffs from (select *, row_number() over (partition by seq order by sbeg, send, unit, ctg, diffs) rn from ({LIFT})) where rn=1", "px_tan", "px_contig")
def _(spark, d):
    first = F.min(F.struct(F.col("beg").alias("start"), F.col("fin").alias("end"), "unit", "ctg", "diffs")).alias("r")
    return lifted(spark, d).groupBy("seq").agg(first).select("seq", "r.*")


@query("o05_top1", "select ctg, beg, fin, unit, diffs from px_tan order by fin-beg desc, ctg, beg, fin, unit, diffs limit 1", "px_tan")
def _(spark, d):
    return view(spark, d, "px_tan").orderBy(F.desc(F.col("fin") - F.col("beg")), "ctg", "beg", "fin", "unit", "diffs").limit(1)


@query("o07_first_hit", "select ctg, beg, fin, unit, diffs from px_tan where ctg=3 and beg>=100 order by beg, fin, unit, diffs limit 1", "px_tan")
def _(spark, d):
    return tandem.first_hit(view(spark, d, "px_tan").select("ctg", "beg", "fin", "unit", "diffs"), (F.col("ctg") == 3) & (F.col("beg") >= 100), "beg", "fin", "unit", "diffs")


@query("u02_shards_in_order", "select l_orderkey, l_linenumber, shard, row_number() over (order by shard, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate) as line_no from (select *, 0 as shard from lineitem where l_returnflag='R' union all select *, 1 from lineitem where l_returnflag='A' union all select *, 2 from lineitem where l_returnflag not in ('R','A'))")
def _(spark, d):
    li = table(spark, d, "lineitem")
    shards = [li.where("l_returnflag = 'R'"), li.where("l_returnflag = 'A'"), li.where("l_returnflag not in ('R', 'A')")]
    whole = ordinal.concatenate(shards, F.floor(F.col("l_orderkey") / 256), ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate"], "line_no")
    return whole.select("l_orderkey", "l_linenumber", "shard", "line_no")


@query("o04_count_desc", f"select arr, count(*) as n from ({STEP}) group by arr order by n desc, arr", "px_step")
def _(spark, d):
    return tandem.exact_copies(view(spark, d, "px_step"), 20).groupBy("arr").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "arr")


@query("o08_set_edit", "select k from (select distinct l_suppkey as k from lineitem union select s_suppkey from supplier) where k not in (select n_nationkey from nation)")
def _(spark, d):
    have, more, less = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    return ordinal.edit_set(have, more, less, "k")


@query("u04_set_insert", "select l_suppkey as k, min(l_orderkey) as first from lineitem group by l_suppkey")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.min("l_orderkey").alias("first"))


@query("a18_byte_histogram", "select lower(h) as byte, count(*) as n from (select unnest(regexp_extract_all(hex(encode(text)),'..')) h from documents) group by 1")
def _(spark, d):
    return byte_histogram(table(spark, d, "documents"), "text").select(F.lower(F.lpad(F.hex("byte"), 2, "0")).alias("byte"), "n")


@query("k10_fasta_lines", "select '>'||seq_id||chr(10)||dna as value from px_seq", "px_seq")
def _(spark, d):
    from seqlake.sources.seqfiles import fasta_lines

    return fasta_lines(view(spark, d, "px_seq").select(F.col("seq_id").cast("string").alias("id"), F.col("dna").alias("seq")))
