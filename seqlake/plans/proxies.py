"""Views that give the driver's tables the shapes of genome records; the same SQL text runs in Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = "(l_orderkey*7919+l_linenumber*104729+l_partkey*31)"
#: {name: SQL}; {rx} is the engine's way to keep only letters. px_line has every distinct line of all documents (copies
#: of documents give families of like lines), px_name the addresses of all pages.
VIEWS = {
    "px_contig": """select cast(s_suppkey as bigint) ctg, cast(s_nationkey as bigint) seq, cast(100000+(s_suppkey*37)%5000 as bigint) len,
        cast(coalesce(sum(100000+(s_suppkey*37)%5000+200) over (partition by s_nationkey order by s_suppkey rows between unbounded preceding and 1 preceding),0) as bigint) pos
        from supplier""",
    "px_tan": f"""select cast(l_suppkey as bigint) ctg, cast({BASE}%90000 as bigint) beg, cast({BASE}%90000+cast(l_quantity as bigint)*10 as bigint) fin,
        cast(1+l_partkey%60 as bigint) unit, cast(cast(l_quantity as bigint)*(l_partkey%5) as bigint) diffs from lineitem""",
    "px_ovl": f"""select cast(aread as bigint) aread, cast(bread as bigint) bread, comp, cast(bb as bigint) bb, cast(bb+blen as bigint) be,
        cast(case when comp=1 then 2000000-bb-blen+off else bb+off end as bigint) ab,
        cast((case when comp=1 then 2000000-bb-blen+off else bb+off end)+alen as bigint) ae
        from (select l_suppkey%10 aread, l_partkey%10 bread, case when l_returnflag='R' then 1 else 0 end comp, {BASE}%1000000 bb,
              1000+cast(l_quantity as bigint)*40 blen, 1000+cast(l_quantity as bigint)*40+l_linenumber*3 alen,
              (l_orderkey*613+l_suppkey*17)%20000 off from lineitem) t""",
    "px_seq": "select doc_id seq_id, translate(lower({rx}),'abcdefghijklmnopqrstuvwxyz','acgtacgtacgtacgtacgtacgtac') dna from documents",
    "px_step": """select user_id arr, event_id, cast(sum(case when event_type='error' then 21 else 20 end) over (partition by user_id order by ts,event_id rows between unbounded preceding and current row)
        - (case when event_type='error' then 21 else 20 end) as bigint) p from events""",
    "px_name": "select cast(page_id as bigint) seq_id, translate(lower({rx:url}),'abcdefghijklmnopqrstuvwxyz','acgtacgtacgtacgtacgtacgtac') s from pages",
    "px_rand": "select page_id seq_id, length({rx:url}) len from pages",
    "px_scaf": "select cast(seq_id%10 as bigint) ctg, concat('chr',seq_id%10%3) name, cast(seq_id%10*2100000 as bigint) pos, cast(2100000 as bigint) len from px_seq where length(dna)>0 group by seq_id%10",
}
NEEDS = {"px_part": ["px_seq"], "px_scaf": ["px_seq"]}
LINE_ORDER = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate")
VIEWS_DUCK = VIEWS | {
    "px_line": f"""select min(id) seq_id, s from (select doc_id*1000000+i-1 id, translate(lower(regexp_replace(x,'[^A-Za-z]','','g')),'abcdefghijklmnopqrstuvwxyz','acgtacgtacgtacgtacgtacgtac') s
        from (select doc_id, unnest(string_split(text,chr(10))) x, generate_subscripts(string_split(text,chr(10)),1) i from documents)) where length(s)>0 group by s""",
    #: Ten sequences, each of all letters of its documents one behind the other; Spark has them in chunks (text_chunks).
    "px_part": "select cast(seq_id%10 as bigint) ctg, string_agg(dna,'' order by seq_id) txt from px_seq group by seq_id%10",
    "px_lines": f"""select row_number() over (order by {','.join(LINE_ORDER)}) line_no,
        case l_returnflag when 'R' then 'A' when 'A' then 'D' else 'U' end typ, cast(l_quantity as bigint) val from lineitem""",
}


def _rx(sql: str, duck: bool) -> str:
    return re.sub(r"\{rx(?::(\w+))?\}", lambda m: f"regexp_replace({m[1] or 'text'},'[^A-Za-z]',''" + (",'g')" if duck else ")"), sql)


def with_views(*names: str) -> str:
    """"with [recursive] px_... as (...)," text for the oracle, views needed by others first."""
    order: list[str] = []
    for n in names:
        order += [x for x in [*NEEDS.get(n, []), n] if x not in order]
    return "with recursive " + ", ".join(f"{n} as ({_rx(VIEWS_DUCK[n], True)})" for n in order)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A proxy view as a DataFrame; px_lines numbers its rows without gathering them in one task."""
    if name == "px_lines":
        from pyspark.sql import functions as F

        from seqlake.operators.ordinal import dense_ordinal

        rows = dense_ordinal(table(spark, sf_dir, "lineitem"), F.floor(F.col("l_orderkey") / 256), LINE_ORDER, "line_no")
        typ = F.when(F.col("l_returnflag") == "R", "A").when(F.col("l_returnflag") == "A", "D").otherwise("U")
        return rows.select("line_no", typ.alias("typ"), F.col("l_quantity").cast("bigint").alias("val"))
    if name == "px_line":
        from pyspark.sql import functions as F

        from seqlake.operators.similar import distinct_texts

        lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x"))
        dna = F.translate(F.lower(F.regexp_replace("x", "[^A-Za-z]", "")), "abcdefghijklmnopqrstuvwxyz", "acgtacgtacgtacgtacgtacgtac")
        return distinct_texts(lines.select((F.col("doc_id") * 1000000 + F.col("i")).alias("seq_id"), dna.alias("s")).where("length(s) > 0"))[0]
    sql = _rx(VIEWS[name], False)
    frames = {n: table(spark, sf_dir, n) for n in ("supplier", "lineitem", "documents", "events", "pages") if f"from {n}" in sql}
    for need in NEEDS.get(name, []):
        if f"from {need}" in sql:
            frames[need] = view(spark, sf_dir, need)
    for n in frames:
        sql = sql.replace(f"from {n}", f"from {{{n}}}")
    return spark.sql(sql, **frames)


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences of px_part as a written chunk table."""
    from pyspark.sql import functions as F

    from seqlake.operators import sv
    from seqlake.operators.scratch import Scratch

    scratch = Scratch(spark, "texts")
    docs = scratch.table(view(spark, sf_dir, "px_seq").select((F.col("seq_id") % 10).cast("long").alias("ctg"), "seq_id", F.col("dna").alias("txt")), "docs")
    return scratch.table(sv.chunks(sv.joined_pieces(docs, F.floor(F.col("seq_id") / 4096), "seq_id")), "chunks")
