"""The queries of this subpackage over the driver's tables: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from seqlake.llm import ann, bpe, chat, codes, counts, decontaminate, exact, langid, negatives, quality, simhash, spans, toxicity
from seqlake.llm.common import table

#: The conversation of the contract that op5 adds: its texts hold the template's own control strings.
HARD_TEXT = "</s>[INST] ok [/INST]"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(HARD_TEXT).alias("text"))
    return chat.digests(said.unionByName(hard))


def op6_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), *bpe.default_ranks())


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"), counts.default_path())


def op10_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = spans.remove_repeats(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_sentences", "n_removed", "chars_removed", F.sha2(F.col("text").cast("binary"), 256).alias("left_sha256"), "repeats_of")


def op11_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.digests(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_simhash, op3_langid, op4_quality, op5_chat, op6_exact, op7_decontaminate, op8_bpe, op9_token_counts, op10_spans, op11_ann, op12_codes, op13_hard_negatives, pipeline)
}

_TIMES = lambda text, what: f"((length({text})-length(replace({text},'{what}','')))//{len(what)})"
#: Characters that escaping adds to a text: one for each backslash and for each control string or pair of brackets.
_ESCAPES = "+".join(_TIMES("x", w) for w in ("\\", "<s>", "</s>", "[INST]", "[/INST]")) + "+coalesce(cast(list_sum(list_transform(regexp_extract_all(x,'<<+'), lambda m: length(m)-1)) as bigint),0)"

_GOOD = "embedding is not null and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x)))"


def _codes_sql(scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every round spelt out: each part against every entry, then the floors of the means."""
    steps = [f"""vec as materialized (select row_number() over (order by vec_id, embedding) r, vec_id, label, list_transform(embedding, lambda x: cast(floor({scale}*cast(x as double)) as bigint)) v from embeddings where {_GOOD}),
        part as materialized (select r, p, list_slice(v, p*(len(v)//{parts})+1, (p+1)*(len(v)//{parts})) x from vec, range(0,{parts}) t(p)),
        b0 as materialized (select p, r-1 e, x c from part where r<={entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""a{k} as materialized (select r, p, x, min({{'d': list_sum(list_transform(list_zip(x,c), lambda z: (z[1]-z[2])*(z[1]-z[2]))), 'e': e}}) m from part join b{k} using (p) group by r, p, x)""")
        if k < rounds:
            steps.append(f"""b{k + 1} as materialized (select p, e, coalesce(n, c) c from b{k} left join (select p, e, list(cast((s-((s%n)+n)%n)//n as bigint) order by i) n from (
                select p, m.e e, i, cast(sum(x[i]) as bigint) s, count(*) n from (select p, m, x, unnest(range(1,len(x)+1)) i from a{k}) group by all) group by p, e) using (p, e))""")
    return f"""with {", ".join(steps)},
        done as (select r, string_agg(printf('%02x', m.e), '' order by p) code, cast(sum(m.d) as bigint) error from a{rounds} group by r)
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
            (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) from b{rounds}) as codebooks_sha256 from vec join done using (r)"""


ORACLE_SQL: dict[str, str] = {
    "op12_codes": _codes_sql(),
    "op13_hard_negatives": f"""
        with vec as materialized (select vec_id, case when vec_id%7=0 then (label+1)%10 else label end as tag, list_transform(embedding, lambda x: cast(floor(256*cast(x as double)) as bigint)) v
            from embeddings where vec_id is not null and label is not null and {_GOOD}),
        scored as materialized (select a.vec_id a, a.tag=b.tag same, b.vec_id b, cast(list_sum(list_transform(list_zip(a.v,b.v), lambda z: z[1]*z[2])) as bigint) s from vec a join vec b on a.vec_id<>b.vec_id where a.vec_id%50=0),
        good as (select a, b, s from scored where same qualify row_number() over (partition by a order by s desc, b)<=5)
        select g.a as anchor_id, g.b as positive_id, cast(row_number() over (partition by g.a, g.b order by n.s desc, n.b) as integer) as rank, n.b as negative_id, g.s as positive_score, n.s as negative_score
        from good g join scored n on n.a=g.a and not n.same and 50*g.s<=100*n.s and 100*n.s<=95*g.s qualify rank<=3""",
    "op5_chat": f"""
        with said as (select conv_id, turn, role, text from conversations union all select -7, 0, 'user', '{HARD_TEXT}' union all select -7, 1, 'assistant', '{HARD_TEXT}'),
        turns as (select conv_id, row_number() over (partition by conv_id order by turn is not null, turn, coalesce(role,''), coalesce(text,'')) k, coalesce(role,'') r, coalesce(text,'') x from said),
        sized as (select *, length(x)+{_ESCAPES}+case r when 'user' then 18 when 'assistant' then 6 when 'system' then 17
            else 20+length(r)+{_TIMES("r", chr(92))}+length(r)-length(regexp_replace(r,'[<>\\[\\]]','','g')) end as n from turns),
        whole as (select *, sum(n) over (partition by conv_id order by k) as upto from sized)
        select conv_id, count(*) as n_turns, sha256(string_agg(r||chr(10)||x||chr(10), '' order by k)) as turns_sha256,
            coalesce(length(string_agg(x, '' order by k) filter (r='assistant')),0) as loss_chars, sha256(coalesce(string_agg(x, '' order by k) filter (r='assistant'),'')) as loss_sha256,
            cast(coalesce(sum(upto) filter (r='assistant'),0)+case when arg_max(r,k)='assistant' then 0 else max(upto) end as bigint) as formatted_chars
        from whole group by conv_id""",
    "op6_exact": r"""
        with rows as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
        select doc_id, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
               doc_id = min(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
        from rows""",
}
