"""The shared test tables seen as evaluation data. Each view has one definition here and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.operators.thresholds import threshold_struct
from scorelake.operators.transcripts import compact
from scorelake.schemas import AGENT_THRESHOLDS, EXPECTED, RAG_THRESHOLDS, STEP


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- raw provider results from events ---------------------------------------------------------------------------

RES_SQL = """
res as (
  select 'ds' || cast(user_id % 7 as varchar) dataset,
         'ds' || cast(user_id % 7 as varchar) || '_' || cast(ts::date as varchar) run_id,
         ts::date as day, event_type provider, user_id as key, event_id ord, value >= 20 success,
         least(1, value / 100) score, cast(json_extract_string(props, '$.k') as int) * 10 latency_ms,
         value / 10000 cost_usd
  from events)"""
FOLD_SQL = (
    RES_SQL
    + """,
fold as (
  select run_id, dataset, day, key, bool_and(success) passed, min(score) score,
         cast(sum(latency_ms) // count(*) as int) latency_ms, sum(cost_usd) cost_usd, min(ord) ord
  from res group by all)"""
)
SUMMARY_SQL = (
    FOLD_SQL
    + """,
summary as (
  select run_id, dataset, day, count(*) total, count(*) filter (passed) passed, count(*) filter (not passed) failed,
         count(*) filter (passed) / count(*) pass_rate, sum(cost_usd) total_cost_usd, avg(latency_ms) avg_latency_ms,
         list_sort(list(latency_ms))[count(*) // 2 + 1] p50_latency_ms,
         list_sort(list(latency_ms))[least(count(*) * 95 // 100, count(*) - 1) + 1] p95_latency_ms
  from fold group by run_id, dataset, day)"""
)
RUN_KEYS = ("run_id", "dataset", "day")


def raw_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    dataset = F.concat(F.lit("ds"), (F.col("user_id") % 7).cast("string"))
    day = F.to_date("ts")
    return e.select(
        dataset.alias("dataset"),
        F.concat(dataset, F.lit("_"), day.cast("string")).alias("run_id"),
        day.alias("day"),
        F.col("event_type").alias("provider"),
        F.col("user_id").alias("key"),
        F.col("event_id").alias("ord"),
        (F.col("value") >= 20).alias("success"),
        F.least(F.lit(1.0), F.col("value") / 100).alias("score"),
        (F.get_json_object("props", "$.k").cast("int") * 10).alias("latency_ms"),
        (F.col("value") / 10000).alias("cost_usd"),
    )


# --- large raw results from lineitem ----------------------------------------------------------------------------

RESL_SQL = """
resl as (
  select 'li' dataset, cast(year(l_shipdate) * 12 + month(l_shipdate) - 1 as int) as run_no, l_suppkey % 4 as provider,
         l_partkey as key, l_orderkey * 8 + l_linenumber as ord, l_returnflag <> 'R' success, l_discount score,
         cast(l_quantity * 20 as int) latency_ms, l_extendedprice / 1000000 cost_usd
  from lineitem)"""
FOLDL_SQL = (
    RESL_SQL
    + """,
foldl as (
  select dataset, run_no, key, bool_and(success) passed, min(score) score,
         cast(sum(latency_ms) // count(*) as int) latency_ms, sum(cost_usd) cost_usd, min(ord) ord
  from resl group by all)"""
)


def raw_results_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.lit("li").alias("dataset"),
        (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).alias("run_no"),
        (F.col("l_suppkey") % 4).alias("provider"),
        F.col("l_partkey").alias("key"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"),
        (F.col("l_returnflag") != "R").alias("success"),
        F.col("l_discount").alias("score"),
        (F.col("l_quantity") * 20).cast("int").alias("latency_ms"),
        (F.col("l_extendedprice") / 1000000).alias("cost_usd"),
    )


# --- retrieval cases from conversations -------------------------------------------------------------------------

RAG_SQL = """
rag_cases as (
  select 'conv' || cast(conv_id % 3 as varchar) dataset, conv_id case_id, arg_min(text, turn) query
  from conversations where role = 'user' group by conv_id),
rag_responses as (
  select conv_id case_id, arg_max(text, turn) answer, cast(sum(length(text)) % 900 as int) latency_ms
  from conversations where role = 'assistant' group by conv_id),
rag as (
  select dataset, case_id, query, split_part(query, ' ', 1) ground_truth, answer,
         coalesce(latency_ms, 0) latency_ms, case when answer is null then 'no response' end error
  from rag_cases left join rag_responses using (case_id))"""


def rag_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    cases = users.groupBy("conv_id").agg(F.min_by("text", "turn").alias("query"))
    return cases.select(
        F.concat(F.lit("conv"), (F.col("conv_id") % 3).cast("string")).alias("dataset"),
        F.col("conv_id").alias("case_id"),
        "query",
        F.split_part("query", F.lit(" "), F.lit(1)).alias("ground_truth"),
    )


def rag_responses(spark: SparkSession, sf_dir: str, newest: bool = True) -> DataFrame:
    replies = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    pick = F.max_by if newest else F.min_by
    return replies.groupBy("conv_id").agg(
        pick("text", "turn").alias("answer"), (F.sum(F.length("text")) % 900).cast("int").alias("latency_ms")
    ).select(
        F.col("conv_id").alias("case_id"), "answer", "latency_ms", F.lit(None).cast("string").alias("error")
    )


def rag_thresholds(**overrides) -> Column:
    return threshold_struct(RAG_THRESHOLDS, **overrides)


CONTEXTS_SQL = """
marked as (
  select conv_id, turn, text,
         min(case when role = 'user' then turn end) over (partition by conv_id) first_user,
         max(case when role = 'assistant' then turn end) over (partition by conv_id) last_reply
  from conversations),
contexts as (
  select conv_id case_id, list(text order by turn) contexts
  from marked where turn is distinct from first_user and turn is distinct from last_reply group by conv_id)"""


def rag_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation that are neither its query nor its answer, as the contexts of its case row."""
    c = table(spark, sf_dir, "conversations")
    ends = c.groupBy("conv_id").agg(
        F.min(F.when(F.col("role") == "user", F.col("turn"))).alias("first_user"),
        F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("last_reply"),
    )
    kept = c.join(ends, "conv_id").filter(
        ~F.col("turn").eqNullSafe(F.col("first_user")) & ~F.col("turn").eqNullSafe(F.col("last_reply"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return kept.groupBy("conv_id").agg(F.transform(ordered, lambda t: t["text"]).alias("contexts")).withColumnRenamed(
        "conv_id", "case_id"
    )


# --- agent trajectories from conversations ----------------------------------------------------------------------

TRJ_SQL = """
trj as (
  select conv_id, 'agent' || cast(conv_id % 3 as varchar) dataset, cast(count(*) as int) step_count,
         arg_min(text, turn) filter (role = 'user') task,
         arg_max(text, turn) filter (role = 'assistant') final_answer,
         coalesce(list('t' || cast(length(text) % 4 as varchar) order by turn) filter (role = 'user'), []) calls,
         coalesce(list(cast(length(text) % 3 as varchar) order by turn) filter (role = 'user'), []) args,
         cast(sum(length(text)) % 5000 as int) latency_ms, sum(length(text)) / 1000000 cost_usd
  from conversations group by conv_id)"""

EXP_SQL = (
    TRJ_SQL
    + """,
expd as (
  select *,
         case conv_id % 5 when 0 then case when conv_id % 10 = 0 then '  ' || final_answer || chr(10)
                                           else split_part(task, ' ', 1) end
                          when 2 then case conv_id % 15 when 2 then '[' when 7 then '(?P<v>[aeiou])(?P=v)' else '[aeiou]{2}' end when 4 then null else split_part(task, ' ', 1) end exp_answer,
         ['exact', 'contains', 'regex', 'llm_judge', 'contains'][conv_id % 5 + 1] exp_match,
         ['t0', 't' || cast(conv_id % 4 as varchar), 't1'] must_call,
         ['t3', 't' || cast(conv_id % 3 as varchar)] must_not_call,
         [{'tool': 't1', 'len': '1'}, {'tool': 't' || cast(conv_id % 4 as varchar), 'len': '2'},
          {'tool': 't2', 'len': null}] must_call_with,
         case when conv_id % 7 <> 0 then 2 + conv_id % 5 end max_steps,
         case when conv_id % 6 <> 0 then 1 + conv_id % 3 end max_tool_calls,
         list_zip(calls, args) zipped
  from trj),
checked as (
  select *,
         list_filter(must_call, lambda t: not list_contains(calls, t)) missing_tools,
         list_filter(must_not_call, lambda t: list_contains(calls, t)) forbidden,
         list_filter(must_call_with, lambda r: len(list_filter(zipped, lambda z: z[1] = r.tool
             and (r.len is null or z[2] = r.len))) = 0) unmet,
         case when exp_answer is null then 1.0::double
              when exp_match = 'exact' then case when trim(coalesce(final_answer, ''), chr(32) || chr(10)) =
                   trim(exp_answer, chr(32) || chr(10)) then 1.0 else 0.0 end
              when exp_match = 'regex' and exp_answer = '[' then 0.0
              when exp_match = 'regex' then case when regexp_matches(coalesce(final_answer, ''),
                   case when exp_answer like '(?P%' then 'aa|ee|ii|oo|uu' else exp_answer end) then 1.0 else 0.0 end
              else case when contains(lower(coalesce(final_answer, '')), lower(exp_answer)) then 1.0 else 0.0 end
         end answer_score,
         case when exp_answer is not null and exp_match = 'llm_judge'
              then 'llm_judge requested but no --judge-model configured; fell back to contains match'
              when exp_answer = '[' and exp_match = 'regex'
              then 'Invalid regex pattern: unterminated character set at position 0' else '' end answer_reason,
         case when max_steps > 1 then greatest(0.0, 1.0 - (step_count - 1) / (max_steps - 1)) else 1.0 end efficiency
  from expd),
scored as (
  select *,
         greatest(0.0, 1.0 - (len(missing_tools) + len(forbidden) + len(unmet)) / 8) tool_score
  from checked)"""
)

def _turn_step(turn: Column, kind: Column) -> Column:
    """A conversation turn as a trajectory step; a user turn is a tool call named by its length."""
    size = F.length(turn["text"])
    call = F.struct(
        F.concat(F.lit("t"), (size % 4).cast("string")).alias("name"),
        F.create_map(F.lit("len"), (size % 3).cast("string")).alias("arguments"),
        size.cast("string").alias("result_json"),
        F.lit(None).cast("string").alias("error"),
        F.lit(0).alias("latency_ms"),
    )
    return F.struct(
        kind.alias("type"),
        turn["text"].alias("content"),
        F.when(turn["role"] == "user", call).alias("tool_call"),
        F.lit(0).alias("latency_ms"),
        F.lit(0).alias("tokens"),
        F.lit(0.0).alias("cost_usd"),
    ).cast(STEP)


def step_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of conversations as rows: system turns think, user turns call a tool, assistant turns think."""
    c = table(spark, sf_dir, "conversations")
    turn = F.struct("turn", "role", "text")
    kind = F.when(F.col("role") == "user", "tool_call").otherwise("thought")
    return c.select("conv_id", "turn", "role", "text", F.lit(0).alias("pos"), _turn_step(turn, kind).alias("step"))


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation with its ordered steps, for what is one text or one trace per conversation anyway.

    As ``step_rows``, and an assistant turn that ends the conversation is its answer.
    """
    c = table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    count = F.size("turns")

    def step(t: Column, i: Column) -> Column:
        last_reply = (t["role"] == "assistant") & (i == count - 1)
        return _turn_step(t, F.when(t["role"] == "user", "tool_call").when(last_reply, "answer").otherwise("thought"))

    replies = F.filter("turns", lambda t: t["role"] == "assistant")
    asks = F.filter("turns", lambda t: t["role"] == "user")
    return c.groupBy("conv_id").agg(turns.alias("turns")).select(
        "conv_id",
        F.transform("turns", step).alias("steps"),
        F.try_element_at(asks, F.lit(1))["text"].alias("task"),
        F.try_element_at(replies, F.lit(-1))["text"].alias("final_answer"),
    )


def compact_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What scoring needs per conversation, in one aggregation and without gathering turns."""
    role, text, turn, chars = F.col("role"), F.col("text"), F.col("turn"), F.sum(F.length("text"))
    return compact(
        step_rows(spark, sf_dir),
        ("conv_id",),
        F.min_by(F.when(role == "user", text), F.when(role == "user", turn)).alias("task"),
        F.max_by(F.when(role == "assistant", text), F.when(role == "assistant", turn)).alias("final_answer"),
        (chars % 5000).cast("int").alias("latency_ms"),
        (chars / 1000000).alias("cost_usd"),
    )


def agent_cases(spark: SparkSession, sf_dir: str, crashes: bool = False, with_steps: bool = False) -> DataFrame:
    t = (trajectories if with_steps else compact_trajectories)(spark, sf_dir)
    t = t.withColumn("dataset", F.concat(F.lit("agent"), (F.col("conv_id") % 3).cast("string")))
    n = F.col("conv_id")
    word = F.split_part("task", F.lit(" "), F.lit(1))
    answer = (
        F.when((n % 5 == 0) & (n % 10 == 0), F.concat(F.lit("  "), "final_answer", F.lit("\n")))
        .when(n % 15 == 2, "[")
        .when(n % 15 == 7, "(?P<v>[aeiou])(?P=v)")
        .when(n % 5 == 2, "[aeiou]{2}")
        .when(n % 5 == 4, F.lit(None))
        .otherwise(word)
    )
    modes = F.array(*[F.lit(m) for m in ("exact", "contains", "regex", "llm_judge", "contains")])
    tool = lambda k: F.concat(F.lit("t"), (n % k).cast("string"))

    def requirement(name: Column, length: str | None) -> Column:
        args = F.create_map(F.lit("len"), F.lit(length)) if length else F.create_map().cast("map<string,string>")
        return F.struct(name.alias("tool"), args.alias("args"))

    expected = F.struct(
        answer.alias("answer"),
        F.element_at(modes, (n % 5).cast("int") + 1).alias("answer_match"),
        F.lit(None).cast("string").alias("rubric"),
        F.array(F.lit("t0"), tool(4), F.lit("t1")).alias("must_call"),
        F.array(F.lit("t3"), tool(3)).alias("must_not_call"),
        F.array(requirement(F.lit("t1"), "1"), requirement(tool(4), "2"), requirement(F.lit("t2"), None)).alias(
            "must_call_with"
        ),
        F.when(n % 7 != 0, 2 + n % 5).cast("int").alias("max_steps"),
        F.when(n % 6 != 0, 1 + n % 3).cast("int").alias("max_tool_calls"),
    ).cast(EXPECTED)
    error = F.when(n % 13 == 0, "boom") if crashes else F.lit(None).cast("string")
    return t.withColumns(
        {"expected": expected, "error": error, "thresholds": threshold_struct(AGENT_THRESHOLDS)}
    )


# --- cases of the plain kinds from documents, labels and benchmark ----------------------------------------------

CASES_SQL = """
plain_cases as (
  select d.doc_id, ['qa', 'classification', 'instruction'][d.doc_id % 3 + 1] as kind, d.text answer,
         d.text query, split_part(b.text, ' ', 2) ground_truth, cast(l.quality as varchar) label,
         case when d.doc_id % 2 = 0 then d.source end document, 'Covers ' || d.lang rubric,
         length(d.text) % 2 = 0 rubric_passed
  from documents d
  join benchmark b on b.item_id = d.doc_id % (select count(*) from benchmark)
  left join labels l on l.doc_id = d.doc_id)"""


def plain_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, b, lab = (table(spark, sf_dir, t) for t in ("documents", "benchmark", "labels"))
    items = b.agg(F.count("*").alias("n")).scalar()
    keyed = d.withColumn("item_id", F.col("doc_id") % items)
    joined = keyed.join(b.select("item_id", F.col("text").alias("passage")), "item_id").join(
        lab.select("doc_id", "quality"), "doc_id", "left"
    )
    kinds = F.array(F.lit("qa"), F.lit("classification"), F.lit("instruction"))
    head = F.col("text")
    return joined.select(
        "doc_id",
        "lang",
        F.element_at(kinds, (F.col("doc_id") % 3).cast("int") + 1).alias("type"),
        F.col("text").alias("answer"),
        F.struct(
            head.alias("query"),
            head.alias("text"),
            head.alias("instruction"),
            F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("document"),
        ).alias("input"),
        F.struct(
            F.split_part("passage", F.lit(" "), F.lit(2)).alias("ground_truth"),
            F.col("quality").cast("string").alias("label"),
            F.concat(F.lit("Covers "), "lang").alias("rubric"),
        ).alias("expected"),
        (F.length("text") % 2 == 0).alias("rubric_passed"),
    )
