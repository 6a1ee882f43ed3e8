"""Queries over cases: answer and tool scoring, judges, assertions, traces, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions.keys import json_map_text, vars_json, vars_key
from scorelake.functions.scales import METRIC_SCALES
from scorelake.functions.text import icontains, py_round
from scorelake.operators import agent, assertions, display, judge, prompts, rag, traces, transcripts
from scorelake.operators.batch import resume_batch, run_batch
from scorelake.operators.thresholds import threshold_struct
from scorelake.plans import bindings as b
from scorelake.plans.registry import query, rounded, with_
from scorelake.schemas import AGENT_THRESHOLDS
from scorelake.session import new_table_path
from scorelake.sources import results

_R = rounded


def _joined(array: str, alias: str) -> Column:
    return F.array_join(array, "|").alias(alias)


# --- retrieval answers ------------------------------------------------------------------------------------------

# The expected text is shown as Python writes it, so a line break in it reads as a backslash and an n.
_NOT_CONTAINED = r"'Answer does not contain expected ground truth: ''' || replace(ground_truth, chr(10), '\n') || ''''"
_RAG_UNJUDGED_SQL = f"""select dataset, case_id, hit::double contains_score, 1.0::double faithfulness_score,
  hit::double answer_correctness_score, hit::double composite_score, latency_ms,
  array_to_string(list_filter([
    case when error is not null then 'Model call failed: ' || error end,
    case when hit = 0 then {_NOT_CONTAINED} end,
    case when hit = 0 then 'Answer correctness score 0.00 below threshold 0.50 (no judge configured; using contains match)' end
  ], lambda r: r is not null), '; ') failure_reasons, error is null and hit = 1 passed
from scored_rag"""


def _scored_rag_sql(error: str) -> str:
    return b.RAG_SQL + f""",
failing as (select * replace ({error} as error) from rag),
scored_rag as (
  select * replace (case when error is null then answer else '' end as answer),
         cast(contains(lower(case when error is null then answer else '' end), lower(ground_truth)) as int) hit
  from failing)"""


def _rag_output(scored: DataFrame) -> DataFrame:
    return scored.select(
        "dataset", "case_id", "contains_score", "faithfulness_score", "answer_correctness_score", "composite_score",
        F.coalesce("latency_ms", F.lit(0)).alias("latency_ms"),
        F.array_join("failure_reasons", "; ").alias("failure_reasons"), "passed",
    )


@query("rag_scores_unjudged", with_(_scored_rag_sql("error"), _RAG_UNJUDGED_SQL))
def rag_scores_unjudged(spark, sf):
    cases = b.rag_cases(spark, sf).withColumn("thresholds", b.rag_thresholds())
    return _rag_output(rag.score_rag(rag.join_responses(cases, b.rag_responses(spark, sf), ("case_id",))))


@query(
    "rag_call_failure",
    with_(_scored_rag_sql("case when answer is not null and case_id % 10 = 0 then 'timeout' else error end"), _RAG_UNJUDGED_SQL),
)
def rag_call_failure(spark, sf):
    """Answers whose call failed, and cases nobody answered, fail with the error first."""
    cases = b.rag_cases(spark, sf).withColumn("thresholds", b.rag_thresholds())
    responses = b.rag_responses(spark, sf).withColumn("error", F.when(F.col("case_id") % 10 == 0, "timeout"))
    return _rag_output(rag.score_rag(rag.join_responses(cases, responses, ("case_id",))))


_FAITH = ["none", "some", "approximately half", "most", "all", "made up", "ALL "]
_CORRECT = ["incorrect", "partially correct", "correct", "Correct!", "not sure"]


def _reply_text(label: Column, reason: Column) -> Column:
    return F.concat(F.lit('{"reasoning": "'), reason, F.lit('", "answer": "'), label, F.lit('"}'))


def _pick(labels: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), (n % len(labels)).cast("int") + 1)


def _rag_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Two judge replies per answered conversation, made from its id and number of turns."""
    c = b.table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    n, turns = F.col("conv_id"), F.col("turns")
    why = F.concat(F.lit("r"), n.cast("string"))
    replies = F.array(
        F.struct(F.lit("faithfulness").alias("metric"), _reply_text(_pick(_FAITH, turns + n), why).alias("raw_text")),
        F.struct(F.lit("answer_correctness").alias("metric"), _reply_text(_pick(_CORRECT, n), why).alias("raw_text")),
    )
    return c.select(n.alias("case_id"), F.explode(replies).alias("_r")).select("case_id", "_r.metric", "_r.raw_text")


def _sql_list(items) -> str:
    return "[" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in items) + "]"


def _scale_sql(label: str, scale: tuple[str, ...]) -> str:
    """Zero-based position of a lower-case label in a scale, by the same rule as ``Scale.position``."""
    s = _sql_list(scale)
    return (
        f"coalesce(nullif(list_position({s}, {label}), 0) - 1, "
        f"list_position({s}, list_filter({s}, lambda k: contains({label}, k) or contains(k, {label}))[1]) - 1)"
    )


_JUDGED_SQL = _scored_rag_sql("error") + f""",
turn_counts as (select conv_id, count(*) n from conversations group by 1),
labels_given as (
  select conv_id case_id, lower(trim({_sql_list(_FAITH)}[(n + conv_id) % {len(_FAITH)} + 1])) fl,
         lower(trim({_sql_list(_CORRECT)}[conv_id % {len(_CORRECT)} + 1])) cl, 'r' || cast(conv_id as varchar) why
  from turn_counts),
positions as (
  select *, {_scale_sql('fl', METRIC_SCALES['faithfulness'])} fp, {_scale_sql('cl', METRIC_SCALES['correctness'])} cp
  from labels_given),
judged as (
  select s.*, coalesce(fp, 2) / 4 fs, coalesce(cp, 1) / 2 cs,
         case when fp is not null then why
              else 'Could not parse label ''' || fl || ''' — defaulted to ''approximately half''' end fwhy,
         case when cp is not null then why
              else 'Could not parse label ''' || cl || ''' — defaulted to ''partially correct''' end cwhy
  from scored_rag s join positions using (case_id)),
verdict as (
  select *, case when error is null then fs else 1.0 end f, case when error is null then cs else hit::double end c,
    list_filter([
      case when error is not null then 'Model call failed: ' || error end,
      case when hit = 0 then {_NOT_CONTAINED} end,
      case when error is null and fs < 0.5 then 'Faithfulness score ' || printf('%.2f', fs) || ' below threshold 0.50: ' || fwhy end,
      case when error is null and cs < 0.75 then 'Answer correctness score ' || printf('%.2f', cs) || ' below threshold 0.75: ' || cwhy
           when error is not null then 'Answer correctness score 0.00 below threshold 0.75 (no judge configured; using contains match)' end
    ], lambda r: r is not null) reasons
  from judged)"""


@query(
    "rag_scores_judged",
    with_(
        _JUDGED_SQL,
        """select dataset, case_id, hit::double contains_score, f faithfulness_score, c answer_correctness_score,
           round(case when error is null then (f * 0.7 + c * 0.3) / (0.7 + 0.3) else c end, 9) composite_score, latency_ms,
           array_to_string(reasons, '; ') failure_reasons, len(reasons) = 0 passed from verdict""",
    ),
)
def rag_scores_judged(spark, sf):
    limits = b.rag_thresholds(
        min_faithfulness_score=0.5, min_answer_correctness_score=0.75, faithfulness_weight=0.7,
        answer_correctness_weight=0.3,
    )
    cases = b.rag_cases(spark, sf).withColumn("thresholds", limits)
    answered = rag.join_responses(cases, b.rag_responses(spark, sf), ("case_id",))
    judged = judge.pivot_metrics(judge.parse_replies(_rag_replies(spark, sf)), judge.RAG_METRICS, ("case_id",))
    scored = rag.score_rag(rag.join_judge(answered, judged, ("case_id",)))
    return _rag_output(scored).withColumn("composite_score", F.round("composite_score", 9))


@query(
    "rag_case_details",
    with_(
        _JUDGED_SQL,
        f"""select case_id, hit = 1 and error is null and cs >= 0.5 passed, {_R('hit', 4)} contains_score, case when error is null then coalesce(fp, 2) end f_raw,
            case when error is null then {_sql_list(METRIC_SCALES['faithfulness'])}[coalesce(fp, 2) + 1] end f_label,
            case when error is null then coalesce(cp, 1) end c_raw, case when error is null then cwhy end c_reason
            from verdict join positions using (case_id)""",
    ),
)
def rag_case_details(spark, sf):
    cases = b.rag_cases(spark, sf).withColumns({"thresholds": b.rag_thresholds(), "cost_usd": F.lit(0.0)})
    answered = rag.join_responses(cases, b.rag_responses(spark, sf), ("case_id",))
    judged = judge.pivot_metrics(judge.parse_replies(_rag_replies(spark, sf)), judge.RAG_METRICS, ("case_id",))
    details = results.rag_case_details(rag.score_rag(rag.join_judge(answered, judged, ("case_id",))))
    return details.select(
        "case_id", "passed", "contains_score", F.col("faithfulness.raw").alias("f_raw"),
        F.col("faithfulness.label").alias("f_label"), F.col("answer_correctness.raw").alias("c_raw"),
        F.col("answer_correctness.reason").alias("c_reason"),
    )


# --- judge replies ----------------------------------------------------------------------------------------------

_METRICS = list(METRIC_SCALES)
_LABELS = [
    "correct", "Partially Correct", "not correct", "", "banana", "Incorrect!", "yes", "ALL of it", "helpful",
    "generally", "none",
]


def _metric_replies(spark: SparkSession, sf: str) -> DataFrame:
    """One reply per document: metric, label and form (plain, fenced, broken) by its id."""
    d = b.table(spark, sf, "documents").select("doc_id", "lang")
    n = F.col("doc_id")
    body = _reply_text(_pick(_LABELS, F.floor(n / len(_METRICS))), F.concat(F.lit("in "), "lang"))
    text = (
        F.when(n % 17 == 0, F.concat(F.lit("I think "), body))
        .when(n % 19 == 0, F.concat(F.lit("["), body, F.lit("]")))
        .when(n % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```\n")))
        .when(n % 3 == 1, F.concat(F.lit("  "), body))
        .otherwise(body)
    )
    return d.select("doc_id", _pick(_METRICS, n).alias("metric"), text.alias("raw_text"))


def _metric_position_sql() -> str:
    arms = " ".join(f"when '{m}' then {_scale_sql('lab', s)}" for m, s in METRIC_SCALES.items())
    return f"case metric {arms} end"


_REPLIES_SQL = f"""
given as (
  select doc_id, {_sql_list(_METRICS)}[doc_id % {len(_METRICS)} + 1] metric, 'in ' || lang why,
         lower(trim({_sql_list(_LABELS)}[(doc_id // {len(_METRICS)}) % {len(_LABELS)} + 1])) lab,
         doc_id % 17 <> 0 and doc_id % 19 <> 0 readable
  from documents),
placed as (
  select *, case when readable then {_metric_position_sql()} end pos,
         case metric {' '.join(f"when '{m}' then {len(s) // 2}" for m, s in METRIC_SCALES.items())} end mid,
         case metric {' '.join(f"when '{m}' then {len(s) - 1}" for m, s in METRIC_SCALES.items())} end max_raw,
         case metric {' '.join(f"when '{m}' then {_sql_list(s)}" for m, s in METRIC_SCALES.items())} end scale
  from given),
metric_rows as (
  select doc_id, metric, cast(coalesce(pos, mid) as int) raw, scale[coalesce(pos, mid) + 1] as label,
         coalesce(pos, mid) / max_raw normalized, cast(max_raw as int) max_raw,
         case when not readable then 'Could not parse judge response: not a JSON object'
              when pos is not null then why
              else 'Could not parse label ''' || lab || ''' — defaulted to ''' || scale[mid + 1] || '''' end reason
  from placed)"""


@query(
    "judge_own_scale",
    """select doc_id, raw, ['harsh', 'neutral', 'warm'][raw + 1] as label, raw / 2 normalized
       from (select doc_id, [0, 1, 2, 1, 2][doc_id % 5 + 1] as raw from documents)""",
)
def judge_own_scale(spark, sf):
    """Replies of a metric with the user's own scale; the fifth repeats its key, of which the last value counts."""
    said = F.array(*map(F.lit, ('"Harsh"', '"neutral "', '"very warm"', '"odd"', '"harsh", "answer": "warm"')))
    reply = F.concat(F.lit('{"answer": '), F.element_at(said, (F.col("doc_id") % 5 + 1).cast("int")), F.lit("}"))
    rows = b.table(spark, sf, "documents").select("doc_id", F.lit("tone").alias("metric"), reply.alias("raw_text"))
    return judge.parse_replies(rows, {"tone": ("harsh", "neutral", "warm")}).select("doc_id", "raw", "label", "normalized")


@query("prompts_own_template", """select doc_id, 'Q: ' || lang || chr(10) || '[1] ' || source as prompt from documents""")
def prompts_own_template(spark, sf):
    text = prompts.rag_prompt(F.col("lang"), F.array("source"), "Q: {query}\n{contexts}")
    return b.table(spark, sf, "documents").select("doc_id", text.alias("prompt"))


@query("judge_labels", with_(_REPLIES_SQL, "select * from metric_rows"))
def judge_labels(spark, sf):
    return judge.parse_replies(_metric_replies(spark, sf)).drop("raw_text")


@query(
    "judge_replies",
    with_(
        _REPLIES_SQL,
        f"""select doc_id // {len(_METRICS)} case_id, round((max(case when metric = 'correctness' then normalized end)
           + max(case when metric = 'completeness' then normalized end)
           + max(case when metric = 'helpfulness' then normalized end)) / 3, 4) judge_score,
           'Correctness: ' || max(case when metric = 'correctness' then reason end)
           || ' | Completeness: ' || max(case when metric = 'completeness' then reason end)
           || ' | Helpfulness: ' || max(case when metric = 'helpfulness' then reason end) judge_reason
           from metric_rows group by 1 having count(*) filter (metric in ('correctness', 'completeness', 'helpfulness')) = 3""",
    ),
)
def judge_replies(spark, sf):
    """The three answer metrics of six documents in a row, combined as one case."""
    parsed = judge.parse_replies(_metric_replies(spark, sf)).withColumn(
        "case_id", F.floor(F.col("doc_id") / len(_METRICS))
    )
    return judge.pivot_metrics(parsed, judge.ANSWER_METRICS, ("case_id",)).select("case_id", "judge_score", "judge_reason")


# --- assertions -------------------------------------------------------------------------------------------------


@query(
    "qa_contains",
    with_(
        b.CASES_SQL,
        "select doc_id, contains(lower(answer), lower(ground_truth)) hit from plain_cases",
    ),
)
def qa_contains(spark, sf):
    return b.plain_cases(spark, sf).select("doc_id", icontains("answer", "expected.ground_truth").alias("hit"))


@query(
    "bench_contains",
    with_(
        b.CASES_SQL,
        "select doc_id % 100 as bucket, count(*) n, count(*) filter (contains(lower(answer), lower(ground_truth))) hits from plain_cases group by 1",
    ),
)
def bench_contains(spark, sf):
    hits = qa_contains(spark, sf)
    return hits.groupBy((F.col("doc_id") % 100).alias("bucket")).agg(
        F.count("*").alias("n"), F.count_if("hit").alias("hits")
    )


ASSERTIONS_SQL = b.CASES_SQL + """,
asserted as (
  select *, case kind
    when 'qa' then [{'t': 'icontains', 'v': ground_truth},
                    {'t': 'llm-rubric', 'v': 'The answer must correctly address the following: ' || ground_truth}]
    when 'classification' then [{'t': 'icontains', 'v': label}]
    else [{'t': 'llm-rubric', 'v': rubric}] end asserts
  from plain_cases)"""


@query(
    "assertions",
    with_(
        ASSERTIONS_SQL,
        """select doc_id, kind as type, array_to_string(list_transform(asserts, lambda a: a.t || '=' || coalesce(a.v, '')), '|') asserts,
           case kind when 'qa' then '{"query": ' || to_json(query)::varchar || '}'
             when 'classification' then '{"text": ' || to_json(query)::varchar || '}'
             else case when document is null then '{"instruction": ' || to_json(query)::varchar || '}'
                  else '{"document": ' || to_json(document)::varchar || ', "instruction": ' || to_json(query)::varchar || '}' end
           end vars_json from asserted""",
    ),
)
def assertion_table(spark, sf):
    built = assertions.build_assertions(b.plain_cases(spark, sf))
    shown = F.transform("assertions", lambda a: F.concat(a["type"], F.lit("="), F.coalesce(a["value"], F.lit(""))))
    return built.select("doc_id", "type", F.array_join(shown, "|").alias("asserts"), vars_json(F.col("vars")).alias("vars_json"))


@query(
    "assertion_scores",
    with_(
        ASSERTIONS_SQL + """,
verdicts as (
  select doc_id, list_transform(asserts, lambda a: case when a.t = 'icontains'
           then contains(lower(answer), lower(coalesce(a.v, ''))) else rubric_passed end) checks from asserted)""",
        """select doc_id, len(list_filter(checks, lambda c: c)) / len(checks) score,
           len(list_filter(checks, lambda c: c)) = len(checks) passed from verdicts""",
    ),
)
def assertion_scores(spark, sf):
    checked = assertions.check_assertions(assertions.build_assertions(b.plain_cases(spark, sf)), "rubric_passed")
    return checked.select(
        "doc_id", assertions.score_checks(F.col("checks")).alias("score"), assertions.all_passed(F.col("checks")).alias("passed")
    )


@query(
    "cls_accuracy",
    """select lang, count(*) cases, count(*) filter (contains(cast(1 - toxic as varchar), cast(quality as varchar))) passed
       from labels join documents using (doc_id) group by lang""",
)
def cls_accuracy(spark, sf):
    lab, d = b.table(spark, sf, "labels"), b.table(spark, sf, "documents").select("doc_id", "lang")
    hit = icontains((1 - F.col("toxic")).cast("string"), F.col("quality").cast("string"))
    return lab.join(d, "doc_id").groupBy("lang").agg(F.count("*").alias("cases"), F.count_if(hit).alias("passed"))


# --- agent scores -----------------------------------------------------------------------------------------------


def _agent(spark: SparkSession, sf: str, **kw) -> DataFrame:
    return agent.score_agent(b.agent_cases(spark, sf, **kw))


_ANSWER_REASON = """case when answer_score < 0.8 then 'Answer score ' || printf('%.2f', answer_score) || ' below threshold 0.80'
     || case when answer_reason <> '' then ': ' || answer_reason else '' end end"""


@query(
    "answer_match_modes",
    with_(
        b.EXP_SQL,
        f"select conv_id, exp_match as answer_match, answer_score, answer_reason, {_ANSWER_REASON} failure from scored",
    ),
)
def answer_match_modes(spark, sf):
    first = F.try_element_at("failure_reasons", F.lit(1))
    return _agent(spark, sf).select(
        "conv_id", F.col("expected.answer_match").alias("answer_match"), "answer_score", "answer_reason",
        F.when(F.startswith(first, F.lit("Answer score")), first).alias("failure"),
    )


@query(
    "tool_checks",
    with_(
        b.EXP_SQL,
        """select conv_id, array_to_string(missing_tools, '|') missing_tools, array_to_string(forbidden, '|') forbidden_tools,
           array_to_string(list_sort(list_distinct(calls)), '|') called, cast(len(calls) as int) tool_call_count from scored""",
    ),
)
def tool_checks(spark, sf):
    cases = b.agent_cases(spark, sf)
    called = F.array_sort(F.array_distinct(F.transform("calls", lambda c: c["name"])))
    return agent.score_agent(cases.withColumn("called", called)).select(
        "conv_id", _joined("missing_tools", "missing_tools"), _joined("forbidden_tools_found", "forbidden_tools"),
        _joined("called", "called"), "tool_call_count",
    )


_UNMET_TEXT = """list_transform(unmet, lambda r: r.tool || '(' || case when list_contains(calls, r.tool)
     then 'len=' || coalesce(r.len, '') else 'not called' end || ')')"""


@query(
    "must_call_with",
    with_(b.EXP_SQL, f"select conv_id, array_to_string({_UNMET_TEXT}, '|') missing_args from scored"),
)
def must_call_with(spark, sf):
    return _agent(spark, sf).select("conv_id", _joined("missing_args", "missing_args"))


@query("tool_score", with_(b.EXP_SQL, "select conv_id, tool_score from scored"))
def tool_score(spark, sf):
    return _agent(spark, sf).select("conv_id", "tool_score")


_LIMIT_REASONS = """case when step_count > max_steps then 'Step count ' || step_count || ' exceeds max ' || max_steps end,
   case when len(calls) > max_tool_calls then 'Tool call count ' || len(calls) || ' exceeds max ' || max_tool_calls end"""


@query(
    "step_limits",
    with_(
        b.EXP_SQL,
        f"select conv_id, step_count, array_to_string(list_filter([{_LIMIT_REASONS}], lambda r: r is not null), '; ') reasons from scored",
    ),
)
def step_limits(spark, sf):
    limits = F.filter("failure_reasons", lambda r: r.rlike("^(Step|Tool call) count"))
    return _agent(spark, sf).select("conv_id", "step_count", F.array_join(limits, "; ").alias("reasons"))


@query("efficiency", with_(b.EXP_SQL, "select conv_id, round(efficiency, 9) efficiency_score from scored"))
def efficiency(spark, sf):
    return _agent(spark, sf).select("conv_id", F.round("efficiency_score", 9).alias("efficiency_score"))


_ALL_REASONS = f"""list_concat(
   list_filter([{_ANSWER_REASON}], lambda r: r is not null),
   list_transform(missing_tools, lambda t: 'Required tool not called: ''' || t || ''''),
   list_transform(forbidden, lambda t: 'Forbidden tool was called: ''' || t || ''''),
   list_transform(unmet, lambda r: case when list_contains(calls, r.tool)
     then 'Tool ''' || r.tool || ''' called but never with required args: len=' || coalesce(r.len, '')
     else 'Tool ''' || r.tool || ''' required by must_call_with but was never called' end),
   list_filter([{_LIMIT_REASONS}], lambda r: r is not null))"""


@query(
    "agent_scores",
    with_(
        b.EXP_SQL,
        f"""select conv_id, answer_score, tool_score, round(efficiency, 9) efficiency_score,
            round((answer_score * 0.4 + tool_score * 0.4 + efficiency * 0.05) / 0.85, 9) composite_score,
            array_to_string({_ALL_REASONS}, '; ') failure_reasons, len({_ALL_REASONS}) = 0 passed from scored""",
    ),
)
def agent_scores(spark, sf):
    return _agent(spark, sf).select(
        "conv_id", "answer_score", "tool_score", F.round("efficiency_score", 9).alias("efficiency_score"),
        F.round("composite_score", 9).alias("composite_score"),
        F.array_join("failure_reasons", "; ").alias("failure_reasons"), "passed",
    )


@query(
    "agent_crash",
    with_(
        b.EXP_SQL,
        f"""select conv_id, step_count, cast(len(calls) as int) tool_call_count,
            case when conv_id % 13 = 0 then 0.0 else answer_score end::double answer_score,
            case when conv_id % 13 = 0 then 0.0 else tool_score end::double tool_score,
            case when conv_id % 13 = 0 then 1.0 else round(efficiency, 9) end::double efficiency_score,
            case when conv_id % 13 = 0 then 0.0
                 else round((answer_score * 0.4 + tool_score * 0.4 + efficiency * 0.05) / 0.85, 9) end::double composite_score,
            conv_id % 13 <> 0 and len({_ALL_REASONS}) = 0 passed,
            case when conv_id % 13 = 0 then 'Agent error: boom' end crash from scored""",
    ),
)
def agent_crash(spark, sf):
    first = F.try_element_at("failure_reasons", F.lit(1))
    return _agent(spark, sf, crashes=True).select(
        "conv_id", "step_count", "tool_call_count", "answer_score", "tool_score",
        F.round("efficiency_score", 9).alias("efficiency_score"), F.round("composite_score", 9).alias("composite_score"),
        "passed", F.when(F.startswith(first, F.lit("Agent error")), first).alias("crash"),
    )


_FIVE = ["correctness", "completeness", "helpfulness", "faithfulness", "logical_coherence"]
_AGENT_JUDGE_SQL = b.EXP_SQL + f""",
metric_values as (
  select conv_id, {', '.join(f"((conv_id + {i}) % {len(METRIC_SCALES[m])}) / {len(METRIC_SCALES[m]) - 1} as {m}" for i, m in enumerate(_FIVE))}
  from trj),
combined as (
  select s.*, round((m.correctness + m.completeness + m.helpfulness) / 3, 4) ja,
         round((m.faithfulness + m.logical_coherence) / 2, 4) jr,
         case when exp_match = 'llm_judge' and exp_answer is not null
              then round((m.correctness + m.completeness + m.helpfulness) / 3, 4) else s.answer_score end a
  from scored s join metric_values m using (conv_id))"""


def _agent_replies(spark: SparkSession, sf: str) -> DataFrame:
    c = b.table(spark, sf, "conversations").select("conv_id").distinct()
    n = F.col("conv_id")
    replies = [
        F.struct(F.lit(m).alias("metric"), _reply_text(_pick(list(METRIC_SCALES[m]), n + i), F.lit(f"why {m}")).alias("raw_text"))
        for i, m in enumerate(_FIVE)
    ]
    return c.select("conv_id", F.explode(F.array(*replies)).alias("_r")).select("conv_id", "_r.metric", "_r.raw_text")


def _judged_agent(spark: SparkSession, sf: str) -> DataFrame:
    parsed = judge.parse_replies(_agent_replies(spark, sf))
    answer = judge.pivot_metrics(parsed, judge.ANSWER_METRICS, ("conv_id",))
    reasoning = judge.pivot_metrics(parsed, judge.REASONING_METRICS, ("conv_id",))
    packed = lambda df, name: df.select("conv_id", F.struct(*[c for c in df.columns if c != "conv_id"]).alias(name))
    cases = b.agent_cases(spark, sf).withColumn("thresholds", threshold_struct(AGENT_THRESHOLDS, min_reasoning_score=0.5))
    joined = cases.join(packed(answer, "answer_judge"), "conv_id", "left").join(
        packed(reasoning, "reasoning_judge"), "conv_id", "left"
    )
    return agent.score_agent(joined)


@query(
    "agent_judged_scores",
    with_(
        _AGENT_JUDGE_SQL,
        """select conv_id, a answer_score, jr reasoning_score,
           case when exp_match = 'llm_judge' and exp_answer is not null
             then 'Correctness: why correctness | Completeness: why completeness | Helpfulness: why helpfulness' else answer_reason end answer_reason,
           round((a * 0.4 + tool_score * 0.4 + jr * 0.15 + efficiency * 0.05) / 1.0, 9) composite_score,
           case when jr < 0.5 then 'Reasoning score ' || printf('%.2f', jr)
             || ' below threshold 0.50: Faithfulness: why faithfulness | Coherence: why logical_coherence' end reasoning_failure
           from combined""",
    ),
)
def agent_judged_scores(spark, sf):
    last = F.element_at("failure_reasons", -1)
    return _judged_agent(spark, sf).select(
        "conv_id", "answer_score", "reasoning_score", "answer_reason", F.round("composite_score", 9).alias("composite_score"),
        F.when(F.size("failure_reasons") > 0, F.when(F.startswith(last, F.lit("Reasoning score")), last)).alias("reasoning_failure"),
    )


@query(
    "agent_case_details",
    with_(
        _AGENT_JUDGE_SQL,
        f"""select conv_id case_id, {_R('a', 4)} answer_score, {_R('jr', 4)} reasoning_score, {_R('tool_score', 4)} tool_score,
            case when exp_match = 'llm_judge' and exp_answer is not null then cast(conv_id % 3 as int) end correctness_raw,
            {_sql_list(METRIC_SCALES['faithfulness'])}[(conv_id + 3) % 5 + 1] faithfulness_label
            from combined""",
    ),
)
def agent_case_details(spark, sf):
    details = results.agent_case_details(_judged_agent(spark, sf).withColumn("case_id", F.col("conv_id")))
    return details.select(
        "case_id", "answer_score", "reasoning_score", "tool_score", F.col("correctness.raw").alias("correctness_raw"),
        F.col("faithfulness.label").alias("faithfulness_label"),
    )


# --- traces, tool lookups, transcripts --------------------------------------------------------------------------


def _traces(spark: SparkSession, sf: str) -> DataFrame:
    t = b.trajectories(spark, sf)
    n = F.col("conv_id")
    steps = F.transform(
        "steps",
        lambda s: F.struct(
            s["type"].alias("type"), s["content"].alias("content"), s["tool_call"]["name"].alias("tool"),
            s["tool_call"]["result_json"].alias("result_json"),
        ),
    )
    return t.select(
        "conv_id", "task", steps.alias("steps"), F.when(n % 3 != 0, F.col("final_answer")).alias("final_answer"),
        F.struct(
            F.when(n % 2 == 0, F.concat(F.lit("case "), n.cast("string"))).alias("description"),
            F.when(n % 4 == 0, "easy").alias("difficulty"),
            F.when(n % 5 == 0, F.array(F.lit("a"), F.lit("b"))).alias("tags"),
        ).alias("metadata"),
    )


_TRACE_SQL = b.TRJ_SQL + """,
last_turns as (select conv_id, arg_max(text, turn) last_text, arg_max(role, turn) last_role from conversations group by 1)"""


@query(
    "trace_to_case",
    with_(
        _TRACE_SQL,
        """select conv_id, task, case when conv_id % 3 <> 0 then final_answer end is not null explicit,
           coalesce(case when conv_id % 3 <> 0 then final_answer end, case when last_role = 'assistant' then last_text end) answer,
           array_to_string(list_filter(calls, lambda c, i: list_position(calls, c) = i), '|') must_call,
           cast(greatest(3, ceil(step_count * 1.5)) as int) max_steps,
           cast(greatest(1, len(calls) + 1) as int) max_tool_calls,
           case when conv_id % 2 = 0 then 'case ' || conv_id else '' end description,
           case when conv_id % 5 = 0 then 'a|b' else '' end tags, case when conv_id % 4 = 0 then 'easy' end difficulty
           from trj join last_turns using (conv_id)""",
    ),
)
def trace_to_case(spark, sf):
    source = _traces(spark, sf).withColumn("explicit", F.col("final_answer").isNotNull())
    e = F.col("expected")
    return traces.trace_to_case(source).select(
        "conv_id", "task", "explicit", e["answer"].alias("answer"), F.array_join(e["must_call"], "|").alias("must_call"),
        e["max_steps"].alias("max_steps"), e["max_tool_calls"].alias("max_tool_calls"), "description", _joined("tags", "tags"),
        "difficulty",
    )


@query(
    "trace_mocks",
    """select conv_id, 't' || cast(length(text) % 4 as varchar) tool, arg_max(cast(length(text) as varchar), turn) response_json
       from conversations where role = 'user' group by 1, 2""",
)
def trace_mocks(spark, sf):
    cases = traces.trace_to_case(_traces(spark, sf))
    return cases.select("conv_id", F.explode("tools").alias("tool", "mock")).select(
        "conv_id", "tool", F.col("mock.response_json").alias("response_json")
    )


def _mocks() -> Column:
    def mock(response: str | None, error: str | None) -> Column:
        return F.struct(
            F.lit(response).cast("string").alias("response_json"), F.lit(0).alias("latency_ms"),
            F.lit(error).cast("string").alias("error"),
        )

    return F.create_map(
        F.lit("t0"), mock('{"r": 0}', None), F.lit("t1"), mock(None, "denied"), F.lit("t2"), mock(None, None)
    )


@query(
    "resolve_tool_calls",
    """select conv_id, turn, 't' || cast(length(text) % 4 as varchar) tool,
       case length(text) % 4 when 0 then '{"r": 0}' when 2 then 'null' end result_json,
       case length(text) % 4 when 1 then 'denied'
         when 3 then 'Tool ''t3'' is not defined in this test case. Available: [''t0'', ''t1'', ''t2'']' end error
       from conversations where role = 'user'""",
)
def resolve_tool_calls(spark, sf):
    """Every tool call looked up in the mocks of its case, one row per call."""
    steps = b.step_rows(spark, sf).filter(F.col("step.tool_call").isNotNull())
    call = agent.resolve_tool_calls(F.array("step"), _mocks())[0]["tool_call"]
    return steps.select("conv_id", "turn", call.alias("c")).select(
        "conv_id", "turn", F.col("c.name").alias("tool"), F.col("c.result_json").alias("result_json"), F.col("c.error").alias("error")
    )


_TRAJECTORY_TEXT_SQL = """
numbered as (
  select *, row_number() over (partition by conv_id order by turn) i, count(*) over (partition by conv_id) n
  from conversations),
lines as (
  select conv_id, i, case when role = 'user' then 'Step ' || i || ' [tool_call] t' || (length(text) % 4) || '({"len": '
           || (length(text) % 3) || '})' || chr(10) || '  → ' || length(text)
         else 'Step ' || i || ' [' || case when role = 'assistant' and i = n then 'answer' else 'thought' end || '] ' || text end line
  from numbered)"""


@query(
    "trajectory_text",
    with_(_TRAJECTORY_TEXT_SQL, "select conv_id, string_agg(line, chr(10) order by i) trajectory from lines group by conv_id"),
)
def trajectory_text(spark, sf):
    return b.trajectories(spark, sf).select("conv_id", prompts.trajectory_text(F.col("steps")).alias("trajectory"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns wrapped as tagged model output; what a turn holds depends on its text length."""
    c = b.table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    size = F.length("text")
    head = F.concat(F.lit("<thought> "), "text", F.lit("\n</thought>"))
    call = F.when(size % 5 == 0, F.lit("<tool_call>{oops</tool_call>")).otherwise(
        F.concat(
            F.lit('\n<tool_call>{"name": "t'), (size % 4).cast("string"), F.lit('", "arguments": {"len": '),
            size.cast("string"), F.lit("}}</tool_call>"),
        )
    )
    answer = F.concat(F.lit("<answer>"), "text", F.lit("</answer> <answer>later</answer>"))
    text = F.concat(
        F.when(size % 7 != 0, head).otherwise(""), F.when(size % 2 == 0, call).otherwise(""),
        F.when(size % 3 == 0, answer).otherwise(""),
    )
    return c.select(F.col("conv_id").alias("case_id"), "turn", text.alias("text"), (size % 100).cast("int").alias("latency_ms"), _mocks().alias("tools"))


_WS = "chr(32) || chr(10)"
_TURNS_SQL = """
replies as (
  select conv_id case_id, turn, text, length(text) n,
         min(case when length(text) % 3 = 0 then turn end) over (partition by conv_id) stop
  from conversations where role = 'assistant'),
kept as (select * from replies where stop is null or turn <= stop)"""


@query(
    "transcript_steps",
    with_(
        _TURNS_SQL + f""",
parts as (
  select case_id, turn, 1 as o, 'thought' as type, trim(text, {_WS}) as content, null as tool, n % 100 as latency_ms
  from kept where n % 7 <> 0
  union all
  select case_id, turn, 2, 'tool_call', 'Calling t' || (n % 4), 't' || (n % 4), 0 from kept where n % 2 = 0 and n % 5 <> 0
  union all
  select case_id, turn, 3, 'observation', case n % 4 when 0 then '{{"r": 0}}' when 1 then 'Error: denied' when 2 then 'null' end, null, 0
  from kept where n % 2 = 0 and n % 5 <> 0
  union all
  select case_id, turn, 4, 'thought', '[parse error in tool call: not a JSON object]', null, 0 from kept where n % 2 = 0 and n % 5 = 0
  union all
  select case_id, turn, 5, 'answer', trim(text, {_WS}), null, n % 100 from kept where n % 3 = 0)""",
        """select case_id, turn, cast(row_number() over (partition by case_id, turn order by o) - 1 as int) pos, type, content,
           tool, cast(latency_ms as int) latency_ms from parts""",
    ),
)
def transcript_steps(spark, sf):
    steps = transcripts.transcript_steps(_turns(spark, sf))
    return steps.select(
        "case_id", "turn", "pos", F.col("step.type").alias("type"), F.col("step.content").alias("content"),
        F.col("step.tool_call.name").alias("tool"), F.col("step.latency_ms").alias("latency_ms"),
    )


@query(
    "transcript_outcomes",
    with_(
        _TURNS_SQL,
        f"""select case_id, max(case when turn = stop then trim(text, {_WS}) end) final_answer,
            cast(sum(n % 100) as bigint) total_latency_ms,
            case when max(stop) is null then 'Reached max iterations (10) without producing an answer' end error
            from kept group by case_id""",
    ),
)
def transcript_outcomes(spark, sf):
    return transcripts.transcript_outcomes(_turns(spark, sf), 10)


@query(
    "assembled_trajectories",
    with_(
        _TURNS_SQL + """,
flags as (
  select case_id, (n % 7 <> 0)::int + (n % 2 = 0 and n % 5 <> 0)::int * 2 + (n % 2 = 0 and n % 5 = 0)::int + (n % 3 = 0)::int steps,
         (n % 2 = 0 and n % 5 <> 0)::int calls from kept)""",
        "select case_id, cast(sum(steps) as int) steps, cast(sum(calls) as int) calls from flags group by 1 having sum(steps) > 0",
    ),
)
def assembled_trajectories(spark, sf):
    rows = transcripts.assemble(transcripts.transcript_steps(_turns(spark, sf)))
    return rows.select("case_id", F.size("steps").alias("steps"), F.size(agent.tool_calls(F.col("steps"))).alias("calls"))


def _event_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as an agent event log: a case is what a user does on a day, the kind of entry goes by event type."""
    e = b.table(spark, sf, "events")
    n = F.get_json_object("props", "$.k")
    orch = lambda body: F.concat(F.lit('{"trace": {"trace": {"orchestrationTrace": {'), body, F.lit("}}}}"))
    kind = F.col("event_type")
    event = (
        F.when(kind == "click", orch(F.concat(F.lit('"rationale": {"text": "look '), n, F.lit('"}'))))
        .when(
            kind == "view",
            orch(F.concat(
                F.lit('"invocationInput": {"actionGroupInvocationInput": {"actionGroupName": "g'), n,
                F.lit('", "requestBody": {"content": {"k": '), n, F.lit("}}}}"),
            )),
        )
        .when(
            kind == "purchase",
            orch(F.concat(F.lit('"observation": {"actionGroupInvocationOutput": {"text": "got '), n, F.lit('"}}'))),
        )
        .when(kind == "signup", F.concat(F.lit('{"chunk": {"bytes": "c'), F.col("event_id").cast("string"), F.lit('"}}')))
        .otherwise(orch(F.lit('"invocationInput": {"actionGroupInvocationInput": {}}')))
    )
    case = F.concat(F.col("user_id").cast("string"), F.lit("_"), F.to_date("ts").cast("string"))
    return e.select(case.alias("case_id"), F.col("event_id").alias("ord"), event.alias("event"))


_LOG_SQL = """
log as (
  select cast(user_id as varchar) || '_' || cast(ts::date as varchar) case_id, event_id, event_type,
         json_extract_string(props, '$.k') n from events)"""
_LOG_ANSWERS = """,
answers as (
  select case_id, string_agg(case when event_type = 'signup' then 'c' || event_id end, '' order by event_id) final_answer
  from log group by case_id)"""


@query(
    "event_log_steps",
    with_(
        _LOG_SQL + _LOG_ANSWERS,
        """select case_id, event_id as turn, case event_type when 'click' then 'thought' when 'view' then 'tool_call' else 'observation' end as type,
           case event_type when 'click' then 'look ' || n when 'view' then 'Invoking g' || n else 'got ' || n end as content,
           case event_type when 'view' then 'g' || n end tool, case event_type when 'view' then '{"k": ' || n || '}' end arguments
           from log where event_type in ('click', 'view', 'purchase')
           union all
           select case_id, 4611686018427387904, 'answer', final_answer, null, null from answers where final_answer is not null""",
    ),
)
def event_log_steps(spark, sf):
    log = _event_log(spark, sf)
    steps = transcripts.with_answer_steps(transcripts.event_log_steps(log), transcripts.event_log_answers(log))
    return steps.select(
        "case_id", "turn", F.col("step.type").alias("type"), F.col("step.content").alias("content"),
        F.col("step.tool_call.name").alias("tool"),
        F.when(F.col("step.tool_call").isNotNull(), json_map_text(F.col("step.tool_call.arguments"))).alias("arguments"),
    )


@query("event_log_answers", with_(_LOG_SQL + _LOG_ANSWERS, "select case_id, final_answer from answers"))
def event_log_answers(spark, sf):
    return transcripts.event_log_answers(_event_log(spark, sf))


@query(
    "tool_args",
    """select event_id, case when event_id % 2 = 0 then '{"k": ' || json_extract_string(props, '$.k') || '}'
       else '{"input": "' || event_type || '"}' end arguments from events""",
)
def tool_args(spark, sf):
    text = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.col("event_type"))
    return b.table(spark, sf, "events").select(
        "event_id", json_map_text(transcripts.argument_map(text)).alias("arguments")
    )


def _echo_agent():
    """A deterministic agent: answers with the first word of its task, fails on every eleventh case."""

    def run(case: dict) -> dict:
        if case["conv_id"] % 11 == 0:
            raise RuntimeError(f"no agent for {case['conv_id']}")
        word = (case["task"] or "").split(" ")[0]
        step = {"type": "answer", "content": word, "tool_call": None, "latency_ms": 0, "tokens": 0, "cost_usd": 0.0}
        return {"steps": [step], "final_answer": word, "total_tokens": len(word), "total_latency_ms": 7}

    return run


@query(
    "run_batch",
    """select conv_id, case when conv_id % 11 <> 0 then split_part(arg_min(text, turn), ' ', 1) end final_answer,
       cast(case when conv_id % 11 <> 0 then 7 else 0 end as int) latency_ms,
       case when conv_id % 11 = 0 then 'no agent for ' || conv_id end error
       from conversations where role = 'user' group by conv_id""",
)
def run_batch_query(spark, sf):
    cases = b.rag_cases(spark, sf).select(F.col("case_id").alias("conv_id"), F.col("query").alias("task"))
    return run_batch(cases, _echo_agent(), "conv_id long").select("conv_id", "final_answer", "latency_ms", "error")


@query(
    "run_batch_resumed",
    """select conv_id, case when conv_id % 11 <> 0 then split_part(arg_min(text, turn), ' ', 1) end final_answer,
       case when conv_id % 11 = 0 then 'no agent for ' || conv_id end error
       from conversations where role = 'user' group by conv_id""",
)
def run_batch_resumed(spark, sf):
    """A run over a third of the cases, and one over all that goes on from it."""
    path = new_table_path(spark, "batch")
    cases = b.rag_cases(spark, sf).select(F.col("case_id").alias("conv_id"), F.col("query").alias("task"))
    resume_batch(cases.filter(F.col("conv_id") % 3 == 0), _echo_agent(), path, "conv_id", "conv_id long", per_task=500)
    return resume_batch(cases, _echo_agent(), path, "conv_id", "conv_id long", per_task=500).select("conv_id", "final_answer", "error")


# --- keys, labels, prompts --------------------------------------------------------------------------------------


@query(
    "vars_keys",
    """select event_id, substr(sha256('{"q": "' || event_type || '", "user": "' || user_id || '"}'), 1, 16) key from events""",
)
def vars_keys(spark, sf):
    pairs = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("q"), F.col("event_type"))
    return b.table(spark, sf, "events").select("event_id", vars_key(pairs).alias("key"))


@query(
    "vars_keys_text",
    """select doc_id, substr(sha256('{"query": ' || to_json(text)::varchar || '}'), 1, 16) key from documents""",
)
def vars_keys_text(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", vars_key(F.create_map(F.lit("query"), F.col("text"))).alias("key"))


@query(
    "case_labels",
    """select doc_id, case when doc_id % 4 = 3 then substr('{''doc'': ''' || doc_id || '''}', 1, 60)
       else case when length(s) > 60 then substr(s, 1, 60) || '…' else s end end as label
       from (select doc_id, case when doc_id % 4 = 0 then trim(replace(text, chr(10), ' '))
                                 when doc_id % 4 = 1 then replace(text, chr(10), ' ') else lang || ' ' || source end s from documents)""",
)
def case_labels(spark, sf):
    d = b.table(spark, sf, "documents")
    n = F.col("doc_id")
    asked = F.concat(F.lit("Context\nQuestion: "), "text")
    short = F.concat("lang", F.lit("\n"), "source")
    pairs = (
        F.when(n % 4 == 0, F.create_map(F.lit("query"), asked))
        .when(n % 4 == 1, F.create_map(F.lit("text"), F.col("text")))
        .when(n % 4 == 2, F.create_map(F.lit("query"), F.lit(""), F.lit("text"), short))
        .otherwise(F.create_map(F.lit("doc"), n.cast("string")))
    )
    return d.select("doc_id", display.case_label(pairs).alias("label"))


_PROVIDER_FORMS = [
    "bedrock:us.anthropic.{}", "anthropic:{}", "{}", "bedrock:eu.meta.{}-v1:0", "openai:gpt-{}", "amazon.{}",
]


@query(
    "provider_names",
    """select event_id, substr(case event_id % 6 when 3 then event_type || '-v1:0' when 4 then 'gpt-' || event_type
         else event_type end, 1, 28) short,
       case event_id % 6 when 0 then 'bedrock:us.anthropic.' || event_type when 1 then 'anthropic:' || event_type
         when 2 then event_type when 3 then 'bedrock:eu.meta.' || event_type || '-v1:0' when 4 then 'openai:gpt-' || event_type
         else 'amazon.' || event_type end provider
       from events""",
)
def provider_names(spark, sf):
    e = b.table(spark, sf, "events")
    forms = F.array(*[F.lit(f) for f in _PROVIDER_FORMS])
    name = F.replace(F.element_at(forms, (F.col("event_id") % 6).cast("int") + 1), F.lit("{}"), F.col("event_type"))
    given = F.when(F.col("event_id") % 2 == 0, name).otherwise(F.concat(F.lit('{"id": "'), name, F.lit('"}')))
    provider = display.provider_id(given)
    return e.select("event_id", display.short_provider(provider).alias("short"), provider.alias("provider"))


@query(
    "prompts_rag",
    with_(
        b.RAG_SQL + ",\n" + b.CONTEXTS_SQL.lstrip(),
        """select case_id, 'Answer the question using ONLY the provided context documents.' || chr(10)
           || 'If the answer cannot be found in the context, say "I don''t know."' || chr(10) || chr(10)
           || 'Context documents:' || chr(10)
           || coalesce(array_to_string(list_transform(contexts, lambda c, i: '[' || i || '] ' || c), chr(10) || chr(10)),
                       '(no context documents provided)')
           || chr(10) || chr(10) || 'Question: ' || query prompt
           from rag left join contexts using (case_id)""",
    ),
)
def prompts_rag(spark, sf):
    cases = b.rag_cases(spark, sf).join(b.rag_contexts(spark, sf), "case_id", "left")
    return cases.select("case_id", prompts.rag_prompt(F.col("query"), F.col("contexts")).alias("prompt"))


@query(
    "prompts_default",
    with_(
        b.CASES_SQL,
        """select doc_id, case kind
           when 'qa' then 'Answer the following question accurately and concisely.' || chr(10) || chr(10) || 'Question: ' || query
           when 'classification' then 'Classify the following text into exactly one of these categories: '
             || case when doc_id % 2 = 0 then 'good, bad' else 'unknown' end || '.' || chr(10)
             || 'Respond with only the category name, nothing else.' || chr(10) || chr(10) || 'Text: ' || query
           else query || coalesce(chr(10) || chr(10) || '---' || chr(10) || document, '') end prompt from plain_cases""",
    ),
)
def prompts_default(spark, sf):
    labels = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("good"), F.lit("bad")))
    return b.plain_cases(spark, sf).select(
        "doc_id", prompts.default_prompt(F.col("type"), F.col("input"), labels).alias("prompt")
    )


def _template_sql(template: str, values: dict[str, str]) -> str:
    """A template as a DuckDB concatenation over the given expressions."""
    out = "'" + template.replace("'", "''") + "'"
    for name, expr in values.items():
        out = out.replace("{" + name + "}", f"' || {expr} || '")
    return out


_RAG_JUDGE_SQL = " union all ".join(
    f"select case_id, '{m}' metric, "
    + _template_sql(
        t,
        {
            "query": "query", "answer": "coalesce(answer, '')", "ground_truth": "ground_truth",
            "contexts": "coalesce(array_to_string(list_transform(contexts, lambda c, i: '[' || i || '] ' || c), chr(10) || chr(10)), '(no contexts provided)')",
        },
    )
    + " prompt from rag left join contexts using (case_id)"
    for m, t in prompts.RAG_JUDGE_TEMPLATES.items()
)


@query("prompts_judge", with_(b.RAG_SQL + ",\n" + b.CONTEXTS_SQL.lstrip(), _RAG_JUDGE_SQL))
def prompts_judge(spark, sf):
    cases = rag.join_responses(b.rag_cases(spark, sf), b.rag_responses(spark, sf), ("case_id",))
    full = cases.join(b.rag_contexts(spark, sf), "case_id", "left")
    return prompts.rag_judge_prompts(full).select("case_id", "metric", "prompt")


_AGENT_PROMPT_SQL = " union all ".join(
    f"select conv_id, '{m}' metric, "
    + _template_sql(
        t,
        {
            "task": "task", "final_answer": "coalesce(final_answer, '(no answer given)')", "trajectory": "trajectory",
            "expected_section": "coalesce(chr(10) || chr(10) || 'Expected answer:' || chr(10) || exp_answer, '')",
            "rubric_section": "''",
        },
    )
    + " prompt from expd join texts using (conv_id)"
    for m, t in prompts.AGENT_JUDGE_TEMPLATES.items()
)


@query(
    "prompts_agent_judge",
    with_(
        b.EXP_SQL + ",\n" + _TRAJECTORY_TEXT_SQL.lstrip()
        + ",\ntexts as (select conv_id, string_agg(line, chr(10) order by i) trajectory from lines group by conv_id)",
        _AGENT_PROMPT_SQL,
    ),
)
def prompts_agent_judge(spark, sf):
    return prompts.agent_judge_prompts(b.agent_cases(spark, sf, with_steps=True)).select("conv_id", "metric", "prompt")


_MIX_SQL = " || chr(10) || ".join(
    f"'  - {k}: ~' || cast(floor({v} * n) as int) || ' cases ({int(v * 100)}%)'" for k, v in prompts.CASE_MIX.items()
)
_GENERATION_SQL = " ".join(
    (f"when '{k}' then " if k != "qa" else "else ")
    + _template_sql(
        t,
        {"document": "text", "filename": "source", "count": "n", "labels": "'good, bad'", "mix": f"({_MIX_SQL})"},
    )
    for k, t in sorted(prompts.GENERATION_TEMPLATES.items(), key=lambda kv: kv[0] == "qa")
)


@query(
    "prompts_generate",
    f"""select doc_id, case kind {_GENERATION_SQL} end prompt from (
          select doc_id, text, source, doc_id % 40 n, ['qa', 'classification', 'instruction', 'rag'][doc_id % 4 + 1] kind from documents)""",
)
def prompts_generate(spark, sf):
    kinds = _pick(["qa", "classification", "instruction", "rag"], F.col("doc_id"))
    labels = F.array(F.lit("good"), F.lit("bad"))
    return b.table(spark, sf, "documents").select(
        "doc_id",
        prompts.generation_prompt(kinds, F.col("text"), F.col("source"), F.col("doc_id") % 40, labels).alias("prompt"),
    )


@query(
    "prompts_generate_agent",
    "select doc_id, "
    + _template_sql(
        prompts.AGENT_GENERATION_TEMPLATE,
        {
            "document": "text", "filename": "source", "count": "doc_id % 9",
            "tools": """case when doc_id % 3 = 0 then '  (no tools defined — all tasks will use generic tool usage)'
                when doc_id % 3 = 1 then 'Tool: find' || chr(10) || '  Description: in ' || lang || chr(10) || '  Parameters: {"q": "text"}'
                else 'Tool: find' || chr(10) || '  Description: in ' || lang end""",
        },
    )
    + " prompt from documents",
)
def prompts_generate_agent(spark, sf):
    tool = F.struct(
        F.lit("find").alias("name"), F.concat(F.lit("in "), "lang").alias("description"),
        F.when(F.col("doc_id") % 3 == 1, '{"q": "text"}').otherwise("{}").alias("parameters_json"),
    )
    tools = F.when(F.col("doc_id") % 3 != 0, F.array(tool))
    return b.table(spark, sf, "documents").select(
        "doc_id",
        prompts.agent_generation_prompt(F.col("text"), F.col("source"), F.col("doc_id") % 9, tools).alias("prompt"),
    )


@query(
    "case_mix",
    with_(
        "mix as (select unnest(" + _sql_list(prompts.CASE_MIX) + ") case_type, unnest(["
        + ", ".join(f"{v}::double" for v in prompts.CASE_MIX.values()) + "]) share)",
        "select doc_id, case_type, cast(floor(share * (n_chars % 50)) as int) cases from documents, mix",
    ),
)
def case_mix(spark, sf):
    d = b.table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 50).alias("count"))
    return prompts.explode_mix(d, "count").drop("count")


@query(
    "rounded_scores",
    with_(b.EXP_SQL, f"select conv_id, {_R('(answer_score * 0.4 + tool_score * 0.4 + efficiency * 0.05) / 0.85', 4)} composite_score from scored"),
)
def rounded_scores(spark, sf):
    return _agent(spark, sf).select("conv_id", py_round(F.col("composite_score"), 4).alias("composite_score"))


@query(
    "called_tools",
    with_(b.TRJ_SQL, "select conv_id, array_to_string(list_sort(list_distinct(calls)), '|') called from trj"),
)
def called_tools(spark, sf):
    called = F.array_sort(agent.called_tools(F.col("steps")))
    return b.trajectories(spark, sf).select("conv_id", F.array_join(called, "|").alias("called"))
