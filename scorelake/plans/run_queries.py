"""Queries over runs: fold, summary, percentiles, regressions, gates and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.functions.keys import short_hash, vars_json
from scorelake.functions.text import py_round
from scorelake.operators import display, fold, regress, summary
from scorelake.operators.agent import score_agent
from scorelake.operators.rag import join_responses, score_rag
from scorelake.operators.thresholds import attach_thresholds, threshold_struct
from scorelake.plans import bindings as b
from scorelake.plans.registry import query, rounded, with_
from scorelake.schemas import LLM_THRESHOLDS, RAG_THRESHOLDS
from scorelake.session import new_table_path
from scorelake.sources import history, results

DAY_KEYS = ("dataset", "day")


def _folded(spark: SparkSession, sf: str) -> DataFrame:
    return fold.fold_providers(b.raw_results(spark, sf), run_keys=b.RUN_KEYS)


def _r(col: str, digits: int = 6) -> F.Column:
    return F.round(col, digits).alias(col)


# --- fold and provider views ------------------------------------------------------------------------------------


@query(
    "fold_providers",
    with_(
        b.FOLD_SQL,
        "select run_id, key, passed, score, latency_ms, round(cost_usd, 6) cost_usd, ord from fold",
    ),
)
def fold_providers(spark, sf):
    return _folded(spark, sf).select("run_id", "key", "passed", "score", "latency_ms", _r("cost_usd"), "ord")


_BREAKDOWN = """,
cases as (
  select run_id, dataset, provider, key, arg_max(success, ord) passed, arg_max(score, ord) score,
         arg_max(latency_ms, ord) latency_ms, arg_max(cost_usd, ord) cost_usd
  from res group by all)"""


@query(
    "provider_breakdown",
    with_(
        b.RES_SQL + _BREAKDOWN,
        "select run_id, provider, key, passed, score, latency_ms, round(cost_usd, 6) cost_usd from cases",
    ),
)
def provider_breakdown(spark, sf):
    cases = fold.provider_cases(b.raw_results(spark, sf))
    return cases.select("run_id", "provider", "key", "passed", "score", "latency_ms", _r("cost_usd"))


@query(
    "provider_summary",
    with_(
        b.RES_SQL + _BREAKDOWN,
        """select run_id, provider, count(*) cases, count(*) filter (passed) passed,
           count(*) filter (passed) / count(*) pass_rate, round(sum(cost_usd), 6) cost_usd,
           avg(latency_ms) avg_latency_ms,
           case when count(*) filter (passed) / count(*) >= 0.8 then 'green'
                when count(*) filter (passed) / count(*) >= 0.6 then 'yellow' else 'red' end band
           from cases group by run_id, provider""",
    ),
)
def provider_summary(spark, sf):
    return fold.provider_summary(b.raw_results(spark, sf)).select(
        "run_id", "provider", "cases", "passed", "pass_rate", _r("cost_usd"), "avg_latency_ms", "band"
    )


@query(
    "provider_matrix",
    with_(
        b.RES_SQL
        + """,
cells as (
  select run_id, key, provider, min(ord) first, arg_max(success, ord) passed, arg_max(score, ord) score,
         arg_max(latency_ms, ord) latency_ms
  from res group by all)""",
        """select run_id, key, min(first) over (partition by run_id, key) first_ord, provider, passed, score, latency_ms
           from cells""",
    ),
)
def provider_matrix(spark, sf):
    """The matrix of all providers that the table has, compared in its long form."""
    raw = b.raw_results(spark, sf)
    found = fold.list_providers(raw)
    matrix = fold.provider_matrix(raw, found)
    cells = F.array(*[
        F.struct(F.lit(p).alias("provider"), *[F.col(f"`{p}_{c}`").alias(c) for c in ("passed", "score", "latency_ms")])
        for p in found
    ])
    rows = matrix.select("run_id", "key", "first_ord", F.explode(cells).alias("c")).select("run_id", "key", "first_ord", "c.*")
    return rows.filter(F.col("passed").isNotNull())


@query(
    "token_totals",
    """select 'ds' || cast(user_id % 7 as varchar) run_id,
       cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) total_tokens,
       cast(sum(case when event_type <> 'error' then event_id % 50 else 0 end) as bigint) prompt_tokens,
       cast(sum(user_id % 9) as bigint) completion_tokens from events group by 1""",
)
def token_totals(spark, sf):
    e = b.table(spark, sf, "events")
    stats = e.select(
        F.concat(F.lit("ds"), (F.col("user_id") % 7).cast("string")).alias("run_id"),
        F.get_json_object("props", "$.k").cast("long").alias("total_tokens"),
        F.when(F.col("event_type") != "error", F.col("event_id") % 50).alias("prompt_tokens"),
        (F.col("user_id") % 9).alias("completion_tokens"),
    )
    return fold.token_totals(stats)


# --- summaries --------------------------------------------------------------------------------------------------

_R = rounded
_SUMMARY_SELECT = f"""run_id, dataset, total, passed, failed, {_R('pass_rate', 4)} pass_rate,
  {_R('total_cost_usd', 6)} total_cost_usd, {_R('avg_latency_ms', 1)} avg_latency_ms,
  {_R('p50_latency_ms', 1)} p50_latency_ms, {_R('p95_latency_ms', 1)} p95_latency_ms"""


@query("run_summary", with_(b.SUMMARY_SQL, f"select {_SUMMARY_SELECT} from summary"))
def run_summary(spark, sf):
    return summary.rounded(summary.summarize_runs(_folded(spark, sf)))


@query(
    "run_percentiles",
    with_(
        b.SUMMARY_SQL,
        """select run_id, dataset, cast(p50_latency_ms as double) p50_latency_ms,
           cast(p95_latency_ms as double) p95_latency_ms from summary""",
    ),
)
def run_percentiles(spark, sf):
    return summary.percentiles(_folded(spark, sf))


@query(
    "rate_bands",
    with_(
        b.SUMMARY_SQL,
        """select run_id, case when passed >= total then 'green' when passed / total >= 0.8 then 'yellow'
           else 'red' end band from summary""",
    ),
)
def rate_bands(spark, sf):
    return summary.with_rate_band(summary.summarize_runs(_folded(spark, sf))).select("run_id", "band")


# --- regressions and gates --------------------------------------------------------------------------------------


def _folded_by_day(spark: SparkSession, sf: str) -> DataFrame:
    folded = fold.fold_providers(b.raw_results(spark, sf), run_keys=DAY_KEYS)
    return folded.withColumn("run_no", F.unix_date("day"))


def _gated(spark: SparkSession, sf: str, thresholds: F.Column) -> DataFrame:
    """Each daily run gated against the run of the day before: one scan, one summary."""
    flagged = regress.flag_against_previous(_folded_by_day(spark, sf))
    runs = summary.summarize_runs(flagged, (*DAY_KEYS, "run_no"), flags={"regressed": "regressions"})
    return regress.apply_gates(regress.previous_rates(runs).withColumn("thresholds", thresholds))


_REGRESSION_SQL = """,
regressed as (
  select c.dataset, c.day, c.key, p.score baseline_score, c.score current_score
  from fold c join fold p on p.dataset = c.dataset and p.key = c.key and c.day = p.day + 1
  where p.passed and not c.passed)"""


_DAY_BEFORE = "s.day = p.day + 1"
_FIRST_DAY = "p.day = date '2024-01-01'"


def _gates_sql(reasons: str, baseline: str = _DAY_BEFORE) -> str:
    return f"""{b.SUMMARY_SQL},
counted as (
  select s.dataset, s.day, count(*) n from fold s join fold p on p.dataset = s.dataset and p.key = s.key and {baseline}
  where p.passed and not s.passed group by all),
joined as (
  select s.*, {_R('p.pass_rate', 4)} baseline_pass_rate, coalesce(n, 0) regressions
  from summary s left join summary p on p.dataset = s.dataset and {baseline}
  left join counted c on c.dataset = s.dataset and c.day = s.day),
gated as (select *, list_filter([{reasons}], lambda r: r is not null) reasons from joined)"""


_GATE_SELECT = f"""select dataset, cast(day as varchar) as day, total, passed, {_R('pass_rate', 4)} pass_rate,
  {_R('total_cost_usd', 6)} total_cost_usd, {_R('avg_latency_ms', 1)} avg_latency_ms,
  {_R('p50_latency_ms', 1)} p50_latency_ms, {_R('p95_latency_ms', 1)} p95_latency_ms, baseline_pass_rate,
  {_R('pass_rate - baseline_pass_rate', 4)} pass_rate_delta, regressions,
  case when baseline_pass_rate is not null then array_to_string(reasons, '; ') end failure_reasons,
  case when baseline_pass_rate is not null then len(reasons) = 0 end gate_passed
from gated"""

_FLAGSHIP_REASONS = f"""
  case when dataset <> 'ds0' and regressions > 0
       then cast(regressions as varchar) || ' previously-passing case(s) now fail' end,
  case when pass_rate < 0.4
       then 'Pass rate ' || printf('%.1f%%', pass_rate * 100) || ' is below required threshold 40.0%' end,
  case when pass_rate - baseline_pass_rate < -0.1
       then 'Pass rate dropped ' || printf('%.1f%%', abs(pass_rate - baseline_pass_rate) * 100)
            || ', exceeds max allowed drop of 10.0%' end,
  case when total_cost_usd > 0.2
       then 'Total cost $' || printf('%.4f', {_R('total_cost_usd', 6)}) || ' exceeds threshold $0.2000' end,
  case when p95_latency_ms > 900
       then 'p95 latency ' || cast(p95_latency_ms as varchar) || 'ms exceeds threshold 900ms' end"""


def _gate_report(gated: DataFrame) -> DataFrame:
    shown = summary.rounded(gated.drop("thresholds"))
    return shown.select(
        "dataset", F.col("day").cast("string").alias("day"), "total", "passed", "pass_rate", "total_cost_usd",
        "avg_latency_ms", "p50_latency_ms", "p95_latency_ms", "baseline_pass_rate",
        py_round(F.col("_delta"), 4).alias("pass_rate_delta"), "regressions",
        F.array_join("failure_reasons", "; ").alias("failure_reasons"), "gate_passed",
    )


@query("flagship_regression", with_(_gates_sql(_FLAGSHIP_REASONS), _GATE_SELECT))
def flagship_regression(spark, sf):
    """Every daily run of every dataset against the run of the day before, gated."""
    limits = threshold_struct(
        LLM_THRESHOLDS, pass_rate=0.4, fail_on_regression=F.col("dataset") != "ds0", max_score_drop=0.1,
        max_cost_usd=0.2, max_p95_latency_ms=900,
    )
    gated = _gated(spark, sf, limits)
    return _gate_report(gated.withColumn("_delta", F.col("pass_rate_delta")))


_RUN_GATE_REASONS = """
  case when regressions > 0 then cast(regressions as varchar) || ' previously-passing case(s) now fail' end,
  case when pass_rate < 1.0
       then 'Pass rate ' || printf('%.1f%%', pass_rate * 100) || ' is below required threshold 100.0%' end,
  case when dataset = 'ds1' and p95_latency_ms > 500
       then 'p95 latency ' || cast(p95_latency_ms as varchar) || 'ms exceeds threshold 500ms' end"""


@query("run_gates", with_(_gates_sql(_RUN_GATE_REASONS, _FIRST_DAY), _GATE_SELECT))
def run_gates(spark, sf):
    """All runs against one baseline per dataset, its first run, with the retrieval defaults as thresholds."""
    limits = threshold_struct(RAG_THRESHOLDS, max_p95_latency_ms=F.when(F.col("dataset") == "ds1", 500))
    first = b.raw_results(spark, sf).filter(F.col("day") == "2024-01-01")
    base = fold.fold_providers(first, run_keys=("dataset",))
    flagged = regress.flag_regressions(
        fold.fold_providers(b.raw_results(spark, sf), run_keys=DAY_KEYS), regress.baseline_cases(base)
    )
    runs = summary.summarize_runs(flagged, DAY_KEYS, flags={"regressed": "regressions"})
    rates = summary.summarize_runs(base, ("dataset",))
    gated = regress.gate_runs(runs.withColumn("thresholds", limits), rates)
    return _gate_report(gated.withColumn("_delta", F.col("pass_rate_delta")))


@query(
    "regressions_llm",
    with_(
        b.FOLD_SQL + _REGRESSION_SQL,
        "select dataset, cast(day as varchar) as day, key, baseline_score, current_score from regressed",
    ),
)
def regressions_llm(spark, sf):
    """The regressed cases of every daily run, with both scores."""
    found = regress.flag_against_previous(_folded_by_day(spark, sf)).filter("regressed")
    return found.select(
        "dataset", F.col("day").cast("string").alias("day"), "key", "baseline_score", F.col("score").alias("current_score")
    )


_RAG_PAIR_SQL = b.RAG_SQL + """,
first_replies as (
  select conv_id case_id, arg_min(text, turn) first_answer from conversations where role = 'assistant' group by 1),
pair as (
  select r.*, contains(lower(coalesce(answer, '')), lower(ground_truth)) now_ok,
         contains(lower(first_answer), lower(ground_truth)) was_ok
  from rag r join first_replies using (case_id))"""


@query(
    "regressions_rag",
    with_(
        _RAG_PAIR_SQL,
        """select dataset, case_id, 'case ' || cast(case_id as varchar) description, 1.0::double baseline_score,
           0.0::double current_score,
           'Answer does not contain expected ground truth: ''' || replace(ground_truth, chr(10), '\\n') || '''; Answer correctness score 0.00 '
           || 'below threshold 0.50 (no judge configured; using contains match)' failure_reasons
           from pair where was_ok and not now_ok""",
    ),
)
def regressions_rag(spark, sf):
    """Retrieval cases answered right in the first reply of a conversation and wrong in the last one."""
    cases = b.rag_cases(spark, sf).withColumn("thresholds", b.rag_thresholds())
    now = score_rag(join_responses(cases, b.rag_responses(spark, sf), ("case_id",)))
    before = score_rag(join_responses(cases, b.rag_responses(spark, sf, newest=False), ("case_id",)))
    base = regress.baseline_cases(
        before.select("dataset", "case_id", "passed", F.col("composite_score").alias("score"), F.col("case_id").alias("ord")),
        ("dataset", "case_id"),
    )
    found = regress.find_regressions(now, base, ("dataset", "case_id"))
    return found.select(
        "dataset", "case_id", F.concat(F.lit("case "), F.col("case_id").cast("string")).alias("description"),
        "baseline_score", F.col("composite_score").alias("current_score"),
        F.array_join("failure_reasons", "; ").alias("failure_reasons"),
    )


@query(
    "sweep_summary",
    with_(
        b.SUMMARY_SQL,
        """select dataset, cast(sum(passed) as bigint) passed, cast(sum(total) as bigint) total,
           sum(passed) / sum(total) pass_rate, case when sum(passed) = sum(total) then 'PASS' else 'FAIL' end status
           from summary group by grouping sets ((dataset), ())""",
    ),
)
def sweep_summary(spark, sf):
    return summary.sweep_summary(summary.summarize_runs(_folded(spark, sf)))


@query(
    "sweep_gate",
    with_(
        _gates_sql("""case when pass_rate < 0.4 then 'x' end, case when pass_rate - baseline_pass_rate < -0.2
                      then 'x' end"""),
        """select cast(day as varchar) as day, bool_and(baseline_pass_rate is null or len(reasons) = 0) all_passed
           from gated group by day""",
    ),
)
def sweep_gate(spark, sf):
    """One verdict per day over all datasets compared with their baselines."""
    limits = threshold_struct(LLM_THRESHOLDS, pass_rate=0.4, fail_on_regression=False, max_score_drop=0.2)
    return regress.sweep_gate(_gated(spark, sf, limits), True, ("day",)).withColumn("day", F.col("day").cast("string"))


# --- history ----------------------------------------------------------------------------------------------------

_HISTORY_SQL = b.SUMMARY_SQL + f""",
runs as (
  select run_id, dataset, cast(day as varchar) || 'T00:00:00+00:00' ran_at, '["a", "b"]' providers,
         cast(total as int) total_cases, cast(passed as int) passed, cast(failed as int) failed,
         {_R('pass_rate', 6)} pass_rate, {_R('total_cost_usd', 6)} total_cost_usd, 0::bigint total_tokens,
         0::bigint prompt_tokens, 0::bigint completion_tokens, {_R('avg_latency_ms', 2)} avg_latency_ms,
         {_R('p50_latency_ms', 2)} p50_latency_ms, {_R('p95_latency_ms', 2)} p95_latency_ms, 'llm' run_type
  from summary)"""


def _history(spark: SparkSession, sf: str) -> DataFrame:
    runs = summary.summarize_runs(_folded(spark, sf), b.RUN_KEYS)
    ran_at = F.concat(F.col("day").cast("string"), F.lit("T00:00:00+00:00"))
    return history.history_runs(runs, "llm", F.lit('["a", "b"]'), ran_at)


def _case_rows(spark: SparkSession, sf: str) -> DataFrame:
    cases = _folded(spark, sf)
    shown = vars_json(F.create_map(F.lit("user"), F.col("key").cast("string")))
    return history.history_cases(cases.withColumn("vars_json", shown).withColumn("key", short_hash(F.col("vars_json"))))


@query(
    "recent_runs",
    with_(
        _HISTORY_SQL,
        """select run_id, dataset, ran_at, providers, total_cases, passed, failed, pass_rate, total_cost_usd,
           total_tokens, avg_latency_ms, p95_latency_ms, run_type from runs order by ran_at desc, run_id desc limit 20""",
    ),
)
def recent_runs(spark, sf):
    return display.recent_runs(_history(spark, sf))


@query(
    "recent_runs_filtered",
    with_(
        _HISTORY_SQL,
        """select run_id, dataset, ran_at, providers, total_cases, passed, failed, pass_rate, total_cost_usd,
           total_tokens, avg_latency_ms, p95_latency_ms, run_type from runs where dataset = 'ds3' and run_type = 'llm'
           order by ran_at desc, run_id desc limit 10""",
    ),
)
def recent_runs_filtered(spark, sf):
    return display.recent_runs(_history(spark, sf), 10, "ds3", "llm")


@query(
    "last_n_stats",
    with_(
        _HISTORY_SQL,
        """select dataset, count(*) run_count, round(avg(pass_rate), 9) avg_pass_rate, min(pass_rate) min_pass_rate,
           max(pass_rate) max_pass_rate, round(sum(total_cost_usd), 6) total_cost_usd,
           round(avg(total_cost_usd), 9) avg_cost_per_run, max(total_cost_usd) max_cost_per_run,
           round(avg(avg_latency_ms), 6) avg_latency_ms, max(p95_latency_ms) max_p95_latency_ms,
           cast(sum(total_tokens) as bigint) total_tokens
           from (select *, row_number() over (partition by dataset order by ran_at desc, run_id desc) n from runs)
           where n <= 10 group by dataset""",
    ),
)
def last_n_stats(spark, sf):
    stats = summary.last_n_stats(_history(spark, sf), 10)
    digits = {"avg_pass_rate": 9, "total_cost_usd": 6, "avg_cost_per_run": 9, "avg_latency_ms": 6}
    return stats.withColumns({c: F.round(c, d) for c, d in digits.items()})


_CASE_ROWS_SQL = """,
case_rows as (
  select run_id, ord as id, '{"user": "' || cast(key as varchar) || '"}' vars_json, passed, score, latency_ms,
         round(cost_usd, 6) cost_usd from fold)"""


@query(
    "run_cases",
    with_(
        _HISTORY_SQL + _CASE_ROWS_SQL,
        """select c.* from case_rows c join
           (select run_id from runs qualify row_number() over (partition by dataset order by ran_at desc, run_id desc) = 1)
           using (run_id)""",
    ),
)
def run_cases(spark, sf):
    """Case rows of the newest run of every dataset."""
    newest = W.partitionBy("dataset").orderBy(F.col("ran_at").desc(), F.col("run_id").desc())
    runs = _history(spark, sf).withColumn("_n", F.row_number().over(newest)).filter("_n = 1")
    return display.run_cases(runs, _case_rows(spark, sf))


def _kind_runs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    cases = b.rag_cases(spark, sf).withColumn("thresholds", b.rag_thresholds())
    rag = score_rag(join_responses(cases, b.rag_responses(spark, sf), ("case_id",)))
    rag = rag.select(
        "dataset", F.concat(F.lit("rag_"), "dataset").alias("run_id"), "passed",
        F.coalesce("latency_ms", F.lit(0)).alias("latency_ms"), F.lit(0.0).alias("cost_usd"), "composite_score",
    )
    agent = score_agent(b.agent_cases(spark, sf)).select(
        "dataset", F.concat(F.lit("run_"), "dataset").alias("run_id"), "passed", "latency_ms", "cost_usd",
        "composite_score", "answer_score", "tool_score",
    )
    return rag, agent


_KIND_SQL = b.RAG_SQL + ",\n" + b.EXP_SQL.lstrip() + f""",
rag_rows as (
  select 'rag_' || dataset run_id, dataset, contains(lower(coalesce(answer, '')), lower(ground_truth))
         and error is null passed, latency_ms, 0.0::double cost_usd, 'rag' run_type
  from rag),
agent_rows as (
  select 'run_' || dataset run_id, dataset, answer_score >= 0.8 and len(missing_tools) + len(forbidden) + len(unmet) = 0
         and (max_steps is null or step_count <= max_steps)
         and (max_tool_calls is null or len(calls) <= max_tool_calls) passed, latency_ms, cost_usd, 'agent' run_type
  from scored),
kind_rows as (select * from rag_rows union all select * from agent_rows),
kind_runs as (
  select run_id, dataset, '2024-02-01T00:00:00+00:00' ran_at, '[]' providers, cast(count(*) as int) total_cases,
         cast(count(*) filter (passed) as int) passed, cast(count(*) filter (not passed) as int) failed,
         {_R('count(*) filter (passed) / count(*)', 6)} pass_rate, {_R('sum(cost_usd)', 6)} total_cost_usd,
         0::bigint total_tokens, 0::bigint prompt_tokens, 0::bigint completion_tokens,
         {_R('avg(latency_ms)', 2)} avg_latency_ms,
         {_R('list_sort(list(latency_ms))[count(*) // 2 + 1]', 2)} p50_latency_ms,
         {_R('list_sort(list(latency_ms))[least(count(*) * 95 // 100, count(*) - 1) + 1]', 2)} p95_latency_ms,
         run_type
  from kind_rows group by run_id, dataset, run_type)"""


@query(
    "history_union",
    with_(
        _HISTORY_SQL + ",\n" + _KIND_SQL.lstrip(), "select * from runs union all by name select * from kind_runs"
    ),
)
def history_union(spark, sf):
    rag, agent = _kind_runs(spark, sf)
    at = F.lit("2024-02-01T00:00:00+00:00")
    return history.union_histories(
        _history(spark, sf).drop("run_type"),
        history.history_runs(summary.summarize_runs(rag), "rag", F.lit("[]"), at),
        history.history_runs(summary.summarize_runs(agent), "agent", F.lit("[]"), at),
    )


@query(
    "dimension_means",
    with_(
        b.EXP_SQL,
        """select 'run_' || dataset run_id, dataset, count(*) total,
           round(avg((answer_score * 0.4 + tool_score * 0.4 + efficiency * 0.05) / 0.85), 6) avg_composite_score,
           round(avg(answer_score), 6) avg_answer_score, round(avg(tool_score), 6) avg_tool_score
           from scored group by dataset""",
    ),
)
def dimension_means(spark, sf):
    _, agent = _kind_runs(spark, sf)
    means = ("composite_score", "answer_score", "tool_score")
    out = summary.summarize_runs(agent, means=means)
    return out.select("run_id", "dataset", "total", *[F.round(f"avg_{m}", 6).alias(f"avg_{m}") for m in means])


@query("history_untyped", with_(_HISTORY_SQL, "select run_id, dataset, total_cases, run_type from runs"))
def history_untyped(spark, sf):
    """Runs of a history from before run types and commits, half of them recorded again since."""
    path = new_table_path(spark, "history")
    runs, cases = _history(spark, sf), _case_rows(spark, sf)
    runs.drop("run_type").write.partitionBy("dataset").parquet(f"{path}/runs")
    cases.write.partitionBy("dataset").parquet(f"{path}/case_results")
    again = F.col("dataset").isin("ds0", "ds2", "ds4")
    history.record_runs(runs.filter(again), cases.filter(again), path)
    return history.load_history(spark, path)[0].select("run_id", "dataset", "total_cases", "run_type")


@query(
    "history_upsert",
    with_(
        _HISTORY_SQL + _CASE_ROWS_SQL,
        """select r.run_id, r.dataset, r.total_cases, r.pass_rate, c.n case_rows, round(c.s, 6) score_sum
           from runs r join (select run_id, count(*) n, sum(score) s from case_rows group by run_id) c using (run_id)""",
    ),
)
def history_upsert(spark, sf):
    """Record all runs wrongly, under another dataset and with every case twice, record them again, and read back what holds."""
    path = new_table_path(spark, "history")
    runs, cases = _history(spark, sf), _case_rows(spark, sf)
    elsewhere = F.concat(F.lit("old "), "dataset")
    wrong = runs.withColumns({"pass_rate": F.lit(-1.0), "dataset": elsewhere})
    history.record_runs(wrong, cases.unionByName(cases).withColumn("dataset", elsewhere), path)
    history.record_runs(runs, cases, path)
    stored, rows = history.load_history(spark, path)
    sums = rows.groupBy("run_id").agg(F.count("*").alias("case_rows"), F.round(F.sum("score"), 6).alias("score_sum"))
    return stored.select("run_id", "dataset", "total_cases", "pass_rate").join(sums, "run_id")


@query(
    "history_of_runs",
    with_(
        _HISTORY_SQL + _CASE_ROWS_SQL,
        """select r.run_id, r.dataset, r.pass_rate, count(*) case_rows, round(sum(c.score), 6) score_sum
           from (select * from runs where dataset in ('ds1', 'ds3') qualify row_number() over (partition by dataset order by run_id desc) <= 2) r
           join case_rows c using (run_id) group by all""",
    ),
)
def history_of_runs(spark, sf):
    """Record every dataset by itself, one of them twice, and read four runs: only the commits that hold them are opened."""
    path = new_table_path(spark, "history")
    runs, cases = _history(spark, sf), _case_rows(spark, sf)
    history.record_runs(runs.withColumn("pass_rate", F.lit(-1.0)), cases.limit(0), path)
    for own in (F.col("dataset").isin("ds1"), F.col("dataset").isin("ds3"), ~F.col("dataset").isin("ds1", "ds3")):
        history.record_runs(runs.filter(own), cases.filter(own), path)
    last = runs.filter(F.col("dataset").isin("ds1", "ds3")).withColumn("_n", F.row_number().over(W.partitionBy("dataset").orderBy(F.desc("run_id"))))
    names = [r["run_id"] for r in last.filter("_n <= 2").select("run_id").collect()]
    stored, rows = history.load_history(spark, path, names)
    sums = rows.groupBy("run_id").agg(F.count("*").alias("case_rows"), F.round(F.sum("score"), 6).alias("score_sum"))
    return stored.select("run_id", "dataset", "pass_rate").join(sums, "run_id")


@query(
    "result_table",
    with_(
        b.SUMMARY_SQL,
        f"""select s.run_id, s.total, {_R('pass_rate', 4)} pass_rate, n cases from summary s
            join (select run_id, count(*) n from fold group by 1) using (run_id)""",
    ),
)
def result_table(spark, sf):
    """Results of all runs in one clustered table, half of the runs written again; read back as last written."""
    path = new_table_path(spark, "results")
    folded = _folded(spark, sf)
    half = F.col("run_id").substr(-1, 1).isin("1", "3", "5", "7", "9")
    results.write_result_table(summary.summarize_runs(folded), folded.unionByName(folded.filter(half)), path)
    results.write_result_table(summary.summarize_runs(folded).filter(half), folded.filter(half), path)
    schemas = "run_id string, total long, pass_rate double, dataset string", "key long, run_id string, dataset string"
    runs, rows = results.read_result_table(spark, path, *schemas)
    return runs.select("run_id", "total", "pass_rate").join(rows.groupBy("run_id").agg(F.count("*").alias("cases")), "run_id")


@query(
    "baseline_reload",
    with_(
        b.SUMMARY_SQL,
        f"""select dataset, run_id, total, passed, {_R('pass_rate', 4)} pass_rate, n case_rows from summary
            join (select run_id, count(*) n from fold group by run_id) using (run_id)
            qualify row_number() over (partition by dataset order by day desc) = 1""",
    ),
)
def baseline_reload(spark, sf):
    """Save the newest run of every dataset as its baseline and read it back."""
    path = new_table_path(spark, "baselines")
    newest = W.partitionBy("dataset").orderBy(F.col("day").desc())
    folded = _folded(spark, sf)
    runs = summary.summarize_runs(folded, b.RUN_KEYS).withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
    history.save_baselines(runs, folded.join(runs.select("run_id"), "run_id", "left_semi"), path)
    saved, cases = history.load_baselines(spark, path)
    counts = cases.groupBy("run_id").agg(F.count("*").alias("case_rows"))
    return saved.join(counts, "run_id").select("dataset", "run_id", "total", "passed", "pass_rate", "case_rows")


@query(
    "failed_cases",
    with_(
        b.FOLD_SQL,
        """select run_id, key, score, greatest(n - 5, 0) more from (
             select *, row_number() over (partition by run_id order by ord) r, count(*) over (partition by run_id) n
             from fold where not passed) where r <= 5""",
    ),
)
def failed_cases(spark, sf):
    return display.failed_cases(_folded(spark, sf), 5).select("run_id", "key", "score", "more")


@query(
    "case_thresholds",
    with_(
        b.FOLD_SQL,
        """select run_id, key, case dataset when 'ds1' then 0.5 when 'ds2' then 0.25 else 1.0 end::double min_rate,
           case when dataset = 'ds2' then 300 end max_p95 from fold""",
    ),
)
def case_thresholds(spark, sf):
    """Dataset thresholds joined to every case; datasets without their own get the defaults."""
    folded = _folded(spark, sf)
    rate = F.when(F.col("dataset") == "ds1", 0.5).otherwise(0.25)
    catalog = folded.select("dataset").distinct().filter(F.col("dataset").isin("ds1", "ds2")).withColumn(
        "thresholds",
        threshold_struct(LLM_THRESHOLDS, pass_rate=rate, max_p95_latency_ms=F.when(F.col("dataset") == "ds2", 300)),
    )
    joined = attach_thresholds(folded, catalog, LLM_THRESHOLDS)
    return joined.select(
        "run_id", "key", F.col("thresholds.pass_rate").alias("min_rate"),
        F.col("thresholds.max_p95_latency_ms").alias("max_p95"),
    )


# --- larger runs, timed -----------------------------------------------------------------------------------------

LARGE_KEYS = ("dataset", "run_no")


def _folded_large(spark: SparkSession, sf: str) -> DataFrame:
    return fold.fold_providers(b.raw_results_large(spark, sf), run_keys=LARGE_KEYS)


@query(
    "bench_fold",
    with_(
        b.FOLDL_SQL,
        """select run_no, count(*) cases, count(*) filter (passed) passed, cast(sum(latency_ms) as bigint) latency_ms,
           round(sum(cost_usd), 4) cost_usd from foldl group by run_no""",
    ),
)
def bench_fold(spark, sf):
    return _folded_large(spark, sf).groupBy("run_no").agg(
        F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.sum("latency_ms").alias("latency_ms"),
        F.round(F.sum("cost_usd"), 4).alias("cost_usd"),
    )


@query(
    "bench_percentiles",
    with_(
        b.RESL_SQL,
        """select run_no, cast(list_sort(list(latency_ms))[count(*) // 2 + 1] as double) p50_latency_ms,
           cast(list_sort(list(latency_ms))[least(count(*) * 95 // 100, count(*) - 1) + 1] as double) p95_latency_ms
           from resl group by run_no""",
    ),
)
def bench_percentiles(spark, sf):
    rows = b.raw_results_large(spark, sf).withColumnRenamed("success", "passed")
    return summary.percentiles(rows, ("run_no",))


@query(
    "bench_regression",
    with_(
        b.FOLDL_SQL,
        """select c.run_no, count(*) regressions, cast(sum(cast(round((p.score - c.score) * 100) as bigint)) as bigint) drop_percent
           from foldl c join foldl p on p.key = c.key and c.run_no = p.run_no + 1
           where p.passed and not c.passed group by c.run_no""",
    ),
)
def bench_regression(spark, sf):
    """Monthly runs against the month before."""
    found = regress.flag_against_previous(_folded_large(spark, sf)).filter("regressed")
    return found.groupBy("run_no").agg(
        F.count("*").alias("regressions"), F.sum(F.round((F.col("baseline_score") - F.col("score")) * 100).cast("long")).alias("drop_percent")
    )
