"""Run and call-log rollups.

Trace: ``run_id, step, model_ms, prompt_tokens, completion_tokens, compacted, repaired, tools``.
Call log: ``ts, model, latency_ms, prompt_tokens, completion_tokens, retries, error``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _exact(ms: str):
    """A sum of milliseconds that does not depend on the order of addition."""
    return F.sum(F.col(ms).cast("decimal(20,6)"))


def run_rollup(trace: DataFrame) -> DataFrame:
    failed = F.size(F.filter("tools", lambda t: ~t["ok"]))
    return trace.groupBy("run_id").agg(
        F.count("*").alias("steps"), F.sum(F.size("tools")).alias("tool_calls"), F.sum(failed).alias("tool_failures"), F.count_if("repaired").alias("repaired_steps"),
        F.count_if("compacted").alias("compactions"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.round(_exact("model_ms"), 1).cast("double").alias("model_ms"),
    )


def tool_rollup(trace: DataFrame) -> DataFrame:
    """Per run and tool: calls, time, failures, mean time."""
    each = trace.select("run_id", F.explode("tools").alias("t"))
    total = _exact("t.duration_ms")
    return each.groupBy("run_id", F.col("t.name").alias("name")).agg(F.count("*").alias("calls"), F.round(total, 2).cast("double").alias("total_ms"), F.count_if(~F.col("t.ok")).alias("failures"), F.round(total / F.count("*"), 2).cast("double").alias("avg_ms"))


def tool_cube(trace: DataFrame) -> DataFrame:
    """Calls, time, failures and mean time by run and tool, by run, by tool, and in all (``level``).

    ``run_id`` and ``name`` are null where a level sums over them.  Runs and tools are counted first, so the cube expands
    one row a run and tool, not one a call.
    """
    each = trace.select("run_id", F.explode("tools").alias("t"))
    base = each.groupBy("run_id", F.col("t.name").alias("name")).agg(F.count("*").alias("n"), _exact("t.duration_ms").alias("ms"), F.count_if(~F.col("t.ok")).alias("bad"))
    calls, total = F.sum("n"), F.sum("ms")
    level = F.element_at(F.array(*map(F.lit, ("run and tool", "run", "tool", "all"))), F.grouping_id().cast("int") + 1)
    return base.cube("run_id", "name").agg(level.alias("level"), calls.alias("calls"), F.round(total, 2).cast("double").alias("total_ms"), F.sum("bad").alias("failures"), F.round(total / calls, 2).cast("double").alias("avg_ms"))


def call_log_rollup(log: DataFrame) -> DataFrame:
    """Per model: calls, errors, retryable ones (429 or 500 and above), retries, tokens, latency: mean, p50 and p95.

    A percentile is the smallest latency that at least that share of the calls do not exceed.
    """
    status = F.regexp_extract(F.coalesce("error", F.lit("")), r"returned (\d{3})", 1)
    code = F.when(status == "", F.lit(None)).otherwise(status.cast("int"))
    return log.groupBy("model").agg(F.count("*").alias("calls"), F.count("error").alias("errors"), F.count_if((code == 429) | (code >= 500)).alias("retryable"), F.sum("retries").alias("retries"), F.count_if(F.col("retries") > 0).alias("retried_calls"), F.round(F.avg("latency_ms"), 4).alias("avg_ms"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"), *[F.percentile_approx("latency_ms", q, 100_000).alias(n) for n, q in (("p50_ms", 0.5), ("p95_ms", 0.95))])


def step_records(steps: DataFrame) -> DataFrame:
    """Trace rows from steps (``elapsed_s``, ``results array<struct<name, duration_ms, ok, content>>``)."""
    error = lambda r: F.when(~r["ok"], F.left(F.coalesce(r["content"], F.lit("")), F.lit(200)))
    tools = F.transform("results", lambda r: F.struct(r["name"].alias("name"), r["duration_ms"].alias("duration_ms"), r["ok"].alias("ok"), error(r).alias("error")))
    return steps.select("run_id", "step", F.round("model_ms", 1).alias("model_ms"), F.round(F.col("elapsed_s") * 1000, 1).alias("step_ms"), "prompt_tokens", "completion_tokens", "compacted", "repaired", tools.alias("tools"))


def run_metrics(trace: DataFrame) -> DataFrame:
    """Per run: iterations, tool calls, repaired steps as a share of the steps with calls (0 without any), prompt tokens."""
    calls = F.size("tools") > 0
    rate = F.coalesce(F.count_if(F.col("repaired") & calls) / F.nullif(F.count_if(calls), F.lit(0)), F.lit(0.0))
    return trace.groupBy("run_id").agg(F.count("*").alias("iterations"), F.sum(F.size("tools")).alias("tool_calls"), F.round(rate, 6).alias("repair_rate"), F.sum("prompt_tokens").alias("prompt_tokens"))


def summary_line(rollup: DataFrame) -> DataFrame:
    """``run_id, line`` from ``run_rollup``: counts in words, the optional ones only where they are not zero."""
    some = lambda c, word: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {word}")))
    tokens = F.concat(F.col("prompt_tokens").cast("string"), F.lit("+"), F.col("completion_tokens").cast("string"), F.lit(" tokens"))
    parts = F.concat_ws(", ", F.concat(F.col("steps").cast("string"), F.lit(" steps")), F.concat(F.col("tool_calls").cast("string"), F.lit(" tool calls")), some("tool_failures", "failed"), some("repaired_steps", "repaired"), some("compactions", "compactions"), tokens, F.concat(F.lit("model "), F.round(F.col("model_ms").cast("decimal(20,1)") / 1000, 1).cast("decimal(20,1)").cast("string"), F.lit("s")))
    return rollup.select("run_id", F.concat(F.lit("trace "), F.col("run_id"), F.lit(": "), parts).alias("line"))
