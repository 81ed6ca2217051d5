"""Completion logs: repair statistics, history policies, run outcomes.

Parsed completions have ``parsed`` (see ``functions.toolcalls.PARSED``) beside their own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.toolcalls import parse_tool_calls


def parsed(completions: DataFrame, text: str = "text", known: set[str] | None = None) -> DataFrame:
    return completions.withColumn("parsed", parse_tool_calls(F.col(text), known))


def _kinds():
    return F.array_distinct(F.flatten(F.transform("parsed.calls", lambda c: c["repairs"])))


def parse_stats(df: DataFrame, *keys: str) -> DataFrame:
    """Completions, those with calls, those repaired, calls, unreadable spans and the repair percentage, by ``keys``."""
    n = F.size("parsed.calls")
    with_calls, repaired = F.count_if(n > 0), F.count_if(F.size(_kinds()) > 0)
    return df.groupBy(*keys).agg(
        F.count("*").alias("completions"), with_calls.alias("with_calls"), repaired.alias("repaired"), F.coalesce(F.sum(n), F.lit(0)).alias("calls_found"),
        F.coalesce(F.sum(F.size("parsed.problems")), F.lit(0)).alias("unparseable"), F.round(100.0 * repaired / F.greatest(with_calls, F.lit(1)), 1).alias("repair_pct"),
    )


def repair_rates(df: DataFrame, runs: DataFrame, *keys: str) -> DataFrame:
    """``parse_stats`` by ``keys`` (model and temperature, say) with the failed runs of the same keys (``runs``: ``keys, outcome``)."""
    failed = runs.groupBy(*keys).agg(F.count_if(F.col("outcome") != "answered").alias("failed"))
    return parse_stats(df, *keys).join(failed, list(keys), "left").withColumn("failed", F.coalesce("failed", F.lit(0)))


def repair_kinds(df: DataFrame, *keys: str) -> DataFrame:
    """How many completions took each kind of repair; a kind counts once per completion."""
    return df.select(*keys, F.explode(_kinds()).alias("kind")).groupBy(*keys, "kind").agg(F.count("*").alias("n"))


def history_text(df: DataFrame, raw_text: str = "text") -> DataFrame:
    """What each completion leaves in history: the chosen rule in ``recorded``, and the six compared policies."""
    raws, lines = F.transform("parsed.calls", lambda c: c["raw"]), F.transform("parsed.calls", lambda c: c["line"])
    before, after = F.col("parsed.prose_before"), F.col("parsed.prose_after")

    def joined(*parts):
        return F.array_join(F.filter(F.concat(*[p if i else F.array(p) for i, p in enumerate(parts)]), lambda x: x != ""), "\n")

    none = F.size("parsed.calls") == 0
    return df.withColumns({
        "recorded": F.when(none, F.col(raw_text)).otherwise(joined(before, F.array_distinct(raws))), "raw_text": F.col(raw_text),
        "prose_only": F.when(F.col("parsed.text") == "", "(calling a tool)").otherwise(F.col("parsed.text")), "call_line": F.array_join(lines, "\n"),
        "before_line": joined(before, lines), "before_line_after": joined(before, lines, F.array(after)), "before_raw": joined(before, raws),
    })


def run_outcomes(steps: DataFrame, max_iterations: int = 15, max_parse_retries: int = 2) -> DataFrame:
    """``run_id, outcome, iterations, tool_calls`` from ``run_id, step (from 1), n_calls, n_problems``.

    A step without calls or problems answers; too many problem steps in a row end a run, and a step with
    calls starts the count anew; the cap counts only if nothing ended earlier.  Later steps are ignored.
    A run that just stops is ``unfinished``.
    """
    w = Window.partitionBy("run_id").orderBy("step")
    called = F.col("n_calls") > 0
    capped = steps.where(F.col("step") <= max_iterations).withColumn("island", F.sum(called.cast("int")).over(w))
    streak = F.sum((~called).cast("int")).over(Window.partitionBy("run_id", "island").orderBy("step"))
    ends = F.when(~called & (F.col("n_problems") == 0), "answered").when(streak > max_parse_retries, "parse_retries_exhausted").when(F.col("step") == max_iterations, "exhausted")
    marked = capped.withColumn("end", ends)
    first = F.min(F.when(F.col("end").isNotNull(), F.col("step"))).over(Window.partitionBy("run_id"))
    lived = marked.withColumn("first", first).where(F.col("first").isNull() | (F.col("step") <= F.col("first")))
    return lived.groupBy("run_id").agg(F.coalesce(F.max_by("end", "step"), F.lit("unfinished")).alias("outcome"), F.count("*").alias("iterations"), F.sum("n_calls").alias("tool_calls"))


def compare_policies(runs: DataFrame, max_iterations: int = 15, key: str = "policy") -> DataFrame:
    """By policy: runs answered and failed, mean iterations (a failed run counts the maximum), tool calls."""
    done = F.col("outcome") == "answered"
    spent = F.when(done, F.col("iterations")).otherwise(max_iterations)
    return runs.groupBy(key).agg(F.count_if(done).alias("done"), F.count_if(~done).alias("failed"), F.round(F.avg(spent), 4).alias("avg_iterations"), F.sum("tool_calls").alias("tool_calls"))
