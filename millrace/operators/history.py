"""Conversation histories: turns, token counts, budget, truncation, transcripts.

Messages: ``conv_id, turn (position), role, text``.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_estimate

OVERHEAD = 10
ROLES = ["system", "user", "assistant", "tool"]


def one_system(messages: DataFrame) -> DataFrame:
    """The latest system message, first; the others in order; ``pos`` from 0."""
    last = Window.partitionBy("conv_id", F.col("role") == "system").orderBy(F.desc("turn"))
    kept = messages.withColumn("r", F.row_number().over(last)).where((F.col("role") != "system") | (F.col("r") == 1)).drop("r")
    order = Window.partitionBy("conv_id").orderBy(F.when(F.col("role") == "system", 0).otherwise(1), "turn")
    return kept.withColumn("pos", F.row_number().over(order) - 1)


def with_turns(messages: DataFrame) -> DataFrame:
    """``turn_no`` from 0 for every message but the system's: a user message opens a turn unless the turn is empty."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rest = messages.where("role <> 'system'").withColumn("nth", F.row_number().over(w))
    opens = F.when((F.col("role") == "user") & (F.col("nth") > 1), 1).otherwise(0)
    return rest.withColumn("turn_no", F.sum(opens).over(w)).drop("nth")


def role_counts(messages: DataFrame) -> DataFrame:
    chars = F.length("text") + F.length("role") + 8
    counts = [F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ROLES]
    return messages.groupBy("conv_id").agg(*counts, F.sum(chars).alias("chars"))


def usage(messages: DataFrame, budget: int, headroom: float = 0.85) -> DataFrame:
    """Tokens of each conversation against ``floor(budget * headroom)``."""
    limit = int(budget * headroom)
    used = messages.groupBy("conv_id").agg(F.sum(token_estimate(F.col("text")) + OVERHEAD).alias("tokens"))
    return used.select("conv_id", "tokens", F.lit(budget).alias("budget"), F.lit(limit).alias("threshold"), (F.col("tokens") > limit).alias("over"))


def truncate(messages: DataFrame, budget: int, keep_turns: int, headroom: float = 0.85) -> DataFrame:
    """History after compaction: system messages, a marker for what was dropped, the kept turns; ``pos`` from 0."""
    dropped = _dropped(messages, budget, keep_turns, headroom).select("conv_id", "turn")
    stay = messages.join(dropped, ["conv_id", "turn"], "left_anti").select("conv_id", F.when(F.col("role") == "system", 0).otherwise(2).alias("k"), "turn", "role", "text")
    note = F.concat(F.lit("["), F.count("*").cast("string"), F.lit(" earlier messages were dropped to stay within the context window. If you need something from them, ask.]"))
    marker = dropped.groupBy("conv_id").agg(note.alias("text")).select("conv_id", F.lit(1).alias("k"), F.lit(-1).cast("long").alias("turn"), F.lit("user").alias("role"), "text")
    order = Window.partitionBy("conv_id").orderBy("k", "turn")
    return stay.unionByName(marker).select("conv_id", (F.row_number().over(order) - 1).alias("pos"), "role", "text")


def compaction_report(messages: DataFrame, budget: int, keep_turns: int, headroom: float = 0.85) -> DataFrame:
    """Every conversation: whether it was over the threshold (``triggered``) and lost messages (``fired``), tokens before and
    after, what was saved (``saved_pct`` of before), dropped turns and messages, and whether it is still over the budget."""
    before = usage(messages, budget, headroom)
    cost = F.sum(token_estimate(F.col("text")) + OVERHEAD)
    after = truncate(messages, budget, keep_turns, headroom).groupBy("conv_id").agg(cost.alias("after"))
    lost = _dropped(messages, budget, keep_turns, headroom).groupBy("conv_id").agg(F.countDistinct("turn_no").alias("turns"), F.count("*").alias("n"))
    joined = before.join(after, "conv_id").join(lost, "conv_id", "left")
    saved = F.col("tokens") - F.col("after")
    return joined.select(
        "conv_id", F.col("over").alias("triggered"), F.col("n").isNotNull().alias("fired"), F.col("tokens").alias("before"), "after", saved.alias("saved"),
        F.round(100 * saved / F.greatest(F.lit(1), F.col("tokens"))).cast("long").alias("saved_pct"), F.coalesce("turns", F.lit(0)).alias("dropped_turns"), F.coalesce("n", F.lit(0)).alias("dropped_messages"),
        (F.col("over") & (F.col("after") > budget)).alias("still_over"),
    )


def _dropped(messages: DataFrame, budget: int, keep: int, headroom: float) -> DataFrame:
    """Messages of the turns that compaction drops."""
    over = usage(messages, budget, headroom).where("over").select("conv_id")
    tagged = with_turns(messages).withColumn("last", F.max("turn_no").over(Window.partitionBy("conv_id")))
    return tagged.where(F.col("turn_no") <= F.col("last") - max(1, keep)).join(over, "conv_id", "left_semi")


def summarize(messages: DataFrame, budget: int, keep_turns: int, summarizer: Callable[[str], str] | None = None, headroom: float = 0.85) -> DataFrame:
    """As ``truncate``, with a summary of what was dropped in the marker; one summarizer call per compacted conversation.

    Without a summarizer, for an empty answer and after an error the marker holds a fixed sentence.
    """
    dropped = _dropped(messages, budget, keep_turns, headroom)
    line = F.struct("turn", F.concat("role", F.lit(": "), F.substring("text", 1, 1500)).alias("l"))
    spans = dropped.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l"]), "\n").alias("span"))

    @F.pandas_udf("string")
    def ask(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                out.append(summarizer(t).strip() or "(summarizer returned nothing)")
            except Exception as e:  # the caller's function may raise anything; one conversation does not end the job
                out.append(f"(summarization failed: {type(e).__name__}; history was dropped)")
        return pd.Series(out, dtype=object)

    summary = F.lit("(no client available to summarize; history was dropped)") if summarizer is None else ask("span")
    note = F.concat(F.lit("[Summary of "), F.col("n").cast("string"), F.lit(" earlier messages, which have been dropped to stay within the context window:]\n\n"), summary)
    marker = spans.select("conv_id", F.lit(1).alias("k"), F.lit(-1).cast("long").alias("turn"), F.lit("user").alias("role"), note.alias("text"))
    stay = messages.join(dropped.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti").select("conv_id", F.when(F.col("role") == "system", 0).otherwise(2).alias("k"), "turn", "role", "text")
    order = Window.partitionBy("conv_id").orderBy("k", "turn")
    return stay.unionByName(marker).select("conv_id", (F.row_number().over(order) - 1).alias("pos"), "role", "text")


def compare_strategies(messages: DataFrame, budget: int, keep_turns: int, summarizer: Callable[[str], str] | None = None, headroom: float = 0.85) -> DataFrame:
    """``conv_id, strategy, before, after, saved, n_messages`` of both ways to compact."""
    before = usage(messages, budget, headroom).select("conv_id", F.col("tokens").alias("before"))
    both = truncate(messages, budget, keep_turns, headroom).withColumn("strategy", F.lit("truncate")).unionByName(summarize(messages, budget, keep_turns, summarizer, headroom).withColumn("strategy", F.lit("summarize")))
    after = both.groupBy("conv_id", "strategy").agg(F.sum(token_estimate(F.col("text")) + OVERHEAD).alias("after"), F.count("*").alias("n_messages"))
    return after.join(before, "conv_id").select("conv_id", "strategy", "before", "after", (F.col("before") - F.col("after")).alias("saved"), "n_messages")


def unpaired_results(messages: DataFrame) -> DataFrame:
    """Tool rows whose ``tool_call_id`` is not among the ids of the nearest earlier assistant message with ``tool_calls``."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    ids = F.when((F.col("role") == "assistant") & (F.size("tool_calls") > 0), F.transform("tool_calls", lambda c: c["id"]))
    open_ids = messages.withColumn("open_ids", F.last(ids, ignorenulls=True).over(w))
    return open_ids.where((F.col("role") == "tool") & ~F.coalesce(F.array_contains("open_ids", F.col("tool_call_id")), F.lit(False))).drop("open_ids")


def _or_null(messages: DataFrame, name: str, kind: str = "string"):
    return F.col(name) if name in messages.columns else F.lit(None).cast(kind)


def transcript(messages: DataFrame) -> DataFrame:
    """Each conversation as text; a message's ``name``, where there is one, stands behind its role."""
    name = _or_null(messages, "name")
    head = F.concat(F.upper("role"), F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit("("), name, F.lit(")"))).otherwise(""))
    body = F.when(F.length("text") >= 500, F.concat(F.substring("text", 1, 500), F.lit(" ...[cut]"))).otherwise(F.col("text"))
    line = F.concat(F.lit("--- "), head, F.lit(" ---\n"), body)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"])
    return messages.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("transcript"))


def to_wire(messages: DataFrame, hosted: bool = False) -> DataFrame:
    """``conv_id, wire``: each conversation as a JSON array of messages in order; bookkeeping columns stay behind.

    The local shape has role, content and a tool row's name.  The hosted shape adds an assistant's calls (``tool_calls
    array<struct<id, name, arguments>>``, the arguments as JSON text) and a tool row's ``tool_call_id``, null or not.
    """
    tool = F.col("role") == "tool"
    name = F.when(tool & (_or_null(messages, "name") != ""), F.to_json(F.struct(_or_null(messages, "name").alias("name"))))
    parts = [F.to_json(F.struct("role", F.coalesce("text", F.lit("")).alias("content")))]
    if hosted:
        calls = _or_null(messages, "tool_calls", "array<struct<id:string,name:string,arguments:string>>")
        made = F.transform(calls, lambda c: F.struct(c["id"].alias("id"), F.lit("function").alias("type"), F.struct(c["name"].alias("name"), c["arguments"].alias("arguments")).alias("function")))
        parts.append(F.when((F.col("role") == "assistant") & (F.size(calls) > 0), F.to_json(F.struct(made.alias("tool_calls")))))
        own = _or_null(messages, "tool_call_id")
        parts.append(F.when(tool, F.coalesce(F.when(own.isNotNull(), F.to_json(F.struct(own.alias("tool_call_id")))), F.lit('{"tool_call_id":null}'))))
    # the members of the objects that are there, in one object
    members = F.array_compact(F.array(*parts, name))
    whole = F.concat(F.lit("{"), F.array_join(F.transform(members, lambda j: F.substring(j, F.lit(2), F.length(j) - 2)), ","), F.lit("}"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", whole.alias("j")))), lambda x: x["j"]), ",")
    return messages.groupBy("conv_id").agg(F.concat(F.lit("["), joined, F.lit("]")).alias("wire"))
