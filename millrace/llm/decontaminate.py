"""Benchmark decontamination: prefix-filtered set join, DataFrame functions only.

Windows are runs of item words.  A window's words are ordered by rarity over all documents; since
containment must be complete, its prefix is its rarest word.  Only document words equal to a prefix
word are joined; the word's place in the window gives the start (positional bound), which must leave
room for the whole window (length bound).  The words of each candidate place are then cut out and joined
with the windows, which is the exact verification.

Whole texts are read however long they are; columns other than id and text are not touched.  Null and empty texts have no words; an item without words has no window; an item with a null id
marks words but is not listed.  Repeated items count once per id; repeated document rows are each
reported.  Empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, doc_id_of, keyed, materialize, with_keys

WINDOW = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything that is neither a digit, an ASCII letter nor beyond ASCII.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def raw_words(text):
    """Words in their own case, in order; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BREAK), lambda w: w != "")


def words(text):
    return raw_words(F.translate(text, UPPER, LOWER))


def item_windows(bench: DataFrame, window: int) -> DataFrame:
    """``item_id, win (words joined by a space), len``."""
    items = bench.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text").cast("string")).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n") - (window - 1)))
    wins = F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.least(F.lit(window), F.col("n"))), " "))
    return items.select("item_id", F.explode(F.array_distinct(wins)).alias("win"), F.least(F.lit(window), F.col("n")).alias("len"))


def contaminated_spans(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """``did, rid, start, len, win`` of every verified window (0-based word starts), and the items' windows."""
    rows = keyed(docs)
    wins = materialize(item_windows(bench, window), "windows")
    each = wins.select("win", "len").distinct()
    parts = each.select("win", "len", F.posexplode(F.split("win", " ")).alias("pos", "word")).withColumn("low", F.lower("word"))
    vocabulary = bounded(parts.select("low").distinct())
    # lower() of single words may only join more words than A-Z would; the verification is exact
    texts = rows.select("did", "rid", raw_words(F.col("text")).alias("w"))
    seen = texts.select(F.explode("w").alias("word")).select(F.lower("word").alias("low")).join(vocabulary, "low").groupBy("low").agg(F.count("*").alias("df"))
    ranked = parts.join(seen, "low", "left").groupBy("win", "len").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "low", "pos")).alias("p"))
    # windows with the same prefix word at the same place are one candidate
    prefix = materialize(ranked.where("p.df > 0").select("len", "p.low", "p.pos").distinct(), "prefixes")
    # the count is taken below the generator, else every word's row would carry the whole array
    placed = texts.withColumn("n", F.size("w")).select("did", "rid", "n", F.posexplode("w").alias("at", "word")).select("did", "rid", "n", "at", F.lower("word").alias("low"))
    fits = placed.join(bounded(prefix), "low").withColumn("start", F.col("at") - F.col("pos")).where("start >= 0 and start + len <= n")
    found = materialize(fits.groupBy("did", "rid").agg(F.collect_set(F.struct("start", "len")).alias("found")), "candidates")
    back = rows.join(bounded(found), ["did", "rid"])
    # the words are bound to a variable, so they are split once a document and not once a candidate
    own = F.transform(F.array(words(F.col("text"))), lambda w: F.transform("found", lambda c: F.struct(c["start"].alias("start"), c["len"].alias("len"), F.array_join(F.slice(w, c["start"] + 1, c["len"]), " ").alias("win"))))[0]
    cut = back.select("did", "rid", F.explode(own).alias("c")).select("did", "rid", "c.start", "c.len", "c.win")
    return materialize(cut.join(bounded(each), ["win", "len"]).select("did", "rid", "start", "len", "win").distinct(), "hits"), wins


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every document."""
    hits, wins = contaminated_spans(docs, bench, window)
    spans = hits.groupBy("did", "rid").agg(F.collect_set(F.struct("start", "len")).alias("spans"))
    counted = spans.select("did", "rid", F.size(F.array_distinct(F.flatten(F.transform("spans", lambda h: F.sequence(h["start"], h["start"] + h["len"] - 1))))).alias("n_hit"))
    which = hits.select("did", "rid", "win").distinct().join(bounded(wins.where("item_id is not null").select("win", "item_id")), "win")
    listed = which.groupBy("did", "rid").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    found = materialize(counted.join(listed, ["did", "rid"], "left"), "found")
    every = keyed(docs).select("did", "rid", F.size(raw_words(F.col("text"))).alias("n"))
    joined = every.join(bounded(found), ["did", "rid"], "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        doc_id_of(), F.col("n").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without any benchmark window, columns unchanged."""
    hits, _ = contaminated_spans(docs, bench, window)
    own, d, r = with_keys(docs)
    gone = bounded(hits.select(F.col("did").alias(d), F.col("rid").alias(r)).distinct())
    return own.join(gone, [d, r], "left_anti").select(*docs.columns)
