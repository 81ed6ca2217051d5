"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter holds all languages: position p of the filter is a mask with bit l set
if an n-gram of language l hashes there, so the AND of an n-gram's positions returns every language
that (perhaps) contains it.  A mask has as many 64-bit words as the labels need; no label is left out.  A text's per-language popcounts are corrected by each language's
false-positive rate, taken from its fill, and the largest decides.

Learning: about ``MAX_DOCS_PER_LANG`` labelled documents per language at most (those whose hash is below that share
of the language's rows) outside the held-out fold; an n-gram belongs to a language if it is frequent enough there, for
the language's amount of text, and not much rarer than in the language where it is most frequent.

A null text or one without a letter is ``und`` with score 0.  Rows without a label teach nothing.
Without any labelled row every text is ``und``.  Long texts are read whole, in blocks of 2**18 characters
that are padded like texts of their own.  A tie goes to the first label, and so does a
text of which no language knows an n-gram, with score 0.  Repeated rows teach once and are each predicted.  Other columns
are not read, whatever their names.  An empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, id_bucket, small

NGRAM = 4
MAX_DOCS_PER_LANG = 3000
#: Least count of an n-gram in a language with much text; one with less than ``LITTLE`` n-grams needs one, with twice that two, and so on.
MIN_COUNT = 4
#: A highest rate is taken over so many n-grams at least, so that a chance n-gram of a little text is not taken from the others.
LITTLE = 20_000
#: An n-gram belongs to a language if its rate there is at least this share of its highest rate.
MIN_SHARE = 0.1
FILTER_BITS = 21
HASHES = 3
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def codes(text: str) -> np.ndarray:
    """64-bit codes of a text's character n-grams: lower case, runs of non-letters as one space, padded."""
    low = text.lower()
    points = np.frombuffer(low.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    ascii_letter = (points >= 97) & (points <= 122)
    letter = ascii_letter | (points >= 0xAA)
    letter &= points != 0xD7
    points = np.where(letter, points, np.uint64(32))
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = letter[1:] | letter[:-1]
    return _rolled(np.concatenate([[np.uint64(32)], points[keep], [np.uint64(32)]]))


def codes_of_grams(grams: list[str]) -> np.ndarray:
    """The codes of n-grams given as strings of ``NGRAM`` characters."""
    return np.concatenate([_rolled(np.array([ord(c) for c in g], np.uint64)) for g in grams])


def _rolled(points: np.ndarray) -> np.ndarray:
    if len(points) < NGRAM:
        return np.zeros(0, np.uint64)
    n = len(points) - NGRAM + 1
    out = np.zeros(n, np.uint64)
    for k in range(NGRAM):
        out = out * np.uint64(0x1F123BB5) + points[k : k + n]
    return out


def positions(code: np.ndarray) -> list[np.ndarray]:
    mixed = code ^ (code >> np.uint64(29))
    return [((mixed * m) >> np.uint64(64 - FILTER_BITS)).astype(np.int64) for m in _MULTIPLIERS[:HASHES]]


class Filter:
    """``masks``: language bits, a row for each word of 64 languages, by position; ``langs``: names by bit."""

    def __init__(self, masks: np.ndarray, langs: list[str]) -> None:
        self.masks, self.langs = masks, langs
        fill = np.array([((masks[i >> 6] >> np.uint64(i & 63)) & np.uint64(1)).mean() for i in range(len(langs))])
        self.false_rate = fill**HASHES

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0
        total, hits = 0, np.zeros(len(self.langs))
        for i in range(0, len(text), 1 << 18):
            code = codes(text[i : i + (1 << 18)])
            p = positions(code)
            total += len(code)
            for w, masks in enumerate(self.masks):
                found = masks[p[0]]
                for q in p[1:]:
                    found = found & masks[q]
                own = hits[64 * w : 64 * w + 64]
                own += [np.count_nonzero(found & np.uint64(1 << b)) for b in range(len(own))]
        rate = np.clip((hits / max(total, 1) - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, 1)
        best = int(np.argmax(rate))
        return self.langs[best], float(rate[best])


def fit(docs: DataFrame, held_out=None, max_docs: int = MAX_DOCS_PER_LANG) -> Filter:
    """Learn from labelled rows for which ``held_out`` (a condition) is false."""
    spark: SparkSession = docs.sparkSession
    known = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), (held_out if held_out is not None else F.lit(False)).alias("out"))
    known = known.where("lang is not null and text is not null and not out").drop("out")
    # a sample of each language in proportion to its rows: one count, then the lowest hashes, with nothing ranked
    counts = known.groupBy("lang").agg(F.count("*").alias("rows")).toArrow()  # a row for each label
    langs = sorted(counts["lang"].to_pylist())
    if not langs:
        return Filter(np.zeros((0, 1 << FILTER_BITS), np.uint64), [])
    words = (len(langs) + 63) // 64
    known = known.withColumn("hash", F.xxhash64("doc_id", "text"))
    share = F.least(F.lit(1.0), F.lit(float(max_docs)) / F.col("rows"))
    sampled = known.join(bounded(spark.createDataFrame(counts)), "lang").where(F.pmod("hash", F.lit(1 << 30)) < share * (1 << 30))
    picked = sampled.dropDuplicates(["lang", "hash"])
    index = {x: i for i, x in enumerate(langs)}

    def count(batches):
        for batch in small(batches):
            by: dict[int, list] = {}
            for t, x in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                by.setdefault(index[x], []).append(codes(t))
            for i, parts in by.items():
                c, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)), pa.array(np.full(len(c), i, np.int32)), pa.array(n)], names=["code", "lang", "n"])

    n_tasks = 2 * max(1, spark.sparkContext.defaultParallelism)
    grams = picked.select("text", "lang").repartition(n_tasks).mapInArrow(count, "code long, lang int, n long").groupBy("code", "lang").agg(F.sum("n").alias("n"))
    size = grams.groupBy("lang").agg(F.sum("n").alias("all"))
    least = F.least(F.lit(MIN_COUNT), F.expr(f"1 + all div {LITTLE}"))
    rated = grams.join(F.broadcast(size), "lang").where(F.col("n") >= least).withColumn("rate", F.col("n") / F.col("all"))
    top = rated.withColumn("top", F.max(F.col("n") / F.greatest("all", F.lit(LITTLE))).over(Window.partitionBy("code")))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.expr("lang % 64"))
    own = top.where(F.col("rate") >= MIN_SHARE * F.col("top")).groupBy("code", F.expr("lang div 64").cast("int").alias("word")).agg(F.sum(bit).alias("mask"))

    def spots(batches):
        for batch in batches:
            p = positions(batch.column("code").to_numpy().view(np.uint64))
            word, mask = (np.tile(batch.column(c).to_numpy(), HASHES) for c in ("word", "mask"))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)), pa.array(word), pa.array(mask)], names=["p", "word", "mask"])

    rows = own.mapInArrow(spots, "p long, word int, mask long").groupBy("p", "word").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most 2**FILTER_BITS rows for 64 labels
    masks = np.zeros((words, 1 << FILTER_BITS), np.uint64)
    masks[rows["word"].to_numpy(), rows["p"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
    return Filter(masks, langs)


def predict(docs: DataFrame, model: Filter, held_out) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document; one pass, no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for batch in small(batches):
            out = [m.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """Learn outside one fold of the ids, predict every document."""
    out = id_bucket("doc_id", folds) == fold
    return predict(docs, fit(docs, out), out)
