"""Exact token counts with a cache, and reports on the estimator. Samples: ``label, text, real``."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import quarter_tokens, token_estimate
from .caching import TableCache

_TOKEN = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9\x00-\x20]")


def word_tokens(text: str) -> int:
    """Runs of ASCII letters and digits, and every other visible character by itself."""
    return len(_TOKEN.findall(text))


def exact_counts(texts: DataFrame, counter: Callable[[str], int] | None = None, cache: DataFrame | TableCache | None = None, col: str = "text") -> DataFrame:
    """``texts`` with ``tokens`` and ``cached``; each different text that ``cache`` lacks is counted once.

    A ``TableCache`` (``tokens bigint``) keeps this run's counts; a DataFrame (``key, tokens``) is only read.  Without a
    counter the estimate stands in, and nothing is cached.
    """
    if counter is None:
        return texts.withColumns({"tokens": token_estimate(F.col(col)), "cached": F.lit(False)})

    @F.pandas_udf("long")
    def count(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else counter(v) for v in values], dtype="Int64")

    held = "_key"
    keyed = texts.withColumn(held, F.sha1(F.col(col).cast("binary")))
    new = keyed.where(F.col(held).isNotNull()).select(F.col(held).alias("key"), F.col(col).alias("_t"))
    if isinstance(cache, TableCache):
        own = uuid.uuid4().hex
        cache.add(cache.missing(new).select("key", count("_t").alias("tokens")), own)
        counts = cache.found(new).select("key", "tokens", (F.col("run") != own).alias("cached"))
    else:
        if cache is not None:
            new = new.join(cache.select("key"), "key", "left_anti")
        counts = new.dropDuplicates(["key"]).select("key", count("_t").alias("tokens"), F.lit(False).alias("cached"))
        if cache is not None:
            counts = counts.unionByName(cache.select("key", "tokens", F.lit(True).alias("cached")))
    return keyed.join(counts.withColumnRenamed("key", held), held, "left").drop(held)


def calibration(samples: DataFrame) -> DataFrame:
    """Per sample: characters, share of JSON punctuation, estimate by quarters and its error in percent, characters a token."""
    chars = F.length("text")
    punct = F.regexp_count("text", F.lit(r'[{}\[\]":,\\]')) / F.greatest(chars, F.lit(1))
    quarter = quarter_tokens(F.col("text"))
    return samples.select(
        "label", chars.alias("chars"), F.round(punct, 6).alias("punct"), quarter.alias("quarter"), "real",
        F.round(100.0 * (quarter - F.col("real")) / F.col("real"), 4).alias("error_pct"), F.round(chars / F.col("real"), 6).alias("chars_per_token"),
    )


def calibration_means(samples: DataFrame) -> DataFrame:
    """Mean characters a token of texts with under and over 5 % punctuation."""
    return calibration(samples).groupBy((F.col("punct") >= 0.05).alias("dense")).agg(F.count("*").alias("n"), F.round(F.avg("chars_per_token"), 4).alias("chars_per_token"))


def out_of_bounds(samples: DataFrame) -> DataFrame:
    """Samples whose estimate is under the real count or over twice it."""
    own = samples.withColumn("estimate", token_estimate(F.col("text")))
    return own.where((F.col("estimate") < F.col("real")) | (F.col("estimate") > 2 * F.col("real")))
