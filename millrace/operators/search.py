"""Exact vector search: a grid of query blocks and vector blocks, the k best of each pair of blocks, then the k best overall."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_path

#: Numbers (rows times dimensions) of a block, on either side.
BLOCK_NUMBERS = 1_000_000
#: Queries that are multiplied at a time.
QUERY_BLOCK = 1024


def block_join(asked: DataFrame, rows: DataFrame, width: tuple, run: Callable, schema: str, numbers: tuple[int, int] | None = None) -> DataFrame:
    """``run(key, asked block, row block)`` for every pair of blocks of one group.

    ``asked`` and ``rows`` have ``g`` (never null), ``key`` (spreads a group's rows over its blocks) and what ``run`` takes;
    ``width`` gives the numbers that a row of each counts for, ``numbers`` those of a block of each (``BLOCK_NUMBERS``).  A group has as many blocks on a side as its numbers ask for, so
    a large group is split, each row of a side is sent once for each block of the other, and a task holds two blocks.
    """
    most = numbers or (BLOCK_NUMBERS, BLOCK_NUMBERS)
    count = lambda df, w, n, name: df.groupBy("g").agg(F.ceil(F.sum(w) / n).alias(name))
    shape = count(asked, width[0], most[0], "across").join(count(rows, width[1], most[1], "down"), "g")
    place = lambda n: F.pmod(F.xxhash64("key"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = asked.join(shape, "g").withColumn("across", place("across")).withColumn("down", every("down")).drop("key")
    right = rows.join(shape, "g").withColumn("down", place("down")).withColumn("across", every("across")).drop("key")
    at = ("g", "across", "down")
    return left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(run, schema)


def matrix(column) -> np.ndarray:
    """The rows of a list column, all of one length, as float64."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(flat):
        return np.zeros((0, 0))
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of scores the columns of its k best by (score descending, id), as row and column numbers."""
    if score.shape[1] > k:
        least = -np.partition(-score, k - 1, axis=1)[:, k - 1]
        row, col = np.nonzero(score >= least[:, None])  # ties with the k-th included
    else:
        row, col = np.nonzero(np.ones(score.shape, bool))
    order = np.lexsort((ids[col], -score[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def best(found: DataFrame, k: int, query: str = "q", row: str = "id") -> DataFrame:
    """The ``k`` best rows of each query with their rank; each task first cuts what it has to the ``k`` best."""
    w = Window.partitionBy(query).orderBy(F.desc("score"), row)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "query_id", group: str | None = None) -> DataFrame:
    """``query_id, rank (from 1), <id_col>, score`` by cosine, ties by id; ``group`` restricts a query to rows of its group.

    ``queries`` has ``query_id`` and ``vector_col`` (and ``group``).  Scores are rounded to 6 digits before ranking.  Rows
    without a vector are left out, and with ``group`` those without a group.  Neither side passes through the driver.
    """

    def own(df: DataFrame, key: str) -> DataFrame:
        g = F.col(group).cast("string") if group else F.lit("")
        return df.select(g.alias("g"), F.col(key).cast("long").alias("key"), F.col(key).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).dropna()

    def run(key, asked: pa.Table, rows: pa.Table) -> pa.Table:
        q, m = asked["id"].to_numpy(), unit(matrix(asked["v"]))
        ids, v = rows["id"].to_numpy(), unit(matrix(rows["v"]))
        out = []
        for i in range(0, len(q) if len(ids) else 0, QUERY_BLOCK):
            score = np.round(m[i : i + QUERY_BLOCK] @ v.T, 6)
            row, col = best_of(score, ids, k)
            out.append(pa.table({"q": q[i + row], "id": ids[col], "score": score[row, col]}))
        return pa.concat_tables(out) if out else pa.table({"q": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    found = block_join(own(queries, query_id), own(vectors, id_col), (F.size("v"), F.size("v")), run, "q long, id long, score double")
    return best(found, k).select(F.col("q").alias(query_id), "rank", F.col("id").alias(id_col), "score")


def unit(m: np.ndarray) -> np.ndarray:
    if m.size == 0:
        return m.reshape(len(m), -1)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


#: Numbers of a block of wanted rows and of packed vectors, and how many of either are multiplied at a time.
RANK_NUMBERS, RANK_ROWS = (2_000_000, 16_000_000), (256, 2048)
#: Packed vectors of one in so many rows are looked at first.
FIRST_LOOK = 16

PACKED = "g int, n int, width int, kind string, ids binary, vectors binary"


def pack(g: int, ids: np.ndarray, vectors: np.ndarray):
    """Rows of ``PACKED`` for vectors of one group: each in the narrowest kind of number that holds it without loss, compressed."""
    if not vectors.size:
        return
    most = np.where((vectors == np.rint(vectors)).all(axis=1), np.abs(vectors).max(axis=1), np.inf)
    low = -1.0
    for kind, high in (("int8", 127.0), ("int16", 32767.0), ("float32", np.inf)):
        own = ~(most <= low) & (most <= high) if np.isfinite(high) else ~(most <= low)
        low = high
        if own.any():
            yield g, int(own.sum()), vectors.shape[1], kind, ids[own].astype(np.int64).tobytes(), pa.compress(vectors[own].astype(kind).tobytes(), "zstd", asbytes=True)


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row by row, rounded to 6 digits, halves away from zero as SQL does; 0 for a zero vector."""
    q, v = q.astype(np.float64), v.astype(np.float64)
    a, b = np.sqrt((q * q).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
    x = (q * v).sum(axis=1) / np.where(a == 0, 1, a) / np.where(b == 0, 1, b) * 1e6
    whole = np.trunc(x)
    return np.where(np.abs(x - whole) == 0.5, whole + np.sign(x), np.rint(x)) / 1e6


def better_than(wanted: DataFrame, packed: DataFrame, k: int) -> DataFrame:
    """``item, better``: how many rows of its group beat an item (a query with one row that it wants) by (score descending, id).

    ``wanted``: ``item, g, query_id, id, score, v`` (the query's vector); ``packed``: rows of ``PACKED`` with a ``key``.  Exact below ``k``: an item that ``k``
    rows beat may be looked at no further and count too few, but no fewer than ``k``.  Items that nothing beats have no row.  Products
    are taken in single precision; only scores within its error of the item's are computed again by ``cosines``.
    """

    def run(key, asked: pa.Table, blocks: pa.Table) -> pa.Table:
        asked = asked.sort_by("query_id")
        item, own, score = asked["item"].to_numpy(), asked["id"].to_numpy(), asked["score"].to_numpy()
        _, head, of = np.unique(asked["query_id"].to_numpy(), return_index=True, return_inverse=True)  # a query's vector goes once
        q = matrix(asked["v"].take(pa.array(head))).astype(np.float32)
        u = unit(q.astype(np.float64)).astype(np.float32)
        error = 1e-6 + u.shape[1] * 2.0**-23
        low, high = (score - error).astype(np.float32), (score + error).astype(np.float32)
        better, live = np.zeros(len(item), np.int64), np.arange(len(item))
        first = True
        for block in zip(*(blocks[c] for c in ("n", "width", "kind", "vectors", "ids")), strict=True):
            n, width, kind, raw, ids = (x.as_py() for x in block)
            raw = pa.decompress(raw, n * width * np.dtype(kind).itemsize, "zstd", asbytes=True)
            v, ids = np.frombuffer(raw, kind).reshape(n, width).astype(np.float32), np.frombuffer(ids, np.int64)
            w = unit(v.astype(np.float64)).astype(np.float32)
            at = 0
            while at < n and len(live):  # few rows first: they settle most of the items that many beat
                end = min(n, at + (RANK_ROWS[1] // 8 if first else RANK_ROWS[1]))
                first = False
                queries, begin = np.unique(of[live], return_index=True)
                least, begin = np.minimum.reduceat(low[live], begin), np.append(begin, len(live))
                for i in range(0, len(queries), RANK_ROWS[0]):
                    part = queries[i : i + RANK_ROWS[0]]
                    found = u[part] @ w[at:end].T
                    near = found.max(axis=1) >= least[i : i + len(part)]
                    some = live[begin[i] : begin[i + len(part)]]
                    line = np.searchsorted(part, of[some])
                    some, line = some[near[line]], line[near[line]]
                    if not len(some):
                        continue
                    better[some] += np.count_nonzero(found[line] > high[some, None], axis=1)
                    some, line = some[better[some] < k], line[better[some] < k]
                    row, col = np.nonzero((found[line] >= low[some, None]) & (found[line] <= high[some, None]))
                    for j in range(0, len(row), 8_192):
                        a, b = some[row[j : j + 8_192]], at + col[j : j + 8_192]
                        exact = cosines(q[of[a]], v[b])
                        beats = (exact > score[a]) | ((exact == score[a]) & (ids[b] < own[a]))
                        better += np.bincount(a[beats], minlength=len(better))
                live, at = live[better[live] < k], end
            if not len(live):
                break
        hit = better > 0
        return pa.table({"item": item[hit], "better": better[hit]})

    asked = wanted.select("g", F.col("query_id").alias("key"), "item", "query_id", "id", "score", "v")
    found = block_join(asked, packed, (F.size("v"), F.col("n").cast("long") * F.col("width")), run, "item long, better long", RANK_NUMBERS)
    return found.groupBy("item").agg(F.sum("better").alias("better"))


def ranks(wanted: DataFrame, packed: DataFrame, k: int) -> DataFrame:
    """``wanted`` without ``v``, with ``rank`` (from 1) among all rows of its group, for the items that are among the first ``k``.

    A part of the rows settles the items that ``k`` of them beat; the others are then compared with all rows.
    """
    early = better_than(wanted, packed.where(F.pmod(F.xxhash64("key"), F.lit(FIRST_LOOK)) == 0), k).where(F.col("better") >= k)
    left = wanted.join(early.select("item"), "item", "left_anti")
    path = shared_path(wanted.sparkSession, "left")
    left.write.parquet(path)
    left = wanted.sparkSession.read.schema(left.schema).parquet(path)
    rank = F.coalesce("better", F.lit(0)) + 1
    return left.drop("v").join(better_than(left, packed, k), "item", "left").withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).drop("better")


def similarity(df: DataFrame, metric: str, col: str) -> DataFrame:
    """``score``: a cosine distance becomes 1 - d; a similarity stays."""
    if metric not in ("distance", "similarity"):
        raise ValueError("metric must be distance or similarity")
    return df.withColumn("score", 1.0 - F.col(col) if metric == "distance" else F.col(col))


def ranking_differences(a: DataFrame, b: DataFrame, id_col: str, tolerance: float = 1e-4) -> DataFrame:
    """Rows of two result sets that differ in id, or in score by more than the tolerance, at a rank of a query."""
    x, y = a.select("query_id", "rank", F.col(id_col).alias("id_a"), F.col("score").alias("score_a")), b.select("query_id", "rank", F.col(id_col).alias("id_b"), F.col("score").alias("score_b"))
    joined = x.join(y, ["query_id", "rank"], "full")
    return joined.where(~F.col("id_a").eqNullSafe(F.col("id_b")) | (F.abs(F.col("score_a") - F.col("score_b")) > tolerance))


def two_digits(score: Column) -> Column:
    """A number with two digits as C prints it: by the double's own value, a true half to even; Spark's ``printf`` rounds its shortest decimal form half up."""

    @F.pandas_udf("string")
    def shown(x: pd.Series) -> pd.Series:
        return x.map("{:.2f}".format)

    return shown(score)


def format_hits(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """``query_id, rendered``: hits (``query_id, rank, source, heading, score, text``) as text; a fixed line where none."""
    where = F.when(F.col("heading") != "", F.concat("source", F.lit(" > "), "heading")).otherwise(F.col("source"))
    line = F.concat(F.lit("["), "rank", F.lit("] "), where, F.lit("  (similarity "), two_digits(F.col("score")), F.lit(")\n"), "text")
    shown = hits.withColumn("line", line).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n\n").alias("rendered"))
    none = F.concat(F.lit("no passages found for '"), F.col("question"), F.lit("'"))
    return queries.join(shown, "query_id", "left").select("query_id", F.coalesce("rendered", none).alias("rendered"))


def index_stats(index: DataFrame, vector_col: str = "embedding") -> DataFrame:
    dims = F.coalesce(F.max(F.size(vector_col)), F.lit(0))
    return index.agg(F.count("*").alias("chunks"), dims.alias("dims"), F.round(F.count("*") * dims * 4 / 1024, 2).alias("kb"))
