"""Approximate vector search: cells, residual product quantisation, exact ranking of a short list.

A unit vector is held as the cell of its nearest centre and, for each slice of its residual, the number of the nearest of 256 code
words: one byte a slice.  A query takes the cells with the nearest centres and adds up, from a table of its products with all code
words, an estimate of every cosine in them; only a short list is then compared exactly.  Centres, code words, the number of
cells to probe and the length of the short list are fitted on a bounded sample (``SAMPLE_ROWS``, ``SAMPLE_NUMBERS``), every row is indexed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_path
from . import search

#: The sample on which an index is fitted: so many rows, and so many numbers, at most.
SAMPLE_ROWS, SAMPLE_NUMBERS = 20_000, 4_000_000
#: Sample rows that serve as questions when probes and short list are chosen.
PROBE_QUESTIONS = 200
CODES = 256
#: Numbers of a vector that one code word stands for.
SLICE = 4
#: Share of the sample's true neighbours that the probed cells hold, and of those that the short list keeps.
COVER = 0.97


def lloyd(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """At most ``k`` centres of the rows; an empty centre moves to the row farthest from its own."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near, far = nearest(x, centres)
        sums = np.stack([np.bincount(near, column, len(centres)) for column in x.T], axis=1)
        n = np.bincount(near, minlength=len(centres))
        empty = np.flatnonzero(n == 0)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if len(empty):
            centres[empty] = x[np.argsort(-far, kind="stable")[: len(empty)]]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and its squared distance."""
    near, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    own = (centres**2).sum(axis=1)
    for i in range(0, len(x), 4096):
        part = x[i : i + 4096]
        d = own - 2 * part @ centres.T
        near[i : i + 4096] = d.argmin(axis=1)
        far[i : i + 4096] = d.min(axis=1) + (part**2).sum(axis=1)
    return near, far


@dataclass
class Model:
    """What a search needs besides the indexed rows; its size does not depend on their number beyond the number of cells."""

    centres: np.ndarray
    words: list[np.ndarray]
    probe: int
    short: float

    def cells(self, m: np.ndarray, probe: int) -> np.ndarray:
        """The ``probe`` cells of each row, nearest first."""
        d = (self.centres**2).sum(axis=1) - 2 * m @ self.centres.T
        return np.argsort(d, axis=1, kind="stable")[:, :probe]

    def codes(self, m: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest, out = m - self.centres[cell], np.zeros((len(m), len(self.words)), np.uint8)
        for i, words in enumerate(self.words):
            out[:, i] = nearest(rest[:, i * SLICE : (i + 1) * SLICE], words)[0]
        return out

    def table(self, q: np.ndarray) -> list[np.ndarray]:
        """For each slice the products of the queries with all code words."""
        return [q[:, i * SLICE : (i + 1) * SLICE] @ words.T for i, words in enumerate(self.words)]

    def estimates(self, tables: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
        return sum(t[:, codes[:, i]] for i, t in enumerate(tables))

    def saved(self) -> str:
        return json.dumps({"centres": self.centres.tolist(), "words": [w.tolist() for w in self.words], "probe": self.probe, "short": self.short})

    @staticmethod
    def read(text: str) -> Model:
        d = json.loads(text)
        return Model(np.array(d["centres"]), [np.array(w) for w in d["words"]], d["probe"], d["short"])


def fit(sample: np.ndarray, cells: int, k: int = 10, seed: int = 7) -> Model:
    """Centres, code words, probes and short list from unit rows.

    Questions are sample rows, each against all others: the probes are as few as leave ``COVER`` of the true ``k`` nearest
    in the probed cells, and the short list (in multiples of ``k``) is twice what ``COVER`` of those need.
    """
    model = Model(lloyd(sample, min(cells, len(sample)), seed=seed), [], 1, 4.0)
    cell = nearest(sample, model.centres)[0]
    rest = sample - model.centres[cell]
    model.words = [lloyd(rest[:, i : i + SLICE], min(CODES, len(sample)), seed=seed + i) for i in range(0, sample.shape[1], SLICE)]
    asked = np.random.default_rng(seed).permutation(len(sample))[:PROBE_QUESTIONS]
    k = min(k, len(sample) - 1)
    if k < 1:
        return model
    true = sample[asked] @ sample.T
    true[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-true, axis=1, kind="stable")[:, :k]
    order = np.argsort(model.cells(sample[asked], len(model.centres)), axis=1, kind="stable")  # each cell's place among a question's
    places = np.sort(np.take_along_axis(order, cell[best], axis=1).ravel())
    model.probe = int(places[int(np.ceil(COVER * len(places))) - 1]) + 1
    guess = sample[asked] @ model.centres.T
    guess = np.take_along_axis(guess, np.broadcast_to(cell, (len(asked), len(cell))), axis=1) + model.estimates(model.table(sample[asked]), model.codes(sample, cell))
    guess[order[:, cell] >= model.probe] = -np.inf
    guess[np.arange(len(asked)), asked] = -np.inf
    rank = np.argsort(np.argsort(-guess, axis=1, kind="stable"), axis=1, kind="stable")
    held = np.sort(np.take_along_axis(rank, best, axis=1)[np.take_along_axis(order, cell[best], axis=1) < model.probe])
    model.short = max(2.0, 2 * (int(held[int(np.ceil(COVER * len(held))) - 1]) + 1) / k)
    return model


def cell_count(rows: int) -> int:
    """A quarter of the root of the rows, between 16 and 4096."""
    return min(4096, max(16, int(rows**0.5 / 4)))


def _own(df: DataFrame, id_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")).dropna()


def build(vectors: DataFrame, path: str, cells: int | None = None, k: int = 10, seed: int = 7) -> Model | None:
    """Writes an index of ``vec_id, embedding`` below ``path``: ``rows`` by cell and ``model``.  None for an empty table.

    The sample are the rows of the lowest id hashes.
    """
    spark = vectors.sparkSession
    rows = _own(vectors, "vec_id")
    n, dims = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n:
        return None
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE_ROWS, max(1, SAMPLE_NUMBERS // dims))).select("embedding").toArrow()
    model = fit(search.unit(search.matrix(sample["embedding"])), cells or cell_count(n), k, seed)
    held = spark.sparkContext.broadcast(model)  # cells times dimensions, 4096 cells at most

    def encode(batches):
        for batch in batches:
            if batch.num_rows:
                m = search.unit(search.matrix(batch.column("embedding")))
                cell = nearest(m, held.value.centres)[0]
                codes = held.value.codes(m, cell)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("embedding"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(cell.astype(np.int32))], names=["id", "embedding", "code", "cell"])

    rows.mapInArrow(encode, "id long, embedding array<float>, code binary, cell int").write.partitionBy("cell").parquet(f"{path}/rows")
    spark.createDataFrame([(model.saved(),)], "model string").write.parquet(f"{path}/model")
    return model


def read_model(spark: SparkSession, path: str) -> Model:
    return Model.read(spark.read.parquet(f"{path}/model").first()["model"])


def candidates(spark: SparkSession, path: str, model: Model, queries: DataFrame, short: int, probe: int) -> DataFrame:
    """``q, id, score, cell, rank``: the ``short`` best estimates of each query over its ``probe`` cells; only codes are read."""
    held = spark.sparkContext.broadcast(model)

    def route(batches):
        for batch in batches:
            if batch.num_rows:
                m = search.unit(search.matrix(batch.column("embedding")))
                cell = held.value.cells(m, probe)
                at = pa.array(np.repeat(np.arange(len(m)), cell.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("embedding").take(at), pa.array(cell.ravel().astype(np.int32))], names=["q", "v", "g"])

    def score(key, asked: pa.Table, rows: pa.Table) -> pa.Table:
        model = held.value
        q, m = asked["q"].to_numpy(), search.unit(search.matrix(asked["v"]))
        ids = rows["id"].to_numpy()
        codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
        out = []
        for i in range(0, len(q), 64):
            part = m[i : i + 64]
            guess = model.estimates(model.table(part), codes) + (part @ model.centres[key[0].as_py()])[:, None]
            row, col = search.best_of(guess, ids, short)
            out.append(pa.table({"q": q[i + row], "id": ids[col], "score": guess[row, col], "cell": np.full(len(row), key[0].as_py(), np.int32)}))
        return pa.concat_tables(out)

    asked = _own(queries, "query_id").mapInArrow(route, "q long, v array<float>, g int").select("g", F.col("q").alias("key"), "q", "v")
    codes = spark.read.parquet(f"{path}/rows").select(F.col("cell").alias("g"), F.col("id").alias("key"), "id", "code")
    # a code of a slice stands for a number, a query for its products with all code words
    found = search.block_join(asked, codes, (F.size("v"), F.octet_length("code")), score, "q long, id long, score double, cell int")
    return search.best(found, short)


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 4, probe: int | None = None, short: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: exact cosines, rounded to 6 digits, of each query's short list."""
    model = read_model(spark, path)
    n_short = short or int(np.ceil(model.short * max(k, 10)))
    listed = candidates(spark, path, model, queries, n_short, probe or model.probe).select("q", "id", "cell")
    own = spark.read.parquet(f"{path}/rows").select("id", "cell", "embedding")
    pairs = listed.join(own, ["cell", "id"]).join(_own(queries, "query_id").select(F.col("id").alias("q"), F.col("embedding").alias("asked")), "q")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(dot("embedding", "embedding")) * F.sqrt(dot("asked", "asked"))
    scored = pairs.select("q", "id", F.round(F.when(size == 0, 0.0).otherwise(dot("embedding", "asked") / size), 6).alias("score"))
    return search.best(scored, k).select(F.col("q").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def approximate_top_k(vectors: DataFrame, queries: DataFrame, k: int = 4, cells: int | None = None, probe: int | None = None, short: int | None = None) -> DataFrame:
    """An index of ``vectors`` in the shared folder and the ``k`` best rows it gives each query."""
    spark = vectors.sparkSession
    path = shared_path(spark, "vectors")
    if build(vectors, path, cells, max(k, 10)) is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search_index(spark, path, queries, k, probe, short)
