"""Retrieval evaluation over ranked hits and relevance labels."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_path
from . import chunking, embedding, search
from .ranking import numbered

CUTOFFS = (1, 3, 5)


def _below(k: int):
    return lambda r: r < k


def per_query(queries: DataFrame, hits: DataFrame, totals: DataFrame) -> DataFrame:
    """``hits``: ``query_id, rank, id, score, relevant``; ``totals``: ``query_id, total_relevant``.

    Per query the 0-based ranks of relevant hits, top hit, first rank, and hit@k, P@k, R@k.
    """
    seen = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("relevant"), F.col("rank") - 1))).alias("ranks"), F.min_by("id", "rank").alias("top_source"), F.max("score").alias("top_score")
    )
    out = queries.join(seen, "query_id", "left").join(totals, "query_id", "left")
    out = out.withColumns({"ranks": F.coalesce("ranks", F.array().cast("array<int>")), "top_source": F.coalesce(F.col("top_source").cast("string"), F.lit("-")), "top_score": F.coalesce("top_score", F.lit(0.0)), "total_relevant": F.coalesce("total_relevant", F.lit(0)).cast("long")})
    found = {k: F.size(F.filter("ranks", _below(k))) for k in CUTOFFS}
    cols = {"first_rank": (F.array_min("ranks") + 1).cast("long")}
    for k in CUTOFFS:
        cols |= {f"hit_{k}": (found[k] > 0).cast("double"), f"p_{k}": found[k] / F.lit(float(k)), f"r_{k}": F.when(F.col("total_relevant") == 0, 0.0).otherwise(found[k] / F.col("total_relevant"))}
    return out.withColumns(cols)


def aggregate(results: DataFrame, group: str) -> DataFrame:
    """Macro means by ``group`` and for all (group ``all``); queries without a ranked hit add 0 to MRR."""
    means = [F.round(F.avg(f"{m}_{k}"), 6).alias(f"{m}_{k}") for k in CUTOFFS for m in ("hit", "p", "r")]
    rolled = results.rollup(group).agg(F.count("*").alias("n"), *means, F.round(F.sum(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))) / F.greatest(F.count("*"), F.lit(1)), 6).alias("mrr"), F.grouping(group).alias("g"))
    return rolled.withColumn(group, F.when(F.col("g") == 1, "all").otherwise(F.col(group).cast("string"))).drop("g")


def misses(results: DataFrame) -> DataFrame:
    """Queries with nothing relevant in the first five hits: what was wanted (``marker, sources``, where given), the top hit and its score."""
    wanted = [c for c in ("marker", "sources") if c in results.columns]
    return results.where("hit_5 = 0").select("query_id", "total_relevant", *wanted, "top_source", F.round("top_score", 6).alias("top_score"))


def per_query_table(results: DataFrame, question: str = "question") -> DataFrame:
    """``place, query_id, rank, total_relevant, question``: by first rank, queries without one last; long questions cut."""
    cut = F.when(F.length(question) > 52, F.concat(F.substring(question, 1, 49), F.lit("..."))).otherwise(F.col(question))
    ranked = numbered(results.select("query_id", "first_rank", "total_relevant", F.col(question).alias(question)), F.col("first_rank").asc_nulls_last(), "query_id")
    return ranked.select(F.col("place").cast("int").alias("place"), "query_id", F.coalesce(F.col("first_rank").cast("string"), F.lit("MISS")).alias("rank"), "total_relevant", cut.alias("question"))


def recall(exact: DataFrame, found: DataFrame, row: str = "vec_id") -> DataFrame:
    """``query_id, wanted, got, recall``: how many of a query's exact hits were found, and in total (``query_id`` null)."""
    hit = found.select("query_id", row).distinct().withColumn("_hit", F.lit(True))
    both = exact.select("query_id", row).distinct().join(hit, ["query_id", row], "left")
    share = F.round(F.count("_hit") / F.greatest(F.count("*"), F.lit(1)), 6)
    return both.rollup("query_id").agg(F.count("*").alias("wanted"), F.count("_hit").alias("got"), share.alias("recall"))


def relevant_chunks(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, chunk_id, source``: chunks of a wanted source that hold the query's marker, case aside.

    ``queries``: ``query_id, sources array<string>, marker``.  An equi-join by source with the marker test on top.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct("sources")).alias("source"), F.lower("marker").alias("_m"))
    return chunks.join(asked, "source").where(F.contains(F.lower("text"), F.col("_m"))).select("query_id", "chunk_id", "source")


def best_setting(metrics: DataFrame, configured: str, key: str = "variant", position: str = "position") -> DataFrame:
    """The variant best in (hit_3, mrr), the first on ties, with its lead over the configured one; ``metrics`` is read once."""
    row = F.struct(key, "hit_3", "mrr")
    both = metrics.agg(F.max_by(row, F.struct("hit_3", "mrr", -F.col(position))).alias("b"), F.max(F.when(F.col(key) == configured, row)).alias("o")).where("b is not null")
    return both.select(f"b.{key}", "b.hit_3", "b.mrr", F.round(F.col("b.hit_3") - F.col("o.hit_3"), 6).alias("hit_3_delta"), F.round(F.col("b.mrr") - F.col("o.mrr"), 6).alias("mrr_delta"))


def gold_violations(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, source, problem``: no gold chunk in a named source (``missing``), or in more than half of its chunks
    and more than one (``too_common``)."""
    asked = queries.select("query_id", F.explode(F.array_distinct("sources")).alias("source"))
    gold = relevant_chunks(chunks, queries).groupBy("query_id", "source").agg(F.count("*").alias("g"))
    sizes = chunks.groupBy("source").agg(F.count("*").alias("n"))
    joined = asked.join(gold, ["query_id", "source"], "left").join(sizes, "source", "left")
    g = F.coalesce("g", F.lit(0))
    problem = F.when(g == 0, "missing").when(g > F.greatest(F.lit(1), F.floor(F.col("n") / 2)), "too_common")
    return joined.select("query_id", "source", problem.alias("problem")).where("problem is not null")


def _vector_id(*parts):
    """A number for a chunk that any SQL can compute: the first 15 hexadecimal digits of an MD5."""
    return F.conv(F.left(F.md5(F.concat_ws(":", *parts)), F.lit(15)), 16, 10).cast("long")


@dataclass(frozen=True)
class Setting:
    """How documents are chunked and marked; ``key`` goes before a chunk's name in its number."""

    size: int
    overlap: int
    prefix: str
    key: str = ""


#: Characters of documents that are chunked at a time, and bytes of a side that may be broadcast.
TEXT_BLOCK, SMALL = 500_000, 8_000_000


def _cut(source: str | None, text: str | None, s: Setting):
    """(name, chunk, what is embedded) of each chunk of a document; the name is what ``_vector_id`` makes a number of."""
    for i, (title, _, own) in enumerate(chunking.titled(text or "", s.size, s.overlap)):
        if source is None:
            yield s.key, own, s.prefix
        else:
            name = f"{source}#{i}"
            yield f"{s.key}:{name}" if s.key else name, own, s.prefix + chunking.context(source, title, own)


def _sources(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("string").alias("source"), F.col("text").cast("string").alias("text"))


def packed_chunks(docs: DataFrame, settings: list[Setting], embedder) -> DataFrame:
    """Vectors of all chunks, a group ``g`` for each setting, as rows of ``search.PACKED``.

    Chunks are embedded where they are cut: a text is not sent anywhere.  Equal texts, which have the same document, are embedded once.
    """
    from hashlib import md5

    names = [f.split()[0] for f in search.PACKED.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary()]

    def pack(rows: list[tuple[str, str]]):
        places: dict[str, int] = {}
        groups = []
        for s in settings:
            ids, at = [], []
            for source, text in rows:
                for name, _, shown in _cut(source, text, s):
                    ids.append(int(md5(name.encode()).hexdigest()[:15], 16))
                    at.append(places.setdefault(shown, len(places)))
            groups.append((ids, at))
        vectors = embedding.vectors_of(list(places), embedder)
        for g, (ids, at) in enumerate(groups):
            for row in search.pack(g, np.array(ids, np.int64), vectors[at]) if at else ():
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=names)

    def run(batches):
        rows, chars = [], 0
        for batch in batches:
            for source, text in zip(batch.column("source"), batch.column("text"), strict=True):
                rows.append((source.as_py(), text.as_py()))
                chars += len(rows[-1][1] or "")
                if chars >= TEXT_BLOCK:
                    yield from pack(rows)
                    rows, chars = [], 0
        yield from pack(rows)

    return _sources(docs).mapInArrow(run, search.PACKED)


def _chunks_of_all(docs: DataFrame, settings: list[Setting]) -> DataFrame:
    """``g, source, name, text, shown``: the chunks at every setting, a document at a time."""
    types = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            for source, text in zip(batch.column("source").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows = [(g, source, *c) for g, s in enumerate(settings) for c in _cut(source, text, s)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["g", "source", "name", "text", "shown"])

    return _sources(docs).mapInArrow(run, "g int, source string, name string, text string, shown string")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ablate(docs: DataFrame, queries: DataFrame, embedder, cases: list[tuple[str, Setting, str]], depth: int) -> DataFrame:
    """Metrics of each case (name, how documents are chunked, the questions' prefix).

    Metrics ask only at which ranks relevant chunks are, so the chunks that beat one of them are counted (``search.ranks``) and not ranked.
    """
    n, settings = len(cases), list(dict.fromkeys(s for _, s, _ in cases))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(settings.index(s)).alias("g"), F.lit(p).alias("p")) for i, (_, s, p) in enumerate(cases)]))
    asked = queries.select("query_id", "question", each.alias("c")).select((F.col("query_id") * n + F.col("c.position")).alias("query_id"), "c.position", "c.g", F.concat("c.p", F.coalesce("question", F.lit(""))).alias("shown"))
    asked = _written(embedding.embed_rows(asked, embedder, "shown", "v").drop("shown"), "asked")
    wanted = queries.select("query_id", F.explode(F.array_distinct("sources")).alias("source"), F.lower("marker").alias("_m"))
    small = (wanted.agg(F.sum(F.octet_length("source") + F.octet_length("_m") + 32)).first()[0] or 0) <= SMALL
    near = F.broadcast(wanted) if small else wanted
    own = _written(docs.select("doc_id", "text").join(near.select(F.col("source").alias("_s")), F.col("doc_id").cast("string") == F.col("_s"), "left_semi"), "wanted")
    found = _chunks_of_all(own, settings).join(near, "source").where(F.contains(F.lower("text"), F.col("_m")))
    found = _written(found.select(F.col("query_id").alias("_q"), "g", _vector_id(F.col("name")).alias("id"), "shown"), "found")  # each stage runs one kind of Python worker
    gold = _written(embedding.embed_rows(found, embedder, "shown", "w").drop("shown"), "gold")
    pairs = asked.withColumn("_q", F.expr(f"(query_id - position) div {n}")).join(gold, ["_q", "g"]).select("query_id", "g", "id", "v", "w")
    scored = pairs.mapInArrow(_scored, "query_id long, g int, id long, score double, v array<float>")
    of = Window.partitionBy("query_id")
    first = scored.withColumns({"total_relevant": F.count("*").over(of), "_r": F.row_number().over(of.orderBy(F.desc("score"), "id"))}).where(F.col("_r") <= depth).drop("_r")
    items = _written(first.withColumn("item", F.monotonically_increasing_id()), "items")  # of a query's relevant chunks no more than ``depth`` can be among the first
    packed = _written(packed_chunks(docs, settings, embedder).withColumn("key", F.monotonically_increasing_id()), "chunks")
    hits = search.ranks(items, packed, depth).select("query_id", "rank", "id", "score", F.lit(True).alias("relevant"))
    totals = items.groupBy("query_id").agg(F.max("total_relevant").alias("total_relevant"))
    metrics = aggregate(per_query(asked.select("query_id", "position"), hits, totals), "position").where("position <> 'all'")
    position = F.col("position").cast("int")
    return metrics.withColumns({"variant": F.element_at(F.array(*[F.lit(name) for name, _, _ in cases]), position + 1), "position": position})


def _scored(batches):
    for b in batches:
        if len(b):
            score = search.cosines(search.matrix(b.column("v")), search.matrix(b.column("w")))
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("g"), b.column("id"), pa.array(score), b.column("v")], names=["query_id", "g", "id", "score", "v"])


def ablate_chunk_size(docs: DataFrame, queries: DataFrame, embedder, model: str, sizes: tuple[int, ...] = (200, 300, 600, 1200, 2000), depth: int = 10, prefixes: tuple[str, str] = ("search_document: ", "search_query: ")) -> DataFrame:
    """One row of metrics per chunk size (overlap a sixth of it): ``variant, position, n, hit_k, p_k, r_k, mrr``.

    ``docs``: ``doc_id, text``; ``queries``: ``query_id long, question, sources array<string>, marker``.  All sizes run in one job.
    """
    return _ablate(docs, queries, embedder, [(str(s), Setting(s, s // 6, prefixes[0], str(i)), prefixes[1]) for i, s in enumerate(sizes)], depth)


#: How documents and questions are marked for an embedder that tells them apart, and two ways not to.
PREFIXES = {"document and query": ("search_document: ", "search_query: "), "none": ("", ""), "document on both": ("search_document: ", "search_document: ")}


def ablate_prefixes(docs: DataFrame, queries: DataFrame, embedder, model: str, size: int = 600, overlap: int = 100, depth: int = 10, prefixes: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """One row of metrics per pair of prefixes, as ``ablate_chunk_size``; chunks that two of them mark alike are embedded once."""
    return _ablate(docs, queries, embedder, [(name, Setting(size, overlap, own), asked) for name, (own, asked) in (prefixes or PREFIXES).items()], depth)


def gold_violations_by_size(docs: DataFrame, queries: DataFrame, sizes: tuple[int, ...] = (200, 600, 2000)) -> DataFrame:
    """``size`` and the violations of ``gold_violations`` at each chunk size (overlap a sixth of it)."""
    return reduce(DataFrame.unionByName, [gold_violations(chunking.chunk(docs, s, s // 6), queries).withColumn("size", F.lit(s)) for s in sizes])
