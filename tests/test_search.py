"""Exact search over a grid of blocks, and the vector index."""

import numpy as np
import pytest

from millrace.operators import chunking, embedding, evaluation, search, vector_index

ROWS = "vec_id long, embedding array<float>, g string"


def frame(spark, x, labels=None):
    return spark.createDataFrame([(i, v.tolist(), None if labels is None else labels[i]) for i, v in enumerate(x)], ROWS)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32))
    return centres[rng.integers(0, 40, 3000)] + 0.3 * rng.normal(size=(3000, 32))


def brute(x, asked, k, same=None):
    u = search.unit(x.astype(np.float32).astype(np.float64))
    out = {}
    for q in asked:
        score = np.round(u @ u[q], 6)
        own = [i for i in range(len(x)) if same is None or same[i] == same[q]]
        out[q] = sorted(own, key=lambda i: (-score[i], i))[:k]
    return out


@pytest.mark.parametrize("numbers", [1_000_000, 700])
def test_blocks_on_both_sides(spark, monkeypatch, numbers):
    """700 numbers a block: 7 blocks of queries against 18 of vectors, or as many as each group asks for."""
    monkeypatch.setattr(search, "BLOCK_NUMBERS", numbers)
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(400, 32)), 1)
    x[50:60] = x[0]  # ties
    labels = ["hot" if i % 3 else f"g{i % 5}" for i in range(400)]
    vectors = frame(spark, x, labels)
    asked = vectors.where("vec_id % 3 = 0 or vec_id < 20").withColumnRenamed("vec_id", "query_id")
    for group in (None, "g"):
        got = {}
        for r in search.top_k(vectors, asked, k=5, group=group).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == brute(x, got, 5, labels if group else None) and len(got) == 147


def test_index_scores_few_and_recalls_most(spark, tmp_path, clustered):
    vectors = frame(spark, clustered)
    asked = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    path = str(tmp_path / "index")
    model = vector_index.build(vectors, path, k=10)
    assert spark.read.parquet(f"{path}/rows").count() == len(clustered)
    again = vector_index.read_model(spark, path)
    assert np.allclose(again.centres, model.centres) and (again.probe, again.short) == (model.probe, model.short)
    found = vector_index.search_index(spark, path, asked, k=10)
    total = evaluation.recall(search.top_k(vectors, asked, k=10), found).where("query_id is null").first()
    assert total.wanted == 1500 and total.recall >= 0.9
    assert model.probe <= 0.1 * len(model.centres) + 1 and model.short * 10 <= 0.1 * len(clustered)
    exact = {(r.query_id, r.vec_id): r.score for r in search.top_k(vectors, asked, k=10).collect()}
    assert all(abs(exact[r.query_id, r.vec_id] - r.score) < 2e-6 for r in found.collect() if (r.query_id, r.vec_id) in exact)


def test_hot_cell_is_split(spark, monkeypatch, tmp_path):
    """Nearly all vectors are one; their codes still come in many blocks."""
    monkeypatch.setattr(search, "BLOCK_NUMBERS", 200)
    x = np.ones((600, 8))
    x[::50] = np.random.default_rng(1).normal(size=(12, 8))
    vectors = frame(spark, x)
    asked = vectors.where("vec_id in (0, 1)").withColumnRenamed("vec_id", "query_id")
    near = vector_index.approximate_top_k(vectors, asked, k=3).orderBy("query_id", "rank").collect()
    assert near[0].vec_id == 0 and [r.score for r in near if r.query_id == 1] == [1.0] * 3


def test_small_and_empty_indexes(spark):
    x = np.array([[1.0, 0, 0], [0, 1, 0], [0, 0, 0]])
    vectors = frame(spark, x)
    asked = vectors.withColumnRenamed("vec_id", "query_id")
    got = vector_index.approximate_top_k(vectors, asked, k=2).collect()
    assert {(r.query_id, r.vec_id) for r in got if r["rank"] == 1} >= {(0, 0), (1, 1)}
    assert vector_index.approximate_top_k(vectors.limit(0), asked).count() == 0
    none = spark.createDataFrame([(5, None, None)], ROWS)
    assert vector_index.approximate_top_k(vectors.union(none), asked, k=9).where("vec_id = 5").count() == 0


def test_recall_counts_per_query_and_in_total(spark):
    rows = lambda x: spark.createDataFrame(x, "query_id long, vec_id long")
    got = {r.query_id: (r.wanted, r.got, r.recall) for r in evaluation.recall(rows([(1, 1), (1, 2), (2, 3)]), rows([(1, 2), (2, 4)])).collect()}
    assert got == {1: (2, 1, 0.5), 2: (1, 0, 0.0), None: (3, 1, 0.333333)}


def test_similarities_are_rounded_by_their_own_value(spark):
    """0.985 lies below its two-digit half, 0.125 and 0.375 on theirs; Spark's printf puts up all of them."""
    hits = spark.createDataFrame([(1, i + 1, f"v{i}", "", s, "t") for i, s in enumerate([0.985, 0.375, 0.125, 0.005])], "query_id long, rank int, source string, heading string, score double, text string")
    asked = spark.createDataFrame([(1, "q"), (2, "w")], "query_id long, question string")
    got = {r.query_id: r.rendered for r in search.format_hits(asked, hits).collect()}
    assert got[1] == "\n\n".join(f"[{i + 1}] v{i}  (similarity {s})\nt" for i, s in enumerate(["0.98", "0.38", "0.12", "0.01"]))
    assert got[2] == "no passages found for 'w'"


@pytest.mark.parametrize("numbers", [(2_000_000, 16_000_000), (300, 900)])
def test_ranks_are_counted_exactly(spark, monkeypatch, numbers):
    """Counted ranks equal those of a full ranking: ties, copies, zero vectors, counts that need one, two or four bytes, many and few blocks."""
    monkeypatch.setattr(search, "RANK_NUMBERS", numbers)
    monkeypatch.setattr(search, "RANK_ROWS", (7, 32))
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, size=(700, 6)).astype(np.float32)  # many equal cosines
    x[40:60], x[60:70], x[70:75] = x[1], 0, x[2] * 100_000.5
    x[75:80] = x[3] * 1000
    group, ids = np.arange(700) % 2, rng.permutation(700) + 10**12
    packs = [(*row, key) for key, (a, g) in enumerate((a, g) for a in range(0, 700, 70) for g in (0, 1)) for own in [np.arange(a, a + 70)[group[a : a + 70] == g]] for row in search.pack(g, ids[own], x[own])]
    assert {row[3] for row in packs} == {"int8", "int16", "float32"}
    packed = spark.createDataFrame(packs, search.PACKED + ", key long")
    q = np.concatenate([x[:20] + rng.integers(-1, 2, size=(20, 6)), np.zeros((1, 6)), x[1:2]]).astype(np.float32)
    items, want = [], {}
    for i in range(len(q)):
        g = i % 2
        own = np.flatnonzero(group == g)
        score = search.cosines(np.repeat(q[i : i + 1], len(own), axis=0), x[own])
        order = sorted(range(len(own)), key=lambda j: (-score[j], ids[own[j]]))
        for place in (0, 3, 9, 10, 40, 200):
            j = order[place]
            items.append((len(items), g, i, int(ids[own[j]]), float(score[j]), q[i].tolist()))
            if place < 10:
                want[items[-1][0]] = place + 1
    wanted = spark.createDataFrame(items, "item long, g int, query_id long, id long, score double, v array<float>")
    assert {r.item: r["rank"] for r in search.ranks(wanted, packed, 10).collect()} == want
    assert np.array_equal(search.cosines(np.array([[1.0, 0]]), np.array([[1.0, 0]])), [1.0]) and search.cosines(np.eye(64)[:1] * 1.0, np.r_[1, np.ones(16383)][None, :64])[0] == 0.125


def test_prefixes_embed_like_chunks_once(spark):
    """Two of the three cases mark documents alike; the planted questions are their documents' first words."""
    seen = spark.sparkContext.accumulator(0)
    inner = embedding.counting_embedder(64)

    def embedder(texts):
        seen.add(len(texts))
        return inner(texts)

    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 4000, 600)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame([(i, texts[i][:200], [str(i)], texts[i][150:180].upper()) for i in (0, 20)], "query_id long, question string, sources array<string>, marker string")
    chunks = chunking.chunk(docs).count()
    got = {r.variant: r for r in evaluation.ablate_prefixes(docs, asked, embedder, "m").collect()}
    assert set(got) == set(evaluation.PREFIXES) and all((r.n, r.hit_1, r.r_1, r.mrr) == (2, 1.0, 1.0, 1.0) for r in got.values())
    assert 2 * chunks <= seen.value < 2.5 * chunks


def test_best_setting_reads_metrics_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    schema = "variant string, position int, hit_3 double, mrr double"
    rows = spark.createDataFrame([("200", 0, 0.4, 0.3), ("300", 1, 0.5, 0.2), ("600", 2, 0.5, 0.25), ("1200", 3, 0.5, 0.25)], schema).mapInArrow(counted, schema)
    assert [tuple(r) for r in evaluation.best_setting(rows, "200").collect()] == [("600", 0.5, 0.25, 0.1, -0.05)]
    assert seen.value == 4
    assert [tuple(r) for r in evaluation.best_setting(rows, "none").collect()] == [("600", 0.5, 0.25, None, None)]
    assert evaluation.best_setting(rows.limit(0), "200").count() == 0
