"""The cache table: what a second run still makes, what is shuffled, and what a failed run leaves."""

import hashlib

import numpy as np
import pytest

from millrace.operators import embedding, tokens
from millrace.operators.caching import TableCache


@pytest.fixture
def texts(spark):
    return spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "c"), (5, "A b")], "id long, text string")


@pytest.fixture
def refuse():
    def own(batch):
        raise AssertionError(f"{len(batch)} texts are embedded again")

    return own


def test_second_run_embeds_nothing(spark, tmp_path, texts, refuse):
    cache = TableCache(spark, str(tmp_path / "c"), "vector ARRAY<FLOAT>", 4)
    first = embedding.embed(texts, embedding.counting_embedder(8), "m", cache=cache).collect()
    assert len(first) == 5 and not any(r.cached for r in first) and cache.frame().count() == 4
    again = embedding.embed(texts, refuse, "m", cache=cache).collect()
    assert all(r.cached for r in again) and {r.id: r.vector for r in again} == {r.id: r.vector for r in first}
    more = embedding.embed(texts.union(spark.createDataFrame([(6, "new"), (7, "new")], texts.schema)), embedding.counting_embedder(8), "m", cache=cache)
    assert {r.id: r.cached for r in more.collect()} == {1: True, 2: True, 3: True, 4: True, 5: True, 6: False, 7: False}
    # a folder that exists is opened again, under whatever name
    assert TableCache(spark, str(tmp_path / "c"), "vector ARRAY<FLOAT>", 4).frame().count() == 5


def test_failed_run_leaves_the_cache(spark, tmp_path, texts, refuse):
    cache = TableCache(spark, str(tmp_path / "c"), "vector ARRAY<FLOAT>", 4)
    with pytest.raises(Exception, match="embedded again"):
        embedding.embed(texts, refuse, "m", cache=cache)
    assert cache.frame().count() == 0
    assert embedding.embed(texts, lambda b: np.ones((len(b), 2)), "m", cache=cache).count() == 5


def above(lines, at):
    """The operators between a line of a plan and the join over it."""
    depth = len(lines[at]) - len(lines[at].lstrip(" :+-"))
    for line in reversed(lines[:at]):
        own = len(line) - len(line.lstrip(" :+-"))
        if own < depth:
            depth = own
            if "Join" in line:
                return
            yield line.strip(" :+-")


def test_cache_is_not_shuffled(spark, tmp_path, texts):
    cache = TableCache(spark, str(tmp_path / "c"), "tokens BIGINT", 4)
    tokens.exact_counts(texts, tokens.word_tokens, cache)
    keyed = texts.selectExpr("sha1(cast(text as binary)) AS key")
    for frame in (cache.missing(keyed), cache.found(keyed)):
        lines = frame._jdf.queryExecution().executedPlan().toString().split("\n")
        scan = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
        assert not [x for x in above(lines, scan) if "Exchange" in x], "\n".join(lines)


def test_counts_are_cached(spark, tmp_path, texts, refuse):
    cache = TableCache(spark, str(tmp_path / "c"), "tokens BIGINT", 4)
    got = {r.id: (r.tokens, r.cached) for r in tokens.exact_counts(texts, tokens.word_tokens, cache).collect()}
    assert got == {1: (2, False), 2: (2, False), 3: (None, None), 4: (1, False), 5: (2, False)}
    again = {r.id: (r.tokens, r.cached) for r in tokens.exact_counts(texts, refuse, cache).collect()}
    assert again == {1: (2, True), 2: (2, True), 3: (None, None), 4: (1, True), 5: (2, True)}
    assert tokens.exact_counts(texts, tokens.word_tokens, cache.frame().select("key", "tokens")).where("cached").count() == 4
    assert [tokens.word_tokens(t) for t in ("", "a1 b-c", "é é\n%")] == [0, 4, 3]


def test_words_are_counted_as_bytes_split_them():
    texts = ["", "  a  B\tc\x0bd\x0ce\r\n f ", "ÄÖ É x \x1cq\x1fz", "\x85a b", "One oNe one", "a" * 100]
    out = np.zeros((len(texts), 16))
    for row, text in zip(out, texts, strict=True):
        for word in text.encode().lower().split():
            digits = hashlib.md5(word).hexdigest()
            row[int(digits[:7], 16) % 16] += 1 if digits[7] < "8" else -1
    embedder = embedding.counting_embedder(16)
    assert np.array_equal(embedder(texts), out) and np.array_equal(embedder(texts[::-1]), out[::-1]) and embedder([]).shape == (0, 16)
