"""Substring dedup against brute force over all windows."""

import hashlib
import random

import pytest

from millrace.llm import substring_dedup

WINDOW = substring_dedup.WINDOW


def brute_force(rows, window=WINDOW):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            own = tuple(w[i : i + window])
            first[own] = min(first.get(own, d), d)
    out = []
    for d, w in words:
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def digest(spark, rows, crowd=substring_dedup.CROWD):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    done = substring_dedup.without_repeats(docs, WINDOW, crowd)
    return sorted(tuple(r) for r in done.selectExpr("did", "n_words", "aggregate(spans, 0L, (s, x) -> s + x.hi - x.lo)", "sha2(kept, 256)").collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    passages = [some(60), some(50), some(49)]
    passages.append(passages[0] + passages[1])
    out = []
    for d in range(60):
        t = some(rng.randint(0, 80))
        for p in rng.sample(passages, rng.randint(0, 3)):
            t += p + some(rng.randint(0, 30))
        out.append((d, " ".join(t)))
    out += [(d + 100, t) for d, t in out[::3]]  # exact copies
    out += [(5, out[7][1]), (5, out[7][1])]  # one id, repeated rows
    out += [(200, "na " * 300), (201, "na " * 70), (202, None), (203, ""), (204, " ".join(some(40_000)))]
    return [*out, (205, out[-1][1][1000:] + " x\n" + out[0][1])]


@pytest.mark.parametrize("crowd", [substring_dedup.CROWD, 1])
def test_against_brute_force(spark, rows, crowd):
    assert digest(spark, rows, crowd) == brute_force(rows)


def test_passages_across_factor_boundaries():
    """Two earlier holders of overlapping halves: the second factor begins before the first one ends."""
    w = [f"x{i}" for i in range(90)]
    blocks = [(1, " ".join(w[:60]).encode()), (2, " ".join(w[25:]).encode()), (3, " ".join(w).encode())]
    assert substring_dedup.factors(blocks) == [[], [], [(0, 60), (25, 90)]]
    assert substring_dedup.factors([(1, blocks[2][1]), (1, blocks[2][1])]) == [[], []]


def test_null_ids_clashing_columns_and_empty_table(spark):
    text = " ".join(f"v{i}" for i in range(55))
    docs = spark.createDataFrame([(None, text, "a", 1), (3, text, "b", 2), (None, text + " more", "c", 3)], "doc_id long, text string, spans string, n long")
    got = {(r.doc_id, r.n_words): r.n_removed for r in substring_dedup.removal_digest(docs).collect()}
    assert got == {(None, 55): 0, (3, 55): 55, (None, 56): 0}
    assert substring_dedup.removal_digest(docs.limit(0)).count() == 0
