import json
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import Row

from millrace.operators import chunking, history, search, textsearch
from millrace.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "conversations", "events")


def cell(x):
    return None if x is None or (isinstance(x, float) and math.isnan(x)) else x


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, name):
    got = registry.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(registry.ORACLE[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    order = [want.columns.index(c) for c in cols]
    a = sorted(repr([cell(r[c]) for c in cols]) for r in got.collect())
    b = sorted(repr([cell(r[i]) for i in order]) for r in want.fetchall())
    assert a == b


def test_chunks_cover_and_sizes_are_checked():
    text = "word " * 500
    parts = list(chunking.spans(text, 600, 100))
    assert parts[0][0] == 0 and all(len(c) <= 600 for _, c in parts)
    assert list(chunking.spans("  \n ", 600, 100)) == [] and list(chunking.spans("short", 600, 100)) == [(0, "short")]
    for size, overlap in ((0, 0), (10, 10)):
        with pytest.raises(ValueError):
            chunking.check_sizes(size, overlap)


def test_chunks_by_hand():
    text = "Alpha beta. Gamma delta, epsilon zeta\n\nEta theta iota kappa"
    # the first window's last third has a comma, the second's has only spaces (its blank line lies before)
    assert chunking.spans(text, 30, 5)[:2] == [(0, "Alpha beta. Gamma delta,"), (20, "lta, epsilon zeta\n\nEta theta")]
    assert chunking.spans("x" * 25, 10, 2) == [(0, "x" * 10), (8, "x" * 10), (16, "x" * 9)]


@pytest.mark.parametrize("size", [40, 90, 300])
def test_chunks_against_the_rule(size):
    rng = random.Random(size)
    text = "".join(rng.choice(["word", "a", " ", " ", ". ", ", ", "\n", "\n\n"]) for _ in range(900))
    parts, body, overlap = chunking.spans(text, size, size // 6), text.strip(), size // 6
    begin, want = 0, []
    while begin < len(body):
        end = min(begin + size, len(body))
        if end < len(body):
            tail = body[begin + 2 * size // 3 : end]
            sep = next((s for s in chunking.SEPARATORS if s in tail), None)
            end = end if sep is None else begin + 2 * size // 3 + tail.rindex(sep) + len(sep)
        if body[begin:end].strip():
            want.append((begin, body[begin:end].strip()))
        begin = len(body) if end == len(body) else max(begin + 1, end - overlap)
    assert parts == want


@pytest.mark.parametrize("pattern, refused", [("(a+)+$", True), ("(a{1,9})+", True), ("(a+) +", True), ("((ab)*c)*", True), ("(?:x*)*", True), (r"\(a+\)+", False), ("[(a+)]+", False), ("(ab)+c*", False), ("a+b*", False), ("(a+)(b+)", False)])
def test_repeats_of_repeats(pattern, refused):
    assert textsearch.repeats_a_repeat(pattern) == refused


def test_grep_report(spark):
    files = [("b.txt", "x\nhit 1"), ("a/c.txt", "hit 2"), ("dist/d.txt", "hit"), (".env", "hit"), ("k.pem", "hit"), ("e.md", "hit"), ("n.txt", None)]
    rows = spark.createDataFrame(files, "source string, text string")
    assert [r.line for r in textsearch.grep_report(rows, "hit", "*.txt").orderBy("n").collect()] == ["a/c.txt:1: hit 2", "b.txt:2: hit 1"]
    assert [r.line for r in textsearch.grep_report(rows, "hit", "*.txt", 1).orderBy("n").collect()] == ["a/c.txt:1: hit 2", "... stopped at 1 results"]
    assert [r.line for r in textsearch.grep_report(rows, "zzz").collect()] == ["no matches for 'zzz' in 3 files"]


def test_report_of_a_dear_marker(spark):
    """Messages are dropped although the marker costs what they did."""
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b" * 30), (1, 2, "user", "c" * 400)]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (got,) = history.compaction_report(m, 100, 1).collect()
    assert got.triggered and got.fired and got.dropped_messages == got.dropped_turns == 2 and got.still_over


def test_wire_shapes(spark):
    schema = "conv_id long, turn long, role string, text string, name string, tool_call_id string, tool_calls array<struct<id:string,name:string,arguments:string>>"
    rows = [(1, 0, "assistant", "look", None, None, [("i", "t", '{"a": 1}')]), (1, 1, "tool", "r", "t", "i", None), (1, 2, "user", "q", "n", None, None), (1, 3, "tool", "s", None, None, None)]
    m = spark.createDataFrame(rows, schema)
    local, hosted = (json.loads(history.to_wire(m, h).first().wire) for h in (False, True))
    assert local == [{"role": "assistant", "content": "look"}, {"role": "tool", "content": "r", "name": "t"}, {"role": "user", "content": "q"}, {"role": "tool", "content": "s"}]
    call = {"id": "i", "type": "function", "function": {"name": "t", "arguments": '{"a": 1}'}}
    assert hosted[0] == {"role": "assistant", "content": "look", "tool_calls": [call]} and hosted[1] == {"role": "tool", "content": "r", "name": "t", "tool_call_id": "i"}
    assert hosted[3]["tool_call_id"] is None and hosted[2] == {"role": "user", "content": "q"}


def test_null_vectors_and_groups(spark):
    v = spark.createDataFrame([Row(vec_id=1, embedding=[1.0, 0.0], g="a"), Row(vec_id=2, embedding=None, g="a"), Row(vec_id=3, embedding=[0.0, 1.0], g=None)], "vec_id long, embedding array<float>, g string")
    q = v.withColumnRenamed("vec_id", "query_id")
    assert {(r.query_id, r.vec_id) for r in search.top_k(v, q).collect()} == {(1, 1), (1, 3), (3, 1), (3, 3)}
    assert [(r.query_id, r.vec_id) for r in search.top_k(v, q, group="g").collect()] == [(1, 1)]


def test_best_of_keeps_ties_in_order():
    rng = np.random.default_rng(1)
    score, ids = np.round(rng.random((5, 40)), 1), rng.permutation(40)
    row, col = search.best_of(score, ids, 7)
    for r in range(5):
        assert [ids[c] for c in col[row == r]] == [ids[c] for c in sorted(range(40), key=lambda c: (-score[r, c], ids[c]))[:7]]


def test_top_k_clamps_and_empty(spark):
    v = spark.createDataFrame([Row(vec_id=1, embedding=[1.0, 0.0]), Row(vec_id=2, embedding=[0.0, 0.0])])
    q = spark.createDataFrame([Row(query_id=9, embedding=[2.0, 0.0])])
    assert [(r.vec_id, r.score) for r in search.top_k(v, q, k=5).orderBy("rank").collect()] == [(1, 1.0), (2, 0.0)]
    assert search.top_k(v.limit(0), q).count() == 0


def test_turns_start_before_first_user(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "assistant", "a"), (1, 2, "user", "u"), (1, 3, "assistant", "b"), (1, 4, "user", "v")]
    got = history.with_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("turn").collect()
    assert [r.turn_no for r in got] == [0, 1, 1, 2]


def test_grep_refuses_nested_quantifiers(spark):
    with pytest.raises(ValueError):
        textsearch.grep(spark.createDataFrame([(1, "x")], "doc_id long, text string"), "(a+)+$")
