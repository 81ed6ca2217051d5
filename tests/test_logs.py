import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from millrace.functions import toolcalls
from millrace.operators import audit, embedding, history, search
from millrace.plans import registry
from millrace.sources import files
from millrace.streaming import rollups

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "text,name,repairs",
    [
        ('{"name": "weigh", "arguments": {"kg": 7}}', "weigh", []),
        ('Weighing now: ```json\n{"name": "weigh", "arguments": {"note": "}"}}', "weigh", ["fenced"]),
        ('{"function": {"name": "weigh", "arguments": "{\\"kg\\": 7}"}}', "weigh", ["nested_function_key", "args_double_encoded"]),
        ('{"action": "weigh", "kg": 7}', "weigh", ["name_key:action", "flattened_args"]),
        ("{'name': 'weigh', 'args': {'kg': None,", "weigh", ["python_literal_closed", "arg_key:args"]),
        ('{"name": "weigh", "arguments": "seven"}', "weigh", ["args_bare_string"]),
        ('{"name": "weigh", "arguments": [7]}', "weigh", ["args_not_object"]),
        ('{"name": "weigh", "arguments": {"kg": 7,},}', "weigh", ["trailing_comma"]),
        ('{"name": "weigh", "arguments": {"kg": 7, "unit":', "weigh", ["unclosed_braces"]),
    ],
)
def test_repairs(text, name, repairs):
    (call,) = toolcalls.parse(text)["calls"]
    assert (call["name"], call["repairs"]) == (name, repairs)


def test_parser_edges():
    assert toolcalls.parse(None)["calls"] == [] and toolcalls.parse(" \n")["text"] == " \n"
    assert toolcalls.parse('a package {"name": "scales", "private": true}', frozenset({"weigh"}))["calls"] == []
    two = toolcalls.parse('first [{"name": "weigh"}, {"name": "tare"}] last')
    assert [c["name"] for c in two["calls"]] == ["weigh", "tare"] and (two["prose_before"], two["prose_after"], two["text"]) == ("first", "last", "first  last")
    assert toolcalls.parse("{tool- what}")["problems"] == ["couldn't parse this as JSON: {tool- what}"]
    assert toolcalls.parse_native("{]") == [] and toolcalls.parse_native(None) == []
    assert toolcalls.without_fences("a ```json\n{}\n``` b ```\n[]") == ("a \n{}\n\n b \n\n[]", True)


def test_positional_argument(spark):
    catalog = spark.createDataFrame([("one", ["q"], "allow"), ("two", ["a", "b"], "ask")], "name string, required array<string>, default_policy string")
    calls = spark.createDataFrame([("one", '{"__positional__": "v"}'), ("two", '{"__positional__": "v"}'), ("zzz", "{}")], "name string, arguments string")
    got = {r.name: r for r in audit.resolve(calls, catalog).collect()}
    assert json.loads(got["one"].resolved) == {"q": "v"} and got["one"].error is None
    assert got["two"].error == "two got a bare string but takes 2 required arguments (a, b). Send an object."
    assert got["zzz"].error == "no tool named 'zzz'. Available: one, two"
    policy = spark.createDataFrame([("write_x", "allow"), ("read", "allow")], "n string, p string").select(audit.external_policy(F.col("n"), F.col("p")).alias("q"))
    assert [r.q for r in policy.collect()] == ["ask", "allow"]


def test_corpus_and_conversations(spark, tmp_path):
    (tmp_path / "c" / "in").mkdir(parents=True)
    (tmp_path / "c" / "a.txt").write_text("A")
    (tmp_path / "c" / "in" / "b c.txt").write_text("B\nb")
    (tmp_path / "c" / "overview-index.txt").write_text("no")
    assert sorted(map(tuple, files.read_corpus(spark, str(tmp_path / "c")).collect())) == [("a.txt", "A"), ("in/b c.txt", "B\nb")]
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "x.json").write_text(json.dumps([{"role": "user", "content": "q\n"}, {"role": "assistant", "content": "", "tool_calls": [{"id": "1", "name": "t", "arguments": "{}"}]}]))
    got = files.read_conversations(spark, str(tmp_path / "v"))
    again = files.messages_of(files.conversation_json(got))
    assert [r.asDict(True) for r in got.orderBy("turn").collect()] == [r.asDict(True) for r in again.orderBy("turn").collect()]


def test_index_appends_and_refuses(spark, tmp_path):
    chunks = spark.createDataFrame([Row(chunk_id="a#0", text="x"), Row(chunk_id="a#1", text="y")])
    vectors = spark.createDataFrame([Row(chunk_id="a#0", vector=[1.0]), Row(chunk_id="a#1", vector=[0.0])])
    path = str(tmp_path / "index")
    for reset, n in ((True, 2), (False, 4), (True, 2)):
        files.write_index(chunks, vectors, path, reset=reset)
        assert spark.read.parquet(path).count() == n
    with pytest.raises(ValueError):
        files.write_index(chunks, vectors.limit(1), path)


def test_embedding_cache(spark):
    texts = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "id long, text string")
    first = embedding.embed(texts, embedding.hashing_embedder(8), "m")
    assert first.count() == 3 and first.where("cached").count() == 0

    def broken(batch):
        raise AssertionError("all texts are cached")

    again = embedding.embed(texts, broken, "m", cache=first.select("key", "vector").dropDuplicates(["key"]))
    assert again.where("cached").count() == 3
    with pytest.raises(Exception, match="returned 0 vectors"):
        embedding.embed(texts, lambda b: [], "m").collect()


def test_approximate_recall(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = vectors.where("vec_id % 20 = 0").withColumn("query_id", F.col("vec_id"))
    exact = {(r.query_id, r.vec_id) for r in search.top_k(vectors, asked).collect()}
    near = {(r.query_id, r.vec_id) for r in registry.QUERIES["v4_approximate_top_k"](spark, SF).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_summaries_and_strategies(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "word " * 40) for t in range(8)]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")

    def marker(f):
        return history.summarize(m, 200, 1, f).where("pos = 0").first().text.split("\n\n", 1)[1]

    def fail(t):
        raise KeyError(t)

    assert marker(None).startswith("(no client") and marker(lambda t: " ") == "(summarizer returned nothing)"
    assert marker(fail) == "(summarization failed: KeyError; history was dropped)" and marker(lambda t: t[:6]) == "user:"
    both = {r.strategy: r for r in history.compare_strategies(m, 200, 1).collect()}
    assert both["truncate"].n_messages == both["summarize"].n_messages == 3 and both["truncate"].saved > 0


def test_chunk_size_sweep(spark):
    got = {r.variant: r for r in registry.QUERIES["r8_chunk_sizes"](spark, SF).collect()}
    assert set(got) == {"200", "300", "600", "1200", "2000"} and len({r.n for r in got.values()}) == 1
    assert all(0 <= r.mrr <= 1 for r in got.values()) and max(r.hit_3 for r in got.values()) > 0
    best = registry.QUERIES["r9_best_size"](spark, SF).first()
    assert best.hit_3 == max(r.hit_3 for r in got.values()) and best.hit_3_delta >= 0


def test_upserts_replace_and_merge(spark, tmp_path):
    path, keys = str(tmp_path / "up"), ["k"]
    write = rollups.upserting(path, keys, 2)
    frame = lambda rows: spark.createDataFrame(rows, "k string, n long")
    state = lambda: {r.k: r.n for r in rollups.latest(spark, path, keys).collect()}
    write(frame([("a", 1), ("b", 1)]), 0)
    write(frame([("a", 2)]), 1)  # and a base of both
    assert state() == {"a": 2, "b": 1}
    write(frame([("b", 5), ("c", 1)]), 2)
    write(frame([("b", 6), ("c", 1)]), 2)  # the batch is repeated
    assert state() == {"a": 2, "b": 6, "c": 1}
    write(frame([("c", 9)]), 3)
    assert state() == {"a": 2, "b": 6, "c": 9} and (tmp_path / "up" / "kind=base" / "number=3").exists()


def test_late_calls_are_dropped_and_sketches_merge(spark, tmp_path):
    line = lambda ts, ms: json.dumps({"ts": ts, "model": "m", "latency_ms": ms, "retries": 0})
    batches = [[line("2024-01-01T00:00:10Z", 1.0), line("2024-01-01T00:00:20Z", 3.0)], [line("2024-01-01T00:30:00Z", 5.0), line("2024-01-01T00:00:30Z", 2.0)], [line("2024-01-01T00:00:40Z", 99.0), line("2024-01-01T01:30:00Z", 7.0)]]
    for n, lines in enumerate(batches):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(lines))
        out = rollups.calls_per_minute(files.read_call_log(spark, str(tmp_path / "in"), stream=True))
        out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    minutes = spark.read.parquet(str(tmp_path / "out"))
    got = [(r.calls, r.avg_ms, r.p50_ms, r.p95_ms) for r in rollups.with_percentiles(minutes).orderBy("minute").collect()]
    assert got == [(3, 2.0, 2.0, 3.0), (1, 5.0, 5.0, 5.0)]  # 99 came behind the watermark, 7 is still open
    (hour,) = rollups.with_percentiles(rollups.coarser(minutes), (0.5,)).collect()
    assert (hour.calls, hour.avg_ms, hour.p50_ms) == (4, 2.75, 2.0)


def test_streams_equal_batches(spark, tmp_path):
    line = {"run_id": "r", "step": 1, "model_ms": 1.5, "prompt_tokens": 2, "completion_tokens": 1, "compacted": False, "repaired": True, "tools": [{"name": "t", "duration_ms": 2.0, "ok": True}]}
    (tmp_path / "t.jsonl").write_text("\n".join(json.dumps(x) for x in (line, line | {"step": 2}, {"run_id": "r", "kind": "summary"})))
    for name, f in (("runs", rollups.running_runs), ("tools", rollups.running_tools)):
        f(files.read_trace(spark, str(tmp_path), stream=True)).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
        assert spark.table(name).collect() == f(files.read_trace(spark, str(tmp_path))).collect()
    assert spark.table("runs").first().steps == 2
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text(json.dumps({"ts": "2024-01-01T00:00:00Z", "model": "m", "latency_ms": 1.0, "retries": 0}))
    assert files.read_call_log(spark, str(tmp_path / "log")).first().model == "m"


def test_percentiles_are_exact_over_many_latencies(spark):
    """A day of 20,000 different latencies, each twice, in four minutes, beside calls without one and a model without a name."""
    minute = F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 4 * 60)
    own = spark.range(20_000).select(minute.alias("minute"), F.lit(None).cast("string").alias("model"), (F.pmod(F.col("id") * 7919, F.lit(20_011)) / 8).alias("latency_ms"), F.lit(2).cast("long").alias("calls"), F.lit(1).cast("long").alias("errors"))
    untimed = spark.range(3).select(F.timestamp_seconds(F.lit(1704067200)).alias("minute"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("double").alias("latency_ms"), F.lit(50_000).cast("long").alias("calls"), F.lit(0).cast("long").alias("errors"))
    day = rollups.coarser(own.union(untimed), "day")
    values = sorted(i * 7919 % 20_011 / 8 for i in range(20_000))
    (got,) = rollups.with_percentiles(day, (0.5, 0.95, 0.999)).collect()
    assert (got.calls, got.errors, got.p50_ms, got.p95_ms) == (190_000, 20_000, values[9_999], values[18_999]) and got["p100_ms"] == values[19_979]
    none = rollups.with_percentiles(rollups.coarser(untimed, "day")).first()
    assert (none.calls, none.p50_ms, none.avg_ms) == (150_000, None, None)
