"""Queries of the retrieval, conversation and telemetry operators over the given tables, with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import cache_key, l2_normalise, quarter_tokens, token_estimate
from ..operators import chunking, evaluation, history, search, telemetry, textsearch

BUDGET, KEEP = 700, 1
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _queries_of(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id % 20 = 0").withColumn("query_id", F.col("vec_id"))


_RANKED = """
WITH q AS (SELECT vec_id AS query_id, embedding AS v, label FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT q.query_id, e.vec_id, q.label AS ql, e.label AS el, round(list_dot_product(q.v::DOUBLE[], e.embedding::DOUBLE[]) / sqrt(list_dot_product(q.v::DOUBLE[], q.v::DOUBLE[])) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 6) AS score FROM q, embeddings e {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
"""


@query(_RANKED.format(where="") + "SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 4")
def v1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search.top_k(vectors, _queries_of(vectors))


@query(_RANKED.format(where="WHERE q.label = e.label") + "SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 4")
def v2_scoped_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search.top_k(vectors, _queries_of(vectors), group="label")


@query(_RANKED.format(where="") + "SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(1 - (1 - score), 6) AS score FROM r WHERE rank <= 4")
def v3_distance_to_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    far = search.top_k(vectors, _queries_of(vectors)).withColumn("distance", 1 - F.col("score")).drop("score")
    return search.similarity(far, "distance", "distance").select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query("SELECT count(*) AS chunks, max(len(embedding)) AS dims, round(count(*) * max(len(embedding)) * 4 / 1024, 2) AS kb FROM embeddings")
def v7_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.index_stats(table(spark, sf_dir, "embeddings"))


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings")
def e3_l2_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = table(spark, sf_dir, "embeddings").select("vec_id", l2_normalise(F.col("embedding")).alias("u"))
    return unit.select("vec_id", F.round(F.sqrt(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"), F.round(F.col("u")[0], 6).alias("first"))


@query("SELECT doc_id, sha1('local' || chr(0) || 'search_document: ' || text) AS key FROM documents")
def e1_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", cache_key("local", "search_document: ", F.col("text")).alias("key"))


_TOKENS = r"""(CASE WHEN length({t}) = 0 THEN 0 ELSE (27 * len(regexp_extract_all({t}, '[A-Za-z\x09-\x0D\x1C-\x20]')) + 60 * len(regexp_extract_all({t}, '[0-9]'))
 + 85 * len(regexp_extract_all({t}, '[^A-Za-z0-9\x09-\x0D\x1C-\x20\x{{80}}-\x{{10FFFF}}]')) + 110 * len(regexp_extract_all({t}, '[\x{{80}}-\x{{FFFF}}]')) + 340 * len(regexp_extract_all({t}, '[\x{{10000}}-\x{{10FFFF}}]'))) // 100 + 1 END)"""


@query(f"SELECT doc_id, CAST({_TOKENS.format(t='text')} AS BIGINT) AS tokens, CAST(greatest(1, length(text) // 4) AS BIGINT) AS quarter FROM documents")
def t1_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"), quarter_tokens(F.col("text")).alias("quarter"))


_USED = f"WITH u AS (SELECT conv_id, CAST(sum({_TOKENS.format(t='text')} + 10) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id)"


@query(f"{_USED} SELECT conv_id, tokens, {BUDGET} AS budget, {int(BUDGET * 0.85)} AS threshold, tokens > {int(BUDGET * 0.85)} AS over FROM u")
def h4_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.usage(table(spark, sf_dir, "conversations"), BUDGET)


@query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS r FROM conversations),
k AS (SELECT * FROM s WHERE role <> 'system' OR r = 1)
SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'system' THEN 0 ELSE 1 END, turn) - 1 AS INTEGER) AS pos FROM k""")
def h1_one_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.one_system(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "pos")


_TURNS = """n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations WHERE role <> 'system'),
t AS (SELECT conv_id, turn, role, text, CAST(sum(CASE WHEN role = 'user' AND nth > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS turn_no FROM n)"""


@query(f"WITH {_TURNS} SELECT conv_id, turn, role, turn_no FROM t")
def h2_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.with_turns(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "turn_no")


@query("SELECT conv_id, count(*) FILTER (WHERE role = 'system') AS n_system, count(*) FILTER (WHERE role = 'user') AS n_user, count(*) FILTER (WHERE role = 'assistant') AS n_assistant, count(*) FILTER (WHERE role = 'tool') AS n_tool, CAST(sum(length(text) + length(role) + 8) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def h3_role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.role_counts(table(spark, sf_dir, "conversations"))


@query(f"""{_USED}, {_TURNS}, o AS (SELECT conv_id FROM u WHERE tokens > {int(BUDGET * 0.85)}),
d AS (SELECT conv_id, turn FROM (SELECT *, max(turn_no) OVER (PARTITION BY conv_id) AS last FROM t) WHERE turn_no <= last - {KEEP} AND conv_id IN (SELECT conv_id FROM o)),
m AS (SELECT conv_id, CASE WHEN role = 'system' THEN 0 ELSE 2 END AS k, turn, role, text FROM conversations WHERE (conv_id, turn) NOT IN (SELECT conv_id, turn FROM d)
UNION ALL SELECT conv_id, 1, -1, 'user', '[' || count(*) || ' earlier messages were dropped to stay within the context window. If you need something from them, ask.]' FROM d GROUP BY conv_id)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY k, turn) - 1 AS INTEGER) AS pos, role, text FROM m""")
def h5_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.truncate(table(spark, sf_dir, "conversations"), BUDGET, KEEP)


_AFTER = f"""{_USED}, {_TURNS}, o AS (SELECT conv_id FROM u WHERE tokens > {int(BUDGET * 0.85)}),
d AS (SELECT conv_id, turn, turn_no FROM (SELECT *, max(turn_no) OVER (PARTITION BY conv_id) AS last FROM t) WHERE turn_no <= last - {KEEP} AND conv_id IN (SELECT conv_id FROM o)),
l AS (SELECT conv_id, count(DISTINCT turn_no) AS turns, count(*) AS n FROM d GROUP BY conv_id),
k AS (SELECT conv_id, text FROM conversations WHERE (conv_id, turn) NOT IN (SELECT conv_id, turn FROM d) UNION ALL SELECT conv_id, '[' || n || ' earlier messages were dropped to stay within the context window. If you need something from them, ask.]' FROM l),
a AS (SELECT conv_id, CAST(sum({_TOKENS.format(t='text')} + 10) AS BIGINT) AS after FROM k GROUP BY conv_id)"""


@query(f"""{_AFTER} SELECT conv_id, tokens > {int(BUDGET * 0.85)} AS triggered, n IS NOT NULL AS fired, tokens AS before, after, tokens - after AS saved, CAST(round(100.0 * (tokens - after) / greatest(1, tokens)) AS BIGINT) AS saved_pct, coalesce(turns, 0) AS dropped_turns,
coalesce(n, 0) AS dropped_messages, tokens > {int(BUDGET * 0.85)} AND after > {BUDGET} AS still_over FROM u JOIN a USING (conv_id) LEFT JOIN l USING (conv_id)""")
def h5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.compaction_report(table(spark, sf_dir, "conversations"), BUDGET, KEEP)


def _wire_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with tool rows: every third one is a tool's answer to the call of the one before it."""
    own = table(spark, sf_dir, "conversations")
    call = F.array(F.struct(F.concat(F.lit("c"), F.col("turn") + 1).alias("id"), F.lit("look").alias("name"), F.lit('{"q": "x"}').alias("arguments")))
    kind = F.pmod(F.col("turn"), F.lit(3))
    return own.select("conv_id", "turn", F.when(kind == 2, "tool").otherwise(F.col("role")).alias("role"), "text", F.when(kind == 2, "look").alias("name"), F.when(kind == 2, F.concat(F.lit("c"), "turn")).alias("tool_call_id"), F.when((kind == 1) & (F.col("role") == "assistant"), call).alias("tool_calls"))


_WIRE = """WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'tool' ELSE role END AS role, text, turn % 3 = 1 AND role = 'assistant' AS calls FROM conversations)
SELECT conv_id, CAST(len(list(1)) AS INTEGER) AS n, string_agg(role, ',' ORDER BY turn) AS roles, CAST(sum(length(text)) AS BIGINT) AS chars, string_agg(CASE WHEN role = 'tool' THEN 'look' ELSE '' END, ',' ORDER BY turn) AS names, {ids} AS ids, {calls} AS calls FROM m GROUP BY conv_id"""
_WIRED = "array<struct<role:string,content:string,name:string,tool_call_id:string,tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>>>"


def _wire_read(wire: DataFrame) -> DataFrame:
    """The exported JSON read back."""
    m = wire.select("conv_id", F.from_json("wire", _WIRED).alias("m"))
    part = lambda f: F.array_join(F.transform("m", f), ",")
    none = F.lit("")
    calls = lambda x: F.coalesce(F.concat_ws(":", x["tool_calls"][0]["id"], x["tool_calls"][0]["type"], x["tool_calls"][0]["function"]["name"], x["tool_calls"][0]["function"]["arguments"]), none)
    return m.select("conv_id", F.size("m").alias("n"), part(lambda x: x["role"]).alias("roles"), F.aggregate("m", F.lit(0).cast("long"), lambda s, x: s + F.length(x["content"])).alias("chars"), part(lambda x: F.coalesce(x["name"], none)).alias("names"), part(lambda x: F.coalesce(x["tool_call_id"], none)).alias("ids"), part(calls).alias("calls"))


@query(_WIRE.format(ids="string_agg('', ',' ORDER BY turn)", calls="string_agg('', ',' ORDER BY turn)"))
def h9_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wire_read(history.to_wire(_wire_messages(spark, sf_dir)))


@query(_WIRE.format(ids="string_agg(CASE WHEN role = 'tool' THEN 'c' || turn ELSE '' END, ',' ORDER BY turn)", calls="""string_agg(CASE WHEN calls THEN 'c' || (turn + 1) || ':function:look:{"q": "x"}' ELSE '' END, ',' ORDER BY turn)"""))
def h9_wire_hosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wire_read(history.to_wire(_wire_messages(spark, sf_dir), hosted=True))


@query("SELECT conv_id, string_agg('--- ' || CASE WHEN turn % 3 = 2 THEN 'TOOL(look)' ELSE upper(role) END || ' ---' || chr(10) || CASE WHEN length(text) >= 500 THEN text[:500] || ' ...[cut]' ELSE text END, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def h11_tool_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.transcript(_wire_messages(spark, sf_dir))


@query("SELECT conv_id, string_agg('--- ' || upper(role) || ' ---' || chr(10) || CASE WHEN length(text) >= 500 THEN text[:500] || ' ...[cut]' ELSE text END, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def h11_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.transcript(table(spark, sf_dir, "conversations"))


def _results(spark: SparkSession, sf_dir: str, wanted: str = "label") -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = _queries_of(vectors).select("query_id", F.expr(wanted).alias("wanted"), F.when(F.col("vec_id") % 40 == 0, "even").otherwise("odd").alias("grp"))
    hits = search.top_k(vectors, _queries_of(vectors), k=10).join(vectors.select("vec_id", "label"), "vec_id").join(asked.select("query_id", "wanted"), "query_id")
    labelled = hits.select("query_id", "rank", F.col("vec_id").alias("id"), "score", (F.col("label") == F.col("wanted")).alias("relevant"))
    totals = asked.join(vectors.groupBy(F.col("label").alias("wanted")).agg(F.count("*").alias("total_relevant")), "wanted").select("query_id", "total_relevant")
    return evaluation.per_query(asked.select("query_id", "grp"), labelled, totals)


_PER = _RANKED.format(where="") + """,
h AS (SELECT query_id, rank, vec_id, score, ql = el AS rel FROM r WHERE rank <= 10),
p AS (SELECT query_id, min(rank) FILTER (WHERE rel) AS first_rank, arg_min(vec_id, rank)::VARCHAR AS top_source, max(score) AS top_score,
 count(*) FILTER (WHERE rel AND rank <= 1) AS f1, count(*) FILTER (WHERE rel AND rank <= 3) AS f3, count(*) FILTER (WHERE rel AND rank <= 5) AS f5 FROM h GROUP BY query_id),
tot AS (SELECT q.query_id, count(*) AS total_relevant FROM q JOIN embeddings e ON e.label = q.label GROUP BY q.query_id),
z AS (SELECT p.*, total_relevant, CASE WHEN query_id % 40 = 0 THEN 'even' ELSE 'odd' END AS grp FROM p JOIN tot USING (query_id))
"""


@query(_PER + "SELECT query_id, total_relevant, top_source, round(top_score, 6) AS top_score, first_rank, f1 > 0 AS hit1, round(f3 / 3.0, 6) AS p_3, round(f5 * 1.0 / total_relevant, 6) AS r_5 FROM z")
def r4_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _results(spark, sf_dir)
    return out.select("query_id", "total_relevant", "top_source", F.round("top_score", 6).alias("top_score"), "first_rank", (F.col("hit_1") > 0).alias("hit1"), F.round("p_3", 6).alias("p_3"), F.round("r_5", 6).alias("r_5"))


@query(_PER + """SELECT coalesce(grp, 'all') AS grp, count(*) AS n, round(avg((f1 > 0)::INT), 6) AS hit_1, round(avg(f1 / 1.0), 6) AS p_1, round(avg(f1 * 1.0 / total_relevant), 6) AS r_1,
 round(avg((f3 > 0)::INT), 6) AS hit_3, round(avg(f3 / 3.0), 6) AS p_3, round(avg(f3 * 1.0 / total_relevant), 6) AS r_3, round(avg((f5 > 0)::INT), 6) AS hit_5, round(avg(f5 / 5.0), 6) AS p_5, round(avg(f5 * 1.0 / total_relevant), 6) AS r_5,
 round(sum(coalesce(1.0 / first_rank, 0)) / greatest(count(*), 1), 6) AS mrr FROM z GROUP BY ROLLUP (grp)""")
def r6_metrics_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.aggregate(_results(spark, sf_dir), "grp")


#: Half of the queries want the next label, which their neighbours seldom have.
_OTHER = "CASE WHEN vec_id % 40 = 0 THEN label ELSE (label + 1) % 10 END"
_PER_OTHER = _PER.replace("embedding AS v, label FROM", f"embedding AS v, {_OTHER} AS label FROM")


@query(_PER_OTHER + "SELECT query_id, total_relevant, top_source, round(top_score, 6) AS top_score FROM z WHERE f5 = 0")
def r7_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.misses(_results(spark, sf_dir, _OTHER))


def trace_of(events: DataFrame) -> DataFrame:
    """Steps from events: a run is a user's day, a step an event, its tool the event's type."""
    run = F.concat("user_id", F.lit("-"), F.date_format("ts", "yyyyMMdd"))
    step = F.row_number().over(Window.partitionBy("run_id").orderBy("event_id"))
    tool = F.struct(F.col("event_type").alias("name"), F.col("value").alias("duration_ms"), (F.col("event_type") != "error").alias("ok"))
    base = events.withColumn("run_id", run).withColumn("step", step)
    return base.select("run_id", "step", F.col("value").alias("model_ms"), (F.col("event_id") % 100).alias("prompt_tokens"), (F.col("event_id") % 7).alias("completion_tokens"), (F.col("event_id") % 11 == 0).alias("compacted"), (F.col("event_id") % 5 == 0).alias("repaired"), F.array(tool).alias("tools"))


_TRACE = "WITH e AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS run_id, * FROM events)"


@query(_TRACE + """ SELECT run_id, count(*) AS steps, count(*) AS tool_calls, count(*) FILTER (WHERE event_type = 'error') AS tool_failures, count(*) FILTER (WHERE event_id % 5 = 0) AS repaired_steps,
count(*) FILTER (WHERE event_id % 11 = 0) AS compactions, CAST(sum(event_id % 100) AS BIGINT) AS prompt_tokens, CAST(sum(event_id % 7) AS BIGINT) AS completion_tokens, (2 * CAST(sum(CAST(value AS DECIMAL(20,6))) * 1000000 AS HUGEINT) + 100000) // 200000 / 10.0 AS model_ms FROM e GROUP BY run_id""")
def m2_run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.run_rollup(trace_of(table(spark, sf_dir, "events")))


@query(_TRACE + " SELECT run_id, event_type AS name, count(*) AS calls, (2 * CAST(sum(CAST(value AS DECIMAL(20,6))) * 1000000 AS HUGEINT) + 10000) // 20000 / 100.0 AS total_ms, count(*) FILTER (WHERE event_type = 'error') AS failures, (2 * CAST(sum(CAST(value AS DECIMAL(20,6))) * 1000000 AS HUGEINT) + count(*) * 10000) // (2 * count(*) * 10000) / 100.0 AS avg_ms FROM e GROUP BY run_id, event_type")
def m3_tool_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.tool_rollup(trace_of(table(spark, sf_dir, "events")))


def call_log_of(events: DataFrame) -> DataFrame:
    """A call log from events: a model is an event's type; a failed call has no tokens."""
    code = F.expr("CASE event_id % 10 WHEN 0 THEN 'returned 429' WHEN 1 THEN 'returned 500' WHEN 2 THEN 'returned 400' END")
    spent = lambda n: F.when(code.isNull(), F.col("event_id") % n).cast("int")
    return events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("model"), F.col("value").alias("latency_ms"), spent(100).alias("prompt_tokens"), spent(7).alias("completion_tokens"), (F.col("event_id") % 3).cast("int").alias("retries"), code.alias("error"))


@query("""WITH l AS (SELECT event_type AS model, value AS latency_ms, event_id % 3 AS retries, CASE event_id % 10 WHEN 0 THEN 429 WHEN 1 THEN 500 WHEN 2 THEN 400 END AS code, CASE WHEN event_id % 10 > 2 THEN event_id % 100 END AS i, CASE WHEN event_id % 10 > 2 THEN event_id % 7 END AS o FROM events)
SELECT model, count(*) AS calls, count(code) AS errors, count(*) FILTER (WHERE code = 429 OR code >= 500) AS retryable, CAST(sum(retries) AS BIGINT) AS retries, count(*) FILTER (WHERE retries > 0) AS retried_calls, round(avg(latency_ms), 4) AS avg_ms,
CAST(sum(i) AS BIGINT) AS prompt_tokens, CAST(sum(o) AS BIGINT) AS completion_tokens, quantile_disc(latency_ms, 0.5) AS p50_ms, quantile_disc(latency_ms, 0.95) AS p95_ms FROM l GROUP BY model""")
def m6_call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.call_log_rollup(call_log_of(table(spark, sf_dir, "events")))


_BODY = r"""trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160))"""


def _last(sep: str, length: int) -> str:
    """The place just behind the last ``sep`` that begins at or after ``low`` and ends at or before ``hi``; null without one."""
    part = "body[low + 1 : hi]"
    return f"CASE WHEN contains({part}, {sep}) THEN low + length({part}) - strpos(reverse({part}), reverse({sep})) + 1 END"


def chunks_sql(size: int, overlap: int) -> str:
    """Chunks by a walk over (begin, cut): the next window depends on where the last one was cut."""
    def cut(begin: str) -> str:
        low, hi = f"({begin} + {2 * size // 3})", f"({begin} + {size})"
        ladder = ", ".join(_last(sep, n).replace("low", low).replace("hi", hi) for sep, n in (("chr(10) || chr(10)", 2), ("chr(10)", 1), ("'. '", 2), ("', '", 2), ("' '", 1)))
        return f"CASE WHEN {hi} >= length(body) THEN length(body) ELSE coalesce({ladder}, {hi}) END"

    step = f"greatest(begin + 1, cut - {overlap})"
    return f"""RECURSIVE b AS (SELECT CAST(doc_id AS VARCHAR) AS source, {_BODY} AS body FROM documents WHERE text IS NOT NULL),
w AS (SELECT source, body, 0 AS begin, {cut('0')} AS cut FROM b WHERE body <> '' UNION ALL SELECT source, body, {step} AS begin, {cut(step)} AS cut FROM w WHERE cut < length(body)),
c AS (SELECT source, begin AS start, {_BODY.replace('text', 'body[begin + 1 : cut]')} AS text FROM w),
chunks AS (SELECT source, start, text, CAST(row_number() OVER (PARTITION BY source ORDER BY start) - 1 AS INTEGER) AS index FROM c WHERE text <> '')"""


@query(f"WITH {chunks_sql(600, 100)} SELECT source || '#' || index AS chunk_id, source, index, '' AS heading, CAST(start AS INTEGER) AS start, text, '[' || source || ']' || chr(10) || text AS context FROM chunks")
def c2_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.with_context(chunking.chunk(table(spark, sf_dir, "documents")))


@query(r"""WITH l AS (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e]') AS ls FROM documents),
x AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS n, len(ls) AS k FROM l)
SELECT doc_id, CAST(n AS INTEGER) AS n, CASE WHEN length(trim(line[:1000])) > 200 THEN trim(line[:1000])[:200] || '...' ELSE trim(line[:1000]) END AS line FROM x
WHERE regexp_matches(line[:1000], '[Ll]icensed') AND NOT (n = k AND line = '')""")
def g1_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textsearch.grep(table(spark, sf_dir, "documents"), "[Ll]icensed")
