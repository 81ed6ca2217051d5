"""Queries of sources, rendering, reports and running rollups, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, chunking, completions, evaluation, search, telemetry, textsearch
from ..sources import files
from ..sources.shared import shared_path
from ..streaming import rollups
from .logs import _C, _completions, _outcomes, _STEPS
from .registry import _OTHER, _PER, _PER_OTHER, _queries_of, _RANKED, _results, _TRACE, ORACLE, call_log_of, chunks_sql, query, table, trace_of


@query("SELECT CAST(doc_id AS VARCHAR) AS source, text FROM documents")
def s1_table_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.from_table(table(spark, sf_dir, "documents"))


@query("SELECT coalesce(source, '__HIVE_DEFAULT_PARTITION__') AS folder, CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def s1_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as files below a folder for each source and read as a corpus."""
    path = shared_path(spark, "corpus")
    table(spark, sf_dir, "documents").where("text is not null").select("text", "source").write.partitionBy("source").text(path)
    read = files.read_corpus(spark, path)
    return read.groupBy(F.regexp_extract("source", "^source=([^/]*)/", 1).alias("folder")).agg(F.sum(F.length("text")).alias("chars"))


@query("SELECT CAST(conv_id AS VARCHAR) AS conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, text AS content FROM conversations")
def s2_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "saved")
    files.write_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content")), path)
    return files.read_conversations(spark, path).select("conv_id", "turn", "role", "content")


@query(ORACLE["m2_run_rollup"])
def s3_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace written as JSON lines with a summary for each run; only its steps are read."""
    path = shared_path(spark, "trace")
    steps = trace_of(table(spark, sf_dir, "events"))
    steps.unionByName(steps.select("run_id", F.lit("summary").alias("kind")).distinct(), allowMissingColumns=True).write.json(path)
    return telemetry.run_rollup(files.read_trace(spark, path))


@query(ORACLE["m6_call_log"])
def s4_call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "calls")
    call_log_of(table(spark, sf_dir, "events")).write.json(path)
    return telemetry.call_log_rollup(files.read_call_log(spark, path))


@query("SELECT 2 * count(*) AS chunks, max(len(embedding)) AS dims, round(2 * count(*) * max(len(embedding)) * 4 / 1024, 2) AS kb FROM embeddings")
def s5_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that is replaced, opened again and added to."""
    path = shared_path(spark, "index")
    own = table(spark, sf_dir, "embeddings").withColumn("chunk_id", F.col("vec_id").cast("string"))
    for reset in (True, True, False):
        files.write_index(own.select("chunk_id", "label"), own.select("chunk_id", "embedding"), path, reset=reset)
    return search.index_stats(spark.read.parquet(path))


@query(_RANKED.format(where="") + """SELECT query_id, string_agg('[' || rank || '] ' || 'v' || vec_id || CASE WHEN el % 2 = 0 THEN ' > even' ELSE '' END || '  (similarity ' || printf('%.2f', score) || ')' || chr(10) || 'label ' || el, chr(10) || chr(10) ORDER BY rank) AS rendered FROM r WHERE rank <= 4 GROUP BY query_id
UNION ALL SELECT -1, 'no passages found for ''nothing'''""")
def v6_rendered_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = _queries_of(vectors)
    shown = vectors.select("vec_id", F.concat(F.lit("v"), "vec_id").alias("source"), F.when(F.col("label") % 2 == 0, "even").otherwise("").alias("heading"), F.concat(F.lit("label "), "label").alias("text"))
    hits = search.top_k(vectors, asked).join(shown, "vec_id")
    questions = asked.select("query_id", F.lit("q").alias("question")).unionByName(asked.select(F.lit(-1).cast("long").alias("query_id"), F.lit("nothing").alias("question")).distinct())
    return search.format_hits(questions, hits)


@query("""SELECT event_id AS call_id, CASE WHEN event_type <> 'click' THEN 'go' || event_id END AS q, CASE WHEN event_type = 'click' THEN 'click got a bare string but takes 2 required arguments (a, b). Send an object.' END AS error FROM events""")
def a2_bare_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    need = F.when(F.col("name") == "click", F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("q")))
    catalog = events.select(F.col("event_type").alias("name")).distinct().select("name", need.alias("required"), F.lit("allow").alias("default_policy"))
    calls = events.select(F.col("event_id").alias("call_id"), F.col("event_type").alias("name"), F.concat(F.lit('{"__positional__": "go'), "event_id", F.lit('"}')).alias("arguments"))
    return audit.resolve(calls, catalog).select("call_id", F.when(F.col("error").isNull(), F.get_json_object("resolved", "$.q")).alias("q"), "error")


_SETTINGS = [(200, 33), (600, 100), (2000, 333)]


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {chunks_sql(s, o)} SELECT {s} AS size, {o} AS overlap, count(*) AS chunks FROM chunks)" for s, o in _SETTINGS))
def c5_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_counts(table(spark, sf_dir, "documents"), _SETTINGS)


@query("""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS source, CASE WHEN length(source) > 0 THEN '# ' || source || chr(10) || chr(10) || replace(text, chr(10), ' ') END AS text, source AS title FROM documents)
SELECT source, title AS heading FROM d WHERE text IS NOT NULL""")
def c3_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts under a heading: each chunk has it."""
    own = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# "), "source", F.lit("\n\n"), F.translate("text", "\n", " ")).alias("text"))
    return chunking.chunk(own.where("text is not null")).select("source", "heading").distinct()


def _reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluated queries with a question and what they wanted."""
    asked = _queries_of(table(spark, sf_dir, "embeddings")).select("query_id", F.concat(F.lit("which vectors are near number "), F.repeat(F.col("query_id").cast("string"), 9)).alias("question"), F.expr(_OTHER).cast("string").alias("marker"), F.array(F.expr(_OTHER).cast("string")).alias("sources"))
    return _results(spark, sf_dir, _OTHER).join(asked, "query_id")


_QUESTION = "'which vectors are near number ' || repeat(query_id::VARCHAR, 9)"


@query(_PER_OTHER + f"SELECT CAST(row_number() OVER (ORDER BY first_rank NULLS LAST, query_id) AS INTEGER) AS place, query_id, coalesce(first_rank::VARCHAR, 'MISS') AS rank, total_relevant, CASE WHEN length({_QUESTION}) > 52 THEN ({_QUESTION})[:49] || '...' ELSE {_QUESTION} END AS question FROM z")
def r7_per_query_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.per_query_table(_reported(spark, sf_dir))


@query(_PER_OTHER + "SELECT query_id, label::VARCHAR AS marker, label::VARCHAR AS sources, total_relevant, top_source, round(top_score, 6) AS top_score FROM z JOIN q USING (query_id) WHERE f5 = 0")
def r7_wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.misses(_reported(spark, sf_dir)).withColumn("sources", F.array_join("sources", "/"))


@query(_PER + "SELECT query_id, (f1 > 0)::INT::DOUBLE AS hit_1, round(f1 / 1.0, 6) AS p_1, round(f1 * 1.0 / total_relevant, 6) AS r_1, (f3 > 0)::INT::DOUBLE AS hit_3, round(f3 * 1.0 / total_relevant, 6) AS r_3, (f5 > 0)::INT::DOUBLE AS hit_5, round(f5 / 5.0, 6) AS p_5 FROM z")
def r4_all_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("query_id", *[F.round(c, 6).alias(c) for c in ("hit_1", "p_1", "r_1", "hit_3", "r_3", "hit_5", "p_5")])


@query(_PER + "SELECT query_id, coalesce((SELECT string_agg(rank - 1, ',' ORDER BY rank) FROM h WHERE h.query_id = z.query_id AND rel), '') AS ranks FROM z")
def r3_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("query_id", F.array_join(F.transform("ranks", lambda x: x.cast("string")), ",").alias("ranks"))


@query(_C + f""", t AS (SELECT *, user_id % 3 AS temperature FROM c), {_STEPS.removeprefix("WITH ")}, f2 AS (SELECT run_id % 3 AS temperature, count(*) FILTER (WHERE outcome <> 'answered') AS failed FROM o GROUP BY 1)
SELECT t.temperature, count(*) AS completions, count(*) FILTER (WHERE kind < 4) AS with_calls, count(*) FILTER (WHERE kind IN (1, 2, 3)) AS repaired, count(*) FILTER (WHERE kind < 4) AS calls_found, count(*) FILTER (WHERE kind = 5) AS unparseable,
round(100.0 * count(*) FILTER (WHERE kind IN (1, 2, 3)) / greatest(count(*) FILTER (WHERE kind < 4), 1), 1) AS repair_pct, coalesce(any_value(failed), 0) AS failed FROM t LEFT JOIN f2 USING (temperature) GROUP BY t.temperature""")
def p4_repair_rate_by_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _completions(spark, sf_dir).withColumn("temperature", F.col("user_id") % 3)
    return completions.repair_rates(own, _outcomes(spark, sf_dir).withColumn("temperature", F.col("run_id") % 3), "temperature")


_HITS = r"""WITH l AS (SELECT 'd/' || source || '/' || doc_id || '.txt' AS path, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e]') AS ls FROM documents WHERE text IS NOT NULL AND doc_id % 10 <> 7),
x AS (SELECT path, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS n, len(ls) AS k FROM l),
m AS (SELECT path, n, CASE WHEN length(trim(line[:1000])) > 200 THEN trim(line[:1000])[:200] || '...' ELSE trim(line[:1000]) END AS line FROM x WHERE regexp_matches(line[:1000], '{p}') AND NOT (n = k AND line = '')),
t AS (SELECT CAST(row_number() OVER (ORDER BY path, n) AS INTEGER) AS n, path || ':' || n || ': ' || line AS line FROM m QUALIFY n <= {k})"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: every tenth lies in a skipped folder, or is a key or a page."""
    end = F.expr("CASE doc_id % 30 WHEN 7 THEN 'node_modules/a.txt' WHEN 17 THEN 'x.pem' WHEN 27 THEN 'a.html' ELSE doc_id || '.txt' END")
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), "source", F.lit("/"), end).alias("source"), "text")


@query(_HITS.format(p="[Ll]icensed", k=100) + " SELECT n, line FROM t WHERE n <= 100 UNION ALL SELECT CAST(count(*) + 1 AS INTEGER), '... stopped at 100 results' FROM t WHERE n <= 100 HAVING count(*) >= 100")
def g1_grep_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textsearch.grep_report(_files(spark, sf_dir), "[Ll]icensed", "*.txt")


@query("SELECT 1 AS n, 'no matches for ''qq+zz'' in ' || count(*) || ' files' AS line FROM documents WHERE text IS NOT NULL AND doc_id % 10 <> 7")
def g1_no_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textsearch.grep_report(_files(spark, sf_dir), "qq+zz", "*.txt")


def _upserted(frame: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """What a running rollup shows when its input has ended, micro-batch by micro-batch."""
    path = shared_path(frame.sparkSession, name)
    writer = frame.writeStream.outputMode("update").option("checkpointLocation", f"{path}-state").foreachBatch(rollups.upserting(path, keys, 3))
    writer.trigger(availableNow=True).start().awaitTermination()
    return rollups.latest(frame.sparkSession, path, keys).select(frame.columns)


@query(ORACLE["m2_run_rollup"])
def st1_running_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upserted(rollups.running_runs(_trace_stream(spark, sf_dir)), "st1-runs", ["run_id"])


@query(ORACLE["m3_tool_rollup"])
def st1_running_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upserted(rollups.running_tools(_trace_stream(spark, sf_dir)), "st1-tools", ["run_id", "name"])


def _trace_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace written as JSON lines, read as it would arrive: two files a micro-batch, a run's steps in several of them."""
    path = shared_path(spark, "steps")
    trace_of(table(spark, sf_dir, "events")).repartition(8, "step", "model_ms").write.json(path)
    return files.read_trace(spark, path, stream=True, files_at_once=2)


_ROUNDED = "(2 * CAST(sum(CAST(value AS DECIMAL(20,6))) * 1000000 AS HUGEINT) + {half}) // (2 * {unit}) / 100.0"


@query(_TRACE + f""" SELECT run_id, event_type AS name, CASE grouping(run_id, event_type) WHEN 0 THEN 'run and tool' WHEN 1 THEN 'run' WHEN 2 THEN 'tool' ELSE 'all' END AS level, count(*) AS calls, {_ROUNDED.format(half=10000, unit=10000)} AS total_ms,
count(*) FILTER (WHERE event_type = 'error') AS failures, {_ROUNDED.format(half="count(*) * 10000", unit="count(*) * 10000")} AS avg_ms FROM e GROUP BY CUBE (run_id, event_type)""")
def m3_tool_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.tool_cube(trace_of(table(spark, sf_dir, "events")))


@query(_TRACE + " SELECT event_id AS step, round(value, 1) AS model_ms, round(value * 1000, 1) AS step_ms FROM e WHERE value IS NOT NULL")
def m1_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(False)
    own = table(spark, sf_dir, "events").where("value is not null").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), F.col("value").alias("model_ms"), F.col("value").alias("elapsed_s"), F.lit(1).alias("prompt_tokens"), F.lit(1).alias("completion_tokens"), none.alias("compacted"), none.alias("repaired"), F.array().cast("array<struct<name:string,duration_ms:double,ok:boolean,content:string>>").alias("results"))
    return telemetry.step_records(own).select("step", "model_ms", "step_ms")
