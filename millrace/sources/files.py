"""Readers and writers: text corpora, conversations, traces, call logs, vector indexes, spilled results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversation_files import ConversationFiles

NOT_CORPUS = "overview-index.txt"
MESSAGE = "array<struct<role:string,content:string,tool_call_id:string,name:string,tool_calls:array<struct<id:string,name:string,arguments:string>>,pinned:boolean,created_at:double>>"
TRACE = "run_id string, kind string, step int, model_ms double, step_ms double, prompt_tokens bigint, completion_tokens bigint, compacted boolean, repaired boolean, tools array<struct<name:string,duration_ms:double,ok:boolean,error:string>>"
CALL_LOG = "ts timestamp, model string, latency_ms double, prompt_tokens int, completion_tokens int, retries int, error string"


def _relative(root: str):
    """The file's path below ``root``."""
    depth = len([p for p in root.split("://")[-1].split("/") if p])
    # a local path reads as file:///a/b, a store's as scheme://host/a/b
    whole = F.filter(F.split(F.regexp_replace(F.col("_metadata.file_path"), r"^[a-z0-9]+:/*", ""), "/"), lambda p: p != "")
    return F.array_join(F.slice(whole, F.lit(depth + 1), F.size(whole)), "/")


def read_corpus(spark: SparkSession, root: str, glob: str = "*.txt") -> DataFrame:
    """``source (path below root), text`` of every file below ``root``; Spark fails if ``root`` is missing."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return files.where(F.col("_metadata.file_name") != NOT_CORPUS).select(F.url_decode(_relative(root)).alias("source"), F.col("value").alias("text"))


def from_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return df.select(F.col(id_col).cast("string").alias("source"), F.col(text_col).alias("text"))


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """``conv_id, turn, role, content, ...`` from files of one JSON array of messages each; a file's name is its conversation's id."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    plus = lambda c: F.replace(c, F.lit("+"), F.lit("%2B"))  # noqa: E731 - decoding would make it a space
    stem = F.url_decode(plus(F.regexp_extract(F.element_at(F.split("_metadata.file_path", "/"), -1), r"^(.*)\.json$", 1)))
    conv = F.replace(F.coalesce(F.try_url_decode(plus(stem)), stem), F.lit("\0"), F.lit(""))
    return files.select(conv.alias("conv_id"), F.posexplode(F.from_json("value", MESSAGE)).alias("turn", "m")).select("conv_id", F.col("turn").cast("long").alias("turn"), "m.*")


def conversation_json(messages: DataFrame) -> DataFrame:
    """``conv_id, json``: each conversation as one JSON array, which ``messages_of`` reads back without loss."""
    fields = [c for c in messages.columns if c not in ("conv_id", "turn")]
    part = F.struct("turn", F.struct(*fields).alias("m"))
    return messages.groupBy("conv_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["m"])).alias("json"))


def write_conversations(messages: DataFrame, path: str) -> None:
    """One file of a JSON array for each conversation, added below ``path``; ``read_conversations`` reads them.

    Messages are sorted within tasks and written one by one.  A null id is written as an empty name.
    """
    spark = messages.sparkSession
    spark.dataSource.register(ConversationFiles)
    fields = [c for c in messages.columns if c not in ("conv_id", "turn")]
    rows = messages.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv_id"), "turn", F.to_json(F.struct(*fields)).alias("message"))
    rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn").select("conv_id", "message").write.format("conversation_files").mode("append").save(path)


def messages_of(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", F.posexplode(F.from_json("json", MESSAGE)).alias("turn", "m")).select("conv_id", F.col("turn").cast("long").alias("turn"), "m.*")


def read_trace(spark: SparkSession, path: str, stream: bool = False, files_at_once: int = 1000) -> DataFrame:
    """Step rows of a trace; its summary rows are left out.  A stream takes ``files_at_once`` files in a micro-batch."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_at_once) if stream else spark.read
    return reader.schema(TRACE).json(path).where("kind is null").drop("kind")


def read_call_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(CALL_LOG).json(path)


def write_index(chunks: DataFrame, vectors: DataFrame, path: str, reset: bool = False, partition_by: str | None = None) -> None:
    """Chunks with their vectors as Parquet; ``reset`` replaces the index, else rows are added.

    A chunk without a vector, or the reverse, is refused before anything is written.
    """
    a, b = chunks.groupBy("chunk_id").agg(F.count("*").alias("a")), vectors.groupBy("chunk_id").agg(F.count("*").alias("b"))
    if not a.join(b, "chunk_id", "full").where("not (a <=> b)").isEmpty():
        raise ValueError("chunks and vectors do not match")
    writer = chunks.join(vectors, "chunk_id").write.mode("overwrite" if reset else "append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def spill_path(name, call_id):
    return F.concat(F.lit(".spill/"), name, F.lit("_"), call_id, F.lit(".txt"))


def spilled(results: DataFrame, limit: int = 4000) -> DataFrame:
    """``spill_path, content`` of the tool results (``name, call_id, content``) longer than ``limit``."""
    return results.where(F.length("content") > limit).select(spill_path(F.col("name"), F.col("call_id")).alias("spill_path"), "content")
