"""What the training-data operators share: shared folder, row keys, bounded broadcasts, bitmaps.

Rows are addressed by ``(did, rid)``: the document id (null becomes the smallest long) and a
64-bit hash of id and text.  Rows equal in both id and text are interchangeable.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = -(2**63)
#: A side of a join is broadcast only when its rows, written as text, do not exceed this.
BROADCAST_BYTES = 8_000_000

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor reaches: ``spark.checkpoint.dir``, or in local mode a temporary one where unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all its machines share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="millrace-")
        base = _local[app]
    return base


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Empty tables of ``materialize`` that nothing reads any more; what is made from them is written itself."""
    for df in tables:
        folders = {f.rpartition("/")[0] for f in df.inputFiles()}
        for folder in folders:
            if re.search(r"-[0-9a-f]{32}$", folder):
                none = df.sparkSession.range(0, 0, 1, 1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
                none.write.mode("overwrite").parquet(folder)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """``did, rid, text`` of a documents table; all other columns are left unread."""
    did = F.col("doc_id").cast("long")
    return docs.select(
        F.coalesce(did, F.lit(NULL_ID)).alias("did"),
        F.xxhash64(did, F.col("text").cast("string")).alias("rid"),
        F.col("text").cast("string").alias("text"),
    )


def free_name(names, base: str) -> str:
    """``base``, with underscores in front until no column has that name."""
    while base.lower() in {n.lower() for n in names}:
        base = "_" + base
    return base


def with_keys(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with its row key in two added columns, and their names."""
    d, r = free_name(docs.columns, "did"), free_name(docs.columns, "rid")
    did = F.col("doc_id").cast("long")
    return docs.withColumns({d: F.coalesce(did, F.lit(NULL_ID)), r: F.xxhash64(did, F.col("text").cast("string"))}), d, r


def marked_copies(own: DataFrame, d: str, r: str) -> tuple[DataFrame, str]:
    """``own`` with an added boolean column, and its name: true for all but one of the rows equal in id and text (keys ``d, r``).

    Copies are counted by their keys alone; only rows that have any are written with a number of their own.
    """
    again, uid, low = (free_name(own.columns, x) for x in ("again", "uid", "low"))
    twice = own.groupBy(d, r).agg(F.count("*").alias(low)).where(F.col(low) > 1).select(d, r)
    twice = materialize(twice, "copies")
    if twice.isEmpty():
        return own.withColumn(again, F.lit(False)), again
    copies = materialize(own.join(twice, [d, r], "left_semi").withColumn(uid, F.monotonically_increasing_id()), "copies")
    first = copies.groupBy(d, r).agg(F.min(uid).alias(low))
    marked = copies.join(first, [d, r]).withColumn(again, F.col(uid) != F.col(low)).select(*own.columns, again)
    return own.join(twice, [d, r], "left_anti").withColumn(again, F.lit(False)).select(*own.columns, again).union(marked), again


def doc_id_of(did: str = "did"):
    return F.when(F.col(did) != NULL_ID, F.col(did)).alias("doc_id")


def bounded(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if all its rows together are within ``limit`` bytes, else as it is.

    ``df`` is a written table or cheap to compute: it is read once more for its size.
    """
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns]))) + 16)).first()[0]
    return F.broadcast(df) if (size or 0) <= limit else df


def id_bucket(doc_id, n: int):
    """crc32 of the id's text, modulo ``n``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


BITMAP_BITS = 25


def bitmap_place(col: str, bits: int = BITMAP_BITS):
    """A hash's word in the bitmap, and its bit there, as columns."""
    h = F.shiftrightunsigned(F.col(col), 64 - bits)
    return F.shiftrightunsigned(h, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))


def bitmap_words(df: DataFrame, col: str, bits: int = BITMAP_BITS) -> DataFrame:
    """``w, b``: the words of ``bitmap`` that are not zero; at most 2**bits / 64 rows."""
    word, bit = bitmap_place(col, bits)
    return df.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))


def bitmap(df: DataFrame, col: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """A one-hash Bloom filter of fixed size (2**bits bits) over a 64-bit hash column.

    Its words are combined on the executors, so the driver receives at most 2**bits / 64 rows.
    """
    rows = bitmap_words(df, col, bits).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
    return out


def in_bitmap(words: np.ndarray, h: np.ndarray, bits: int = BITMAP_BITS) -> np.ndarray:
    """Which hashes (uint64) may be in the bitmap; no false negatives."""
    at = h >> np.uint64(64 - bits)
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def small(batches, size: int = 2_000_000):
    """The Arrow batches in slices of about ``size`` bytes of ``text``, so that a task's Python copies stay small."""
    import pyarrow.compute as pc

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def byte_texts(column) -> list[bytes]:
    """A string column of an Arrow batch as UTF-8 bytes, null as empty."""
    return [b"" if x is None else x for x in column.cast("binary").to_pylist()]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` (the smallest node reachable) for all nodes of ``edges(src, dst)`` that are not themselves the smallest.

    Alternating large-star and small-star steps: each is an aggregation by node and an inner join
    back, so a hub's edges are combined before the shuffle and may be split by the skew join.
    """
    both = edges.where("src <> dst")
    cur = materialize(both.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        two = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = two.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = two.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        cur = materialize(small.distinct(), "edges")
        now = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
