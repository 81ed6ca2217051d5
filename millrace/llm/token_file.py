"""Token ids as binary shards: bit-plane or byte-plane shuffled, zstandard-compressed, with an index.

A shard image is ``magic | planes ... | index | footer``.  Ids are cut into blocks of fixed size; a
block is transposed into byte planes (the k-th bytes of all ids) or bit planes (the k-th bits), each
plane compressed on its own.  The index holds each plane's place, the documents' ids and their
lengths, so a block or a document can be read without the rest.  Shards are rows of a Parquet table
(``part, shard, first, n_ids, image``), which any store that Spark writes can hold.

A null or empty text has only the end id.  Rows of equal ids lie next to each other, in an order that their texts
decide; repeated rows are written each; a null doc_id sorts first.  Long texts are encoded whole.  Other columns are not
read, whatever their names.  An empty table gives no shard.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, doc_id_of, keyed, materialize, small
from .encode import encoder, text_groups

MAGIC = b"PLN1"
BLOCK_IDS = 1 << 16
SHARD_IDS = 1 << 21
PLANES = ("byte", "bit")


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """A block of unsigned 32-bit ids as planes, least significant first; zero planes at the end are dropped."""
    octets = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    rows = list(octets)
    if planes == "bit":
        rows = [np.packbits((o >> b) & 1) for o in octets for b in range(8)]
    while rows and not rows[-1].any():
        rows.pop()
    return [r.tobytes() for r in rows]


def from_planes(rows: list[bytes], n: int, planes: str) -> np.ndarray:
    octets = np.zeros((4, n), dtype=np.uint8)
    for k, row in enumerate(rows):
        if planes == "bit":
            octets[k // 8] |= np.unpackbits(np.frombuffer(row, np.uint8), count=n) << (k % 8)
        else:
            octets[k] = np.frombuffer(row, np.uint8)
    return np.ascontiguousarray(octets.T).view("<u4").ravel()


def write_image(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, planes: str = "byte", level: int = 1) -> bytes:
    """One shard: ids of whole documents in order."""
    pack = zstandard.ZstdCompressor(level=level).compress
    body, at, index = [MAGIC], len(MAGIC), []
    for i in range(0, len(ids), BLOCK_IDS):
        block = ids[i : i + BLOCK_IDS]
        parts = [pack(p) for p in to_planes(block, planes)]
        index.append([at, len(block), [len(p) for p in parts]])
        body += parts
        at += sum(map(len, parts))
    docs = pack(np.concatenate([doc_ids.astype("<i8"), lengths.astype("<i8")]).tobytes())
    head = json.dumps({"planes": planes, "blocks": index, "docs": [at, len(docs), len(doc_ids)]}).encode()
    return b"".join([*body, docs, head, struct.pack("<I", len(head)), MAGIC])


def read_image(image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``ids, doc_ids, lengths`` of a shard."""
    if image[:4] != MAGIC or image[-4:] != MAGIC:
        raise ValueError("not a token shard")
    (n,) = struct.unpack("<I", image[-8:-4])
    head = json.loads(image[-8 - n : -8])
    unpack = zstandard.ZstdDecompressor().decompress
    blocks = []
    for at, count, sizes in head["blocks"]:
        rows = []
        for size in sizes:
            rows.append(unpack(image[at : at + size]))
            at += size
        blocks.append(from_planes(rows, count, head["planes"]))
    at, size, count = head["docs"]
    docs = np.frombuffer(unpack(image[at : at + size]), "<i8")
    return np.concatenate(blocks) if blocks else np.zeros(0, "<u4"), docs[:count], docs[count:]


def write_shards(docs: DataFrame, path: str, end_id: int = 0, planes: str = "byte", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Shards of all documents in ascending doc_id order, written to the shared folder and read back.

    Columns: ``part, shard, first (ids before it in its part), n_ids, image``; parts follow each other
    in doc_id order.
    """
    if planes not in PLANES:
        raise ValueError(f"planes must be one of {PLANES}")
    rows = keyed(docs).select("did", "text")
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.repartitionByRange(n, "did", F.xxhash64("text")).sortWithinPartitions("did", "text").withColumn("part", F.spark_partition_id())
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        enc = encoder(path, False)
        shard = first = held = 0
        ids, dids, lens, part = [], [], [], None

        def flush():
            nonlocal shard, first, held, ids, dids, lens
            image = write_image(np.frombuffer(b"".join(ids), "<u4"), np.array(dids), np.array(lens), planes)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int64()), pa.array([first], pa.int64()), pa.array([held], pa.int64()), pa.array([image], pa.binary())], names=["part", "shard", "first", "n_ids", "image"])
            shard, first, held, ids, dids, lens = shard + 1, first + held, 0, [], [], []
            return out

        for batch in small(batches):
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            names, texts = batch.column("did").to_pylist(), batch.column("text").to_pylist()
            for i, j in text_groups(texts):
                for did, own in zip(names[i:j], enc.encode_many(texts[i:j]), strict=True):
                    ids.append(own + end)
                    dids.append(did)
                    lens.append(len(own) // 4 + 1)
                    held += lens[-1]
                    if held >= shard_ids:
                        yield flush()
        if dids:
            yield flush()

    return materialize(rows.mapInArrow(run, "part int, shard long, first long, n_ids long, image binary"), "tokens")


def read_documents(shards: DataFrame) -> DataFrame:
    """``did, place (ids before it in its part), part, n_tokens, ids_crc32`` of each document, from the shards."""

    def run(batches):
        for batch in batches:
            for part, first, image in zip(batch.column("part"), batch.column("first"), batch.column("image"), strict=True):
                ids, dids, lens = read_image(image.as_py())
                raw, at = memoryview(ids.astype("<u4").tobytes()), np.concatenate([[0], np.cumsum(lens)])
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * len(dids), pa.int32()), pa.array(dids), pa.array(at[:-1] + first.as_py()), pa.array(lens), pa.array(crc, pa.int64())], names=["part", "did", "place", "n_tokens", "ids_crc32"])

    return shards.select("part", "first", "image").mapInArrow(run, "part int, did long, place long, n_tokens long, ids_crc32 long")


def token_starts(shards: DataFrame) -> DataFrame:
    """Documents of the shards with ``start``, the ids of all documents before them.

    The offsets of the parts are one row per part, as many as shuffle partitions.
    """
    from pyspark.sql import Window

    sizes = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return read_documents(shards).join(bounded(base), "part").select(doc_id_of(), (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def token_ids(docs: DataFrame, path: str, end_id: int = 0, planes: str = "byte") -> DataFrame:
    """Write the shards of ``docs``, read them back: ``doc_id, start, n_tokens, ids_crc32``."""
    return token_starts(write_shards(docs, path, end_id, planes))


def export(shards: DataFrame, folder: str) -> None:
    """Each shard image as a file of its own in ``folder``, which all executors must reach as a local path."""

    def save(batches):
        import os

        for batch in batches:
            for part, shard, image in zip(batch.column("part"), batch.column("shard"), batch.column("image"), strict=True):
                name = os.path.join(folder, f"{part.as_py():06d}-{shard.as_py():06d}.pln")
                with open(name + ".part", "wb") as f:
                    f.write(image.as_py())
                os.replace(name + ".part", name)
            yield pa.RecordBatch.from_arrays([batch.column("part")], names=["part"])

    shards.select("part", "shard", "image").mapInArrow(save, "part int").count()

