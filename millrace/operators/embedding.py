"""Embedding with a cache, and a hashing embedder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cache_key
from .caching import TableCache

BATCH = 64
#: Words whose numbers an embedder remembers before it begins anew.
REMEMBERED = 100_000


def hashing_embedder(dims: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic embedder for tests and baselines: signed hashes of words, unit length."""

    def embed(texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), dims))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = xxhash.xxh64_intdigest(word)
                row[h % dims] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    return embed


def counting_embedder(dims: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Signed counts of words by their MD5: exact numbers that SQL can recompute; cosines need no unit length.

    Words are what ASCII white space parts, A-Z lower-cased; the first seven hexadecimal digits choose the place, the eighth the sign.
    """
    from hashlib import md5

    known = {"": -1}

    def number(word: str) -> int:
        digits = md5(word.encode()).hexdigest()
        return int(digits[:7], 16) % dims + (dims if digits[7] < "8" else 0)

    def embed(texts: list[str]) -> np.ndarray:
        if len(known) > REMEMBERED:
            known.clear()
            known[""] = -1
        split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
        each = pc.list_flatten(split).dictionary_encode()
        words = each.dictionary.to_numpy(zero_copy_only=False).tolist()
        codes = list(map(known.get, words))
        for i, code in enumerate(codes):
            if code is None:
                codes[i] = known[words[i]] = number(words[i])
        slot, word, row = np.array(codes, np.int64), each.indices.to_numpy(), pc.list_parent_indices(split).to_numpy()
        at = slot[word]
        if (slot < 0).any():
            row, at = row[at >= 0], at[at >= 0]
        both = np.bincount(row * (2 * dims) + at, minlength=len(texts) * 2 * dims).reshape(-1, 2 * dims)
        return both[:, dims:] - both[:, :dims]

    embed.batch = 65_536  # most words of a large batch are found in it again
    return embed


def vectors_of(texts: list[str], embedder: Callable[[list[str]], np.ndarray]) -> np.ndarray:
    """A float32 row for each text; the embedder gets ``embedder.batch`` texts at a time, or ``BATCH``."""
    size, out = getattr(embedder, "batch", BATCH), []
    for at in range(0, len(texts), size):
        part = texts[at : at + size]
        vectors = np.asarray(embedder(part))
        if len(vectors) != len(part):
            raise ValueError(f"the embedder returned {len(vectors)} vectors for {len(part)} texts")
        out.append(vectors.astype(np.float32))
    return np.concatenate(out) if out else np.zeros((0, 0), np.float32)


def embed_rows(rows: DataFrame, embedder: Callable[[list[str]], np.ndarray], col: str, out: str) -> DataFrame:
    """``rows`` with ``out array<float>``, made of ``col`` where a row lies; equal texts of a batch are embedded once."""

    def run(batches):
        for batch in batches:
            texts = batch.column(col).dictionary_encode()
            vectors = vectors_of(texts.dictionary.to_pylist(), embedder)[texts.indices.to_numpy()]
            lists = pa.ListArray.from_arrays(np.arange(0, vectors.size + 1, max(1, vectors.shape[1]), dtype=np.int32), pa.array(vectors.ravel())) if len(batch) else pa.array([], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{out}` array<float>")


def embed(texts: DataFrame, embedder: Callable[[list[str]], np.ndarray], model: str, prefix: str = "search_document: ", cache: DataFrame | TableCache | None = None, col: str = "text") -> DataFrame:
    """``texts`` with ``key, vector, cached``; only different texts that ``cache`` lacks are embedded.

    A ``TableCache`` (``vector array<float>``) keeps what this run makes; a DataFrame (``key, vector``) is only read.
    """

    def run(frames):
        for frame in frames:
            size = getattr(embedder, "batch", BATCH)
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size]
                yield pd.DataFrame({"key": part["key"].to_numpy(), "vector": list(vectors_of([prefix + t for t in part["_t"]], embedder))})

    keyed = texts.withColumn("key", cache_key(model, prefix, F.coalesce(F.col(col), F.lit(""))))
    new = keyed.select("key", F.coalesce(F.col(col), F.lit("")).alias("_t"))
    made = lambda rows: rows.mapInPandas(run, "key string, vector array<float>")
    if isinstance(cache, TableCache):
        own = uuid.uuid4().hex
        cache.add(made(cache.missing(new)), own)
        known = cache.found(keyed).select("key", "vector", (F.col("run") != own).alias("cached"))
    elif cache is not None:
        fresh = made(new.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])).withColumn("cached", F.lit(False))
        known = fresh.unionByName(cache.select("key", "vector", F.lit(True).alias("cached")))
    else:
        known = made(new.dropDuplicates(["key"])).withColumn("cached", F.lit(False))
    return keyed.join(known, "key", "left")
