"""SimHash near-duplicates: pigeonhole blocks, join on blocks, verify the Hamming distance.

A fingerprint's bits are split into six blocks.  Two fingerprints that differ in at most three
bits agree on three whole blocks, so they share one of the twenty three-block keys.  A key held by
many different fingerprints is split again in the same way over its remaining bits (64, 32, 16, 8
free bits), so that no bucket exceeds a fixed size and no pair is lost.

Nulls and empty texts have fingerprint zero and are linked like any other.  Repeated rows and ties
share a fingerprint; the smallest doc_id names the class.  Long texts are hashed whole.  Other columns are not read,
whatever their names.  Empty tables give empty results.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, byte_texts, connected_components, doc_id_of, keyed, marked_copies, materialize, small, with_keys

DISTANCE = 3
BLOCKS = 6
#: Different fingerprints in one bucket, beyond which its key is split further.
BUCKET = 64
LEVELS = 3


def _blocks(bits: list[int]) -> list[list[int]]:
    return [list(x) for x in np.array_split(np.array(bits), BLOCKS)]


def _split(bits: list[int]) -> list[tuple[int, list[int]]]:
    """For each three-block choice: mask of the chosen bits and the bits left free."""
    blocks = _blocks(bits)
    out = []
    for chosen in combinations(range(BLOCKS), BLOCKS - DISTANCE):
        out.append((sum(1 << int(b) for i in chosen for b in blocks[i]), [int(b) for i in range(BLOCKS) if i not in chosen for b in blocks[i]]))
    return out


class KeyMasks:
    """Masks of every key path: level one has 20, each splits into 20 of the next level."""

    def __init__(self) -> None:
        self.free = [list(range(64))]
        self.fixed = [0]
        self.level_masks: list[np.ndarray] = []
        for _ in range(LEVELS):
            free, fixed = [], []
            for f, m in zip(self.free, self.fixed, strict=True):
                for mask, left in _split(f):
                    free.append(left)
                    fixed.append(m | mask)
            self.free, self.fixed = free, fixed
            self.level_masks.append(np.array(fixed, dtype=np.uint64))


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``shingle`` words, repeats included; of all words where there are no more."""
    h64 = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([h64(joined, 42)] if words else [], dtype="<u8")
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[: len(words) - shingle]]]
    return np.array([h64(joined[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :], strict=True)], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """Bits that more than half of the hashes have; zero without any."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int) -> int:
    """Majority bits of the hashes of a text's word shingles."""
    return majority(shingle_hashes(text.lower().split(), shingle))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``did, rid, fp`` of every row; ``fp`` is a signed long with the fingerprint's bits."""

    def run(batches):
        for batch in small(batches):
            fp = np.array([fingerprint(t, shingle) for t in byte_texts(batch.column("text"))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("rid"), pa.array(fp)], names=["did", "rid", "fp"])

    return keyed(docs).mapInArrow(run, "did long, rid long, fp long")


def _expand(rows: DataFrame, level: int) -> DataFrame:
    """Rows ``fp, path`` of the level above to one row per key of this level: ``fp, path, val``."""
    masks = KeyMasks().level_masks[level]

    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            path = batch.column("path").to_numpy().astype(np.int64)
            n = len(fp)
            if not n:
                continue
            sub = (path[:, None] * 20 + np.arange(20)).ravel()
            wide = np.repeat(fp, 20)
            yield pa.RecordBatch.from_arrays([pa.array(wide.view(np.int64)), pa.array(sub.astype(np.int32)), pa.array((wide & masks[sub]).view(np.int64))], names=["fp", "path", "val"])

    return rows.mapInArrow(run, "fp long, path int, val long")


def _pairs_in(batches):
    for batch in batches:
        lists = batch.column("fps")
        bucket = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        fps = lists.flatten().to_numpy().view(np.uint64)
        for step in range(1, len(fps)):  # ends after the largest bucket's size
            same = np.flatnonzero(bucket[step:] == bucket[:-step])
            if not len(same):
                break
            x, y = fps[same], fps[same + step]
            near = np.bitwise_count(x ^ y) <= DISTANCE
            x, y = x[near].view(np.int64), y[near].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["src", "dst"])


def close_pairs(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Pairs ``src, dst`` of different fingerprints (``fp``) within three bits of each other."""
    found = None
    rows = distinct.select("fp", F.lit(0).alias("path"))
    for level in range(LEVELS):
        last = level == LEVELS - 1
        keys = _expand(rows, level)
        shared = keys.groupBy("path", "val").agg(F.count("*").alias("n")).where("n > 1")
        marked = materialize(keys.join(shared, ["path", "val"]), "buckets")
        small = marked if last else marked.where(F.col("n") <= bucket)
        pairs = small.groupBy("path", "val").agg(F.collect_list("fp").alias("fps")).mapInArrow(_pairs_in, "src long, dst long")
        found = pairs if found is None else found.union(pairs)
        if last:
            break
        rows = marked.where(F.col("n") > bucket).select("fp", "path")
        if rows.isEmpty():
            break
    return found.distinct()


def classes(docs: DataFrame, shingle: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Every row with its fingerprint and class: ``did, rid, fp, root, component``.

    ``root`` is the class's smallest fingerprint, ``component`` the smallest did reachable over links
    of at most three differing bits (null if no member has an id).
    """
    marks = materialize(fingerprints(docs, shingle), "fingerprints")
    distinct = materialize(marks.groupBy("fp").agg(F.min(F.when(F.col("did") != NULL_ID, F.col("did"))).alias("low")), "distinct")
    comp = connected_components(close_pairs(distinct, bucket))
    roots = distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    named = roots.join(roots.groupBy("root").agg(F.min("low").alias("component")), "root").select("fp", "root", "component")
    return marks.join(named, "fp")


def near_duplicate_classes(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fingerprint (16 hex digits), component_id`` for every document."""
    return classes(docs, shingle).select(doc_id_of(), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """Documents with one of each group of near copies left: the smallest (did, rid).

    Near copies have a shingle similarity of 0.8 or more (see ``near_copies``).  Texts without a word are
    kept only once, and so are rows equal in id and text.
    """
    from . import near_copies

    own, d, r = with_keys(docs)
    stay = near_copies.representatives(docs, shingle).select(F.col("did").alias(d), F.col("rid").alias(r))
    kept, again = marked_copies(own.join(stay, [d, r], "left_semi"), d, r)
    return kept.where(~F.col(again)).select(*docs.columns)
