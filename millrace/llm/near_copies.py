"""Near copies: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

At 0.8 two SimHash fingerprints differ in about ten of 64 bits, give or take three, so a radius that finds most
such pairs has no selective pigeonhole blocks.  Candidates are therefore fingerprints within three bits and, for
the pairs further apart, documents that agree on one of twenty bands of four minima (a pair at 0.8 is missed once
in 30,000 times).  Every candidate is verified by its exact similarity.

A crowded bucket is first compared with one member.  Only members whose group, over all links, is not that
member's are then compared with the bucket's other groups, so that a large group of near copies does not grow with
its square.  No pair of a bucket is left out; a large bucket of unlike documents is compared in full.

Equal texts but for case and white space are one node.  Texts without a word, nulls among them, are one node too.  Long
texts are compared by all their shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import bounded, byte_texts, connected_components, keyed, materialize, small

SIMILARITY = 0.8
BANDS, ROWS = 20, 4
#: Nodes in one bucket beyond which not all its pairs are compared at once.
BUCKET = 16
_rng = np.random.default_rng(42)
_ODD = _rng.integers(0, 2**63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, (BANDS * ROWS, 1), dtype=np.uint64)


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Sorted different shingle hashes."""
    return np.unique(simhash.shingle_hashes(text.lower().split(), shingle))


def bands(shingles: np.ndarray) -> list[int]:
    """A 64-bit key for each band; none for a text without a word."""
    if not len(shingles):
        return []
    low = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(shingles), 4096):
        low = np.minimum(low, (shingles[None, i : i + 4096] * _ODD + _ADD).min(axis=1))
    raw = low.tobytes()
    return [xxhash.xxh64_intdigest(raw[8 * ROWS * k : 8 * ROWS * (k + 1)], k) for k in range(BANDS)]


def marks(docs: DataFrame, shingle: int) -> DataFrame:
    """``did, rid, node (hash of the words), fp, bands`` of every row."""

    def run(batches):
        for batch in small(batches):
            nodes, fps, keys = [], [], []
            for t in byte_texts(batch.column("text")):
                words = t.lower().split()
                hashes = simhash.shingle_hashes(words, shingle)
                nodes.append(xxhash.xxh64_intdigest(b" ".join(words), 7))
                fps.append(simhash.majority(hashes))
                keys.append(bands(np.unique(hashes)))
            signed = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), signed([k for ks in keys for k in ks]))
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("rid"), signed(nodes), signed(fps), lists], names=["did", "rid", "node", "fp", "bands"])

    return keyed(docs).mapInArrow(run, "did long, rid long, node long, fp long, bands array<long>")


def _pairs_in(batches):
    for batch in batches:
        lists = batch.column("nodes")
        bucket = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        nodes = lists.flatten().to_numpy()
        for step in range(1, len(nodes)):  # ends after the largest bucket's size
            same = np.flatnonzero(bucket[step:] == bucket[:-step])
            if not len(same):
                break
            x, y = nodes[same], nodes[same + step]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["src", "dst"])


def _similar(batches):
    for batch in batches:
        keep = []
        for k in range(batch.num_rows):
            a, b = (batch.column(c)[k].values.to_numpy() for c in ("sa", "sb"))
            least = SIMILARITY * max(len(a), len(b)) - 1e-9
            if min(len(a), len(b)) >= least:
                common = len(np.intersect1d(a, b, assume_unique=True))
                if common >= SIMILARITY * (len(a) + len(b) - common) - 1e-9:
                    keep.append(k)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("src").take(at), batch.column("dst").take(at)], names=["src", "dst"])


def _sets(docs: DataFrame, places: DataFrame, shingle: int) -> DataFrame:
    """``node, shingles`` of the documents at ``node, did, rid``."""

    def run(batches):
        for batch in small(batches):
            own = [shingle_set(t, shingle).view(np.int64) for t in byte_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(own, pa.list_(pa.int64()))], names=["node", "shingles"])

    return keyed(docs).join(bounded(places), ["did", "rid"]).select("node", "text").mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def _pair(a: str, b: str):
    return F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")


def links(nodes: DataFrame, docs: DataFrame, shingle: int, bucket: int = BUCKET) -> DataFrame:
    """``src, dst``: nodes of similarity 0.8 or more, enough of them to connect every group."""
    keys = nodes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1")
    marked = materialize(keys.join(shared, "key"), "near-buckets")
    crowded = marked.where(F.col("n") > bucket)
    every = marked.where(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("node").alias("nodes")).mapInArrow(_pairs_in, "src long, dst long")
    star = crowded.where("node <> pivot").select(*_pair("node", "pivot"))
    of = nodes.where(F.size("bands") > 0).groupBy("fp").agg(F.min("node").alias("rep"))
    of = materialize(of, "near-fingerprints")
    near = simhash.close_pairs(of)
    a, b = of.select(F.col("fp").alias("src"), F.col("rep").alias("a")), of.select(F.col("fp").alias("dst"), F.col("rep").alias("b"))
    bits = near.join(a, "src").join(b, "dst").select(*_pair("a", "b"))
    same = nodes.join(of, "fp").where("node <> rep and size(bands) > 0").select(*_pair("node", "rep"))
    candidates = materialize(every.union(star).union(bits).union(same).distinct(), "near-candidates")
    wanted = candidates.select(F.col("src").alias("node")).union(candidates.select("dst")).distinct()
    places = materialize(nodes.join(wanted, "node").select("node", "first.did", "first.rid"), "near-places")
    sets = materialize(_sets(docs, places, shingle), "near-sets")

    def verified(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("node").alias("src"), F.col("shingles").alias("sa"))
        right = sets.select(F.col("node").alias("dst"), F.col("shingles").alias("sb"))
        return pairs.join(left, "src").join(right, "dst").select("src", "dst", "sa", "sb").mapInArrow(_similar, "src long, dst long")

    found = materialize(verified(candidates), "near-links")
    if crowded.isEmpty():
        return found
    group = crowded.join(connected_components(found), "node", "left").select("key", "node", "pivot", F.coalesce("component", "node").alias("group"))
    group = materialize(group, "near-groups")
    home = group.where("node = pivot").select("key", F.col("group").alias("home"))
    away = group.join(home, "key").where("group <> home").select("key", F.col("node").alias("a"), F.col("group").alias("ga"))
    rest = away.join(group.select("key", F.col("node").alias("b"), F.col("group").alias("gb")), "key").where("ga <> gb").select(*_pair("a", "b")).distinct()
    return found.union(verified(rest.join(candidates, ["src", "dst"], "left_anti")))


def representatives(docs: DataFrame, shingle: int = 5, bucket: int = BUCKET) -> DataFrame:
    """``did, rid``: of each group of near copies the smallest."""
    place = F.min(F.struct("did", "rid")).alias("first")
    nodes = materialize(marks(docs, shingle).groupBy("node").agg(place, F.first("fp").alias("fp"), F.first("bands").alias("bands")), "near-nodes")
    group = connected_components(links(nodes, docs, shingle, bucket))
    tagged = nodes.select("node", "first").join(group, "node", "left").withColumn("root", F.coalesce("component", "node"))
    return tagged.groupBy("root").agg(F.min("first").alias("first")).select("first.did", "first.rid")
