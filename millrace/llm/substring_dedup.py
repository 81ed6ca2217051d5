"""Removal of word passages that an earlier document has, by relative Lempel-Ziv parsing.

The reference of a document is every document with a smaller id, indexed in blocks.  A rolling hash gives each run of
16 words a value; within every window of 50 words the smallest value is its anchor, and consecutive windows with one
anchor make a block: the words of all of them.  Content alone decides the anchors, so a document's passage can only
match inside blocks of its own anchors, and neighbouring blocks overlap by 49 words.

A document is factored block by block.  A block that an earlier document has too is one factor.  The first holder of a
block factors it greedily against the other blocks of the anchor that begin in earlier documents: the longest match
from the first matching window, then on from the first window that crosses the factor's end, so that passages
over a boundary are found as well.  Factors of at least a window are removed.  An anchor with more than ``CROWD`` different
blocks is indexed by whole windows instead, which an aggregate by content reduces to their first holders before the
shuffle; no anchor's blocks are compared pair by pair.  Blocks (and windows of crowded anchors) are told apart by
128-bit hashes of their words; within an anchor words are compared.

A null or empty text has no words.  A null id is smaller than all others.  Rows of one id never match each other, equal
or not.  Texts shorter than the window lose nothing; long texts are parsed in overlapping pieces.  Equal values of an
anchor go to the leftmost.  Other columns are not read, whatever their names.  An empty table gives no row.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, byte_texts, doc_id_of, in_bitmap, keyed, materialize, small
from .suffix_dedup import _BYTES, _power, _sliding_least, merged

WINDOW = 50
GRAM = 16
#: Different blocks of one anchor, beyond which their windows are dealt out one by one.
CROWD = 500
_PIECE = 1 << 18


def _pieces(text: bytes, window: int):
    """``first word, words`` of a text's pieces: each window lies in exactly one."""
    words = text.split()
    step = max(_PIECE // 8, window)
    for s in range(0, max(len(words) - window + 1, 0), step):
        yield s, words[s : s + step + window - 1]


def _laid(texts: list[bytes], window: int):
    """Groups of pieces to be laid end to end, about ``_PIECE`` bytes each."""
    group, size = [], 0
    for i, text in enumerate(texts):
        for s, words in _pieces(text, window):
            group.append((i, s, words))
            size += sum(map(len, words)) + len(words)
            if size > _PIECE:
                yield group
                group, size = [], 0
    if group:
        yield group


def block_rows(texts: list[bytes], window: int = WINDOW, gram: int = GRAM):
    """For groups of texts: text number, first word, number of windows and anchor key of each block, the words' bytes and each block's range in them."""
    for group in _laid(texts, window):
        raw = b" ".join([b" ".join(words) for _, _, words in group])
        data = np.frombuffer(raw, np.uint8)
        start = np.concatenate([[0], np.flatnonzero(data == 32) + 1, [len(data) + 1]])
        power, inverse = _power(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * power[: len(data)], out=sums[1:])
        n = len(start) - 1
        h = (sums[start[gram:] - 1] - sums[start[: n - gram + 1]]) * inverse[start[: n - gram + 1]]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        # the leftmost of the smallest: the hash's high bits, then the place
        packed = (h & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(len(h), dtype=np.uint64)
        anchor = (_sliding_least(packed, window - gram + 1) & np.uint64(0xFFFFF)).astype(np.int64)
        counts = np.array([len(words) for _, _, words in group])
        owner = np.repeat(np.arange(len(group)), counts)
        own = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :])  # windows within one piece
        new = np.concatenate([[True], (np.diff(own) > 1) | (np.diff(anchor[own]) != 0)])
        at = np.flatnonzero(new)
        first, last = own[at], own[np.concatenate([at[1:], [len(own)]]) - 1]
        piece = owner[first]
        begin = np.cumsum(counts) - counts
        number = np.array([i for i, _, _ in group])[piece]
        place = np.array([s for _, s, _ in group])[piece] + first - begin[piece]
        yield number, place, last - first + 1, h[anchor[first]], raw, start[first], start[last + window] - 1


def _digests(raw: bytes, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Two longs for each range of the bytes."""
    each = b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
    return np.frombuffer(each, "<i8").reshape(-1, 2).T.copy()


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=names.split())


def reference_blocks(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Blocks whose anchor may occur more than once, with their place: ``key, one, two, n, did, rid, at``."""

    def keys(batches):
        for batch in small(batches):
            for _, _, _, key, *_ in block_rows(byte_texts(batch.column("text")), window):
                own, n = np.unique(key, return_counts=True)
                yield _batch("key n", own.view(np.int64), n)

    repeated = keyed(docs).select("text").mapInArrow(keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    words = docs.sparkSession.sparkContext.broadcast(bitmap(repeated, "key"))  # a fixed number of bits

    def run(batches):
        for batch in small(batches):
            did, rid = batch.column("did").to_numpy(), batch.column("rid").to_numpy()
            for number, place, n, key, raw, lo, hi in block_rows(byte_texts(batch.column("text")), window):
                k = in_bitmap(words.value, key)
                one, two = _digests(raw, lo[k], hi[k])
                yield _batch("key one two n did rid at", key[k].view(np.int64), one, two, n[k], did[number[k]], rid[number[k]], place[k])

    return keyed(docs).mapInArrow(run, "key long, one long, two long, n long, did long, rid long, at long")


def _mark(one, rid, at):
    """What a bitmap knows an occurrence by; the same in Spark and numpy."""
    if isinstance(one, np.ndarray):
        return one.view(np.uint64) ^ rid.view(np.uint64) ^ (at.astype(np.uint64) << np.uint64(40))
    return one.bitwiseXOR(rid).bitwiseXOR(F.shiftleft(at, 40))


def _words_of(docs: DataFrame, blocks: DataFrame, window: int) -> DataFrame:
    """The words of the listed occurrences ``one, did, rid, at``: ``key, one, two, n, did, span``; some others may come with them."""
    marks = docs.sparkSession.sparkContext.broadcast(bitmap(blocks.select(_mark(F.col("one"), F.col("rid"), F.col("at")).alias("h")), "h"))

    def run(batches):
        for batch in small(batches):
            did, rid = batch.column("did").to_numpy(), batch.column("rid").to_numpy()
            for number, place, n, key, raw, lo, hi in block_rows(byte_texts(batch.column("text")), window):
                one, two = _digests(raw, lo, hi)
                k = np.flatnonzero(in_bitmap(marks.value, _mark(one, rid[number], place)))
                spans = [raw[a:b] for a, b in zip(lo[k].tolist(), hi[k].tolist(), strict=True)]
                yield _batch("key one two n did span", key[k].view(np.int64), one[k], two[k], n[k], did[number[k]], pa.array(spans, pa.binary()))

    return keyed(docs).mapInArrow(run, "key long, one long, two long, n long, did long, span binary")


def _starts(span: bytes) -> list[int]:
    out = [0]
    for w in span.split(b" "):
        out.append(out[-1] + len(w) + 1)
    return out


def factors(blocks: list[tuple[int, bytes]], window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """For ``(did, words)`` of one anchor, ascending by did: the word ranges of each that factors against smaller dids cover."""
    index: dict[bytes, tuple[bytes, list[int], int]] = {}
    out: list[list[tuple[int, int]]] = []
    for _, same in groupby(blocks, key=lambda b: b[0]):
        later = []
        for _, span in same:
            at, own, s = _starts(span), [], 0
            n = len(at) - window
            while s < n:
                found = index.get(span[at[s] : at[s + window] - 1])
                if found is None:
                    s += 1
                    continue
                other, there, p = found
                more = 0  # words beyond the window on which both go on alike
                while s + window + more < len(at) - 1 and p + window + more < len(there) - 1 and span[at[s + window + more] : at[s + window + more + 1] - 1] == other[there[p + window + more] : there[p + window + more + 1] - 1]:
                    more += 1
                own.append((s, s + window + more))
                s += more + 1  # the first window that crosses the factor's end
            out.append(own)
            later.append((span, at))
        for span, at in later:
            for s in range(len(at) - window):
                index.setdefault(span[at[s] : at[s + window] - 1], (span, at, s))
    return out


_FACTORS = "one long, two long, n long, did long, lo long, hi long"


def _factored(blocks: DataFrame, window: int) -> DataFrame:
    """Factors within each anchor, whose blocks meet in one task."""

    def settle(rows):
        # a block may come twice, its first holder and one that the bitmap let through
        rows.sort(key=lambda r: (r[4], r[1], r[2]))
        found = [(*r[1:5], a, b) for r, own in zip(rows, factors([(r[4], r[5]) for r in rows], window), strict=True) for a, b in own]
        return found

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[-1][0]:
                    out += settle(held)
                    held = []
                held.append(row)
            yield _batch("one two n did lo hi", *([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] or [pa.array([], pa.int64())] * 6))
        if held:
            out = settle(held)
            yield _batch("one two n did lo hi", *([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] or [pa.array([], pa.int64())] * 6))

    return blocks.select("key", "one", "two", "n", "did", "span").repartition("key").sortWithinPartitions("key").mapInArrow(run, _FACTORS)


def _crowded(blocks: DataFrame, window: int) -> DataFrame:
    """The same for crowded anchors: each window goes to the first document that has it."""

    def run(batches):
        for batch in batches:
            for one, two, n, did, span in zip(*(batch.column(c).to_pylist() for c in ("one", "two", "n", "did", "span")), strict=True):
                at = np.array(_starts(span))
                lo = np.arange(n)
                h1, h2 = _digests(span, at[lo], at[lo + window] - 1)
                yield _batch("h1 h2 one two n did lo", h1, h2, *(np.full(n, x) for x in (one, two, n, did)), lo)

    each = materialize(blocks.mapInArrow(run, "h1 long, h2 long, one long, two long, n long, did long, lo long"), "windows")
    first = each.groupBy("h1", "h2").agg(F.min("did").alias("low"), F.max("did").alias("high")).where("low < high").select("h1", "h2", "low")
    return each.join(first, ["h1", "h2"]).where("low < did").select("one", "two", "n", "did", "lo", (F.col("lo") + window).alias("hi"))


def duplicate_spans(docs: DataFrame, window: int = WINDOW, crowd: int = CROWD) -> DataFrame:
    """``did, rid, lo, hi``: word ranges whose every word is covered by a window of an earlier document."""
    found = materialize(reference_blocks(docs, window), "occurrences")
    blocks = materialize(found.groupBy("key", "one", "two", "n").agg(F.count("*").alias("c"), F.min(F.struct("did", "rid", "at")).alias("first"), F.max("did").alias("high")), "blocks")
    kinds = blocks.groupBy("key").agg(F.count("*").alias("m"), F.min("first.did").alias("low"), F.max("first.did").alias("high")).where("m > 1 AND low < high").select("key", "m")
    mixed = materialize(blocks.join(kinds, "key").select("m", "one", "two", "n", "first.did", "first.rid", "first.at"), "mixed")
    spans = _words_of(docs, mixed, window).join(mixed.select("m", "one", "two", "n", "did"), ["one", "two", "n", "did"])
    if mixed.where(F.col("m") > crowd).isEmpty():
        parts = _factored(spans, window)
    else:
        spans = materialize(spans, "spans")
        parts = _factored(spans.where(F.col("m") <= crowd), window).union(_crowded(spans.where(F.col("m") > crowd), window))
    parts = parts.groupBy("one", "two", "n", "did").agg(F.collect_list(F.struct("lo", "hi")).alias("parts"))
    known = blocks.select("one", "two", "n", F.col("first.did").alias("low"), "high").join(parts.withColumnRenamed("did", "low"), ["one", "two", "n", "low"], "left").where("low < high OR parts IS NOT NULL")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("lo"), (F.col("n") + (window - 1)).alias("hi")))
    each = found.join(known, ["one", "two", "n"]).withColumn("part", F.explode(F.when(F.col("did") > F.col("low"), whole).otherwise(F.col("parts"))))
    return each.select("did", "rid", (F.col("at") + F.col("part.lo")).alias("lo"), (F.col("at") + F.col("part.hi")).alias("hi"))


def without_repeats(docs: DataFrame, window: int = WINDOW, crowd: int = CROWD) -> DataFrame:
    """``did, rid, n_words, spans array<struct<lo, hi>> (removed word ranges), kept (words joined by a space)`` of every document."""
    spans = duplicate_spans(docs, window, crowd).groupBy("did", "rid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    joined = keyed(docs).join(spans, ["did", "rid"], "left")

    def run(batches):
        for batch in small(batches):
            runs = [merged([(x["lo"], x["hi"]) for x in s or ()]) for s in batch.column("spans").to_pylist()]
            kept, sizes = [], []
            for text, own in zip(byte_texts(batch.column("text")), runs, strict=True):
                words = text.split()
                sizes.append(len(words))
                edge = [0, *[x for r in own for x in r], len(words)]
                kept.append(b" ".join([w for a, b in zip(edge[::2], edge[1::2], strict=True) for w in words[a:b]]))
            cut = pa.array([[{"lo": a, "hi": b} for a, b in own] for own in runs], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
            yield _batch("did rid n_words spans kept", batch.column("did"), batch.column("rid"), pa.array(sizes, pa.int64()), cut, pa.array(kept, pa.binary()))

    return joined.mapInArrow(run, "did long, rid long, n_words long, spans array<struct<lo: long, hi: long>>, kept binary")


def removal_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document."""
    done = without_repeats(docs, window)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["hi"] - x["lo"])
    return done.select(doc_id_of(), "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
