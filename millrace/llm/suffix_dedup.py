"""Removal of repeated byte strings by prefix-free parsing.

Texts are UTF-8 bytes.  A rolling hash gives every 16-byte string a value; within every 200 such
values the smallest one triggers a phrase.  So each 400-byte window has one trigger that its content
alone decides, and consecutive windows with the same trigger make one phrase: the bytes of all of
them.  Phrases overlap by a window, hence no phrase is a prefix of another's continuation and equal
windows lie at equal places of phrases with the same trigger context (201 bytes from the trigger on).

The dictionary holds the different phrases with their counts, which is the parse as far as repeats need
it.  Phrases whose trigger context occurs once are unique and leave at once; phrases that occur more than
once repeat whole.  For phrases that share their context with a different phrase the suffixes of the
dictionary are sorted: prefix doubling over the phrases of a context gives each suffix its rank among them by
its first 400 bytes, and suffixes of one rank are repeats.  Every suffix that matters begins inside a phrase and
has its 400 bytes there (phrases overlap by a window), so the dictionary's order decides and no suffix of the
parse has to be sorted; ranks compare bytes, not hashes.  Phrases and contexts are told apart by 128-bit hashes.

A null text is empty.  Texts shorter than the window lose nothing; long texts are parsed in overlapping blocks.
Rows equal in id and text are different documents of the same content and lose all of their windows, like any
exact copies.  Ties of the trigger go to the leftmost.  Other columns are not read, whatever their names.  An empty
table gives no row.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, byte_texts, doc_id_of, in_bitmap, keyed, materialize, small

WINDOW = 400
GRAM = 16
#: Different phrases of one trigger context, beyond which their windows are dealt out one by one.
CROWD = 1000
_BLOCK = 1 << 19
_M = (1 << 64) - 1
_BASE = 0x5851F42D4C957F2D


def _table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTES = _table(1)
_powers: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        size = 1 << max(20, int(n).bit_length())
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers


def rolling_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A value for each string of ``gram`` bytes; it chooses triggers and decides no equality."""
    power, inverse = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * power[: len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * inverse[: len(sums) - gram]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(29)


def suffix_ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes with ``depth`` bytes left by their first ``depth`` bytes; equal ranks are equal bytes.

    Prefix doubling: ranks by eight bytes, then by pairs of ranks.
    """
    n = len(data)
    if n < depth:
        return np.zeros(0, np.int64)
    have = min(8, depth)
    word = np.zeros(n - have + 1, np.uint64)
    for k in range(have):
        word = word << np.uint64(8) | data[k : k + len(word)]
    ranks = np.unique(word, return_inverse=True)[1].astype(np.int64)
    while have < depth:
        step = min(have, depth - have)
        ranks = np.unique(ranks[:-step] << 32 | ranks[step:], return_inverse=True)[1].astype(np.int64)
        have += step
    return ranks


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    out, have = x, 1
    while 2 * have <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if have < width:
        shift = width - have
        out = np.minimum(out[: len(out) - shift], out[shift:])
    return out


def phrases(data: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``first, last`` window starts and ``trigger`` of each phrase of one text (a block of it)."""
    width = window // 2
    n = len(data) - window + 1
    h = rolling_hashes(data, gram)
    at = np.arange(len(h))
    # the leftmost of the smallest: the hash's high bits, then the place
    packed = (h & np.uint64(_M ^ 0xFFFFF)) | at.astype(np.uint64)
    least = _sliding_least(packed, width)[:n]
    trigger = (least & np.uint64(0xFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], trigger[1:] != trigger[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    return first, last, trigger[first]


def _blocks(text: bytes, window: int):
    """Overlapping blocks of a long text: each window lies in exactly one."""
    data = np.frombuffer(text, dtype=np.uint8)
    for s in range(0, max(len(data) - window + 1, 0), _BLOCK):
        yield s, data[s : s + _BLOCK + window - 1]


def _joined(texts: list[bytes], window: int):
    """Groups of texts laid end to end: ``numbers, starts, data``; a long text comes in blocks of its own.

    Windows across texts are the caller's to leave out.
    """
    group: list[tuple[int, int, np.ndarray]] = []
    size = 0
    for i, t in enumerate(texts):
        if len(t) < window:
            continue
        for s, data in _blocks(t, window):
            if size + len(data) > _BLOCK and group:
                yield group
                group, size = [], 0
            group.append((i, s, data))
            size += len(data)
    if group:
        yield group


def phrase_rows(texts: list[bytes], window: int = WINDOW, contents: bool = True):
    """Arrays for all phrases: text number, first window start (in the text), windows, context hash, two halves of the content's hash."""
    width = window // 2
    context = window - width + 1
    for group in _joined(texts, window):
        data = np.concatenate([d for _, _, d in group])
        sizes = np.array([len(d) for _, _, d in group])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        first, last, trigger = phrases(data, window)
        part = np.searchsorted(ends, first, side="right")
        final = np.searchsorted(ends, last, side="right")
        # cut phrases that run from one text into the next, and drop windows that cross an end
        cross = np.flatnonzero(final > part)
        if len(cross):
            more = [(first[c], last[c], trigger[c], p) for c in cross for p in range(part[c], final[c] + 1)]
            keep = np.ones(len(first), bool)
            keep[cross] = False
            first = np.concatenate([first[keep], [max(f, begins[p]) for f, _, _, p in more]]).astype(np.int64)
            last = np.concatenate([last[keep], [min(e, ends[p] - 1) for _, e, _, p in more]]).astype(np.int64)
            trigger = np.concatenate([trigger[keep], [t for _, _, t, _ in more]]).astype(np.int64)
            part = np.concatenate([part[keep], [p for *_, p in more]]).astype(np.int64)
        last = np.minimum(last, ends[part] - window)
        ok = last >= first
        first, last, trigger, part = first[ok], last[ok], trigger[ok], part[ok]
        raw = data.tobytes()
        key = np.array([xxhash.xxh3_64_intdigest(raw[t : t + context]) for t in trigger.tolist()], dtype=np.uint64)
        one = two = None
        if contents:
            digests = b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(first.tolist(), (last + window).tolist(), strict=True)])
            one, two = np.frombuffer(digests, "<u8").reshape(-1, 2).T.copy()
        number = np.array([i for i, _, _ in group])[part]
        offset = np.array([s for _, s, _ in group])[part] - begins[part]
        yield number, first + offset, last - first + 1, key, one, two


def _context_keys(docs: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for batch in small(batches):
            for *_, key, _, _ in phrase_rows(byte_texts(batch.column("text")), window, False):
                own, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], names=["key", "n"])

    return keyed(docs).select("text").mapInArrow(run, "key long, n long")


def shared_phrases(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Occurrences of phrases whose trigger context may occur more than once: ``key, one, two, n, did, rid, at``."""
    repeated = _context_keys(docs, window).groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    words = docs.sparkSession.sparkContext.broadcast(bitmap(repeated, "key"))  # a fixed number of bits

    def run(batches):
        bits = words.value
        for batch in small(batches):
            did, rid = batch.column("did").to_numpy(), batch.column("rid").to_numpy()
            for number, first, n, key, one, two in phrase_rows(byte_texts(batch.column("text")), window):
                k = in_bitmap(bits, key)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[k].view(np.int64), one[k].view(np.int64), two[k].view(np.int64), n[k], did[number[k]], rid[number[k]], first[k])], names=["key", "one", "two", "n", "did", "rid", "at"])

    return keyed(docs).mapInArrow(run, "key long, one long, two long, n long, did long, rid long, at long")


def _windows_of(spans: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner of every window of the spans, and its place in the spans laid end to end."""
    sizes = np.array([len(s) for s in spans])
    count = sizes - window + 1
    owner = np.repeat(np.arange(len(spans)), count)
    return owner, np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(np.cumsum(sizes) - sizes, count)


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def repeated_spans(docs: DataFrame, window: int = WINDOW, crowd: int = CROWD) -> DataFrame:
    """``did, rid, lo, hi``: byte ranges whose every byte is covered by a repeated window."""
    found = materialize(shared_phrases(docs, window), "phrases")
    dictionary = materialize(found.groupBy("key", "one", "two", "n").agg(F.count("*").alias("c"), F.min(F.struct("did", "rid", "at")).alias("first")), "dictionary")
    whole = dictionary.where("c > 1").select("one", "two", "n")
    spans = found.join(whole, ["one", "two", "n"]).select("did", "rid", F.col("at").alias("lo"), (F.col("at") + F.col("n") + (window - 1)).alias("hi"))
    kinds = dictionary.groupBy("key").agg(F.count("*").alias("m"), F.max("c").alias("most")).where("m > 1")
    mixed = materialize(dictionary.join(kinds, "key").select("key", "m", "c", "n", "first.did", "first.rid", "first.at"), "mixed")
    texts = _texts_at(docs, mixed, window)

    def compare(batches):
        """Rows arrive sorted by context; all phrases of a context are compared at once."""
        held: list[tuple] = []
        size = 0

        def settle(rows):
            spans = [r[4] for r in rows]
            owner, start = _windows_of(spans, window)
            ranks = suffix_ranks(np.frombuffer(b"".join(spans), np.uint8), window)[start]
            twice = np.bincount(ranks)[ranks] > 1
            out = []
            edges = np.searchsorted(owner, np.arange(len(rows) + 1))
            for k, (_, did, rid, at, _, c) in enumerate(rows):
                if c == 1:
                    out += [(did, rid, at + a, at + b + window - 1) for a, b in _runs(twice[edges[k] : edges[k + 1]])]
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["did", "rid", "lo", "hi"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "did", "rid", "at", "span", "c")), strict=True):
                if size > 1_000_000 and row[0] != held[-1][0]:
                    yield settle(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield settle(held)

    few = texts.where(F.col("m") <= crowd).drop("m").repartition("key").sortWithinPartitions("key").mapInArrow(compare, "did long, rid long, lo long, hi long")
    out = spans.union(few)
    if not mixed.where(F.col("m") > crowd).isEmpty():
        out = out.union(_crowded(texts.where(F.col("m") > crowd), window))
    return out


def _crowded(texts: DataFrame, window: int) -> DataFrame:
    """The same comparison with every window a row of its own, for contexts with very many different phrases."""

    def expand(batches):
        for batch in batches:
            did, rid, at, c = (batch.column(x).to_numpy() for x in ("did", "rid", "at", "c"))
            spans = batch.column("span").to_pylist()
            for i in range(0, len(spans), 500):
                part = spans[i : i + 500]
                owner, start = _windows_of(part, window)
                raw = b"".join(part)
                h1, h2 = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[x : x + window]) for x in start.tolist()]), "<u8").reshape(-1, 2).T.copy()
                first = np.searchsorted(owner, np.arange(len(part)))
                place = np.arange(len(owner)) - first[owner]
                owner = owner + i
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1.view(np.int64), h2.view(np.int64), did[owner], rid[owner], at[owner] + place, c[owner])], names=["h1", "h2", "did", "rid", "lo", "c"])

    each = materialize(texts.select("did", "rid", "at", "span", "c").mapInArrow(expand, "h1 long, h2 long, did long, rid long, lo long, c long"), "windows")
    twice = each.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    return each.where("c = 1").join(twice, ["h1", "h2"]).select("did", "rid", "lo", (F.col("lo") + window).alias("hi"))


def _texts_at(docs: DataFrame, mixed: DataFrame, window: int) -> DataFrame:
    """``key, m, c, did, rid, at, span`` of the listed phrases, read from their texts."""
    wanted = materialize(mixed.groupBy("did", "rid").agg(F.collect_list(F.struct("key", "m", "c", "n", "at")).alias("at")), "places")

    def run(batches):
        for batch in small(batches):
            did, rid = batch.column("did").to_pylist(), batch.column("rid").to_pylist()
            for i, (t, ats) in enumerate(zip(byte_texts(batch.column("text")), batch.column("at").to_pylist(), strict=True)):
                k = len(ats)
                spans = [t[x["at"] : x["at"] + x["n"] + window - 1] for x in ats]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in ats], pa.int64()) for c in ("key", "m", "c")] + [pa.array([did[i]] * k, pa.int64()), pa.array([rid[i]] * k, pa.int64()), pa.array([x["at"] for x in ats], pa.int64()), pa.array(spans, pa.binary())], names=["key", "m", "c", "did", "rid", "at", "span"])

    own = keyed(docs).join(wanted, ["did", "rid"])
    return own.mapInArrow(run, "key long, m long, c long, did long, rid long, at long, span binary")


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching ranges."""
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, window: int = WINDOW, crowd: int = CROWD) -> DataFrame:
    """``did, rid, n_bytes, spans array<struct<lo, hi>>, kept (bytes)`` of every document."""
    spans = repeated_spans(docs, window, crowd).groupBy("did", "rid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    joined = keyed(docs).join(spans, ["did", "rid"], "left")

    def run(batches):
        for batch in small(batches):
            texts = byte_texts(batch.column("text"))
            runs = [merged([(x["lo"], x["hi"]) for x in s or ()]) for s in batch.column("spans").to_pylist()]
            kept = []
            for t, own in zip(texts, runs, strict=True):
                edge = [0, *[x for r in own for x in r], len(t)]
                kept.append(b"".join([t[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True)]) if own else t)
            spans_array = pa.array([[{"lo": a, "hi": b} for a, b in own] for own in runs], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("rid"), pa.array(list(map(len, texts)), pa.int64()), spans_array, pa.array(kept, pa.binary())], names=["did", "rid", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, "did long, rid long, n_bytes long, spans array<struct<lo: long, hi: long>>, kept binary")


def removal_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""
    done = without_repeats(docs, window)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["hi"] - x["lo"])
    return done.select(doc_id_of(), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


