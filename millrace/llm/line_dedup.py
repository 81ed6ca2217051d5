"""Fuzzy line deduplication: SimHash of normalised lines, join on pigeonhole blocks, verify edit
similarity, keep one occurrence of each connected group.

A line's form is lower case without ASCII punctuation, its words joined by single spaces (the stripped
line itself if no word is left).  Lines of one form are equal.  A form has a SimHash over its different words.  Its blocks are,
by its length: for up to ``SHORT`` characters the line less each of its characters; for up to ``THIRDS`` characters each third of ``LEAST_THIRD`` and more; for 3 to 11 words the line less each of its
words of up to ``PART`` of its letters; for fewer than 12 words also the SimHashes of up to six runs of words; for 6 words and more every two near
ones of the twelve smallest hashes of its pairs of neighbouring words, pairs of long words first.  By the pigeonhole principle one changed character of a
short line, two replaced ones, one changed word of a line of 3 to 11 words, or edits that leave a run whole, leave a block equal.  Two forms
are linked if they share a block, their SimHashes differ in at most ``DISTANCE`` bits (forms of up to ``SHORT`` characters: in any number) and their edit similarity is at least 0.8.
Of each group of linked forms the first occurrence in (doc_id, text hash, line number) order stays, all others are removed.

Inside a block's bucket each member is first compared with the nearest ones by SimHash.  Only members that this leaves in
different groups are then compared with each other, where the forms are; groups that a link joins are one from then on.  So
a bucket gives no more links than it has members, and no link between groups is lost.  A bucket of more than ``CROWD`` forms is dealt out again by the blocks of the
whole SimHash that two forms within ``DISTANCE`` bits must share; only unlike forms that agree there as well
are compared in full.

Blank lines always stay.  A null text has no line and stays null.  Of rows equal in id and text all but one lose
their lines.  Repeated lines inside a document count like any other; ties in the order are equal lines.  Long
lines are compared whole.  Columns of the input keep their names whatever they are.  Empty tables give empty
results.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, bitmap_place, bitmap_words, connected_components, discard, free_name, in_bitmap, keyed, marked_copies, materialize, small, with_keys
from .suffix_dedup import _BYTES, _power

DISTANCE = 22
SIMILARITY = 0.8
#: Runs of words that have a block of their own, and the least words of a run.
PARTS, LEAST_PART = 6, 3
#: Characters of a line that is also looked up less each of them; words of one that is looked up less each of those (from, to).
SHORT, FEW = 32, (3, 12)
#: Share of a line's letters that a word may have whose replacement can leave lines alike.
PART = 0.3
#: Characters of a line that is also looked up by its thirds, and of a third: shorter ones are common, and their lines have fewer edits.
THIRDS, LEAST_THIRD = 48, 9
#: Lines of so many words and more have pairs of neighbouring words as blocks, two at a time: those of so many smallest hashes,
#: so far apart in their order (the second number for lines of fewer than ``FEW[1]`` words).
PAIRED, PAIRS, REACH = 6, 12, (3, 4)
#: Letters of two words that make them a long pair.
LONG_PAIR = 9
#: Forms in one bucket beyond which it is dealt out again by the whole SimHash; how often.
CROWD, LEVELS = 16384, 2
#: Forms a task remembers in order to describe each only once; forgetting them changes no result.
SEEN = 500_000

#: Pairs that are held against the lower bound together; pieces of a form in it, and the lanes that stand for its characters.
TOGETHER, PIECE, LANES = 20_000, 64, 32
#: Keys that a task sorts at once to count them; bits of a key that the bitmap of those with two forms goes by, and of those that deal the counting.
HELD, KEY_BITS, PART_BITS = 4_000_000, 27, 12
#: Characters of the longest forms whose distances are computed many at a time, and of the longest held against the lower bound.
AT_ONCE, BOUNDED = 2048, 8192
#: Rows of a bucket up to which all buckets of a size are looked at together.
FEW_ROWS = 48
#: Pieces that are moved along their ranges together.
ROWS = 4096

_PUNCTUATION = frozenset(string.punctuation.encode()[i : i + 1] for i in range(len(string.punctuation)))
_PLAIN = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
#: Lengths of runs, each about double: a line with a word more or less mostly has runs of the same length.
_LADDER = [LEAST_PART]
while _LADDER[-1] < 1 << 40:
    _LADDER.append(_LADDER[-1] * 2 + 1)
_LADDER = np.array(_LADDER)
#: A byte's eight bits as eight bytes, so that eight counts are added at once.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()
#: Words that are left out of both lines together, at most, before they agree again.
_AHEAD = 12
_MIX = np.uint64(0x9E3779B97F4A7C15)


def form(line: str) -> bytes:
    """The normalised line; empty for a blank one."""
    words = line.lower().encode().translate(_PLAIN).split()
    return b" ".join(words) if words else line.strip(" \t\n\r\x0b\x0c").encode()


def forms_of(text: str) -> list[tuple[int, bytes]]:
    """``line number, form`` of the lines that are not blank."""
    out, raw = [], None
    for k, line in enumerate(text.lower().encode().translate(_PLAIN).split(b"\n")):
        words = line.split()
        if words:
            out.append((k, b" ".join(words)))
        else:
            raw = raw or text.split("\n")
            if own := raw[k].strip(" \t\n\r\x0b\x0c"):
                out.append((k, own.encode()))
    return out


def _majority(lanes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Majority bits of the words ``start[i]:end[i]``; runs of up to 255 words."""
    edges = np.stack([start, end], axis=1).ravel()
    sums = np.add.reduceat(lanes, edges, axis=0)[::2].view(np.uint8)
    return np.packbits(2 * sums.astype(np.uint16) > (end - start)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _coded(forms: list[bytes]):
    """Forms in lots: ``start, end``, the number of each word in the list of the lot's different words, how many words each form has, and that list."""
    ends = np.cumsum(np.fromiter(map(len, forms), np.int64, len(forms)) + 1)
    start = 0
    while start < len(forms):
        end = min(int(np.searchsorted(ends, (ends[start - 1] if start else 0) + (1 << 20))) + 1, len(forms))
        parts = pc.split_pattern(pa.array(forms[start:end], pa.binary()), b" ")
        words = parts.flatten().dictionary_encode()
        yield start, end, words.indices.to_numpy(), np.diff(parts.offsets.to_numpy()), words.dictionary.to_numpy(zero_copy_only=False).tolist()
        start = end


def blocks_of(forms: list[bytes], runs: bool | np.ndarray = True, coded=None) -> tuple[np.ndarray, np.ndarray]:
    """Each form's SimHash over its words, and the keys of its runs of words (a row for each form, 0 for none); ``runs``: for which forms."""
    runs = np.broadcast_to(runs, len(forms))
    whole, keys = np.zeros(len(forms), np.uint64), np.zeros((len(forms), PARTS), np.uint64)
    for start, end, word, n, different in _coded(forms) if coded is None else coded:
        digests = np.frombuffer(b"".join(map(xxhash.xxh64_digest, different)), np.uint8).reshape(-1, 8)[:, ::-1]
        lanes = _SPREAD[digests]
        # the whole SimHash counts a word once, else the most common words would make unlike lines look alike
        own = np.sort(np.repeat(np.arange(len(n), dtype=np.uint64) << np.uint64(32), n) | word.astype(np.uint64))
        own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        edge = np.searchsorted(own, np.arange(len(n), dtype=np.uint64) << np.uint64(32))
        n_once = np.diff(np.append(edge, len(own)))
        distinct = np.concatenate([lanes[(own & np.uint64(0xFFFFFFFF)).astype(np.int64)], np.zeros((1, 8), np.uint64)])
        low = np.flatnonzero(n_once < 256)
        whole[start + low] = _majority(distinct, edge[low], edge[low] + n_once[low])
        for i in np.flatnonzero(n_once >= 256):
            counts = np.zeros(64, np.int64)
            for a in range(edge[i], edge[i] + n_once[i], 255):
                counts += distinct[a : min(a + 255, edge[i] + n_once[i])].sum(axis=0).view(np.uint8)
            whole[start + i] = np.packbits(2 * counts > n_once[i], bitorder="little").view("<u8")[0]
        with_runs = np.flatnonzero(runs[start:end])
        lanes = np.concatenate([lanes[word[np.repeat(runs[start:end], n)]], np.zeros((1, 8), np.uint64)])
        n = n[with_runs].astype(np.int64)
        at = np.cumsum(n) - n
        size = np.minimum(_LADDER[np.searchsorted(_LADDER, np.maximum(n // PARTS, LEAST_PART), side="right") - 1], n)
        for p in range(PARTS):
            k = p // 2 + 1
            own = np.flatnonzero(k * size <= n)
            a = at[own] + ((k - 1) * size[own] if p % 2 == 0 else n[own] - k * size[own])
            # the first words stand for a run that is longer than the counts allow
            value = _majority(lanes, a, a + np.minimum(size[own], 255))
            keys[start + with_runs[own], p] = (value ^ np.uint64(p + 1)) * _MIX | np.uint64(1)
    # only a form without words begins with punctuation and may have other blanks than single spaces
    odd = [i for i, f in enumerate(forms) if f[:1] in _PUNCTUATION and f != b" ".join(f.split())]
    if odd:
        whole[odd], keys[odd] = blocks_of([b" ".join(forms[i].split()) for i in odd], runs[odd])
    return whole, keys


def _few_words(words: np.ndarray, length: np.ndarray, start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For lines of ``n`` words: number of the line and key of the line and of the line less each word of up to ``PART`` of its letters."""
    w, size = words[start[:, None] + np.arange(n)], length[start[:, None] + np.arange(n)]
    owner, out = [], []
    for gone in range(n + 1):
        own = np.arange(len(start)) if gone == n else np.flatnonzero(size[:, gone] <= PART * size.sum(axis=1))
        key = np.full(len(own), n - (gone < n), np.uint64)
        for i in range(n):
            if i != gone:
                key = (key ^ w[own, i]) * _MIX
                key ^= key >> np.uint64(29)
        owner.append(own)
        out.append(key)
    return np.concatenate(owner), np.concatenate(out)


def _short_line(text: str) -> set[int]:
    """Keys of a short line's thirds, of the line itself and, up to ``SHORT`` characters, of the line less each of its characters."""
    third = len(text) // 3
    parts = [f"{k} {text[k * third : (k + 1) * third]}" for k in range(2)] + [f"2 {text[len(text) - third :]}"] if third >= LEAST_THIRD else []
    less = (text[:i] + text[i + 1 :] for i in range(len(text))) if len(text) <= SHORT else ()
    return {xxhash.xxh64_intdigest(x, 3) for x in (text, *less)} | {xxhash.xxh64_intdigest(x, 4) for x in parts}


def more_blocks(forms: list[bytes], coded=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of the form and key of blocks that also hold when every run of words has an edit; number of the form and value of word pairs.

    A line of up to ``SHORT`` characters: the line less each of its characters; of up to ``THIRDS``: each third.  One of 3 to 11
    words: the line less each of its words.  One of 6 words and more: the smallest hashes of its pairs of neighbouring words in order.
    """
    owner, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    paired, values = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for i, form in enumerate(forms):
        if len(form) > 4 * THIRDS or len(text := form.decode()) > THIRDS:
            continue
        own = _short_line(text)
        owner.append(np.full(len(own), i))
        keys.append(np.fromiter(own, np.uint64, len(own)))
    for start, end, word, n, different in _coded(forms) if coded is None else coded:
        data = np.frombuffer(b"".join(different), np.uint8)
        power, inverse = _power(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * power[: len(data)], out=sums[1:])
        sizes = np.fromiter(map(len, different), np.int64, len(different))
        stop = np.cumsum(sizes)
        begin = stop - sizes
        words = (sums[stop] - sums[begin]) * inverse[begin]
        words = (words ^ words >> np.uint64(31)) * _MIX
        words ^= words >> np.uint64(30)
        words, length = words[word], sizes[word]
        first = np.cumsum(n) - n
        for k in range(FEW[0], FEW[1]):
            at = np.flatnonzero(n == k)
            if len(at):
                own, less = _few_words(words, length, first[at], k)
                owner.append(at[own] + start)
                keys.append(less)
        if (n >= PAIRED).any():
            line = np.repeat(np.arange(len(n)), n)
            pair = (words[:-1] * np.uint64(3) + words[1:]) * _MIX
            pair ^= pair >> np.uint64(32)
            # pairs of short words are common in any language: they come last
            pair = pair >> np.uint64(1) | (length[:-1] + length[1:] < LONG_PAIR).astype(np.uint64) << np.uint64(63)
            inside = np.flatnonzero((line[1:] == line[:-1]) & (n[line[1:]] >= PAIRED))
            # the line above, the hash below: one sort gives each line's smallest
            code = np.sort(line[inside].astype(np.uint64) << np.uint64(44) | pair[inside] >> np.uint64(20))
            code = code[np.concatenate([[True], code[1:] != code[:-1]])]
            own = (code >> np.uint64(44)).astype(np.int64)
            least = np.arange(len(own)) - np.searchsorted(own, own) < PAIRS
            paired.append(own[least] + start)
            values.append(code[least] & np.uint64((1 << 44) - 1))
    return tuple(np.concatenate(x) for x in (owner, keys, paired, values))


def _two_at_a_time(paired: np.ndarray, values: np.ndarray, few: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the form and key of every two near word pairs; ``few``: whether a form has less than ``FEW[1]`` words."""
    first = np.flatnonzero(np.concatenate([[True], paired[1:] != paired[:-1]])) if len(paired) else np.zeros(0, np.int64)
    held, form = np.diff(np.append(first, len(paired))), paired[first]
    value = values * _MIX
    owner, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for i in range(PAIRS):
        for j in range(i + 1, min(i + 1 + REACH[1], PAIRS)):
            on = (held > j) & ((j - i <= REACH[0]) | few[form])
            both = (value[first[on] + i] * np.uint64(3) + value[first[on] + j]) * _MIX
            owner.append(form[on])
            keys.append(both ^ both >> np.uint64(31))
    return np.concatenate(owner), np.concatenate(keys)


def described_blocks(forms: list[bytes]) -> tuple[np.ndarray, np.ndarray, tuple, tuple]:
    """Each form's SimHash, whether it has few words, and its keys and its word pairs: values, and where each form's begin."""
    coded = list(_coded(forms))
    few = np.concatenate([np.zeros(0, bool), *(n < FEW[1] for _, _, _, n, _ in coded)])
    fp, runs = blocks_of(forms, few, coded)
    at, place = np.nonzero(runs)
    more, keys, paired, values = more_blocks(forms, coded)
    owner, keys = np.concatenate([at, more]), np.concatenate([runs[at, place], keys])
    order = np.argsort(owner.astype(np.uint16) if len(forms) <= 1 << 16 else owner, kind="stable")  # small numbers are sorted by their digits
    ends = lambda own: np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(forms)))])
    return fp, few, (keys[order], ends(owner)), (values, ends(paired))


def expanded(few: np.ndarray, keys: np.ndarray, ends: np.ndarray, values: np.ndarray, pair_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the form and key of all blocks, in any order; a form with equal words may have a key twice."""
    number = np.arange(len(few))
    own, both = _two_at_a_time(np.repeat(number, np.diff(pair_ends)), values, few)
    return np.concatenate([np.repeat(number, np.diff(ends)), own]), np.concatenate([keys, both])


def all_blocks(forms: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each form's SimHash; the keys of all its blocks, and where each form's begin."""
    fp, few, (keys, ends), (values, pair_ends) = described_blocks(forms)
    owner, keys = expanded(few, keys, ends, values, pair_ends)
    owner, keys = np.unique(np.stack([owner.astype(np.uint64), keys]), axis=1)
    return fp, keys, np.concatenate([[0], np.cumsum(np.bincount(owner.astype(np.int64), minlength=len(forms)))])


_LINES = "did long, rid long, line int, node long, fp long, chars int, few boolean, keys binary, pairs binary, form string"


def lines(docs: DataFrame) -> DataFrame:
    """``did, rid, line, node (hash of the form)`` of every line that is not blank; where a task meets a form first, also ``fp, chars, few, keys, pairs, form``."""

    def run(batches):
        seen: set[int] = set()
        for batch in small(batches):
            did, rid, texts = batch.column("did").to_numpy(), batch.column("rid").to_numpy(), batch.column("text").to_pylist()
            owner, number, forms = [], [], []
            for i, t in enumerate(texts):
                for k, f in forms_of(t or ""):
                    owner.append(i)
                    number.append(k)
                    forms.append(f)
                if forms and (len(forms) > 20_000 or i == len(texts) - 1):
                    nodes = [xxhash.xxh64_intdigest(f, 7) for f in forms]
                    new = []
                    for j, x in enumerate(nodes):
                        if x not in seen:
                            seen.add(x)
                            new.append(j)
                    if len(seen) > SEEN:
                        seen = set()
                    fresh = [forms[j] for j in new]
                    fp, few, *lists = described_blocks(fresh)
                    texts_of = [f.decode() for f in fresh]
                    place = np.full(len(forms), -1, np.int64)
                    place[new] = np.arange(len(new))
                    take = pa.array(place, mask=place < 0)
                    lists = [pa.Array.from_buffers(pa.binary(), len(fresh), [None, pa.py_buffer((8 * ends).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))]) for values, ends in lists]
                    described = [pa.array(fp.view(np.int64)), pa.array([len(t) for t in texts_of], pa.int32()), pa.array(few), *lists, pa.array(texts_of, pa.string())]
                    at = np.array(owner)
                    yield pa.RecordBatch.from_arrays([pa.array(did[at]), pa.array(rid[at]), pa.array(number, pa.int32()), pa.array(np.array(nodes, np.uint64).view(np.int64)), *[c.take(take) for c in described]], names=["did", "rid", "line", "node", "fp", "chars", "few", "keys", "pairs", "form"])
                    owner, number, forms = [], [], []

    return keyed(docs).mapInArrow(run, _LINES)


def _near(fp: np.ndarray, chars: np.ndarray, i, j) -> np.ndarray:
    """Whether forms may be alike by their SimHashes and lengths."""
    low, high = np.minimum(chars[i], chars[j]), np.maximum(chars[i], chars[j])
    return ((np.bitwise_count(fp[i] ^ fp[j]) <= DISTANCE) | (high <= SHORT)) & (low >= SIMILARITY * high - 1e-9)


def _nearest(fp: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of one bucket with the nearest one before them, and with the nearest of all, as far as they may be alike."""
    n, a, b = len(fp), [], []
    step = max(1, 2_000_000 // n)
    for i in range(0, n, step):
        own = np.arange(i, min(i + step, n))
        bits = np.where(_near(fp, chars, own[:, None], np.arange(n)[None, :]), np.bitwise_count(fp[own][:, None] ^ fp[None, :]), 255).astype(np.uint8)
        bits[np.arange(len(own)), own] = 255
        for _ in range(2):
            to = bits.argmin(axis=1)
            near = bits[np.arange(len(own)), to] < 255
            a.append(own[near])
            b.append(to[near])
            bits[np.arange(n)[None, :] > own[:, None]] = 255
    a, b = np.concatenate(a), np.concatenate(b)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pairs[0], pairs[1]


def _alike_sized(start: np.ndarray, size: np.ndarray, most: int):
    """The first rows of small buckets of one size, and that size, as far as they may be held together."""
    for n in np.unique(size[size <= most]).tolist():
        own = start[size == n]
        step = max(1, 1_000_000 // (n * n))
        for i in range(0, len(own), step):
            yield own[i : i + step], n


def _nearest_in(fp: np.ndarray, chars: np.ndarray, start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``_nearest`` for all buckets of ``n`` rows that begin at ``start``."""
    at = start[:, None] + np.arange(n)
    own, size = fp[at], chars[at]
    low, high = np.minimum(size[:, :, None], size[:, None, :]), np.maximum(size[:, :, None], size[:, None, :])
    bits = np.bitwise_count(own[:, :, None] ^ own[:, None, :])
    bits[~(((bits <= DISTANCE) | (high <= SHORT)) & (low >= SIMILARITY * high - 1e-9))] = 255
    bits[:, np.arange(n), np.arange(n)] = 255
    found = []
    for _ in range(2):
        to = bits.argmin(axis=2)
        bucket, i = np.nonzero(bits.min(axis=2) < 255)
        j = to[bucket, i]
        found.append((bucket * n + np.minimum(i, j)) * n + np.maximum(i, j))
        bits[:, np.arange(n)[None, :] > np.arange(n)[:, None]] = 255
    found = np.unique(np.concatenate(found))
    first = start[found // (n * n)]
    return first + found // n % n, first + found % n


def _across_in(fp: np.ndarray, chars: np.ndarray, group: np.ndarray, start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ``_across`` in all buckets of ``n`` rows that begin at ``start``."""
    i, j = np.triu_indices(n, 1)
    i, j = (start[:, None] + i).ravel(), (start[:, None] + j).ravel()
    other = np.flatnonzero(group[i] != group[j])
    i, j = i[other], j[other]
    near = _near(fp, chars, i, j)
    return i[near], j[near]


def _all_across(fp: np.ndarray, chars: np.ndarray, group: np.ndarray, start: np.ndarray, size: np.ndarray):
    """Pairs of rows of one bucket and different groups that may be alike, a lot at a time."""
    for own, n in _alike_sized(start, size, FEW_ROWS):
        yield _across_in(fp, chars, group, own, n)
    for s, n in zip(start[size > FEW_ROWS].tolist(), size[size > FEW_ROWS].tolist(), strict=True):
        for i, js in _across(fp[s : s + n], chars[s : s + n], group[s : s + n]):
            yield np.full(len(js), s + i), s + js


def _across(fp: np.ndarray, chars: np.ndarray, group: np.ndarray):
    """Each member outside the largest group with those of other groups that may be like it; no pair twice."""
    order = np.argsort(chars, kind="stable")
    fp, chars = fp[order], chars[order]
    _, inverse, n = np.unique(group[order], return_inverse=True, return_counts=True)
    other = inverse != np.argmax(n)
    at = np.flatnonzero(other)
    low = np.searchsorted(chars, SIMILARITY * chars[at] - 1e-9)
    high = np.searchsorted(chars, (chars[at] + 1e-9) / SIMILARITY, side="right")
    short = int(np.searchsorted(chars, SHORT, side="right"))
    for i, a, b in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
        near = np.bitwise_count(fp[a:b] ^ fp[i]) <= DISTANCE
        if i < short:
            near[: short - a] = True
        j = np.flatnonzero(near) + a
        j = j[(inverse[j] != inverse[i]) & (~other[j] | (j > i))]
        if len(j):
            yield int(order[i]), order[j]


def _letters(lanes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How often the characters of each of ``LANES`` lanes are in each form: an edit takes one away and adds one at most."""
    owner = np.repeat(np.arange(len(ends) - 1) * LANES, np.diff(ends))
    return np.bincount(owner + lanes, minlength=LANES * (len(ends) - 1)).reshape(-1, LANES)


def _least_edits(lanes: np.ndarray, start, size, begin, end) -> np.ndarray:
    """The least edit distance of each piece ``start, size`` (of up to 64 characters) to any substring of ``begin:end``; lanes stand for characters.

    Bit-parallel, all pieces at once: a step takes the next character of every piece's range.
    """
    number, one = np.arange(len(start)), np.uint64(1)
    table = np.zeros((len(start), LANES + 1), np.uint64)  # the last lane is in no piece: it goes on where a range has ended
    for t in range(int(size.max())):
        own = number[size > t]
        table[own, lanes[start[own] + t]] |= one << np.uint64(t)
    table, row = table.ravel(), number * (LANES + 1)
    up, down = np.full(len(start), ~np.uint64(0)), np.zeros(len(start), np.uint64)
    last, score = (size - 1).astype(np.uint64), size.astype(np.int64)
    best = score.copy()
    for t in range(int((end - begin).max())):
        at = begin + t
        eq = table[row + np.where(at < end, lanes[np.minimum(at, len(lanes) - 1)], LANES)]
        across = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(across | up), up & across
        score += (plus >> last & one).astype(np.int64) - (minus >> last & one).astype(np.int64)
        np.minimum(best, score, out=best)
        plus, eq = plus << one, eq | down
        up = minus << one | ~(eq | plus)
        down = plus & eq
    return best


def maybe_alike(forms: list[str], chars: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """False for pairs ``a, b`` of forms whose edit similarity is surely under 0.8.

    Two lower bounds of the edit distance: the characters that one form has more often, and the sum over pieces of 64 characters of the
    first form of each piece's least distance to any part of the second form that it may meet within the edits allowed.  Characters that
    share a lane count as equal, which only makes the bounds smaller.
    """
    lanes = (np.frombuffer("".join(forms).encode("utf-32-le"), "<u4") % LANES).astype(np.uint8)
    chars = chars.astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(chars)])
    most = np.floor(np.maximum(chars[a], chars[b]) * (1 - SIMILARITY) + 1e-9).astype(np.int64)
    letters = _letters(lanes, ends)
    keep = np.ones(len(a), bool)
    for i in range(0, len(a), ROWS):
        more = letters[b[i : i + ROWS]] - letters[a[i : i + ROWS]]
        keep[i : i + ROWS] = np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1)) <= most[i : i + ROWS]
    # of the longest forms the bound costs as much as the distance itself
    pieces = np.where(np.maximum(chars[a], chars[b]) > BOUNDED, 0, -(-chars[a] // PIECE))
    cost = np.zeros(len(a), np.int64)
    for low, high in ((np.zeros(len(a), np.int64), -(-pieces // 2)), (-(-pieces // 2), pieces)):
        own = np.flatnonzero(keep & (high > low))
        own = own[np.argsort(most[own], kind="stable")]
        n = high[own] - low[own]
        pair = np.repeat(own, n)
        first = (np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + low[pair]) * PIECE
        size = np.minimum(chars[a[pair]] - first, PIECE)
        # a path that uses ``most`` edits in all is never further off its diagonal than this
        off = chars[b[pair]] - chars[a[pair]]
        begin = np.maximum(first + (off - most[pair]) // 2, 0)
        end = np.maximum(np.minimum(first + size - (-off - most[pair]) // 2, chars[b[pair]]), begin)
        for i in range(0, len(pair), ROWS):
            k = slice(i, i + ROWS)
            np.add.at(cost, pair[k], _least_edits(lanes, ends[a[pair[k]]] + first[k], size[k], ends[b[pair[k]]] + begin[k], ends[b[pair[k]]] + end[k]))
        keep &= cost <= most
    return keep


def _distances(codes: np.ndarray, kinds: int, start, size, begin, length, most: int) -> np.ndarray:
    """Edit distances of the strings ``codes[start : start + size]`` to ``codes[begin : begin + length]``, right where they are at most ``most``.

    Bit-parallel in blocks of 64 rows.  All pairs go together, and all blocks: a block is a column behind the one above it.  A block
    begins and ends with the columns that a path of ``most`` edits can reach in its rows; outside of them distances are only too large.
    """
    n_pairs, n_blocks, n_columns, one = len(start), int(size.max() + 63) // 64, int(length.max()), np.uint64(1)
    block = np.arange(n_blocks)
    table = np.zeros((n_pairs, n_blocks, kinds + 1), np.uint64)  # the last kind is in no string: it goes on where one has ended
    for t in range(64):
        p, k = np.nonzero(64 * block + t < size[:, None])
        table[p, k, codes[start[p] + 64 * k + t]] |= one << np.uint64(t)
    table, row = table.ravel(), np.arange(n_pairs * n_blocks).reshape(n_pairs, -1) * (kinds + 1)
    column = np.arange(n_columns)
    text = np.where(column < length[:, None], codes[np.minimum(begin[:, None] + column, len(codes) - 1)], kinds)
    text = np.concatenate([text, np.full((n_pairs, n_blocks), kinds)], axis=1)[:, ::-1]
    final = (size - 1) // 64
    height = np.clip(size[:, None] - 64 * block, 0, 64)
    last = np.maximum(height - 1, 0).astype(np.uint64)
    score = np.minimum(64 * (block + 1), size[:, None])
    first, end = np.maximum(64 * block - most - 1, 0) + block, np.minimum(64 * block + 64 + most, n_columns - 1) + block
    up, down = np.full((n_pairs, n_blocks), ~np.uint64(0)), np.zeros((n_pairs, n_blocks), np.uint64)
    more, less = np.zeros((n_pairs, n_blocks + 1), np.uint64), np.zeros((n_pairs, n_blocks + 1), np.uint64)
    more[:, 0] = 1
    over = length - 1 + final
    out = np.zeros(n_pairs, np.int64)
    low = high = 0
    for now in range(int(over.max()) + 1):
        while low < n_blocks - 1 and end[low] < now:
            low += 1
            more[:, low], less[:, low] = 1, 0
        while high < n_blocks and first[high] <= now:
            if high and first[high] > high:
                score[:, high] = score[:, high - 1] - more[:, high].astype(np.int64) + less[:, high].astype(np.int64) + height[:, high]
            high += 1
        k = slice(low, high)
        add, take = more[:, k].copy(), less[:, k].copy()
        at = text.shape[1] - 1 - now + low
        eq = table[row[:, k] + text[:, at : at + high - low]]
        u, d = up[:, k], down[:, k]
        either = eq | d
        eq |= take
        across = (((eq & u) + u) ^ u) | eq
        plus, minus = d | ~(across | u), u & across
        own = more[:, low + 1 : high + 1], less[:, low + 1 : high + 1]
        own[0][:], own[1][:] = plus >> last[:, k] & one, minus >> last[:, k] & one
        score[:, k] += own[0].astype(np.int64) - own[1].astype(np.int64)
        plus = plus << one | add
        up[:, k] = minus << one | take | ~(either | plus)
        down[:, k] = plus & either
        done = np.flatnonzero(over == now)
        if len(done):
            out[done] = score[done, final[done]]
    return out


def within(forms: list[str], chars: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the forms of each pair ``a, b`` have an edit similarity of 0.8 or more; exact."""
    chars = chars.astype(np.int64)
    high, low = np.maximum(chars[a], chars[b]), np.minimum(chars[a], chars[b])
    most = np.floor(high * (1 - SIMILARITY) + 1e-9).astype(np.int64)
    out = (a == b) | (high == 0)
    near = ~out & (high - low <= most)
    for i in np.flatnonzero(near & ((high > AT_ONCE) | (low == 0))).tolist():
        out[i] = alike(forms[a[i]], forms[b[i]])
    own = np.flatnonzero(near & (high <= AT_ONCE) & (low > 0))
    if not len(own):
        return out
    codes = np.frombuffer("".join(forms).encode("utf-32-le"), "<u4")
    there = np.zeros(0x110000, bool)
    there[codes] = True
    kinds = int(there.sum())
    codes = (np.cumsum(there) - 1)[codes]
    ends = np.cumsum(chars) - chars
    own = own[np.lexsort((most[own], -(-low[own] // 64)))]
    less, more = np.where(chars[a] <= chars[b], a, b), np.where(chars[a] <= chars[b], b, a)
    i = 0
    while i < len(own):
        cells = -(-high[own[i:]] // 64)
        k = own[i : i + max(1, int(np.searchsorted(np.maximum.accumulate(cells) * np.arange(1, len(cells) + 1), min(2 * ROWS, (1 << 20) // (kinds + 1)), side="right")))]
        out[k] = _distances(codes, kinds, ends[less[k]], low[k], ends[more[k]], high[k], int(most[k].max())) <= most[k]
        i += len(k)
    return out


_PAIRS = "kind int, key long, src long, dst long, fp long, chars int"


def _rows(kind: int, key, src, dst, fp, chars) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(src), kind, np.int32)), *[pa.array(x) for x in (key, src, dst, fp, chars)]], names=["kind", "key", "src", "dst", "fp", "chars"])


def _buckets(batches, crowd: int | None, columns: tuple[str, ...], settle):
    """Calls ``settle`` on whole buckets (rows sorted by key and node); rows of buckets beyond ``crowd`` leave as kind 2."""
    held = [np.zeros(0, np.int64)] * len(columns)

    def cut(rows, last: bool):
        """Whole buckets, and what may go on in the next batch."""
        key = rows[0]
        end = len(key) if last else int(np.searchsorted(key, key[-1])) if len(key) else 0
        return [x[:end] for x in rows], [x[end:] for x in rows]

    def work(rows):
        if not len(rows[0]):
            return
        once = np.ones(len(rows[0]), bool)
        once[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
        rows = [x[once] for x in rows]
        edge = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]]))
        size = np.diff(np.append(edge, len(rows[0])))
        if crowd is not None and (many := np.repeat(size > crowd, size)).any():
            yield _rows(2, rows[0][many], rows[1][many], rows[1][many], rows[2][many], rows[3][many].astype(np.int32))
            rows, size = [x[~many] for x in rows], size[size <= crowd]
        yield from settle(rows, np.cumsum(size) - size, size)

    def columns_of(batch):
        return [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]

    passing = None  # the key of a crowded bucket whose rows are handed on as they come
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [np.concatenate([a, b]) for a, b in zip(held, columns_of(batch), strict=True)]
        if passing is not None:
            end = int(np.searchsorted(rows[0], passing, side="right"))
            yield _rows(2, rows[0][:end], rows[1][:end], rows[1][:end], rows[2][:end], rows[3][:end].astype(np.int32))
            rows = [x[end:] for x in rows]
            passing = passing if not len(rows[0]) else None
        done, held = cut(rows, False)
        yield from work(done)
        if crowd is not None and len(held[0]) > 4 * crowd:
            passing = held[0][0]
            yield _rows(2, held[0], held[1], held[1], held[2], held[3].astype(np.int32))
            held = [x[:0] for x in held]
    yield from work(cut(held, True)[0])


def _first_look(crowd: int | None):
    """Kind 0: pairs of a member and its nearest ones.  Kind 1: members of buckets of three and more, for the second look."""

    def settle(rows, start, size):
        key, node, fp, chars = rows
        two = start[size == 2]
        two = two[_near(fp.view(np.uint64), chars, two, two + 1)]
        a, b = [two], [two + 1]
        for own, n in _alike_sized(start[size > 2], size[size > 2], FEW_ROWS):
            x, y = _nearest_in(fp.view(np.uint64), chars, own, n)
            a.append(x)
            b.append(y)
        for s, n in zip(start[size > FEW_ROWS].tolist(), size[size > FEW_ROWS].tolist(), strict=True):
            x, y = _nearest(fp[s : s + n].view(np.uint64), chars[s : s + n])
            a.append(x + s)
            b.append(y + s)
        a, b = np.concatenate(a), np.concatenate(b)
        yield _rows(0, key[a], np.minimum(node[a], node[b]), np.maximum(node[a], node[b]), fp[a], chars[a].astype(np.int32))
        more = np.repeat(size > 2, size)
        yield _rows(1, key[more], node[more], node[more], fp[more], chars[more].astype(np.int32))

    return lambda batches: _buckets(batches, crowd, ("key", "node", "fp", "chars"), settle)


def _mixed(batches):
    """Members of buckets that the first look has left in several groups, as far as one of another group may be like them."""
    names = ("key", "node", "fp", "chars", "group")

    def settle(rows, start, size):
        key, node, fp, chars, group = rows
        keep = np.zeros(len(group), bool)
        several = np.minimum.reduceat(group, start) != np.maximum.reduceat(group, start)
        for i, j in _all_across(fp.view(np.uint64), chars, group, start[several], size[several]):
            keep[i] = keep[j] = True
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, node, fp, chars.astype(np.int32), group)], names=names)

    yield from _buckets(batches, None, names, settle)


def _second_look(batches, once: bool = False):
    """Links between the groups of a bucket; groups that a link has joined are one from then on, so no more links leave than groups come.

    ``once``: a column ``shared`` has all keys of the member, in order; two members that share several are compared in the bucket of the least only.
    """
    root: dict[int, int] = {}

    def of(g: int) -> int:
        while (up := root.get(g, g)) != g:
            root[g] = root.get(up, up)
            g = up
        return g

    def tested(pairs, rows):
        """Links among the pairs: those that the lower bound leaves, by their exact similarity."""
        _, node, _, chars, group, form, *_ = rows
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
        at, place = np.unique(np.concatenate([i, j]), return_inverse=True)
        forms, groups = form[at].tolist(), group[at].tolist()
        root.update((g, g) for g in groups if g not in root)
        place = place.reshape(2, -1)
        apart = np.array([of(groups[x]) != of(groups[y]) for x, y in zip(*place.tolist(), strict=True)], bool)
        place = place[:, apart]
        place = place[:, maybe_alike(forms, chars[at], *place)]
        links = []
        for x, y in place[:, within(forms, chars[at], *place)].T.tolist():
            gx, gy = of(groups[x]), of(groups[y])
            if gx != gy:
                root[gx] = gy
                links.append((at[x], at[y]))
        a, b = node[np.array(links, np.int64).reshape(-1, 2)].T
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["src", "dst"])

    def settle(rows, start, size):
        key, _, fp, chars, group, *_ = rows
        if len(root) > SEEN:
            root.clear()  # only what this task has joined is forgotten
        less: dict[int, set[int]] = {}

        def earlier(i: int) -> set[int]:
            """The member's keys under that of its bucket."""
            if i not in less:
                own = rows[-1][i]
                less[i] = set(own[: np.searchsorted(own, key[i])].tolist())
            return less[i]

        held, n = [], 0
        for i, j in _all_across(fp.view(np.uint64), chars, group, start, size):
            if once:
                new = np.array([earlier(x).isdisjoint(earlier(y)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], bool)
                i, j = i[new], j[new]
            for k in range(0, len(i), TOGETHER):
                held.append((i[k : k + TOGETHER], j[k : k + TOGETHER]))
                n += len(held[-1][0])
                if n >= TOGETHER:
                    yield tested(held, rows)
                    held, n = [], 0
        if held:
            yield tested(held, rows)

    yield from _buckets(batches, None, ("key", "node", "fp", "chars", "group", "form", *(["shared"] if once else [])), settle)


def _dealt(rows: DataFrame, f, schema: str = _PAIRS) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(f, schema)


def _split(batches):
    """Rows of crowded buckets, once for each block of the SimHash."""
    blocks = [sum(1 << int(b) for b in part) for part in np.array_split(np.arange(64), DISTANCE + 1)]
    for batch in batches:
        key, node, fp, chars = (batch.column(c).to_numpy() for c in ("key", "node", "fp", "chars"))
        for b, mask in enumerate(blocks):
            own = (key.view(np.uint64) ^ ((fp.view(np.uint64) & np.uint64(mask)) + np.uint64(b + 1)) * _MIX) * np.uint64(0xC2B2AE3D27D4EB4F)
            own ^= own >> np.uint64(31)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(node), pa.array(fp), pa.array(chars)], names=["key", "node", "fp", "chars"])


def form_links(every: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``src, dst``: linked forms of ``lines``, enough of them to connect every group."""
    found, _, rest = _linked(every, crowd)
    return found if rest is None else found.union(rest)


def form_groups(every: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``connected_components`` of ``form_links``: of the second look's links only the groups of the first that they join are worked on."""
    _, groups, rest = _linked(every, crowd)
    if rest is None:
        return groups
    for end in ("src", "dst"):
        own = groups.select(F.col("node").alias(end), "component")
        rest = rest.join(own, end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    top = connected_components(rest)
    joined = groups.join(top.select(F.col("node").alias("component"), F.col("component").alias("above")), "component", "left")
    return joined.select("node", F.coalesce("above", "component").alias("component")).union(top)


def _linked(every: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The links of the first look, their components, and the links of the second look, if it has any work."""
    described = every.where("fp is not null")
    rows = _shared_keys(described)
    looks = []
    for level in range(LEVELS):
        found = materialize(_dealt(rows, _first_look(crowd if level < LEVELS - 1 else None)), "line-buckets")
        looks.append(found)
        crowded = found.where("kind = 2")
        if level == LEVELS - 1 or crowded.isEmpty():
            break
        rows = crowded.select("key", F.col("src").alias("node"), "fp", "chars").mapInArrow(_split, "key long, node long, fp long, chars int")
    both = looks[0] if len(looks) == 1 else looks[0].union(looks[1])
    candidates = materialize(both.where("kind = 0").select("src", "dst").distinct(), "line-pairs")
    found = _verified(candidates, described)
    members = both.where("kind = 1").select("key", F.col("src").alias("node"), "fp", "chars")
    groups = connected_components(found)
    tagged = members.join(groups, "node", "left").withColumn("group", F.coalesce("component", "node"))
    columns = "key long, node long, fp long, chars int, group long"
    mixed = materialize(_dealt(tagged.select("key", "node", "fp", "chars", "group"), _mixed, columns), "line-mixed")
    discard(*looks, candidates)
    if mixed.isEmpty():
        return found, groups, None
    # the forms come along, so that a bucket's links leave it and not its pairs
    shared = mixed.groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("shared"))
    texts = _forms(mixed.select("node"), described)
    rest = _dealt(mixed.join(texts.join(shared, "node"), "node"), lambda batches: _second_look(batches, True), "src long, dst long")
    rest = materialize(rest.distinct(), "line-rest")
    discard(mixed, texts)
    return found, groups, rest


def _packed_halves(half: np.ndarray) -> pa.RecordBatch:
    """Sorted upper halves of keys, each twice at most, a row for each value of their first ``PART_BITS`` bits: how many
    have which next bits, then the last sixteen bits of each."""
    half = np.sort(half)
    again = np.zeros(len(half), bool)
    again[2:] = half[2:] == half[:-2]
    half = half[~again]
    edges = np.searchsorted(half, np.arange((1 << 16) + 1, dtype=np.uint64) << np.uint64(16)).reshape(-1)
    counts = np.diff(edges).astype(np.uint32).reshape(1 << PART_BITS, -1)
    ends = edges[:: counts.shape[1]]
    parts = np.flatnonzero(np.diff(ends))
    low = (half & np.uint32(0xFFFF)).astype(np.uint16)
    return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array([counts[p].tobytes() + low[ends[p] : ends[p + 1]].tobytes() for p in parts], pa.binary())], names=["part", "halves"])


def _twice(batches):
    """For each part of ``_packed_halves`` (rows sorted by part) the words of a bitmap, by their first ``KEY_BITS`` bits, of the halves that come more than once."""
    n = 1 << (16 - PART_BITS)

    def words(part: int, rows: list[bytes]) -> pa.RecordBatch:
        own = []
        for row in rows:
            counts = np.frombuffer(row, np.uint32, n)
            own.append(np.repeat(np.arange(n, dtype=np.uint32) << np.uint32(16), counts) | np.frombuffer(row, np.uint16, offset=4 * n))
        half = np.sort(np.concatenate(own))
        at = half[1:][half[1:] == half[:-1]] >> np.uint32(32 - KEY_BITS)
        bits = np.zeros(1 << (KEY_BITS - PART_BITS), np.uint8)
        bits[at] = 1
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["part", "words"])

    held, last = [], None
    for batch in batches:
        for part, row in zip(batch.column("part").to_pylist(), batch.column("halves").to_pylist(), strict=True):
            if part != last and held:
                yield words(last, held)
                held = []
            last = part
            held.append(row)
    if held:
        yield words(last, held)


def _longs(column) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit numbers in a binary column, and where each row's begin."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(np.uint64) if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint64)
    return values, (ends - ends[0]) // 8


def _shared_keys(described: DataFrame) -> DataFrame:
    """``key, node, fp, chars`` for the keys that more than one form has; most keys are unique and are only counted.

    They are counted by 32 bits and let pass by a fixed-size bitmap, so some unique ones come with them.  Of a form that several
    tasks have described the one of the least place counts (by a bitmap again, so a few more may).
    """
    spark = described.sparkSession
    placed = described.withColumn("place", F.xxhash64("node", "did", "rid", "line"))
    first = placed.groupBy("node").agg(F.min("place").alias("place"))
    known = spark.sparkContext.broadcast(bitmap(first, "place"))

    def chosen(batch):
        return batch.take(pa.array(np.flatnonzero(in_bitmap(known.value, batch.column("place").to_numpy().view(np.uint64)))))

    def blocks(batch):
        few = batch.column("few").to_numpy(zero_copy_only=False)
        return expanded(few, *_longs(batch.column("keys")), *_longs(batch.column("pairs")))

    def halves(batches):
        held, n = [], 0
        for batch in map(chosen, batches):
            held.append((blocks(batch)[1] >> np.uint64(32)).astype(np.uint32))
            n += len(held[-1])
            if n > HELD:
                yield _packed_halves(np.concatenate(held))
                held, n = [], 0
        if n:
            yield _packed_halves(np.concatenate(held))

    source = placed.select("node", "place", "fp", "chars", "few", "keys", "pairs")
    twice = source.mapInArrow(halves, "part int, halves binary").repartition("part").sortWithinPartitions("part").mapInArrow(_twice, "part int, words binary").toArrow()
    bits = np.zeros(1 << (KEY_BITS - 6), np.uint64)
    for part, own in zip(twice["part"].to_pylist(), twice["words"].to_pylist(), strict=True):
        bits.reshape(1 << PART_BITS, -1)[part] = np.frombuffer(own, np.uint64)
    words = spark.sparkContext.broadcast(bits)

    def run(batches):
        for batch in map(chosen, batches):
            owner, keys = blocks(batch)
            at = np.flatnonzero(in_bitmap(words.value, keys, KEY_BITS))
            owner = pa.array(owner[at])
            yield pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), *[batch.column(c).take(owner) for c in ("node", "fp", "chars")]], names=["key", "node", "fp", "chars"])

    return source.mapInArrow(run, "key long, node long, fp long, chars int")


def _forms(nodes: DataFrame, described: DataFrame) -> DataFrame:
    """``node, form`` of the nodes; only forms that a fixed-size bitmap of them lets pass are moved."""
    words = bitmap_words(nodes, "node")
    word, bit = bitmap_place("node")
    passed = described.select("node", "form").withColumn("w", word).join(F.broadcast(words), "w").where(F.col("b").bitwiseAND(bit) != 0)
    return materialize(passed.select("node", "form").dropDuplicates(["node"]), "line-forms")


def _verified(pairs: DataFrame, described: DataFrame) -> DataFrame:
    """The pairs of an edit similarity of 0.8 or more."""
    texts = _forms(pairs.select(F.explode(F.array("src", "dst")).alias("node")), described)
    left = texts.select(F.col("node").alias("src"), F.col("form").alias("ta"))
    right = texts.select(F.col("node").alias("dst"), F.col("form").alias("tb"))
    found = materialize(pairs.join(left, "src").join(right, "dst").mapInArrow(_alike, "src long, dst long"), "line-links")
    discard(texts)
    return found


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or ``most + 1`` if it is larger; bit-parallel over the shorter text's characters."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    i = 0
    low = min(len(a), len(b))
    while i < low and a[i] == b[i]:
        i += 1
    j = 0
    while j < low - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    places: dict[str, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for n, y in enumerate(b, 1):
        eq = places.get(y, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (full & ~(diagonal | up)), diagonal & up
        distance += bool(plus & last) - bool(minus & last)
        if distance - (len(b) - n) > most:
            return most + 1
        plus = plus << 1 | 1
        up = full & (minus << 1 | ~(diagonal | plus))
        down = full & plus & diagonal
    return distance


def surely_within(a: str, b: str, most: int) -> bool:
    """Whether replacing the runs of words that differ already costs at most ``most``.

    The words are walked side by side; where they differ, the nearest place at which two words agree again ends the run.
    """
    if abs(len(a) - len(b)) > most:
        return False
    x, y = a.split(" "), b.split(" ")
    i = j = cost = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            i += 1
            j += 1
            continue
        for skip in range(1, _AHEAD):
            step = next((k for k in range(skip + 1) if x[i + k : i + k + 2] == y[j + skip - k : j + skip - k + 2] != []), None)
            if step is not None:
                break
        else:
            break
        # one more character for the space beside a run that is empty on one side
        cost += max(len(" ".join(x[i : i + step])), len(" ".join(y[j : j + skip - step]))) + (step in (0, skip))
        if cost > most:
            return False
        i, j = i + step, j + skip - step
    return cost + max(len(" ".join(x[i:])), len(" ".join(y[j:]))) + (i < len(x)) + (j < len(y)) <= most


def _most(a: str, b: str) -> int:
    """The largest edit distance at which two forms are alike."""
    return int(max(len(a), len(b)) * (1 - SIMILARITY) + 1e-9)


def alike(a: str, b: str) -> bool:
    """Whether two forms have an edit similarity of 0.8 or more."""
    most = _most(a, b)
    return surely_within(a, b, most) or edit_distance(a, b, most) <= most


def _alike(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(start, TOGETHER)
            left, right = part.column("ta").to_pylist(), part.column("tb").to_pylist()
            keep = np.array([surely_within(a, b, _most(a, b)) for a, b in zip(left, right, strict=True)], dtype=bool)
            open_ = np.flatnonzero(~keep)
            forms = [left[i] for i in open_] + [right[i] for i in open_]
            chars, n = np.fromiter(map(len, forms), np.int64, len(forms)), len(open_)
            maybe = np.flatnonzero(maybe_alike(forms, chars, np.arange(n), n + np.arange(n)))
            keep[open_[maybe[within(forms, chars, maybe, n + maybe)]]] = True
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([part.column("src").take(at), part.column("dst").take(at)], names=["src", "dst"])


def _keep_flags(batches):
    """The lines to keep as one flag each, up to the last that goes."""
    for batch in batches:
        flags = []
        for gone in batch.column("gone").to_pylist():
            own = np.ones(max(gone) + 1, bool)
            own[gone] = False
            flags.append(own)
        yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("rid"), pa.array(flags, pa.list_(pa.bool_())), pa.array([len(x) - int(x.sum()) for x in flags], pa.int32())], names=["did", "rid", "keep", "gone"])


def removed_lines(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``did, rid, keep array<boolean> (by line number, true beyond its end), gone (their number)`` of rows that lose lines."""
    every = materialize(lines(docs), "lines")
    comp = form_groups(every, crowd)
    places = every.select("did", "rid", "line", "node")
    rooted = materialize(places.join(comp, "node", "left").select("did", "rid", "line", F.coalesce("component", "node").alias("root")), "line-roots")
    discard(every)
    shared = rooted.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root")
    some = materialize(rooted.join(shared, "root"), "line-groups")
    discard(rooted)
    first = some.groupBy("root").agg(F.min(F.struct("did", "rid", "line")).alias("first"))
    lost = some.join(first, "root").where(F.struct("did", "rid", "line") != F.col("first"))
    flags = lost.groupBy("did", "rid").agg(F.collect_set("line").alias("gone")).mapInArrow(_keep_flags, "did long, rid long, keep array<boolean>, gone int")
    flags = materialize(flags, "line-flags")
    discard(some)
    return flags


def deduplicated(docs: DataFrame, crowd: int = CROWD) -> tuple[DataFrame, str]:
    """All columns of ``docs`` with the text less its removed lines, and the name of an added column that counts them."""
    own, d, r = with_keys(docs)
    own, again = marked_copies(own, d, r)
    keep, count = free_name(own.columns, "keep"), free_name(own.columns, "removed")
    lost = removed_lines(docs, crowd).select(F.col("did").alias(d), F.col("rid").alias(r), F.col("keep").alias(keep), F.col("gone").alias(count))
    joined = own.join(lost, [d, r], "left")
    split = F.split(F.col("text").cast("string"), "\n", -1)
    blank = lambda x: ~x.rlike(r"[^ \t\n\x0B\f\r]")
    kept = F.filter(F.zip_with(split, F.col(keep), lambda x, k: F.when(F.coalesce(k, F.lit(True)), x)), lambda x: x.isNotNull())
    rest = F.when(F.col(again), F.filter(split, blank)).when(F.col(keep).isNotNull(), kept)
    text = F.when(rest.isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))
    gone = F.when(F.col(again), F.size(F.filter(split, lambda x: ~blank(x)))).otherwise(F.coalesce(F.col(count), F.lit(0)))
    gone = F.when(F.col("text").isNull(), 0).otherwise(gone)
    return joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns], gone.alias(count)), count


def line_dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines (not blank), n_removed, kept_sha256 (of the remaining text)`` of every document."""
    text = F.col("text").cast("string")
    n_lines = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]")))
    done, count = deduplicated(docs.select("doc_id", text.alias("text"), n_lines.alias("n_lines")))
    return done.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col(count).cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def clean_lines(docs: DataFrame) -> DataFrame:
    """Documents with repeated lines removed; ``n_chars`` follows the text where it exists."""
    done, _ = deduplicated(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)
