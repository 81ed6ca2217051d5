"""Language-model scoring with a probabilistic suffix tree over words.

Tokens are words and one end per text; a text starts in the context of an end.  The tree's symbols are
the most frequent words (the head), the end, and one class for all other words, among them those of more
than ``HEAD_BYTES`` bytes; a word of that class is drawn by its own share.  Words never seen in training have the mass
of the different words together (Witten and Bell), spread over all forms by a chain of bytes that is learned from the different words:
each byte, or the word's end, given the one before.  Contexts of up to ``DEPTH`` symbols
are candidates if they are frequent enough and their suffix is retained, and retained if their next-symbol
distribution diverges from their suffix's; each distribution is smoothed towards the suffix's.  Every token
is scored from its longest retained context.

Counts cover every training text.  The head grows with the cube root of the training tokens N, the contexts and next-symbol
entries of a depth with the fourth root: at most ``HEAD``, ``CONTEXTS`` and ``ENTRIES`` times that root, which the least counts
N / (that bound) see to.  So what is broadcast stays a few hundred MB at 10**13 tokens; rarer evidence is counted towards the suffix's
distribution.  Words outside the head are looked up by a join.

A null text is an empty one: its only token is the end.  Texts are scored whole however long they are.  Repeated
rows are scored each.  Ties in the head go to the smaller word.  Other columns are not read, whatever their names.
Without training rows all counts are zero and every token is unknown.  An empty table gives no row.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, doc_id_of, id_bucket, keyed, materialize, small

DEPTH = 4
#: Words of the head at most, times the cube root of the training tokens; contexts and entries of a depth, times the fourth root.
HEAD, CONTEXTS, ENTRIES = 160, 2000, 12_000
#: Nats of total divergence (count times KL) that a context must bring over its suffix.
MIN_GAIN = 12.0
HEAD_BYTES = 64
#: A symbol's bits in a code; the last two symbols are the end and the class of all other words.
BITS = 23
MASK = (1 << BITS) - 1
END, RARE = MASK - 1, MASK
#: Different words, or symbols, that a task holds before it hands its partial counts on.
TASK_WORDS, TASK_SYMBOLS = 500_000, 4_000_000


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, c`` over all rows' ``text``; partial counts leave each task already combined."""

    def rows(counts: Counter):
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches):
        counts: Counter = Counter()
        for batch in small(batches):
            for t in byte_texts(batch.column("text")):
                counts.update(words_of(t))
                if len(counts) > TASK_WORDS:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


#: A chain's state before the first byte, and what ends a word.
EDGE = 256
#: What each of the 257 next bytes counts for before any is seen.
BYTE_PRIOR = 0.02


def spelling(vocabulary: DataFrame) -> np.ndarray:
    """log10 of each byte, or the end, given the byte before or the start: from the different words of ``vocabulary``."""

    def run(batches):
        for batch in batches:
            before, after, _ = _steps(batch.column("word").to_pylist())
            codes, n = np.unique(before * 257 + after, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], names=["code", "n"])

    found = vocabulary.select("word").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # 257 * 257 rows at most
    counts = np.full(257 * 257, BYTE_PRIOR)
    counts[found["code"].to_numpy()] += found["n"].to_numpy()
    counts = counts.reshape(257, 257)
    return np.log10(counts / counts.sum(axis=1, keepdims=True))


def _steps(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each step of all words' chains, what comes before and after it, and where each word's steps begin."""
    sizes = np.array([len(w) for w in words], dtype=np.int64) + 1
    edge = np.cumsum(sizes) - sizes
    after = np.full(sizes.sum(), EDGE, np.int64)
    inside = np.ones(len(after), bool)
    inside[edge + sizes - 1] = False
    after[inside] = np.frombuffer(b"".join(words), np.uint8)
    before = np.concatenate([[EDGE], after[:-1]]) if len(after) else after
    return before, after, edge


def spelled(words: list[bytes], table: np.ndarray) -> np.ndarray:
    """log10 of each word's form."""
    if not words:
        return np.zeros(0)
    before, after, edge = _steps(words)
    return np.add.reduceat(table[before, after], edge)


def symbol_runs(texts: list[bytes], get):
    """Symbols of texts laid end to end, and each one's place in its text; a text is END, its words' symbols, END."""
    parts: list = []
    sizes = []
    for t in texts:
        words = words_of(t)
        parts.append(END)
        parts += [get(w, RARE) for w in words]
        parts.append(END)
        sizes.append(len(words) + 2)
    n = np.array(sizes, dtype=np.int64)
    return np.array(parts, dtype=np.int64), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``keys``, and which are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class SuffixTree:
    """``root``: probabilities of the head's symbols, the end and the rare class.

    ``levels[d - 1]``: the retained contexts of d symbols as sorted codes (the number of the suffix among the contexts
    of d - 1 symbols, then the oldest symbol), their symbols (oldest first), their totals, the part of them that goes to
    the suffix's distribution (next symbols too rare to be entries, and one for each entry), and the entries' codes (the context's number, then
    the next symbol) and counts.
    """

    def __init__(self, head: np.ndarray, end: float, rare: float) -> None:
        self.head, self.end, self.rare = head, end, rare
        self.levels: list[tuple[np.ndarray, ...]] = []

    def unigram(self, symbols: np.ndarray) -> np.ndarray:
        p = np.append(self.head, [self.end, self.rare])
        return p[np.where(symbols == END, len(self.head), np.where(symbols == RARE, len(self.head) + 1, symbols))]

    def contexts_of(self, history: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each depth the places that have a retained context of that depth, and its number.

        ``history[d - 1]`` is the symbol d before each place, -1 for none.
        """
        at, number, out = np.arange(len(history[0])), np.zeros(len(history[0]), np.int64), []
        for (contexts, *_), older in zip(self.levels, history, strict=False):
            own = older[at]
            number, there = find(contexts, number << BITS | own)
            there &= own >= 0
            at, number = at[there], number[there]
            out.append((at, number))
        return out

    def probabilities(self, symbols: np.ndarray, history: list[np.ndarray]) -> np.ndarray:
        """Of each place's symbol, from its longest retained context."""
        p = self.unigram(symbols)
        for (_, _, totals, rare, entries, counts), (at, number) in zip(self.levels, self.contexts_of(history), strict=True):
            e, hit = find(entries, number << BITS | symbols[at])
            n = np.where(hit, counts[e] if len(counts) else 0, 0)
            p[at] = (n + rare[number] * p[at]) / totals[number]
        return p

    def codes_of(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of contexts given by their symbols (oldest first), and which of them have a retained suffix."""
        depth = strings.shape[1]
        number, ok = np.zeros(len(strings), np.int64), np.ones(len(strings), bool)
        for d in range(1, depth):
            at, there = find(self.levels[d - 1][0], number << BITS | strings[:, depth - d])
            number, ok = np.where(there, at, 0), ok & there
        return number << BITS | strings[:, 0], ok

    def add_level(self, candidates: np.ndarray, strings: np.ndarray, totals: np.ndarray, codes: np.ndarray, n: np.ndarray) -> None:
        """Keep the candidates (sorted codes) that diverge from their suffixes; ``codes, n``: entries by candidate."""
        order = np.argsort(codes)
        codes, n = codes[order], n[order].astype(float)
        owner, symbols = codes >> BITS, codes & MASK
        # Witten and Bell: the suffix's distribution counts as much as there are different entries, and for the rarer ones
        kinds = np.bincount(owner, minlength=len(totals))
        rare = totals - np.bincount(owner, weights=n, minlength=len(totals)) + kinds
        totals = totals + kinds
        below = self.probabilities(symbols, [strings[owner, -d] for d in range(1, strings.shape[1])] or [np.full(len(codes), -1)]) if self.levels else self.unigram(symbols)
        own = (n + rare[owner] * below) / totals[owner]
        keep = np.bincount(owner, weights=n * np.log(own / below), minlength=len(totals)) >= MIN_GAIN
        number = np.cumsum(keep) - 1
        entry = keep[owner]
        self.levels.append((candidates[keep], strings[keep], totals[keep].astype(float), rare[keep], number[owner[entry]] << BITS | symbols[entry], n[entry]))


def history_of(symbols: np.ndarray, place: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each token (all but a text's first END) its symbol, and the symbols up to ``depth`` before it (-1 for none)."""
    own = np.flatnonzero(place > 0)
    return symbols[own], [np.where(place[own] >= d, symbols[np.maximum(own - d, 0)], -1) for d in range(1, depth + 1)]


def coded(texts: DataFrame, head) -> DataFrame:
    """The training texts as symbols: ``symbols, place`` (32-bit numbers), a row for a few hundred texts."""

    def run(batches):
        get = head.value.get
        for batch in small(batches):
            every = byte_texts(batch.column("text"))
            for i in range(0, len(every), 200):
                symbols, place = symbol_runs(every[i : i + 200], get)
                yield pa.RecordBatch.from_arrays([pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in (symbols, place)], names=["symbols", "place"])

    return materialize(texts.select("text").mapInArrow(run, "symbols binary, place binary"), "symbols")


def next_counts(rows: DataFrame, tree: SuffixTree, candidates: np.ndarray, depth: int) -> DataFrame:
    """``code, n`` for every candidate context's number followed by every symbol, over all training texts."""
    held = rows.sparkSession.sparkContext.broadcast((tree, candidates))

    def run(batches):
        tree, wanted = held.value
        codes: list[np.ndarray] = []
        size = 0

        def counted():
            c, n = np.unique(np.concatenate(codes), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(c), pa.array(n)], names=["code", "n"])

        for batch in batches:
            for s, p in zip(batch.column("symbols").to_pylist(), batch.column("place").to_pylist(), strict=True):
                symbols, history = history_of(np.frombuffer(s, "<i4").astype(np.int64), np.frombuffer(p, "<i4"), depth)
                at, number = tree.contexts_of(history)[-1] if depth > 1 else (np.arange(len(symbols)), np.zeros(len(symbols), np.int64))
                older = history[-1][at]
                number, there = find(wanted, number << BITS | older)
                there &= older >= 0
                codes.append(number[there] << BITS | symbols[at[there]])
                size += len(codes[-1])
                if size > TASK_SYMBOLS:
                    yield counted()
                    codes, size = [], 0
        if codes:
            yield counted()

    return rows.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def learn_tree(rows: DataFrame, tree: SuffixTree, frequency: np.ndarray, ends: int, rare: int, total: int) -> SuffixTree:
    """``frequency``: training counts of the head's words; ``ends, rare``: of the end and of all other words."""
    root = max(total, 1) ** (1 / 4)
    least_context, least_entry = max(2, total / (CONTEXTS * root)), max(1, total / (ENTRIES * root))
    symbols = np.concatenate([np.arange(len(frequency)), [END, RARE]])
    counts = np.concatenate([frequency, [ends, rare]])
    strings, totals = symbols[counts >= least_context][:, None], counts[counts >= least_context]
    for depth in range(1, DEPTH + 1):
        if not len(strings):
            break
        candidates, ok = tree.codes_of(strings)
        order = np.flatnonzero(ok)[np.argsort(candidates[ok])]
        candidates, strings, totals = candidates[order], strings[order], totals[order]
        found = next_counts(rows, tree, candidates, depth).where(F.col("n") >= least_entry).toArrow()  # at most ENTRIES * root rows
        codes, n = found["code"].to_numpy(), found["n"].to_numpy()
        tree.add_level(candidates, strings, totals, codes, n)
        # a frequent entry is a candidate of the next depth; an END ends the text
        more = (n >= least_context) & (codes & MASK != END)
        strings, totals = np.column_stack([strings[codes[more] >> BITS], codes[more] & MASK]), n[more]
    return tree


def lm_scores(docs: DataFrame, folds: int = 5, fold: int = 1) -> DataFrame:
    """Learn outside one fold of the ids; score every text.

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.
    """
    spark = docs.sparkSession
    training = docs.where(id_bucket("doc_id", folds) != fold).select(F.col("text").cast("string").alias("text"))
    vocab = materialize(word_counts(training), "vocabulary")
    n_docs = training.count()
    n_words, v_words = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    train_tokens, v = n_words + n_docs, v_words + (n_docs > 0)
    below, mass = train_tokens + 0.5 * (v + 1), max(1, train_tokens + v)
    unknown = v / mass if v else 1.0
    top = vocab.where(F.length("word") <= HEAD_BYTES).orderBy(F.desc("c"), "word").limit(min(END, int(HEAD * max(train_tokens, 1) ** (1 / 3)))).toArrow()
    words, c = top["word"].to_pylist(), top["c"].to_numpy().astype(np.int64)
    rare = n_words - int(c.sum())
    tree = SuffixTree(c / mass, n_docs / mass or unknown, rare / mass + unknown)
    head = spark.sparkContext.broadcast({w: i for i, w in enumerate(words)})
    trees = spark.sparkContext.broadcast(learn_tree(coded(training, head), tree, c, n_docs, rare, train_tokens))
    # the base of the head's words, of the end and of the rest, which the join adds
    base_of = np.append(np.log10((np.append(c, n_docs) + 0.5) / below), 0.0)
    log_rare = math.log10(tree.rare)
    forms = spark.sparkContext.broadcast(spelling(vocab))

    def split(batches):
        """A row for each text (its word is a space and the text's place) and for each of its words outside the head."""
        get, tree, serial = head.value.get, trees.value, 0
        for batch in small(batches):
            dids, rids = batch.column("did").to_pylist(), batch.column("rid").to_pylist()
            every = byte_texts(batch.column("text"))
            for i in range(0, len(every), 200):
                texts = every[i : i + 200]
                symbols, place = symbol_runs(texts, get)
                own, history = history_of(symbols, place, DEPTH)
                sizes = np.diff(np.append(np.flatnonzero(place == 0), len(symbols))) - 1
                edge = np.cumsum(sizes) - sizes
                base = np.add.reduceat(base_of[np.where(own == END, len(base_of) - 2, np.where(own == RARE, len(base_of) - 1, own))], edge)
                score = np.add.reduceat(np.log10(tree.probabilities(own, history)), edge)
                known = np.add.reduceat(((own != RARE) & ((own != END) | (n_docs > 0))).astype(np.int64), edge)
                cols: list[list] = [[] for _ in range(9)]
                for k, t in enumerate(texts):
                    serial += 1
                    did, rid = dids[i + k], rids[i + k]
                    for col, x in zip(cols, (did, rid, b" %d %d %d" % (did, rid, serial), int(sizes[k]), int(known[k]), float(base[k]), float(score[k]), 1, 0.0), strict=True):
                        col.append(x)
                    tail = Counter([w for w in words_of(t) if w not in head.value])
                    m = len(tail)
                    for col, x in zip(cols, ([did] * m, [rid] * m, tail.keys(), tail.values(), [0] * m, [0.0] * m, [0.0] * m, [0] * m, spelled(list(tail), forms.value).tolist()), strict=True):
                        col += x
                types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(cols, types, strict=True)], names=["did", "rid", "word", "n", "known", "base", "own", "texts", "spell"])

    rows = keyed(docs).mapInArrow(split, "did long, rid long, word binary, n long, known long, base double, own double, texts long, spell double")
    c, text = F.coalesce("c", F.lit(0)), F.col("texts") == 1
    # a word of training has its share, any other its form's part of the unknown mass
    drawn = F.when(c > 0, F.log10(c / F.lit(float(mass)))).otherwise(F.lit(math.log10(unknown)) + F.col("spell"))
    parts = rows.join(vocab, "word", "left").select(
        "did", "rid", "texts", F.when(text, F.col("n")).otherwise(0).alias("tokens"), F.when(text, F.col("known")).otherwise(F.when(c > 0, F.col("n")).otherwise(0)).alias("known"),
        F.when(text, F.col("base")).otherwise(F.col("n") * F.log10((c + 0.5) / below)).alias("base"), F.when(text, F.col("own")).otherwise(F.col("n") * (drawn - log_rare)).alias("own"),
    )
    sums = parts.groupBy("did", "rid").agg(*[F.sum(c).alias(c) for c in ("texts", "tokens", "known", "base", "own")])
    each = sums.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "texts")))  # rows equal in id and text
    per = lambda c: F.expr(f"{c} div texts")
    named = each.withColumn("doc_id", doc_id_of())
    return named.select(
        "doc_id", (id_bucket("doc_id", folds) == fold).alias("held_out"), per("tokens").alias("n_tokens"), per("known").alias("n_known"),
        F.lit(int(train_tokens)).cast("long").alias("train_tokens"), (F.col("base") / F.col("texts")).alias("base_score"), (F.col("own") / F.col("texts")).alias("score"),
    )
