"""Quality rules, line first: bad lines are taken out, then documents that lost too much are rejected.

A line fails for navigation (separators between its words), for symbols (too many of ``#*$%&|<>``
for its letters), for missing punctuation (a very long run of words without any), or for boilerplate
(a listed phrase).  A document is rejected if it has too few words, if repeated three-word windows
cover too much of it, or if the failing lines hold too large a share of its word characters.

A null or empty text has no words and is rejected; ties do not arise; repeated rows are judged alike; long texts are
judged whole; columns of the input keep their names; an empty table gives no row.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, small

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document is rejected if more than this share of its word characters is in failing lines.
MAX_LOST_PERCENT = 40
NAVIGATION_PERCENT = 20
SYMBOL_PERCENT = 10
UNPUNCTUATED_WORDS = 60

# The characters counted as symbols, and phrases of web page furniture.
SYMBOLS = re.compile(r"[#*$%&|<>]")
BOILERPLATE = ("all rights reserved", "cookie policy", "accept cookies", "enable javascript", "terms of service", "privacy policy", "lorem ipsum", "click here to", "sign in to", "subscribe to our newsletter", "skip to content")
NAVIGATION = {b"|", b"\xc2\xbb", b"\xe2\x80\xba", b">", b">>", b"\xe2\x80\xa2", b"\xc2\xb7", b"/"}
PUNCTUATION = re.compile(r"[.!?,;:…。]")


def line_fails(line: str, words: list[bytes]) -> bool:
    """Whether a line with words is navigation, symbols, unpunctuated or boilerplate."""
    if 100 * sum(w in NAVIGATION for w in words) > NAVIGATION_PERCENT * len(words):
        return True
    if 100 * len(SYMBOLS.findall(line)) > SYMBOL_PERCENT * sum(map(len, words)):
        return True
    if len(words) > UNPUNCTUATED_WORDS and not PUNCTUATION.search(line):
        return True
    low = line.lower()
    return any(p in low for p in BOILERPLATE)


def judge(text: str | None) -> tuple:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines_removed, cleaned text``."""
    raw = text or ""
    words = raw.encode().split()
    n = len(words)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen, repeat, covered = Counter(windows), 0, 0
    if len(seen) < len(windows):
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeat += i + 3 - max(i, covered)
                covered = i + 3
    lines, earlier, dup, lost, total, good, removed = raw.split("\n"), set(), 0, 0, 0, [], 0
    for line in lines:
        own = line.encode().split()
        if not own:
            good.append(line)
            continue
        dup += line in earlier
        earlier.add(line)
        chars = len(b"".join(own).decode())
        total += chars
        if line_fails(line, own):
            lost += chars
            removed += 1
        else:
            good.append(line)
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
    kept = not failed and 100 * lost <= MAX_LOST_PERCENT * total
    return n, total, len(SYMBOLS.findall(raw)), dup, repeat, failed, kept, removed, None if text is None else "\n".join(good)


FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "cleaned"]
_TYPES = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64(), pa.string()]
_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines_removed long, cleaned string"


def judged(docs: DataFrame, *carried: str) -> tuple[DataFrame, dict[str, str]]:
    """The ``carried`` columns of every document with its verdict and cleaned text; one pass, no shuffle.

    Also the names of the added columns, which give way to carried ones of the same name.
    """
    own = docs.select(F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carried)])

    def run(batches):
        for batch in small(batches):
            rows = [judge(t) for t in batch.column(0).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(FIELDS)
            yield pa.RecordBatch.from_arrays(batch.columns[1:] + [pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=[*batch.schema.names[1:], *FIELDS])

    done = own.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields[1:]), _SCHEMA]))
    names = {f: free_name(carried, f) for f in FIELDS}
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carried)], *[F.col(f).alias(n) for f, n in names.items()]), names


def quality_rules(docs: DataFrame) -> DataFrame:
    """Statistics and verdict of every document, without its text."""
    return judged(docs, "doc_id")[0].drop("cleaned")


def clean(docs: DataFrame) -> DataFrame:
    """Kept documents with failing lines taken out; ``n_chars`` follows the text where it exists."""
    done, name = judged(docs, *[c for c in docs.columns if c != "text"])
    kept = done.where(F.col(name["kept"])).withColumn("text", F.col(name["cleaned"]))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)
