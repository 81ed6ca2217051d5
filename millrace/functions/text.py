"""Text and vector column functions; all built-in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hundredths of a token per character: ASCII letter or space, digit, ASCII punctuation, other BMP, beyond.
WEIGHTS = (27, 60, 85, 110, 340)


def token_estimate(text: Column) -> Column:
    """Tokens by character class; empty is 0, null is null.

    Each class is taken out of what the classes before it have left, so only lengths are needed and no match is kept.
    """
    left = [text]
    for chars in (r"[A-Za-z\x09-\x0D\x1C-\x20]+", "[0-9]+", r"[\x00-\x7F]+", r"[\x{80}-\x{FFFF}]+"):
        left.append(F.regexp_replace(left[-1], chars, ""))
    sizes = [F.length(x) for x in left]
    counts = [a - b for a, b in zip(sizes, sizes[1:])] + [sizes[-1]]
    total = sum((c * w for c, w in zip(counts[1:], WEIGHTS[1:])), counts[0] * WEIGHTS[0])
    # one more for any text but the empty one; no branch, in which the lengths would be computed again and again
    return (F.floor(total / 100) + F.least(sizes[0], F.lit(1))).cast("long")


def quarter_tokens(text: Column) -> Column:
    """The four-characters-a-token rule, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(vector: Column) -> Column:
    """Unit length; a zero vector stays."""
    norm = F.sqrt(dot(vector, vector))
    return F.when(norm == 0, F.transform(vector, lambda x: x.cast("double"))).otherwise(F.transform(vector, lambda x: x.cast("double") / norm))


def cache_key(model: str, prefix: str, text: Column) -> Column:
    """SHA-1 of model, a NUL, prefix and text."""
    return F.sha1(F.concat(F.lit(f"{model}\0{prefix}"), text).cast("binary"))


def trim_result(content: Column, spill: Column, limit: int) -> Column:
    """Head and tail of a long tool result around a notice; short ones unchanged."""
    head, tail = limit // 2, limit - limit // 2
    cut = F.length(content) - limit
    notice = F.concat(F.lit("\n\n... ["), cut.cast("string"), F.lit(" characters trimmed to fit the context window. Full output saved to "), spill, F.lit(" -- read_file it if you need the middle.] ...\n\n"))
    return F.when(F.length(content) > limit, F.concat(F.substring(content, 1, head), notice, F.substring(content, -tail, tail))).otherwise(content)
