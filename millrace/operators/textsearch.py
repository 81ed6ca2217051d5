"""Searching lines of texts with a Java regular expression."""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .audit import SECRET_NAMES, SECRET_SUFFIXES

BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
# Folders whose files are not searched.
SKIPPED_FOLDERS = (".git", "__pycache__", "node_modules", ".venv", "venv", ".pytest_cache", ".ruff_cache", "dist", "build", ".chroma")


def repeats_a_repeat(pattern: str) -> bool:
    """Whether a group that is repeated without a small bound holds something that is itself repeated."""
    inner = [False]  # for each open group: whether it holds a repeat
    at, closed = 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at, closed = at + 2, False
            continue
        if c == "[":
            end = at + 2 if pattern[at + 1 : at + 2] != "^" else at + 3
            while end < len(pattern) and pattern[end] != "]":
                end += 2 if pattern[end] == "\\" else 1
            at, closed = end + 1, False
            continue
        if c == "(":
            inner.append(False)
            closed = False
            at += 2 if pattern[at + 1 : at + 2] == "?" else 1
            continue
        if c == ")" and len(inner) > 1:
            closed = inner.pop()
            inner[-1] |= closed
        elif c in "*+{":
            if closed:
                return True
            inner[-1] = True
        elif c != " ":
            closed = False
        at += 1
    return False


def numbered_lines(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, n (from 1), line``; a line break at the end starts no line."""
    parts = F.split("text", BREAKS, -1)
    lines = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return docs.select(id_col, F.posexplode(lines).alias("n", "line")).withColumn("n", F.col("n") + 1)


def grep(docs: DataFrame, pattern: str, id_col: str = "doc_id", max_line: int = 1000) -> DataFrame:
    """Matching lines, each cut to ``max_line`` before matching and to 200 for output."""
    if repeats_a_repeat(pattern):
        raise ValueError("nested quantifiers are refused")
    cut = numbered_lines(docs, id_col).withColumn("line", F.substring("line", 1, max_line)).where(F.col("line").rlike(pattern))
    shown = F.trim("line")
    return cut.select(id_col, "n", F.when(F.length(shown) > 200, F.concat(F.substring(shown, 1, 200), F.lit("..."))).otherwise(shown).alias("line"))


def searchable(files: DataFrame, glob: str = "*", path_col: str = "source") -> DataFrame:
    """Files (``path_col, text``) whose name matches ``glob``, outside the skipped folders, that do not look like credentials."""
    parts = F.split(F.col(path_col), "/")
    name = F.element_at(parts, -1)
    secret = F.lower(name).isin(*SECRET_NAMES)
    for suffix in SECRET_SUFFIXES:
        secret |= F.lower(name).endswith(suffix)
    return files.where(name.rlike("^" + fnmatch.translate(glob).removesuffix(r"\z").removesuffix(r"\Z") + "$") & ~F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED_FOLDERS))) & ~secret)


def grep_report(files: DataFrame, pattern: str, glob: str = "*", max_results: int = 100, path_col: str = "source") -> DataFrame:
    """``n, line``: ``path:number: text`` of the first ``max_results`` matching lines by path and number.

    A last row says that the search stopped there; without a match the only row says in how many files there was none.
    The files are searched once, at the call.
    """
    spark = files.sparkSession
    own = searchable(files.where("text is not null"), glob, path_col).select(path_col, "text")
    top = grep(own, pattern, path_col).orderBy(path_col, "n").limit(max_results).collect()  # a report's length
    lines = [f"{r[path_col]}:{r['n']}: {r['line']}" for r in top]
    if len(lines) >= max_results:
        lines.append(f"... stopped at {max_results} results")
    return spark.createDataFrame(list(enumerate(lines or [f"no matches for {pattern!r} in {own.count()} files"], 1)), "n int, line string")


def read_lines(docs: DataFrame, start: int | None = None, end: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """``id_col, shown, error``: lines ``start`` to ``end`` (from 1) with right-aligned numbers; an empty range is an error."""
    parts = F.split(F.coalesce("text", F.lit("")), BREAKS, -1)
    lines = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    lo, n = max((start or 1) - 1, 0), F.size("_l")
    hi = F.least(F.lit(end), n) if end else n
    rows = docs.select(id_col, lines.alias("_l"))
    width = F.length(hi.cast("string"))
    numbered = F.transform(F.slice("_l", F.lit(lo + 1), F.greatest(hi - lo, F.lit(0))), lambda x, i: F.concat(F.lpad((i + lo + 1).cast("string"), width, F.lit(" ")), F.lit("  "), x))
    error = F.when(hi <= lo, F.concat(F.lit(f"line range {start}-{end} is empty; the file has "), n.cast("string"), F.lit(" lines")))
    return rows.select(id_col, F.when(hi > lo, F.array_join(numbered, "\n")).alias("shown"), error.alias("error"))
