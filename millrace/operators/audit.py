"""Resolving logged tool calls and auditing their paths, commands and permissions.

The tool catalog (``name, required array<string>, default_policy``) is a checked small table.
"""

from __future__ import annotations

import difflib
import json
import shlex

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.toolcalls import POSITIONAL

MAX_TOOLS = 10_000

# What the audit looks for.
ENCODED = ("%2e", "%2f", "%5c", "\x00")
SECRET_NAMES = (".env", ".env.local", ".env.production", "id_rsa", "id_ed25519", ".netrc", ".pgpass", "credentials", "secrets.yaml", "secrets.yml")
SECRET_SUFFIXES = (".pem", ".key", ".p12", ".pfx")
PROGRAMS = ("ls", "cat", "head", "tail", "wc", "file", "stat", "find", "grep", "rg", "sort", "uniq", "cut", "tr", "git", "echo", "pwd", "date", "which")
BANNED_FLAGS = ("-exec", "-execdir", "-ok", "-okdir", "-fprint", "-fprintf", "-fls", "--exec-path", "--upload-pack", "-c", "--command", "--use-compress-program")
GIT_READS = ("status", "log", "diff", "show", "branch", "ls-files", "rev-parse", "describe", "blame", "remote")
SHELL = r"`|\$\(|[;|><&]"
MUTATING = "write|edit|move|delete|create|put|patch"


def _catalog_rows(catalog: DataFrame) -> list:
    rows = catalog.limit(MAX_TOOLS + 1).collect()
    if len(rows) > MAX_TOOLS:
        raise ValueError(f"a catalog holds at most {MAX_TOOLS} tools")
    if len({r["name"] for r in rows}) < len(rows):
        raise ValueError("a tool is listed twice")
    return rows


def resolve(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """``calls`` (``name, arguments`` JSON text) with ``resolved`` arguments and ``error`` (null: fine).

    Unknown names get the nearest known one at a ratio of 0.7 or more; a bare string becomes the only
    required argument; missing required ones are named.
    """
    names = sorted(r["name"] for r in _catalog_rows(catalog))

    @F.pandas_udf("struct<near:string,moved:string>")
    def looked_up(asked: pd.Series, arguments: pd.Series, key: pd.Series) -> pd.DataFrame:
        """The known name nearest to an unknown one, and arguments whose bare string has got its key; null where not asked."""
        near = {a: next(iter(difflib.get_close_matches(a, names, n=1, cutoff=0.7)), None) for a in asked.dropna().unique()}
        moved = []
        for a, k in zip(arguments, key, strict=True):
            if k is None:
                moved.append(None)
                continue
            held = json.loads(a)
            held[k] = held.pop(POSITIONAL)
            moved.append(json.dumps(held, ensure_ascii=False))
        return pd.DataFrame({"near": asked.map(near.get, na_action="ignore").astype(object), "moved": pd.Series(moved, dtype=object)})

    tools = catalog.select("name", F.col("required").alias("_required"), F.lit(True).alias("_known"))
    joined = calls.join(F.broadcast(tools), "name", "left")
    bare, need = F.get_json_object("arguments", f"$.{POSITIONAL}"), F.coalesce("_required", F.array().cast("array<string>"))
    alone = bare.isNotNull() & (F.size(need) == 1)
    # one pass over the calls, however they were made
    found = looked_up(F.when(F.col("_known").isNull(), F.col("name")), F.when(alone, F.col("arguments")), F.when(alone, need[0]))
    every = joined.withColumn("_found", found).withColumn("_near", F.col("_found.near")).withColumn("resolved", F.coalesce("_found.moved", "arguments"))
    missing = F.array_except(need, F.coalesce(F.json_object_keys("resolved"), F.array().cast("array<string>")))
    hint = F.when(F.col("_near").isNotNull(), F.concat(F.lit(" Did you mean '"), "_near", F.lit("'?"))).otherwise("")
    no_tool = F.concat(F.lit("no tool named '"), F.coalesce("name", F.lit("")), F.lit("'."), hint, F.lit(" Available: " + ", ".join(names)))
    string = F.concat("name", F.lit(" got a bare string but takes "), F.size(need).cast("string"), F.lit(" required arguments ("), F.array_join(need, ", "), F.lit("). Send an object."))
    error = F.when(F.col("_known").isNull(), no_tool).when(bare.isNotNull() & (F.size(need) != 1), string).when(F.size(missing) > 0, F.concat(F.lit("invalid arguments -- missing required: "), F.array_join(missing, ", ")))
    return every.select(*calls.columns, "resolved", error.alias("error"))


def external_policy(name: Column, policy: Column) -> Column:
    """The default policy of an outside tool: one whose name says that it changes things is never just allowed."""
    return F.when(F.lower(name).rlike(MUTATING) & (policy == "allow"), "ask").otherwise(policy)


def decide(calls: DataFrame, catalog: DataFrame, overrides: DataFrame, approvals: DataFrame | None = None, auto_approve: bool = False) -> DataFrame:
    """``calls`` with ``policy`` (allow, deny, ask, auto) and ``allowed``.

    ``overrides``: ``name, override``; ``approvals``: ``call_id, approved``.  Without an approval an asked call is refused.
    """
    for side in (catalog, overrides):
        _catalog_rows(side.select("name"))
    out = calls.join(F.broadcast(catalog.select("name", "default_policy")), "name", "left").join(F.broadcast(overrides), "name", "left")
    policy = F.coalesce("override", "default_policy", F.lit("ask"))
    out = out.withColumn("policy", F.when((policy == "ask") & F.lit(auto_approve), "auto").otherwise(policy))
    answer = F.lit(False)
    if approvals is not None:
        out, answer = out.join(approvals, "call_id", "left"), F.coalesce("approved", F.lit(False))
    return out.withColumn("allowed", F.when(F.col("policy").isin("allow", "auto"), True).when(F.col("policy") == "deny", False).otherwise(answer)).select(*calls.columns, "policy", "allowed")


def audit_summary(decisions: DataFrame, *keys: str) -> DataFrame:
    return decisions.groupBy(*keys).agg(F.count("*").alias("checks"), F.count_if(~F.col("allowed")).alias("denied"), F.array_sort(F.collect_set(F.when(~F.col("allowed"), F.col("name")))).alias("denied_tools"))


def _parts(path: Column, root: str) -> Column:
    """The path's parts after ``.`` and ``..`` are folded; relative ones start at ``root``."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))

    def fold(seen, part):
        up = F.slice(seen, F.lit(1), F.greatest(F.size(seen) - 1, F.lit(0)))
        return F.when(part.isin("", "."), seen).when(part == "..", up).otherwise(F.concat(seen, F.array(part)))

    return F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), fold)


def path_problem(path: Column, root: str) -> Column:
    """Why a path is refused (``empty``, ``encoded``, ``escape``, ``credential``), null if it is not; lexical only."""
    parts, home = _parts(path, root), [p for p in root.split("/") if p]
    last = F.element_at(parts, -1)
    inside = F.slice(parts, 1, len(home)) == F.array(*[F.lit(p) for p in home]) if home else F.lit(True)
    secret = F.lower(last).isin(*SECRET_NAMES) | F.lower(last).rlike("(" + "|".join(s.replace(".", r"\.") for s in SECRET_SUFFIXES) + ")$") | (F.array_contains(parts, ".git") & (last == "config"))
    coded = F.lit(False)
    for mark in ENCODED:
        coded = coded | F.lower(path).contains(mark)
    return F.when(path.isNull() | ~path.rlike(r"\S"), "empty").when(coded, "encoded").when(~inside, "escape").when(F.coalesce(secret, F.lit(False)), "credential")


def path_candidates(arg: Column) -> Column:
    """The path-shaped values of an argument: itself, or what a flag carries."""
    value = F.regexp_extract(arg, r"(?s)^-[^=]*=(.*)$", 1)
    joined = F.when(arg.startswith("-") & ~arg.startswith("--") & ~arg.contains("=") & (F.length(arg) > 2), F.substring(arg, 3, 1 << 30)).otherwise("")
    return F.filter(F.array(arg, value, joined), lambda x: (x != "") & ~x.startswith("-") & (x.contains("/") | x.contains("..") | x.startswith("~")))


def _strings(value) -> list[str]:
    if isinstance(value, str):
        return [value]
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else []
    return [s for v in inner for s in _strings(v)]


def argument_strings(arguments: Column) -> Column:
    """Every string nested anywhere in a JSON text; none if it cannot be read."""

    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            try:
                out.append(_strings(json.loads(v)) if v else [])
            except ValueError:
                out.append([])
        return pd.Series(out, dtype=object)

    return run(arguments)


def confine(calls: DataFrame, root: str) -> DataFrame:
    """``calls`` with ``refused``: structs of argument and problem for every path-shaped value outside ``root`` or secret."""
    held = F.flatten(F.transform(F.col("_strings"), lambda a: F.transform(path_candidates(a), lambda c: F.struct(a.alias("arg"), path_problem(c, root).alias("problem")))))
    return calls.withColumn("_strings", argument_strings(F.col("arguments"))).withColumn("refused", F.filter(held, lambda x: x["problem"].isNotNull())).drop("_strings")


def _split_command(commands: pd.Series) -> pd.DataFrame:
    rows = []
    for c in commands:
        try:
            rows.append((shlex.split((c or "").strip()), None))
        except ValueError as e:
            rows.append((None, str(e)))
    return pd.DataFrame(rows, columns=["argv", "error"])


def audit_commands(commands: DataFrame, root: str, col: str = "command") -> DataFrame:
    """``commands`` with ``refusal``: null if allowed, else the first of ``empty, quoting, shell, program, flag, escape,
    credential, git`` that holds (path problems by their own names)."""
    words = commands.withColumn("_w", F.pandas_udf(_split_command, "struct<argv:array<string>,error:string>")(F.col(col)))
    argv = F.col("_w.argv")
    rest = F.slice(argv, F.lit(2), F.greatest(F.size(argv), F.lit(0)))
    program = F.regexp_extract(argv[0], r"([^/]+)/*$", 1)
    shell = F.exists(argv, lambda t: ~t.rlike(r"\s") & t.rlike(SHELL))
    flag = F.exists(rest, lambda a: F.split(a, "=")[0].isin(*BANNED_FLAGS))
    problems = F.filter(F.transform(F.flatten(F.transform(rest, path_candidates)), lambda c: path_problem(c, root)), lambda p: p.isNotNull())
    sub = F.get(F.filter(rest, lambda a: ~a.startswith("-")), F.lit(0))
    refusal = (
        F.when(F.col("_w.error").isNotNull(), "quoting").when(F.size(argv) == 0, "empty").when(shell, "shell").when(~program.isin(*PROGRAMS), "program").when(flag, "flag")
        .when(F.size(problems) > 0, F.get(problems, F.lit(0))).when((program == "git") & ~F.coalesce(sub.isin(*GIT_READS), F.lit(False)), "git")
    )
    return words.withColumn("refusal", refusal).drop("_w")
