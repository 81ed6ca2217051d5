"""Repair of conversations whose turns are blank, repeated, cut off or out of order, with the cheapest edits.

A row is blank (nothing but white space), a duplicate (role and text came earlier in its conversation) or truncated (its last
visible character is none of ``.!?``); the first fault counts.  Keep costs 0, rerole to user or assistant 1, delete 2, insert an
empty turn 5, a truncated row that stays 5; blank and duplicate rows must go.  What is left reads system?, then pairs of user and
assistant, or nothing.  The audit names the edits in order (K, R, D, I); of equally cheap ones it is the least in ASCII.

Each conversation becomes a signature, a letter for the role and fault of each row.  All different signatures are sorted by
their reversed text and read as one automaton from the end: signatures that end alike share those nodes, and each
node gets the cost-to-go and the best edit for each state of the grammar once, whatever the number of conversations.
From one node and state no two edits have the same letter, so the best audit suffix is a chain of letters through shared nodes.

Rows of a conversation are ordered by turn (null first), then by the digest of role and text; rows equal in all are repeats of each other.
A null role or text is one space, a null id is a conversation of its own, a role with an empty name has no initial and cannot be
kept.  Signatures come from a range sort, so a conversation with very many rows is spread over tasks, and repeats are
counted before they are shuffled.  Only its hash runs over the sorted rows of a conversation in one task, one row at a time: a digest of the
whole has no parallel form.  Other columns are not read, whatever their names.  An empty table gives no row.
"""

from __future__ import annotations

from hashlib import sha256
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
_SPACE = " \t\n\x0b\f\r"
# States of the grammar: nothing yet, after the system turn, after a user turn, after an assistant turn.
_NEXT = (2, 2, 3, 2)
_ROLE = ("user", "user", "assistant", "user")
_INITIAL = ("u", "u", "a", "u")
_ACCEPTS = (True, False, False, True)


def _key(column: str):
    """A conversation's id as text that is never null."""
    return F.coalesce(F.concat(F.lit(":"), F.col(column).cast("string")), F.lit(""))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with a twentieth of the rows dropped, emptied, cut, repeated or given to the user each."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), as_text("role").alias("role"), as_text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.withColumn("again", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", role.alias("role"), text.alias("text"))


def distinct_rows(conversations: DataFrame) -> DataFrame:
    """``c, turn, h, n, role, text``: equal rows of a conversation as one with their number; ``h`` is the digest of role and text."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(_key("conv_id").alias("c"), F.col("turn").cast("long").alias("turn"), as_text("role").alias("role"), as_text("text").alias("text"))
    rows = rows.withColumn("h", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return materialize(rows.groupBy("c", "turn", "h").agg(F.count("*").alias("n"), F.first("role").alias("role"), F.first("text").alias("text")), "turns")


def judged(rows: DataFrame) -> DataFrame:
    """``c, turn, h, n, initial, blank, cut, later``; ``later``: role and text came in an earlier turn."""
    seen = F.rtrim(F.col("text"), F.lit(_SPACE))
    slim = rows.select("c", "turn", "h", "n", F.substring("role", 1, 1).alias("initial"), (seen == "").alias("blank"), (~F.right(seen, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    first = slim.groupBy("c", "h").agg(F.min(F.struct("turn")).alias("low"), F.count("*").alias("turns")).where("turns > 1").select("c", "h", "low")
    later = F.col("low").isNotNull() & ~F.col("turn").eqNullSafe(F.col("low.turn"))
    return slim.join(first, ["c", "h"], "left").select("c", "turn", "h", "n", "initial", "blank", "cut", later.alias("later"))


_PIECE = {"c": pa.string(), "part": pa.int64(), "signature": pa.string(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "turns": pa.int64(), "low": pa.int64(), "high": pa.int64(), "first": pa.string(), "last": pa.string()}


def _pieces(batches):
    """Rows arrive in order; one piece for each conversation that this task has rows of."""
    part = TaskContext.get().partitionId()
    piece: dict | None = None

    def batch_of(done):
        return pa.RecordBatch.from_pydict({k: pa.array([p[k] if k != "signature" else "".join(p[k]) for p in done], t) for k, t in _PIECE.items()})

    for batch in batches:
        done = []
        for c, turn, n, initial, blank, cut, later in zip(*(batch.column(x).to_pylist() for x in ("c", "turn", "n", "initial", "blank", "cut", "later")), strict=True):
            if piece is None or piece["c"] != c:
                if piece:
                    done.append(piece)
                piece = dict.fromkeys(_PIECE, 0) | {"c": c, "part": part, "signature": [], "low": None, "high": None, "first": initial, "last": None}
            letter = initial if initial in ("s", "u", "a") else "o"
            if blank:
                piece["blank"] += n
                piece["signature"].append("X" * n)
            else:
                piece["duplicate"] += n - 1 + later
                piece["truncated"] += cut and not later
                piece["signature"].append(("X" if later else letter.upper() if cut else letter) + "X" * (n - 1))
            if piece["last"] is not None and piece["last"] + initial not in ("su", "ua", "au"):
                piece["illegal"] += 1
            piece["illegal"] += n - 1
            piece["last"] = initial
            if turn is not None and turn != piece["high"]:
                piece["turns"] += 1
                piece["low"] = turn if piece["low"] is None else piece["low"]
                piece["high"] = turn
        if done:
            yield batch_of(done)
    if piece:
        yield batch_of([piece])


def signatures(rows: DataFrame) -> DataFrame:
    """``c, signature, gaps, blank, duplicate, truncated, illegal`` of each conversation with rows."""
    order = ["c", "turn", "h"]
    kinds = {pa.string(): "string", pa.int64(): "long"}
    schema = ", ".join(f"{k} {kinds[t]}" for k, t in _PIECE.items())
    ordered = materialize(judged(rows), "judged").repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = materialize(ordered.mapInArrow(_pieces, schema), "pieces")
    # a conversation has at most one piece a task: what lies across two pieces is settled here
    before = Window.partitionBy("c").orderBy("part")
    last = F.lag("last").over(before)
    across = last.isNotNull() & ~F.concat(last, F.col("first")).isin("su", "ua", "au")
    earlier = F.max("high").over(before.rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.withColumns({"illegal": F.col("illegal") + across.cast("long"), "turns": F.col("turns") - F.coalesce(earlier == F.col("low"), F.lit(False)).cast("long")})
    merged = pieces.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("part", "signature"))).alias("all"), *[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated", "illegal", "turns")], F.min("low").alias("low"), F.max("high").alias("high"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("long"))
    return merged.select("c", F.array_join(F.col("all.signature"), "").alias("signature"), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal")


#: A node: cost-to-go by state, best letter by state.
Node = tuple[tuple[int, ...], str]


def _settled(costs: list[int], letters: list[str]) -> Node:
    """The edits that consume a row, and beside them those that insert first."""
    out, best = list(costs), list(letters)
    for s in (3, 2, 3, 2, 0, 1):  # a user turn and its answer follow each other, so twice is enough
        other = INSERT + out[_NEXT[s]]
        if (other, "I") < (out[s], best[s]):
            out[s], best[s] = other, "I"
    return tuple(out), "".join(best)


_NEVER = 1 << 60
END: Node = _settled([0 if a else _NEVER for a in _ACCEPTS], [" " if a else "~" for a in _ACCEPTS])


def node(letter: str, below: Node) -> Node:
    """The node that a row in front of ``below`` leads to."""
    costs, letters = [], []
    own = letter.lower()
    for s in range(4):
        ways = [(DELETE + below[0][s], "D")]
        if letter != "X":
            stay = TRUNCATED if letter.isupper() else 0
            ways.append((REROLE + stay + below[0][_NEXT[s]], "R"))
            if own == _INITIAL[s]:
                ways.append((stay + below[0][_NEXT[s]], "K"))
            elif own == "s" and s == 0:
                ways.append((stay + below[0][1], "K"))
        cost, best = min(ways)
        costs.append(cost)
        letters.append(best)
    return _settled(costs, letters)


def audit_of(signature: str, nodes: list[Node]) -> str:
    """The best audit: ``nodes[k]`` is the node before the last ``k`` rows."""
    out, s, k = [], 0, len(signature)
    while True:
        edit = nodes[k][1][s]
        if edit == " ":
            return "".join(out)
        out.append(edit)
        if edit == "D":
            k -= 1
        elif edit == "I":
            s = _NEXT[s]
        else:
            s = 1 if edit == "K" and s == 0 and signature[-k] in "sS" else _NEXT[s]
            k -= 1


def _solve(batches):
    """Signatures arrive sorted from their ends; the nodes of the last one are at hand, and what it shares with the next stays."""
    last, nodes = "", [END]
    for batch in batches:
        signature = batch.column("signature").to_pylist()
        cost, audit = [], []
        for text in signature:
            ends = text[::-1]
            del nodes[len(commonprefix((last, ends))) + 1 :]
            for letter in ends[len(nodes) - 1 :]:
                nodes.append(node(letter, nodes[-1]))
            last = ends
            cost.append(nodes[-1][0][0])
            audit.append(audit_of(text, nodes))
        yield pa.RecordBatch.from_arrays([batch.column("signature"), pa.array(cost, pa.int64()), pa.array(audit, pa.string())], names=["signature", "cost", "audit"])


def solved(found: DataFrame) -> DataFrame:
    """``signature, cost, audit`` of each different signature."""
    different = materialize(found.groupBy("signature").agg(F.count("*").alias("conversations")).withColumn("ends", F.reverse("signature")), "signatures")
    return different.repartitionByRange("ends").sortWithinPartitions("ends").select("signature").mapInArrow(_solve, "signature string, cost long, audit string")


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class _Walk:
    """Applies an audit to the rows of a conversation, one after another."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _turn(self, edit: str, role: str, text: str):
        if edit == "K" and self.state == 0 and role[:1] == "s":
            self.state = 1
            return edit, role, text
        own = role if edit == "K" else _ROLE[self.state]
        self.state = _NEXT[self.state]
        return edit, own, text

    def inserted(self):
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._turn("I", "", "")

    def row(self, role: str, text: str, n: int):
        yield from self.inserted()
        for k in range(n):
            if k:
                yield from self.inserted()
            edit = self.audit[self.at]
            self.at += 1
            if edit != "D":
                yield self._turn(edit, role, text)


def _walked(batches, start, step, finish):
    """Calls for each conversation's header, repaired turns and end; rows arrive sorted, a header first."""
    state = walk = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["kind"] == 0:
                if state is not None:
                    for turn in walk.inserted():
                        step(state, turn, out)
                    finish(state, out)
                state, walk = start(row), _Walk(row["audit"])
            else:
                for turn in walk.row(row["role"], row["text"], row["n"]):
                    step(state, turn, out)
        yield out
    if state is not None:
        out = []
        for turn in walk.inserted():
            step(state, turn, out)
        finish(state, out)
        yield out


def _stream(conversations: DataFrame, ids: DataFrame) -> DataFrame:
    """Each conversation's header (counts, cost, audit) and its rows, sorted within one task."""
    rows = distinct_rows(conversations)
    found = materialize(signatures(rows), "found")
    known = found.join(solved(found), "signature").drop("signature")
    heads = ids.select(_key("conv_id").alias("c"), F.col("conv_id").cast("string").alias("conv_id")).distinct().join(known, "c", "left")
    heads = heads.select("c", "conv_id", *[F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in _COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.lit(0).alias("kind"))
    both = heads.unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition("c").sortWithinPartitions("c", "kind", "turn", "h")


def repair_digest(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``, a row for every conversation of ``ids``."""
    ids = conversations if ids is None else ids

    def start(head):
        return [head, sha256(), ""]

    def step(state, turn, out):
        state[1].update(f"{state[2]}{turn[1]}:{turn[2]}".encode())
        state[2] = "\n"

    def finish(state, out):
        out.append((*(state[0][x] for x in ("conv_id", *_COUNTS, "audit")), state[1].hexdigest()))

    types = [pa.string(), *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]
    names = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]

    def run(batches):
        for out in _walked(batches, start, step, finish):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    done = _stream(conversations, ids).mapInArrow(run, "conv_id string, " + ", ".join(f"{x} long" for x in _COUNTS) + ", audit string, repaired_sha256 string")
    return done.withColumn("conv_id", F.col("conv_id").cast(ids.schema["conv_id"].dataType))


def repaired(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, edit, role, text``: the turns of each repaired conversation, in order from 0."""

    def start(head):
        return [head["conv_id"], 0]

    def step(state, turn, out):
        out.append((*state, *turn))
        state[1] += 1

    types, names = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()], ["conv_id", "place", "edit", "role", "text"]

    def run(batches):
        for out in _walked(batches, start, step, lambda state, out: None):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    done = _stream(conversations, conversations).mapInArrow(run, "conv_id string, place long, edit string, role string, text string")
    return done.withColumn("conv_id", F.col("conv_id").cast(conversations.schema["conv_id"].dataType))
