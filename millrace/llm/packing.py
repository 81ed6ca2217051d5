"""Sequence packing by non-negative least squares.

Documents are cut into whole windows and one remainder each.  The remainders' length histogram
(at most ``window`` counts) is all that the driver sees: shallow combinations of up to three length
classes that fill a window are enumerated, their repeat counts solved by non-negative least squares
(Lawson-Hanson), rounded down, and what is left is packed greedily, longest first, again as counts.
The plan is a list of exact length patterns; pieces find their slot by their rank among the pieces of
their length, which salted counts give without sorting a hot length in one task.

A null or empty text has only its end id and is packed like any other; repeated rows are packed each; long texts are cut
into as many windows as they need.  Ties between pieces of a length go by (doc_id, start).  Other columns are not read,
whatever their names.  An empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_id_of, keyed, materialize, small
from .encode import encoder, text_groups

#: Remainder lengths are solved in classes of so many lengths; the exact lengths are used when patterns are filled.
CLASS = 8
END_ID = 1


def pieces(docs: DataFrame, path: str, window: int = 2048, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Whole windows and the remainder of every document: ``did, start, length, ids_crc32, doc_tokens, salt, piece`` (and ``ids``).

    ``salt`` numbers the pieces of a task round robin; it only spreads equal lengths over tasks.  ``piece`` is a number of
    its own for each piece of the written table.  ``ids`` below 65,536 are written in two bytes each, in all of a piece or none.
    """
    spark = docs.sparkSession
    salts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        enc, salt, piece = encoder(path, True), 0, TaskContext.get().partitionId() << 33
        for batch in small(batches):
            names, texts = batch.column("did").to_pylist(), batch.column("text").to_pylist()
            for i, j in text_groups(texts):
                cols: list[list] = [[] for _ in range(8)]
                for did, own in zip(names[i:j], enc.encode_many(texts[i:j]), strict=True):
                    own += end
                    n = len(own) // 4
                    for s in range(0, n, window):
                        part = own[4 * s : 4 * (s + window)]
                        salt, piece = (salt + 1) % salts, piece + 1
                        for c, v in zip(cols, (did, s, len(part) // 4, zlib.crc32(part), n, salt, piece, part), strict=True):
                            c.append(v)
                arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
                out_names = ["did", "start", "length", "ids_crc32", "doc_tokens", "salt", "piece"]
                if with_ids:
                    arrays.append(pa.array([_narrow(x) for x in cols[7]], pa.binary()))
                    out_names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=out_names)

    schema = "did long, start long, length long, ids_crc32 long, doc_tokens long, salt long, piece long" + ", ids binary" * with_ids
    return materialize(keyed(docs).mapInArrow(run, schema), "pieces")


def _narrow(ids: bytes) -> bytes:
    wide = np.frombuffer(ids, "<u4")
    return wide.astype("<u2").tobytes() if wide.max() < 1 << 16 else ids


def _wide(batches):
    """Ids in four bytes each again."""
    for batch in batches:
        at = batch.schema.get_field_index("ids")
        own = [np.frombuffer(x, "<u2").astype("<u4").tobytes() if len(x) == 2 * n else x for x, n in zip(batch.column(at).to_pylist(), batch.column("length").to_pylist(), strict=True)]
        yield batch.set_column(at, "ids", pa.array(own, pa.binary()))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Lawson-Hanson: x >= 0 with least ||a x - b||."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, dtype=bool)
    for _ in range(rounds or 3 * a.shape[0]):
        grad = a.T @ (b - a @ x)
        grad[active] = -np.inf
        j = int(np.argmax(grad))
        if grad[j] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        active[j] = True
        while True:
            at = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if z.min() > 0:
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - z[low], 1e-300))
            x[at] += step * (z - x[at])
            gone = at[(x[at] <= 1e-12)]
            x[gone] = 0
            active[gone] = False
            if not active.any():
                break
    return x


def combinations_filling(classes: int) -> list[tuple[int, ...]]:
    """One, two or three length classes (1..classes) that together fill all classes of a window."""
    out: list[tuple[int, ...]] = [(classes,)]
    out += [(i, classes - i) for i in range(1, classes // 2 + 1)]
    out += [(i, j, classes - i - j) for i in range(1, classes // 3 + 1) for j in range(i, (classes - i) // 2 + 1)]
    return out


def plan(histogram: dict[int, int], window: int = 2048, size: int = CLASS) -> list[tuple[tuple[int, ...], int]]:
    """Exact patterns (piece lengths of a sequence) and how many sequences follow each.

    The histogram has at most ``window`` lengths, so the plan's size does not grow with the data.
    """
    left = np.zeros(window + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] += n
    out: list[tuple[tuple[int, ...], int]] = []
    if left[window]:
        out.append(((window,), int(left[window])))
        left[window] = 0
    while window % size:
        size //= 2
    classes = window // size
    if left.any():
        combos = combinations_filling(classes)
        a = np.zeros((classes, len(combos)))
        for j, combo in enumerate(combos):
            for c in combo:
                a[c - 1, j] += 1
        b = np.add.reduceat(left[1:], np.arange(0, window, size)).astype(float)
        counts = np.floor(nnls(a, b) + 1e-9).astype(np.int64)
        for j in np.argsort(-counts, kind="stable"):
            want = int(counts[j])
            while want > 0:  # every pass uses up a length of one class or all that is wanted
                lengths = []
                for c, k in Counter(combos[j]).items():
                    for _ in range(k):
                        own = [x for x in range(c * size, (c - 1) * size, -1) if left[x] > lengths.count(x)]
                        lengths.append(own[0] if own else 0)
                if 0 in lengths:
                    break
                used = Counter(lengths)
                n = min(want, *(int(left[x]) // k for x, k in used.items()))
                for x, k in used.items():
                    left[x] -= n * k
                out.append((tuple(lengths), n))
                want -= n
    while left.any():  # greedy: longest first, then the longest that still fits
        lengths, room = [], window
        spare = left.copy()
        while room and (fits := np.flatnonzero(spare[: room + 1])).size:
            x = int(fits[-1])
            k = min(room // x, int(spare[x]))
            lengths += [x] * k
            spare[x] -= k
            room -= x * k
        used = Counter(lengths)
        n = min(int(left[x]) // k for x, k in used.items())
        for x, k in used.items():
            left[x] -= n * k
        out.append((tuple(lengths), n))
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """``length, low rank, high rank, first sequence, offset, per``: where the pieces of a length go, by rank.

    ``per`` pieces of the length follow each other in each of the pattern's sequences.
    """
    used: Counter = Counter()
    out, sequence = [], 0
    for lengths, n in patterns:
        at = 0
        for x, per in sorted(Counter(lengths).items(), reverse=True):
            out.append((x, used[x], used[x] + n * per, sequence, at, per))
            used[x] += n * per
            at += x * per
        sequence += n
    return out


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``).

    The ids (little-endian unsigned 32-bit numbers) are not ranked with the pieces; they join their places by the piece's number.
    """
    spark = docs.sparkSession
    whole = pieces(docs, path, window, end_id, with_ids)
    rows = whole.drop("ids")
    counts = materialize(rows.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(plan(histogram, window))
    at = spark.createDataFrame(table or [(0, 0, 0, 0, 0, 1)], "length long, low long, high long, sequence long, offset long, per long")
    ranked = rows.withColumn("own", F.row_number().over(Window.partitionBy("length", "salt").orderBy("did", "start")) - 1)
    placed = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own"))
    # the slot table has a bounded number of rows whatever the data, hence the broadcast
    hit = placed.join(F.broadcast(at), "length").where("rank >= low and rank < high")
    cols = [doc_id_of(), "start", "length", "ids_crc32", "doc_tokens", F.expr("sequence + (rank - low) div per").alias("sequence_id"), F.expr("offset + (rank - low) % per * length").alias("offset")]
    if not with_ids:
        return hit.select(*cols)
    places = materialize(hit.select("piece", *cols), "places")
    joined = places.join(whole.select("piece", "ids"), "piece").drop("piece")
    return joined.mapInArrow(_wide, joined.schema)
