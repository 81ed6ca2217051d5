"""A Merkle manifest of documents: leaves by source, ternary trees, proofs and their check after tampering.

Leaves are numbered by a range sort on (source, doc_id), so that a large source is spread over many tasks; only a count for
each part and source is added up.  Each run of ``3 ** levels`` leaves of a source is a superblock.  Going up, a superblock
is reduced to one node, the nodes are superblocks again, and so on to the source's subroot; subroots go the same way to
the root.  Going down, the nodes of each superblock are cogrouped with what lies outside it on the way to the root (one
row), which finishes the local reduction, joins both halves of each proof and folds the tampered leaf in one step.  No task
holds more than a superblock, and the driver gets only two counts.

A null value is written ``-``.  A null id comes first in its source, a null source before all others; leaves of one source
and id are ordered by their digest, and equal rows keep a leaf each.  An id that is null has the crc32 of an empty text.
An empty text has zero bytes, unlike a null one; long texts are hashed whole.  Other columns are not read, whatever their
names.  An empty table gives no row.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, id_bucket, materialize

#: Children of a node.
RUN = 3
#: Levels that a superblock spans: at most 729 nodes of one tree meet in a task.
LEVELS = 6


def _part(value):
    """``-`` if null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(text):
    whole = [F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long")]
    return F.sha2(F.concat(*[_part(c) for c in whole], _part(text)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """``source, doc_id, leaf, tampered``; the last is null where tampering changes nothing."""
    text = F.col("text").cast("string")
    hit = (id_bucket("doc_id", 2) == 0) & text.contains("\n")
    return docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(text).alias("leaf"), F.when(hit, leaf_digest(F.replace(text, F.lit("\n"), F.lit("")))).alias("tampered"))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``tree`` (the rank of the source), ``pos`` (the leaf's place in it), ``n`` (its leaves) and ``trees``."""
    order = ["source", "doc_id", "leaf", "uid"]
    fixed = materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "leaves")

    def count(batches):
        part, run, place, last = TaskContext.get().partitionId(), -1, 0, object()
        for batch in batches:
            runs, places = [], []
            for source in batch.column("source").to_pylist():
                if source != last:
                    run, place, last = run + 1, 0, source
                runs.append(run)
                places.append(place)
                place += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(runs), pa.int64()), pa.array(runs, pa.int64()), pa.array(places, pa.int64())], names=[*batch.schema.names, "part", "run", "place"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fixed.schema.fields) + ", part long, run long, place long"
    placed = materialize(fixed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(count, schema), "placed")
    # parts are in the order of sources: a source's run is its first, or goes on from an earlier part as that part's run 0
    own = Window.partitionBy("source")
    runs = placed.groupBy("part", "run").agg(F.first("source").alias("source"), F.count("*").alias("size"))
    runs = runs.withColumns({"before": F.coalesce(F.sum("size").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")), "n": F.sum("size").over(own)})
    runs = materialize(runs, "runs")
    fresh = runs.where("before = 0").groupBy("part").agg(F.count("*").alias("new"), F.min("run").alias("low"))
    # one row for each part of the sort, whatever the number of sources
    fresh = fresh.select("part", "low", (F.sum("new").over(Window.orderBy("part")) - F.col("new")).alias("base"), F.sum("new").over(Window.partitionBy()).alias("trees"))
    ranked = runs.join(fresh, "part", "left").withColumn("tree", F.when(F.col("before") == 0, F.col("base") + F.col("run") - F.col("low")))
    ranked = ranked.select("part", "run", "before", "n", F.max("tree").over(own).alias("tree"))
    ranked = bounded(materialize(ranked, "ranked"))
    return placed.join(ranked, ["part", "run"]).select("tree", (F.col("before") + F.col("place")).alias("pos"), "n", F.col("leaf").alias("node"), "tampered", "doc_id")


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def reduced(nodes: list[str], n: int, levels: int = LEVELS) -> list[list[str]]:
    """All levels of a superblock, from its nodes up; ``n`` is the number of nodes of its tree on that level."""
    out = [nodes]
    while n > 1 and len(out) <= levels:
        nodes = [_hash("".join(nodes[i : i + RUN])) for i in range(0, len(nodes), RUN)]
        n = -(-n // RUN)
        out.append(nodes)
    return out


def inner_path(levels: list[list[str]], i: int) -> list[str]:
    """For each level of node ``i``'s way up: ``left siblings|right siblings``."""
    out = []
    for row in levels[:-1]:
        k = i % RUN
        run = row[i - k : i - k + RUN]
        out.append("".join(run[:k]) + "|" + "".join(run[k + 1 :]))
        i //= RUN
    return out


def folded(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its path give."""
    for step in path:
        left, _, right = step.partition("|")
        leaf = _hash(left + leaf + right)
    return leaf


_NODES = "tree long, pos long, n long, node string"


def _risen(nodes: DataFrame, levels: int) -> DataFrame:
    """One node for each superblock."""
    width = RUN**levels

    def finish(key, rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].iat[0])
        top = reduced(rows.sort_values("pos")["node"].tolist(), n, levels)[-1]
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "n": [-(-n // width)], "node": top})

    return nodes.select("tree", "pos", "n", "node", F.expr(f"pos div {width}").alias("block")).groupBy("tree", "block").applyInPandas(finish, _NODES)


def climbed(nodes: DataFrame, most: int, levels: int = LEVELS) -> list[DataFrame]:
    """The nodes of each round, the last with one node a tree; ``most`` is the size of the largest tree."""
    rounds = [nodes]
    while most > 1 or len(rounds) < 2:
        rounds.append(materialize(_risen(rounds[-1], levels), "nodes"))
        most = -(-most // RUN**levels)
    return rounds


def _within(levels: int, nodes: DataFrame, outer: DataFrame):
    """Nodes by superblock beside the one row of what lies outside each."""
    block = nodes.withColumn("block", F.expr(f"pos div {RUN**levels}")).groupBy("tree", "block")
    return block.cogroup(outer.groupBy("tree", "pos"))


def descended(rounds: list[DataFrame], outer: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``tree, pos, path, subroot, root`` of the nodes of the first round but the lowest, from those of the last one."""

    def extend(nodes: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("pos")
        way = reduced(nodes["node"].tolist(), int(nodes["n"].iat[0]), levels)
        rest = top["path"].iat[0]
        paths = [";".join([*inner_path(way, i), *filter(None, [rest])]) for i in range(len(nodes))]
        return pd.DataFrame({"tree": nodes["tree"], "pos": nodes["pos"], "path": paths, "subroot": top["subroot"].iat[0], "root": top["root"].iat[0]})

    for nodes in reversed(rounds[:-1]):
        outer = materialize(_within(levels, nodes, outer).applyInPandas(extend, "tree long, pos long, path string, subroot string, root string"), "paths")
    return outer


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every document."""
    base = materialize(numbered(leaves(docs)), "forest")
    most, trees = base.agg(F.max("n"), F.max("tree") + 1).first()
    most, trees = most or 0, trees or 0
    sources = climbed(base, most, levels)
    subroots = sources[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(trees).cast("long").alias("n"), "node")
    above = climbed(subroots, trees, levels)
    empty = F.lit(None).cast("string")
    top = descended(above, above[-1].select("tree", "pos", F.lit("").alias("path"), empty.alias("subroot"), F.col("node").alias("root")), levels)
    top = top.withColumnRenamed("pos", "rank").join(subroots.select(F.col("pos").alias("rank"), F.col("node").alias("own")), "rank")
    outer = descended(sources[1:], top.select(F.col("rank").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("own").alias("subroot"), "root"), levels)

    def finish(nodes: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("pos")
        own = nodes["node"].tolist()
        way = reduced(own, int(nodes["n"].iat[0]), levels)
        rest = [x for x in top["path"].iat[0].split(";") if x]
        root, out = top["root"].iat[0], []
        for i, (leaf, tampered) in enumerate(zip(own, nodes["tampered"], strict=True)):
            path = inner_path(way, i) + rest
            found = folded(tampered if isinstance(tampered, str) else leaf, path)
            out.append((_hash("".join(path).replace("|", "")), found, found == root))
        proof, found, same = zip(*out, strict=True)
        return pd.DataFrame({"doc_id": nodes["doc_id"], "leaf": own, "subroot": top["subroot"].iat[0], "root": root, "proof_sha256": proof, "folded_root": found, "verified": same})

    # ids travel as text: pandas has no nulls among longs
    lowest = sources[0].withColumn("doc_id", F.col("doc_id").cast("string"))
    done = _within(levels, lowest, outer).applyInPandas(finish, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return done.withColumn("doc_id", F.col("doc_id").cast("long"))
