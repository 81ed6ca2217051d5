"""The manifest against a direct build of all trees."""

import random
import zlib
from hashlib import sha256

import pytest

from millrace.llm import merkle

COLS = "doc_id long, source string, lang string, n_chars long, text string, n long, node string"


def h(x):
    return sha256(x.encode()).hexdigest()


def leaf_of(row, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, i):
    out = []
    for row in levels[:-1]:
        run = row[i // 3 * 3 : i // 3 * 3 + 3]
        out.append((run[: i % 3], run[i % 3 + 1 :]))
        i //= 3
    return out


def brute_force(rows):
    by = {}
    for r in rows:
        hit = zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 2 == 0
        text = r[4].replace("\n", "") if hit and r[4] is not None else r[4]
        by.setdefault(r[1], []).append((r[0], leaf_of(r, r[4]), leaf_of(r, text)))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = tree([x[1] for x in by[s]])
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (doc_id, leaf, tampered) in enumerate(by[s]):
            path = way(trees[s], i) + way(top, k)
            proof, found = "", tampered
            for left, right in path:
                proof += "".join(left + right)
                found = h("".join([*left, found, *right]))
            root = top[-1][0]
            out.append((doc_id, leaf, trees[s][-1][0], root, h(proof), found, found == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels", [1, merkle.LEVELS])
def test_manifest_against_brute_force(spark, levels):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        source = rng.choice([None, "", "a", "b", "hot", "hot", "hot", "hot", "é", "z"])
        rows.append((rng.choice([i, i, i, None, 7]), source, rng.choice([None, "en"]), rng.choice([None, 3]), rng.choice([None, "", "x", "a\nb", "\n", "é\n" * 3000]), 1, "own"))
    rows += [(9999, "alone", "en", 1, "a\nb", 1, "own"), rows[0], rows[0]]
    got = merkle.manifest(spark.createDataFrame(rows, COLS), levels)
    found = sorted(map(tuple, got.collect()), key=repr)
    assert found == brute_force(rows)
    assert {r[-1] for r in found} == {True, False}


def test_one_leaf_and_empty_table(spark):
    docs = spark.createDataFrame([(1, None, None, None, "a b", 0, "x")], COLS)
    (row,) = merkle.manifest(docs).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root == h("1:1---3:a b") and row.proof_sha256 == h("") and row.verified
    assert merkle.manifest(docs.limit(0)).count() == 0
