"""How many planted near copies of lines end in one group, by the length of the line and the kind of edit."""

import random

import numpy as np
import pyarrow as pa

from millrace.llm import line_dedup

BANDS = ((1, 5), (6, 11), (12, 29), (30, 79), (80, 140))
EACH = 120


def planted(seed=11):
    """``band, edit, line, edited line`` with an edit similarity of 0.8 or more."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    common = ["the", "of", "and", "a", "in", "to", "is", "on", "for", "with"]
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(3, 10))) if rng.random() < 0.7 else rng.choice(common)

    def one_character(x):
        k = rng.randrange(len(x))
        return x[:k] + rng.choice([rng.choice(letters), "", x[k] + rng.choice(letters)]) + x[k + 1 :]

    def one_word(x):
        own = x.split(" ")
        own[rng.randrange(len(own))] = word()
        return " ".join(own)

    def some_characters(x):
        own = list(x)
        for _ in range(max(1, round(0.05 * len(x)))):
            own[rng.randrange(len(own))] = rng.choice(letters)
        return "".join(own)

    out = []
    for band in BANDS:
        for edit in (one_character, one_word, some_characters):
            n = 0
            while n < EACH:
                x = " ".join(word() for _ in range(rng.randint(*band)))
                y = edit(x)
                fx, fy = line_dedup.form(x).decode(), line_dedup.form(y).decode()
                most = int(max(len(fx), len(fy)) * 0.2 + 1e-9)
                if fx != fy and line_dedup.edit_distance(fx, fy, most) <= most:
                    out.append((band, edit.__name__, x, y))
                    n += 1
    return out


def test_recall_in_every_length_and_edit(spark):
    pairs = planted()
    rows = [(2 * i + k, line) for i, (*_, x, y) in enumerate(pairs) for k, line in enumerate((x, y))]
    every = line_dedup.materialize(line_dedup.lines(spark.createDataFrame(rows, "doc_id long, text string")), "lines")
    node = {r.did: r.node for r in every.select("did", "node").collect()}
    comp = {r.node: r.component for r in line_dedup.connected_components(line_dedup.form_links(every)).collect()}
    group = lambda i: comp.get(node[i], node[i])
    found, lines = {}, {}
    for i, (band, edit, *_) in enumerate(pairs):
        found[band, edit] = found.get((band, edit), 0) + (group(2 * i) == group(2 * i + 1))
        lines.setdefault(group(2 * i), set()).add(i)
    print({k: round(n / EACH, 2) for k, n in found.items()})
    assert min(found.values()) >= 0.9 * EACH
    # unlike lines stay apart
    assert sum(len(x) > 1 for x in lines.values()) <= 0.02 * len(pairs)


def test_keys_of_short_lines():
    """One changed character, or one changed word, leaves a key; long lines have word pairs, two at a time."""
    keys = lambda line: set(line_dedup.all_blocks([line])[1].tolist())
    assert keys(b"quick") & keys(b"quixk") and keys(b"quick") & keys(b"quck") and not keys(b"quick") & keys(b"slow")
    assert keys(b"alpha beta gamma delta epsilons") & keys(b"alpha betas gamma delta epsilons")
    long = b" ".join(b"word%d" % i for i in range(14))
    assert len(keys(long)) == 30
    fp, flat, ends = line_dedup.all_blocks([b"", b"a", long])
    assert len(fp) == 3 and ends.tolist()[-1] == len(flat)


def test_links_leave_a_bucket_and_not_its_pairs():
    """A bucket of 300 unlike forms gives no row; every link between groups of like forms is kept, at most one less than groups."""
    rng = random.Random(3)
    unlike = ["".join(rng.choice("abcdefghijklmnopqrst ") for _ in range(50)) for _ in range(300)]
    like = [f[:k] + "z" + f[k + 1 :] for f in unlike[:20] for k in (3, 20, 40)]

    def rows_of(forms):
        n = len(forms)
        cols = [np.zeros(n, np.int64), np.arange(n), np.full(n, 7), np.full(n, 50, np.int32), np.arange(n)]
        batch = pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(forms)], names=["key", "node", "fp", "chars", "group", "form"])
        return [(a, b) for out in line_dedup._second_look([batch]) for a, b in zip(out.column("src").to_pylist(), out.column("dst").to_pylist(), strict=True)]

    assert rows_of(unlike) == []
    root = list(range(360))
    for a, b in (found := rows_of(unlike + like)):
        root = [root[a] if x == root[b] else x for x in root]
    assert len(found) == len(like) and all(root[300 + 3 * i + k] == root[i] for i in range(20) for k in range(3))


def test_lower_bound_never_parts_like_forms():
    """Against the exact distance: pieces of one and of many, shifted parts, letters outside ASCII; most unlike forms go without it."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh éß") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    forms = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 3, 12, 13, 14, 40, 90, 200) for _ in range(4)]
    for f in list(forms):
        own = list(f)
        for _ in range(rng.randint(1, 1 + len(f) // 6)):
            k = rng.randrange(len(own) + 1)
            own[k : k + rng.randint(0, 2)] = rng.choice(["", "x", "ü"])
        forms += ["".join(own), f[len(f) // 9 :] + " tail", f[: len(f) // 3] + f[len(f) // 2 :]]
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(forms)), np.arange(len(forms))))
    near = np.flatnonzero(a != b)
    a, b = a[near], b[near]
    keep = line_dedup.maybe_alike(forms, np.array([len(f) for f in forms]), a, b)
    exact = np.array([line_dedup.edit_distance(forms[i], forms[j], m := line_dedup._most(forms[i], forms[j])) <= m for i, j in zip(a.tolist(), b.tolist(), strict=True)])
    assert exact.sum() > 100 and not (exact & ~keep).any() and (keep & ~exact).sum() < 0.02 * (~exact).sum()


def test_pairs_that_share_buckets_are_compared_once(monkeypatch):
    """Six forms in forty buckets: each pair meets its exact test once, and the links are those of one bucket."""
    forms = ["the same words again and again number %s" % (x * 19) for x in "abcdef"]
    forms[5] = forms[0].replace("words", "wordz")
    n, keys = len(forms), 40
    tested = []
    exact = line_dedup.alike
    monkeypatch.setattr(line_dedup, "maybe_alike", lambda forms, chars, a, b: np.ones(len(a), bool))
    monkeypatch.setattr(line_dedup, "alike", lambda a, b: tested.append((a, b)) or exact(a, b))
    key, node = np.repeat(np.arange(keys), n), np.tile(np.arange(n), keys)
    cols = [key, node, np.full(n * keys, 7), np.full(n * keys, len(forms[0]), np.int32), node]
    batch = pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(forms * keys), pa.array([list(range(keys))] * n * keys)], names=["key", "node", "fp", "chars", "group", "form", "shared"])
    found = [r for out in line_dedup._second_look([batch], True) for r in zip(out.column("src").to_pylist(), out.column("dst").to_pylist(), strict=True)]
    assert found == [(0, 5)] and len(tested) == len(set(tested)) <= n * (n - 1) // 2


def test_halves_that_come_twice():
    """The bitmap has every half of a key that two packed lots have, or one has twice, and few others."""
    rng = np.random.default_rng(4)
    lots = [rng.integers(0, 2**32, 50_000, dtype=np.uint32) for _ in range(3)]
    lots[1][:100], lots[2][100:150] = lots[0][:100], lots[2][:50]
    rows = sorted((p, h) for x in lots for p, h in zip(*(c.to_pylist() for c in line_dedup._packed_halves(x).columns), strict=True))
    batch = pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([h for _, h in rows], pa.binary())], names=["part", "halves"])
    bits = np.zeros((1 << line_dedup.PART_BITS, 1 << (line_dedup.KEY_BITS - line_dedup.PART_BITS - 6)), np.uint64)
    for out in line_dedup._twice([batch.slice(0, 5000), batch.slice(5000)]):
        bits[out.column("part")[0].as_py()] = np.frombuffer(out.column("words")[0].as_py(), np.uint64)
    half, n = np.unique(np.concatenate(lots), return_counts=True)
    hit = line_dedup.in_bitmap(bits.ravel(), half.astype(np.uint64) << np.uint64(32), line_dedup.KEY_BITS)
    assert hit[n > 1].all() and hit[n == 1].mean() < 0.01


def test_distances_of_many_pairs_at_once(monkeypatch):
    """Against the distance of one pair: blocks of 64 rows and their edges, letters outside ASCII, forms beyond the length that goes together."""
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefgh éß語") for _ in range(n))
    forms = ["", "", "a"]
    for n in (1, 5, 30, 63, 64, 65, 127, 128, 129, 300, 700):
        for _ in range(12):
            own = list(letters(n))
            forms.append("".join(own))
            for _ in range(rng.randint(0, 1 + int(n * rng.choice([0.02, 0.1, 0.2, 0.3])))):
                k = rng.randrange(len(own) + 1)
                own[k : k + rng.randint(0, 2)] = rng.choice(["", "x", "ab"])
            forms.append(letters(rng.randint(0, n // 6)) + "".join(own))
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(forms)), np.arange(len(forms))))
    some = np.flatnonzero((abs(a - b) == 1) | (np.arange(len(a)) % 7 == 0))
    a, b = a[some], b[some]
    exact = [line_dedup.edit_distance(forms[i], forms[j], m := line_dedup._most(forms[i], forms[j])) <= m for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    for at_once in (line_dedup.AT_ONCE, 200):
        monkeypatch.setattr(line_dedup, "AT_ONCE", at_once)
        assert line_dedup.within(forms, np.array([len(f) for f in forms]), a, b).tolist() == exact
    assert 200 < sum(exact) < len(exact) - 200


def test_small_buckets_of_one_size_go_together():
    """The nearest pairs and those across groups are those of each bucket by itself; no Python call for each bucket."""
    rng = np.random.default_rng(1)
    for n, lowest in ((3, 20), (5, 1), (9, 20), (line_dedup.FEW_ROWS, 20)):
        start = np.arange(50) * n
        fp = np.repeat(rng.integers(0, 2**64, 50, dtype=np.uint64), n)
        for _ in range(12):
            fp ^= np.uint64(1) << rng.integers(0, 64, len(fp)).astype(np.uint64)
        chars, group = rng.integers(lowest, 60, len(fp)).astype(np.int32), rng.integers(0, 4, len(fp))
        nearest, across = set(), set()
        for s in start.tolist():
            own = slice(s, s + n)
            nearest |= {(s + i, s + j) for i, j in zip(*(x.tolist() for x in line_dedup._nearest(fp[own], chars[own])), strict=True)}
            across |= {(min(s + i, s + j), max(s + i, s + j)) for i, js in line_dedup._across(fp[own], chars[own], group[own]) for j in js.tolist()}
        assert set(zip(*(x.tolist() for x in line_dedup._nearest_in(fp, chars, start, n)), strict=True)) == nearest
        got = [p for i, j in line_dedup._all_across(fp, chars, group, start, np.full(50, n)) for p in zip(i.tolist(), j.tolist(), strict=True)]
        assert set(got) == across and len(got) == len(across) and across


def test_pairs_of_several_buckets_meet_the_exact_test_once(monkeypatch):
    """As above where the pairs go many at a time."""
    forms = ["the same words again and again number %s" % (x * 19) for x in "abcdef"]
    forms[5] = forms[0].replace("words", "wordz")
    n, keys = len(forms), 40
    seen, exact = [], line_dedup.within
    monkeypatch.setattr(line_dedup, "maybe_alike", lambda forms, chars, a, b: np.ones(len(a), bool))
    monkeypatch.setattr(line_dedup, "within", lambda forms, chars, a, b: seen.extend((forms[i], forms[j]) for i, j in zip(a, b, strict=True)) or exact(forms, chars, a, b))
    key, node = np.repeat(np.arange(keys), n), np.tile(np.arange(n), keys)
    cols = [key, node, np.full(n * keys, 7), np.full(n * keys, len(forms[0]), np.int32), node]
    batch = pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(forms * keys), pa.array([list(range(keys))] * n * keys)], names=["key", "node", "fp", "chars", "group", "form", "shared"])
    found = [r for out in line_dedup._second_look([batch], True) for r in zip(out.column("src").to_pylist(), out.column("dst").to_pylist(), strict=True)]
    assert found == [(0, 5)] and len(seen) == len(set(seen)) == n * (n - 1) // 2


def test_groups_are_the_components_of_all_links(spark, monkeypatch):
    """Links of the second look between groups, between single forms and between both; the components of the first are not computed again."""
    at = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    found, rest = at([(1, 2), (2, 3), (10, 11), (20, 21), (30, 31)]), at([(3, 11), (21, 50), (0, 20), (60, 61)])
    want = {r.node: r.component for r in line_dedup.connected_components(found.union(rest)).collect()}
    worked = []
    first = line_dedup.connected_components(found)
    monkeypatch.setattr(line_dedup, "_linked", lambda every, crowd: (found, first, rest))
    exact = line_dedup.connected_components
    monkeypatch.setattr(line_dedup, "connected_components", lambda edges: worked.append(edges.count()) or exact(edges))
    rows = line_dedup.form_groups(None).collect()
    assert {r.node: r.component for r in rows} == want and len(rows) == len(want) and worked == [4]
