"""The bitmask filter against exact sets of n-grams, counted with plain dictionaries."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import language_id as lid

LETTERS = {"de": "enisratdhulcgmobwfkzäöüß", "en": "etaoinshrdlcumwfgypbvk", "fr": "esaitnrulodcpmévqfbgàèç", "xx": "aeioumnk"}


def is_letter(c):
    return c != "×" and ("a" <= c <= "z" or ord(c) >= 0xAA)


def grams(text):
    low, out = text.lower(), []
    for i, c in enumerate(low):
        if is_letter(c):
            out.append(c)
        elif i == 0 or is_letter(low[i - 1]):
            out.append(" ")
    padded = " " + "".join(out) + " "
    return [padded[i : i + lid.NGRAM] for i in range(len(padded) - lid.NGRAM + 1)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)

    own = {x: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(300)] for x, letters in LETTERS.items()}

    def text(lang, words):
        word = lambda: rng.choice(own[lang]) if rng.random() < 0.7 else "".join(rng.choice(LETTERS[lang]) for _ in range(5))
        return " ".join(word() + rng.choice(["", "", ",", ". 12", "\n"]) for _ in range(words))

    out = []
    for i in range(240):
        lang = rng.choice(["de", "en", "en", "fr"]) if i % 40 else "xx"
        out.append((i, text(lang, rng.randint(1, 120)), lang))
    out += [(300, text("en", 50_000), "en"), (301, "12 -- 34", "en"), (302, None, "fr"), (303, text("de", 40), None), (304, "zzz qqq jjj xyz", "en"), (305, "×", None)]
    return out + [out[1], out[1]]


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def exact_sets(rows):
    """The n-grams of each language by the rules of the model, without any filter."""
    counts = {}
    for i, text, lang in set(rows):  # repeated rows teach once
        if not held(i) and text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(grams(text))
    every = {x: sum(c.values()) for x, c in counts.items()}
    rated = {x: {g: n for g, n in c.items() if n >= min(lid.MIN_COUNT, 1 + every[x] // lid.LITTLE)} for x, c in counts.items()}
    top = {}
    for x, c in rated.items():
        for g, n in c.items():
            top[g] = max(top.get(g, 0.0), n / max(every[x], lid.LITTLE))
    return {x: {g for g, n in c.items() if n / every[x] >= lid.MIN_SHARE * top[g]} for x, c in rated.items()}


def test_filter_and_predictions_against_exact_sets(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = lid.id_bucket("doc_id", 4) == 2
    model, exact = lid.fit(docs, out), exact_sets(rows)
    assert model.langs == sorted(exact) == ["de", "en", "fr", "xx"]
    known = sorted(set().union(*exact.values()))
    assert len(known) > 5000
    p = lid.positions(np.concatenate([lid.codes_of_grams(known)]))
    found = model.masks[0][p[0]] & model.masks[0][p[1]] & model.masks[0][p[2]]
    for b, lang in enumerate(model.langs):
        has = (found >> np.uint64(b)) & np.uint64(1) == 1
        own = np.array([g in exact[lang] for g in known])
        assert has[own].all()  # no n-gram of a language is missed
        extra, rest = (has & ~own).sum(), (~own).sum()
        expected = model.false_rate[b] * rest
        assert extra <= expected + 5 * expected**0.5 + 3, (lang, extra, expected)
    got = {r.doc_id: r for r in lid.predict(docs, model, out).collect()}
    for i, text, _ in rows:
        own = grams(text or "")
        if text is None or not any(map(str.isalpha, text)):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        if len(text) > 1 << 18:
            continue  # cut into blocks, below
        hits = {x: sum(g in exact[x] for g in own) / len(own) for x in model.langs}
        best = max(hits.values())
        assert abs(got[i].score - best) < 0.02 and hits[got[i].lang_pred] >= best - 0.02
        assert got[i].held_out == held(i)
    assert got[300].lang_pred == "en"
    right = [got[i].lang_pred == lang for i, text, lang in rows if held(i) and lang and len(text or "") > 40]
    assert len(right) > 30 and sum(right) >= 0.95 * len(right)


def test_blocks_of_long_texts_ties_and_unknown_text(spark):
    """A text over a block has the n-grams of its blocks, each padded; a tie and a text that no language knows go to the first label."""
    both = [(i, "same words here and there " * 3, lang) for i, lang in enumerate(["b", "a", "b", "a"])]
    docs = spark.createDataFrame([*both, (9, "qzx jjj", None)], "doc_id long, text string, lang string")
    none = F.lit(False)
    got = {r.doc_id: r for r in lid.predict(docs, lid.fit(docs), none).collect()}
    assert {got[i].lang_pred for i in range(4)} == {"a"} and (got[9].lang_pred, got[9].score) == ("a", 0.0)
    model = lid.fit(docs)
    long = "same words here and there " * 15_000
    assert len(long) > 1 << 18 and model.predict(long)[0] == "a" and model.predict(long)[1] > 0.99
