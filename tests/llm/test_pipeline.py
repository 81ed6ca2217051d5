"""The corpus pipeline: each stage on its own input, and the whole."""

import random
import zlib

import pytest

import corpus_pipeline
from millrace.llm import packing, registry
from millrace.llm.encode import PieceEncoder

COLS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return ". ".join(" ".join("".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 8))) for _ in range(10)) for _ in range(n // 10)) + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(31)
    clean = [prose(rng, 120) for _ in range(8)]
    item = prose(rng, 30)
    near = clean[0].split(" ")
    near[60] = "changed"
    texts = [*clean, clean[1], " ".join(near), prose(rng, 60) + " " + item + " " + prose(rng, 60), "too short", None, "", "one line of its own, which is here twice. " + clean[7] + "\n" + prose(rng, 60) + "\n" + clean[2]]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)] + [(3, clean[3], "en", "s", len(clean[3])), (None, prose(rng, 80), None, None, None)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, COLS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return f"{path}"


def test_stages_keep_and_drop(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: sorted(-1 if r.doc_id is None else r.doc_id for r in df.collect())
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality_rules", "line_dedup", "simhash_near_dedup", "decontamination", "packing"]
    good = stage["quality_rules"](spark, docs, folder)
    assert ids(good) == [-1, 0, 1, 2, 3, 3, 4, 5, 6, 7, 8, 9, 10, 14] and good.columns == docs.columns
    lines = {r.doc_id: r.text for r in stage["line_dedup"](spark, docs, folder).collect() if r.doc_id in (2, 8, 14)}
    assert lines[8] == "" and "\n" not in lines[14] and lines[14] and lines[2]  # the copy goes, and the lines that are like those of 7 and 2
    # one of each group: 8 is 1 again, 9 is like 0, 3 comes twice; texts without a word are one
    assert ids(stage["simhash_near_dedup"](spark, docs, folder)) == [-1, 0, 1, 2, 3, 4, 5, 6, 7, 10, 11, 12, 14]
    assert 10 not in ids(stage["decontamination"](spark, docs, folder)) and len(ids(stage["decontamination"](spark, docs, folder))) == docs.count() - 1


def test_whole_run_packs_what_is_kept(spark, folder):
    pieces = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in pieces} == {None, 0, 1, 2, 3, 4, 5, 6, 7, 14}
    encoder = PieceEncoder(registry.vocabulary("word_bpe_49k.json"), True)
    for k in (1, 4, 5):  # nothing of these is repeated
        own = sorted((r for r in pieces if r.doc_id == k), key=lambda r: r.start)
        ids = encoder.encode_many([texts[k]])[0] + (1).to_bytes(4, "little")
        assert sum(r.length for r in own) * 4 == len(ids) and all(r.length <= 2048 for r in own)
        assert all(r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) for r in own)
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces)
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in pieces)


def test_ids_of_pieces_are_written_in_two_bytes(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    path = registry.vocabulary("word_bpe_49k.json")
    assert all(len(r.ids) == 2 * r.length for r in packing.pieces(docs, path, with_ids=True).collect())
    high = packing.pieces(docs, path, end_id=1 << 16, with_ids=True)
    assert sum(len(r.ids) == 4 * r.length for r in high.collect()) == docs.count()  # the last piece of each document
    wide = packing.pack(docs, path, end_id=1 << 16, with_ids=True).collect()
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in wide)


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
