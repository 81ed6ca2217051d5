"""A corpus pipeline of five stages; each takes what its predecessor kept.

quality rules -> line dedup -> SimHash near-dedup -> benchmark decontamination -> packing.
All but the last return the columns of ``documents``; the last returns the packed pieces, each with its ids and where it
lies in the sequences.

Null and empty texts have too few words and go in the first stage.  Of rows equal in id and text one stays.  A null id
is an id of its own in every stage; ties go to the smaller (doc_id, text hash).  Long texts are worked on whole.
Columns beside those of ``documents`` pass through whatever their names, up to the packing.  An empty table gives no
piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, line_dedup, packing, quality, registry, simhash
from millrace.llm.common import materialize, read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; failing lines leave the others."""
    return quality.clean(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of like lines the first stays."""
    return line_dedup.clean_lines(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays; five-word shingles."""
    return simhash.keep_one(docs, shingle=5)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids, and the ids, with their sequence and offset."""
    return packing.pack(docs, registry.vocabulary("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("simhash_near_dedup", near_deduplication),
    ("decontamination", benchmark_decontamination),
    ("packing", sequence_packing),
]

#: Packing needs a tokenizer and a solver; SimHash classes need a transitive closure over bit distances.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
