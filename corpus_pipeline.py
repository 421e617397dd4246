"""The corpus pipeline: quality, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's documents. All stages but the last
return the columns they were given; the last returns packed pieces.

NULL and empty texts are documents like others: the classifier scores them, they
are near duplicates of nothing, hold no personal data and are packed as one end
id. Rows that repeat an id are decided one by one; of equal rows one stays. An
empty table passes through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plantpulse.llm import neardup, packing, pii, quality
from plantpulse.llm.common import held_out, prepare, scratch, table, texts


#: Cache of the packing stage: its executors' heaps are full of the stages before.
PACKING_CACHE = 8 << 20


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3; the classifier learns
    from the labelled folds that the quality query learns from."""
    prepare(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 5, 0))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 80 %."""
    prepare(spark)
    return neardup.keep_first(docs, width=5, percent=80)


def private_data_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    prepare(spark)
    return pii.masked(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids, with the ids."""
    prepare(spark)
    return packing.pack(texts(docs), public_tokenizers.path("word_bpe_49k.json"), cache_bytes=PACKING_CACHE, keep=False)


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", distinct_documents),
    ("personal_data", private_data_masked),
    ("packing", packed),
]

#: Learned scores and sketches have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
