"""Training-data pipeline over ``documents``: five stages, each written as Parquet and read again.

1. quality rules: documents that the rules reject go;
2. MinHash near-dedup: the least doc_id of each group of near copies (similarity 0.8) stays;
3. benchmark decontamination: documents that hold a benchmark item go;
4. PII: entities in the texts become surrogates;
5. SentencePiece: a sampled segmentation of every text, as piece ids that decode to it.

Stages 1 to 4 return the columns of their input.  ``ORACLE_SQL`` is None: surrogates and sampled
segmentations cannot be said in SQL; ``tests/llm/test_pipeline.py`` holds the run against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from perigee.llm import decontam, neardup, pieces, pii, quality
from perigee.llm.common import table, written

NEAR_PCT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the limits of their (lang, source) group; null, empty and blank texts fail, repeated
    rows are judged each, an empty table stays empty, other columns pass untouched."""
    return quality.keep_clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near copies, one row of equal id and text; a row without
    an id stays only where no equal text has one; texts without words are linked with nothing and stay."""
    return neardup.drop_near_duplicates(docs, NEAR_PCT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window like a benchmark item; texts and items without words match nothing, an empty
    benchmark drops nothing, repeated rows are judged each."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, entities in their texts replaced; ``n_chars`` follows the new text; null and empty texts stay
    as they are, repeated rows become equal rows."""
    return pii.surrogate_pii(docs)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and sampled piece ids of every row; null and empty texts have no pieces, repeated rows get equal ones."""
    return pieces.sampled_encoding(docs, pieces.Vocabulary.load())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii_surrogates", pii_surrogates),
    ("sentence_pieces", sentence_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
