"""From raw documents to token ids: quality rules, quality classifier, near-duplicates, source mix, BPE.

Defined cases, of the stages one after another: null and empty texts go with the quality rules; of repeated rows one stays; a null doc_id
is kept like any other; without labels the rules keep what the base rule passes and the classifier scores all alike; an empty table gives
no rows; other columns travel along, whatever their names, up to the last stage, which returns doc_id, n_tokens, ids and decoded_sha256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import bpe, mil_classifier, near_dedup, quality_rules, source_mix
from graphloom.llm.common import cut, table

STAGES = [
    ("quality rules", quality_rules.stage),
    ("quality classifier", mil_classifier.stage),
    ("near duplicates", near_dedup.stage),
    ("source mix", source_mix.stage),
    ("BPE", bpe.stage),
]

#: The stages learn models and hash with seeds; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in turn, each to what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
