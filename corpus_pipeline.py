"""From raw documents to token digests: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mailquarry.llm import bpe, decontaminate, langid, simhash, suffixdedup
from mailquarry.llm.common import cut, drop_cut, table

STAGES = [
    ("language_id", langid.stage),
    ("simhash_near_dedup", simhash.stage),
    ("suffix_array_dedup", suffixdedup.stage),
    ("decontaminate", decontaminate.stage),
    ("bpe", bpe.stage),
]

#: Fingerprints, kernels and merges are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the documents that all stages keep."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop_cut(before)
        before = docs
    return docs
