"""A corpus through five stages: quality rules, line dedup, MinHash near-dedup, mixing of sources, byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, lines, minhash, mixing, quality
from quern.sources.tables import materialize

STAGES = [("quality rules", quality.stage), ("line dedup", lines.stage), ("minhash near-dedup", minhash.stage), ("source mixing", mixing.stage), ("byte-level bpe", bpe.stage)]
#: SQL can't express the BPE of the last stage; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each over a table that the one before has written to the shared folder: doc_id, n_tokens and digests.

    Null and empty texts go in the first stage, which wants words; null ids and sources pass through all; rows that repeat an id and a text
    are alike in every stage; an empty table gives an empty one. Extra columns of documents are carried along and not read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
