"""Incremental ingest by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import content_sha


def hash_groups(docs: DataFrame) -> DataFrame:
    """sha, first doc_id and number of documents of equal content."""
    return docs.groupBy(content_sha(F.col("text")).alias("sha")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


def carry_forward(new: DataFrame, old: DataFrame) -> DataFrame:
    """new (doc_id, text) with the vector (carried) that old (text, embedding) has for equal content, one for each content; null: embed anew."""
    had = old.groupBy(content_sha(F.col("text")).alias("sha")).agg(F.min_by("embedding", "old_id").alias("carried"), F.min("old_id").alias("carried_from"))
    return new.withColumn("sha", content_sha(F.col("text"))).join(had, "sha", "left")
