"""Mixing sources to target weights: tokens per source, rates of repetition, then hash-seeded copies of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.llm.common import WORD
from quern.sources.tables import materialize


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def numbered_sources(sizes: DataFrame) -> DataFrame:
    """sizes with n, from 0: the place of each source by code point, null last. No task sees all sources: each counts its range of a sort."""
    ordered = materialize(sizes.orderBy(F.col("source").isNull(), F.col("source")).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    # One row for each partition of the sort.
    parts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    parts = parts.select("part", F.coalesce(F.sum("rows").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ordered.join(F.broadcast(parts), part == F.col("part")).withColumn("n", F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).drop("place", "part", "before")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget_pct: int = 150, max_repeat: int = 2) -> DataFrame:
    """source, source_size, weight, target of each row of sizes (source, source_size).

    The weights go round the sources by code point, null last. A target is least(max_repeat * source_size, level * weight). The level starts
    at the budget over all weights; sources that it takes above their cap stop there, and the rest is shared anew by the weights of the others,
    until none is above. An empty table gives an empty result; a source without words has target 0."""
    listed = numbered_sources(sizes).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int"))).drop("n")
    listed = materialize(listed.withColumn("cap", F.lit(max_repeat) * F.col("source_size")))
    budget = (listed.agg(F.sum("source_size")).first()[0] or 0) * budget_pct / 100.0
    level, stopped = 0.0, -1
    while True:
        above = F.lit(level) * F.col("weight") > F.col("cap")
        n, caps, open_ = listed.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0)), F.sum(F.when(~above, F.col("weight")))).first()
        if n == stopped or not open_:
            break
        level, stopped = (budget - caps) / open_, n
    return listed.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def rated(docs: DataFrame, weights: tuple[int, ...], budget_pct: int, max_repeat: int, seed: str) -> DataFrame:
    """docs (doc_id, source, size and others) with source_size, target and copies. The rows of docs are not shuffled when the sources are few."""
    targets = materialize(source_targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget_pct, max_repeat))
    joined = docs.alias("d").join(spread(targets), F.col("d.source").eqNullSafe(F.col("t.source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    copies = (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")
    return joined.select("d.*", "source_size", "target", copies.alias("copies"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), budget_pct: int = 150, max_repeat: int = 2, seed: str = "mix") -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, copies, taken = copies * size.

    copies is floor(rate) plus one if the hash of seed and id, as a number from 0 to 1, is below the rate's fraction; rate is target / source_size.
    The draws are independent, so a source's taken words lie about its target with a standard deviation of sqrt(f (1 - f)) times the root of
    the sum of its squared sizes, f the fraction: a few per cent of the target from some thousand documents on, more for few or very uneven ones.
    Texts are read once, for a table of ids and sizes. Sources are summed up by partial aggregation (a source can hold most rows).
    Null texts have size 0; null sources are one source; repeated ids get the same draw; a source of size 0 has rate 0. Other columns are not returned."""
    docs = materialize(df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text_col).alias("size")))
    return rated(docs, weights, budget_pct, max_repeat, seed).drop("source").withColumn("taken", F.col("copies") * F.col("size"))


def take(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), budget_pct: int = 150, max_repeat: int = 2, seed: str = "mix") -> DataFrame:
    """The rows of df, each as often as mix takes it, with the columns of df."""
    docs = df.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"))
    rows = rated(docs, weights, budget_pct, max_repeat, seed).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


#: Up to so many sources, their targets are broadcast, if names have at most 256 characters on average: 6 MB. Beyond it, they are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def spread(targets: DataFrame) -> DataFrame:
    """The targets for a join: broadcast if they are few and their names short, which is counted first."""
    n, chars = targets.agg(F.count("*"), F.coalesce(F.sum(F.length("source")), F.lit(0))).first()
    return F.broadcast(targets.alias("t")) if n <= BROADCAST_SOURCES and chars <= 256 * BROADCAST_SOURCES else targets.alias("t")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the columns of docs. Null texts have no words, null sources are one source, an empty table gives an empty one."""
    return take(docs)


ORACLE_SQL = """
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
listed AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight, 2 * source_size AS cap,
    sum(source_size) OVER () * 150 / 100.0::DOUBLE AS budget FROM sizes),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS own
  FROM listed WINDOW before AS (ORDER BY cap / weight::DOUBLE, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce(max(CASE WHEN own * weight <= cap THEN own END) OVER () * weight, cap::DOUBLE)) AS target FROM levels),
rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix:' || doc_id), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS draw
  FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source),
copied AS (SELECT *, (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM rated)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM copied"""
