"""Intervals, islands and ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(df: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """Clusters of each key's values along a line: a new one where the gap to the last value is over the tolerance."""
    order = W.partitionBy(key).orderBy(value)
    rows = df.select(key, value).withColumn("new", (F.col(value) - F.lag(value).over(order) > tolerance).cast("int"))
    rows = rows.withColumn("island", F.sum(F.coalesce("new", F.lit(0))).over(order.rangeBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(key, F.col("island").cast("long").alias("island")).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.round(F.avg(value), 6).alias("mean"))


def valleys(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """The empty bands between each key's intervals."""
    order = W.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    return df.select(key, F.col(start).alias("to"), reach.alias("from")).where(F.col("from") < F.col("to")).select(key, "from", "to")


def overlaps(a: DataFrame, b: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs of intervals (a_id, a_start, a_end; b_id, b_start, b_end; of integers, ends not included) of one key that overlap.

    Both are dealt out to bins of a width, which should be about their length, so only neighbours meet, however many rows a key has. A pair
    counts in the first bin that both have."""
    bins = lambda df, x: df.withColumn("bin", F.explode(F.sequence(F.floor(F.col(f"{x}_start") / width), F.floor((F.col(f"{x}_end") - 1) / width))))
    met = bins(a.where("a_end > a_start"), "a").join(bins(b.where("b_end > b_start"), "b"), [key, "bin"])
    met = met.where((F.col("b_end") > F.col("a_start")) & (F.col("b_start") < F.col("a_end")))
    return met.where(F.col("bin") == F.floor(F.greatest("a_start", "b_start") / width)).select(key, "a_id", "b_id")


def deepest(points: DataFrame, nodes: DataFrame, key: str, width: int) -> DataFrame:
    """For each point (point, pos) the deepest node (node, depth, start, end) of its key that holds it; the first of them by node. Nodes stand in bins of a width, as in overlaps."""
    spread = nodes.where("end > start").withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    held = points.withColumn("bin", F.floor(F.col("pos") / width)).join(spread, [key, "bin"]).where((F.col("start") <= F.col("pos")) & (F.col("pos") < F.col("end")))
    return held.groupBy(key, "point").agg(F.min_by("node", F.struct(-F.col("depth"), "node")).alias("node"), F.max("depth").alias("depth"))


def uniform(df: DataFrame, key: str, duration: str, step: int) -> DataFrame:
    """key, start, end: windows of a step over each duration, the last one cut at its end; one empty window for none."""
    n = F.greatest(F.lit(1), F.ceil(F.col(duration) / step)).cast("long")
    at = df.select(key, F.col(duration).alias("d"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k"))
    start = (F.col("k") * step).cast("double")
    return at.select(key, start.alias("start"), F.when(F.col("d") <= 0, 0.0).otherwise(F.least(start + step, F.col("d"))).alias("end"))


def keyframes(scenes: DataFrame, key: str, long: float = 30.0, step: float = 15.0) -> DataFrame:
    """key, at: the middle of each scene (start, end), and in scenes longer than long one frame every step, a second before the end at the latest and not within two of the middle."""
    middle = (F.col("start") + F.col("end")) / 2
    n = F.floor((F.col("end") - F.col("start")) / step).cast("int")
    more = F.when(F.col("end") - F.col("start") > long, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.col("start") + k * step)).otherwise(F.array().cast("array<double>"))
    inside = F.filter(more, lambda t: (t < F.col("end") - 1.0) & (F.abs(t - middle) > 2.0))
    return scenes.select(key, F.explode(F.concat(F.array(middle), inside)).alias("at"))


def page_batches(df: DataFrame, key: str, pages: str, size: int = 16, overlap: int = 0, after: Column | None = None) -> DataFrame:
    """key, first_page, last_page: batches of a size over a document's pages, from 1, each sharing overlap pages with the one before, behind the pages done (after)."""
    start = F.coalesce(after, F.lit(0)).cast("long") + 1 if after is not None else F.lit(1).cast("long")
    last = F.col(pages).cast("long")
    # With an overlap, no batch starts that the one before already ends.
    stop = F.greatest(start, last - overlap)
    at = df.where(start <= last).select(key, last.alias("n"), F.explode(F.sequence(start, stop, F.lit(size - overlap).cast("long"))).alias("first_page"))
    return at.select(key, "first_page", F.least(F.col("first_page") + size - 1, F.col("n")).alias("last_page"))


def streamable(df: DataFrame) -> Column:
    """Whether a document (pages, digital, tables, prose: counts of its pages) is taken in batch by batch: 24 pages at least, not of scanned tables alone, and few pages of scanned prose."""
    return (F.col("pages") >= 24) & ~((F.col("digital") == 0) & (F.col("tables") > 0)) & (F.col("prose") <= F.greatest(F.lit(2.0), F.col("pages") * 0.1))
