"""Updates of tables: replacing, inserting or changing rows by key, and what depends on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.text import content_sha
from quern.sources.tables import scratch_dir

# Kinds of memories.
KINDS = ["fact", "preference", "event"]


def updated(df: DataFrame, changes: DataFrame, key: str, *columns: str) -> DataFrame:
    """df with the values of changes (key and columns) where they aren't null, by key; one row of changes for each key. Other rows stay."""
    new = changes.select(key, *(F.col(c).alias(f"new_{c}") for c in columns))
    joined = df.join(new, key, "left")
    return joined.withColumns({c: F.coalesce(f"new_{c}", c) for c in columns}).select(*df.columns)


def replaced(df: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """A table of df with all rows of each value of by that new has taken out and new's put in: partitions of a written table, of which only those are written again."""
    path = scratch_dir(df.sparkSession)
    df.write.partitionBy(by).parquet(path)
    new.select(*df.columns).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def orphans_dropped(rows: DataFrame, sources: DataFrame, by: str) -> DataFrame:
    """rows of those values of by that sources still has."""
    return rows.join(sources.select(by).distinct(), by, "left_semi")


def unparsed(arriving: DataFrame, parsed: DataFrame) -> DataFrame:
    """Of arriving (source, text), what isn't there yet with the same content: parsed has source, sha, status."""
    done = parsed.where("status = 'parsed'").select("source", "sha")
    return arriving.withColumn("sha", content_sha(F.col("text"))).join(done, ["source", "sha"], "left_anti")


def jobs_entered(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """job, source, status, attempts for each wanted source: its latest job that isn't done goes on with one attempt more, else a new one (null job) starts. jobs: job, source, status, attempts, created_at."""
    open_ = jobs.where("status <> 'done'").groupBy("source").agg(F.max_by(F.struct("job", "attempts"), F.struct("created_at", "job")).alias("last"))
    return wanted.select("source").distinct().join(open_, "source", "left").select("last.job", "source", F.lit("running").alias("status"), (F.coalesce("last.attempts", F.lit(0)) + 1).cast("long").alias("attempts"))


def consolidated(memories: DataFrame, changes: DataFrame, recalled: DataFrame) -> DataFrame:
    """memories (id, content, kind) after changes (op, id, content, kind, at): ADD puts in a new one, UPDATE changes one that recalled (id) has.

    Blank contents and other operations are left out; of several updates of one, the last counts; a kind that isn't one of KINDS stays as it was."""
    text = F.trim("content")
    sound = changes.withColumn("content", text).where("content <> ''").withColumn("op", F.upper("op"))
    last = sound.where("op = 'UPDATE'").join(recalled.select("id"), "id", "left_semi").groupBy("id").agg(F.max_by(F.struct("content", "kind"), "at").alias("new"))
    kind = F.when(F.col("new.kind").isin(KINDS), F.col("new.kind"))
    kept = memories.join(last, "id", "left").select("id", F.coalesce("new.content", memories.content).alias("content"), F.coalesce(kind, memories.kind).alias("kind"))
    return kept.union(sound.where("op = 'ADD'").select(F.col("at").alias("id"), "content", F.coalesce("kind", F.lit("fact"))))


def feedback(shown: DataFrame, signals: DataFrame) -> DataFrame:
    """shown (id and others) with thumb (from -1 to 1), accepted and clicked: of each kind of signal (id, at, thumb, accepted, clicked), the last given, null where none was."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    given = signals.groupBy("id").agg(last("thumb"), last("accepted"), last("clicked"))
    return shown.join(given, "id", "left").withColumn("thumb", F.greatest(F.lit(-1), F.least(F.lit(1), F.col("thumb"))))


def audited(before: DataFrame, after: DataFrame, key: str, name: str) -> DataFrame:
    """What changed between two states of a table, as rows of an audit log: key, action (create, update, delete), target (the name after, else before), and both states as JSON."""
    side = lambda df, c: df.select(key, F.struct(*[x for x in df.columns if x != key]).alias(c))
    both = side(before, "before").join(side(after, "after"), key, "full")
    action = F.when(F.col("before").isNull(), "create").when(F.col("after").isNull(), "delete").when(~F.col("before").eqNullSafe(F.col("after")), "update")
    rows = both.withColumn("action", action).where("action IS NOT NULL")
    return rows.select(key, "action", F.coalesce(f"after.{name}", f"before.{name}").alias("target"), F.to_json("before").alias("before"), F.to_json("after").alias("after"))


def corpus(docs: DataFrame, by: str, length: int = 12_000) -> DataFrame:
    """by and corpus: the texts of each value of by under their titles, in the order of ord, cut at length; docs: by, ord, title, body.

    Only the first texts that can stand within the length are ever brought together: each takes some characters."""
    block: Column = F.concat(F.lit("## "), "title", F.lit("\n"), "body")
    least = len("## \n\n\n")
    order = W.partitionBy(by).orderBy("ord")
    first = docs.select(by, "ord", F.substring(block, 1, length).alias("block")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= length // least + 1)
    before = first.withColumn("used", F.coalesce(F.sum(F.length("block") + 2).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).where(F.col("used") < length)
    blocks = F.transform(F.sort_array(F.collect_list(F.struct("ord", "block"))), lambda x: x["block"])
    return before.groupBy(by).agg(F.substring(F.array_join(blocks, "\n\n"), 1, length).alias("corpus"))
