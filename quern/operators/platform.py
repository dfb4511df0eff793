"""Listings, access, health, audit and feedback of knowledge bases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.text import similarity, trigrams


def health(bases: DataFrame, sources: DataFrame, chunks: DataFrame, graphs: DataFrame, wikis: DataFrame) -> DataFrame:
    """For each base (kb): its sources, failed ones, chunks and embedded ones, a score, and the issues by name, joined by commas.

    100 less 40 for failed sources, 25 for chunks without a vector, and 10 each for a missing graph and a missing wiki, 0 at least; a base without
    sources has no other issue. sources: kb, status; chunks: kb, embedded (boolean); graphs and wikis: kb of those that have one."""
    of_sources = sources.groupBy("kb").agg(F.count("*").alias("n_sources"), F.count_if(F.col("status") == "failed").alias("n_failed"))
    of_chunks = chunks.groupBy("kb").agg(F.count("*").alias("n_chunks"), F.count_if("embedded").alias("n_embedded"))
    has = lambda df, c: df.select("kb").distinct().withColumn(c, F.lit(True))
    rows = bases.select("kb").distinct().join(of_sources, "kb", "left").join(of_chunks, "kb", "left").join(has(graphs, "graph"), "kb", "left").join(has(wikis, "wiki"), "kb", "left")
    rows = rows.fillna(0, ["n_sources", "n_failed", "n_chunks", "n_embedded"]).fillna(False, ["graph", "wiki"])
    some = F.col("n_sources") > 0
    found = {"no_sources": (~some, 0), "failed_sources": (F.col("n_failed") > 0, 40), "unembedded": (F.col("n_embedded") < F.col("n_chunks"), 25), "no_graph": (some & ~F.col("graph"), 10), "no_wiki": (some & ~F.col("wiki"), 10)}
    lost = reduce(lambda a, b: a + b, (F.when(test, cost).otherwise(0) for test, cost in found.values()))
    issues = F.array_join(F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, (test, _) in found.items()))), ",")
    return rows.select("kb", "n_sources", "n_failed", "n_chunks", "n_embedded", F.greatest(F.lit(0), F.lit(100) - lost).cast("long").alias("score"), issues.alias("issues"))


def metrics(requests: DataFrame) -> DataFrame:
    """method, status, n and seconds of requests (method, status, duration)."""
    return requests.groupBy("method", "status").agg(F.count("*").alias("n"), F.round(F.sum("duration"), 6).alias("seconds"))


def matching(df: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows of which one of the columns contains the query, in any case; a blank query is no condition."""
    needle = query.strip().lower()
    return df.where(reduce(lambda a, b: a | b, (F.contains(F.lower(c), F.lit(needle)) for c in columns))) if needle else df


def visible(bases: DataFrame, members: DataFrame) -> DataFrame:
    """user_id, kb, role: what each user of members (user_id, kb, role; workspace) may see: own bases, shared ones, those of the workspace."""
    owned = bases.select(F.col("owner").alias("user_id"), "kb", F.lit("owner").alias("role"), F.lit(0).alias("order"))
    shared = members.join(bases.select("kb"), "kb").select("user_id", "kb", "role", F.lit(1).alias("order"))
    users = members.select("user_id", "workspace").distinct()
    open_ = users.join(bases.where("visibility = 'workspace'"), "workspace").select("user_id", "kb", F.lit("viewer").alias("role"), F.lit(2).alias("order"))
    return owned.union(shared).union(open_).groupBy("user_id", "kb").agg(F.min_by("role", F.struct("order", "role")).alias("role"))


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by the columns order."""
    names = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("last")).select(key, "last.*")


def last_rows(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n rows of each key, with their number in ascending order, from 1."""
    ranked = df.withColumn("back", F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc()))).where(F.col("back") <= n)
    return ranked.withColumn("no", F.row_number().over(W.partitionBy(key).orderBy(order)).cast("long")).drop("back")


def page(df: DataFrame, size: int, number: int, *order) -> DataFrame:
    """One page of a listing, numbers from 1, with the total of all rows."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(size * (number - 1)).limit(size).crossJoin(F.broadcast(total))


def impressions(hits: DataFrame) -> DataFrame:
    """What was shown for each query: an array of (doc_id, rank, score) by rank."""
    shown = F.sort_array(F.collect_list(F.struct("rank", "doc_id", "score")))
    return hits.groupBy("query_id").agg(F.count("*").alias("n_shown"), shown.alias("shown"))


def ndcg(found: DataFrame, wanted: DataFrame, k: int = 10) -> DataFrame:
    """query_id, ndcg, recall at k, from the relevant hits (query_id, rank from 0) and the number of what is relevant to each query (query_id, n): pairs of queries and relevant documents aren't made."""
    gain = lambda rank: 1.0 / F.log2(rank + 2.0)
    hits = found.where(F.col("rank") < k).groupBy("query_id").agg(F.sum(gain(F.col("rank"))).alias("dcg"), F.count("*").alias("hits"))
    ideal = F.aggregate(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(k)).cast("int") - 1), F.lit(0.0), lambda s, i: s + gain(i))
    rows = wanted.where("n > 0").join(hits, "query_id", "left").withColumn("ideal", ideal)
    return rows.select("query_id", (F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"), (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("recall"))


def memories_recalled(memories: DataFrame, asked: DataFrame, n: int = 5, threshold: float = 0.05) -> DataFrame:
    """user_id, query_id, id, score: for each question (user_id, query_id, query) the n most similar memories (user_id, id, content) of the same user, never of others: above the threshold, or that contain the question; ties by id."""
    own = memories.select("user_id", "id", F.lower("content").alias("c"), trigrams(F.col("content")).alias("m"))
    q = asked.where("trim(query) <> ''").select("user_id", "query_id", F.lower("query").alias("q"), trigrams(F.col("query")).alias("g"))
    scored = own.join(q, "user_id").select("user_id", "query_id", "id", F.round(similarity(F.col("m"), F.col("g")), 10).alias("s"), F.contains("c", F.col("q")).alias("holds"))
    order = W.partitionBy("user_id", "query_id").orderBy(F.col("s").desc(), "id")
    best = scored.where((F.col("s") > threshold) | F.col("holds")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return best.select("user_id", "query_id", "id", F.round("s", 4).alias("score"))
