"""Deep retrieval: search along section trees, citations, the fusion of all paths, and records for other programs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.text import similarity, trigrams
from quern.operators.intervals import deepest
from quern.operators.recall import rrf, top
from quern.sources.tables import materialize, small


def descendants(nodes: DataFrame) -> DataFrame:
    """source, node, below: each node with itself and all below it, from its path (array of node numbers from the root): no recursion."""
    return nodes.select("source", F.explode("path").alias("node"), F.element_at("path", -1).alias("below"))


def page_ranges(nodes: DataFrame) -> DataFrame:
    """source, node, page_start, page_end: the first and last page of a node and all below it; nodes: source, path, page_start, page_end."""
    rows = nodes.select("source", F.explode("path").alias("node"), "page_start", "page_end")
    return rows.groupBy("source", "node").agg(F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"))


def tree_search(queries: DataFrame, candidates: DataFrame, nodes: DataFrame, members: DataFrame, beam: int = 2, looked_at: int = 30, levels: int = 6, max_select: int = 8, per_node: int = 12) -> DataFrame:
    """query_id, doc_id, rank, source, node: what stands in the sections that a search from each candidate source's root selects.

    queries: query_id, query; candidates: query_id, source, rank; nodes: source, node, parent, ord, title, summary; members: doc_id, source, node,
    ord. Of the first looked_at sections at hand, the beam most like the query (by trigrams of title and summary, ties by ord) are chosen;
    one with sections below it gives way to them, others are selected. After a source's share of levels, what is at hand counts, beam of it.
    At most max_select sections of a query count, by the rank of their source, the step and their place. Each gives its subtree's first
    per_node documents by ord; one already given doesn't count again."""
    shares = candidates.groupBy("query_id").agg(F.greatest(F.lit(1), F.floor(F.lit(levels) / F.count("*"))).alias("share"))
    here = materialize(candidates.select("query_id", "source", F.col("rank").alias("source_rank")).join(shares, "query_id"))
    nodes = materialize(nodes)
    roots = nodes.where("parent IS NULL").select("source", F.col("node").alias("root"))
    kids = nodes.where("parent IS NOT NULL").select("source", F.col("parent"), "node", "ord", "title", "summary")
    inner = kids.select("source", F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(True))
    grams = queries.select("query_id", trigrams(F.col("query")).alias("q"))
    front = here.join(roots, "source").select("query_id", "source", "source_rank", "share", F.col("root").alias("at"))
    bare = front.join(inner.select("source", F.col("node").alias("at"), "inner"), ["source", "at"], "left_anti")
    selected = bare.select("query_id", "source", "source_rank", F.lit(0).alias("step"), F.lit(0).cast("long").alias("place"), F.col("at").alias("node"))
    for step in range(1, levels + 1):
        active = front.where(F.col("share") >= step)
        hand = active.join(kids, (active.source == kids.source) & (active["at"] == kids.parent)).select("query_id", active.source, "source_rank", "share", "node", "ord", "title", "summary")
        by_ord = W.partitionBy("query_id", "source").orderBy("ord")
        hand = hand.withColumn("n", F.row_number().over(by_ord)).where(F.col("n") <= looked_at).join(small(grams), "query_id")
        scored = hand.withColumn("score", F.round(similarity(F.col("q"), trigrams(F.concat("title", F.lit(" — "), "summary"))), 10))
        best = W.partitionBy("query_id", "source").orderBy(F.col("score").desc(), "ord")
        picked = scored.withColumn("place", F.row_number().over(best).cast("long")).where(F.col("place") <= beam).join(inner, ["source", "node"], "left")
        picked = materialize(picked.select("query_id", "source", "source_rank", "share", "place", "node", "inner"))
        if picked.isEmpty():
            break
        leaf = F.col("inner").isNull() | (F.col("share") == step)
        selected = selected.union(picked.where(leaf).select("query_id", "source", "source_rank", F.lit(step), "place", "node"))
        front = picked.where(~leaf).select("query_id", "source", "source_rank", "share", F.col("node").alias("at"))
    order = W.partitionBy("query_id").orderBy("source_rank", "step", "place", "node")
    selected = selected.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= max_select)
    # A subtree's first documents are among the first of each section in it, so all others go before they meet the sections above theirs.
    first = W.partitionBy("source", "node").orderBy("ord", "doc_id")
    few = members.select("doc_id", "source", "node", "ord").withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_node).drop("n")
    below = descendants(tree_paths(nodes)).join(materialize(few).withColumnRenamed("node", "below"), ["source", "below"])
    below = below.withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_node).select("source", "node", "doc_id", "n")
    rows = selected.join(below, ["source", "node"]).groupBy("query_id", "doc_id").agg(F.min(F.struct("turn", "n", "source", "node")).alias("f"))
    ranked = W.partitionBy("query_id").orderBy("f.turn", "f.n")
    return rows.select("query_id", "doc_id", (F.row_number().over(ranked) - 1).alias("rank"), "f.source", "f.node")


def tree_paths(nodes: DataFrame) -> DataFrame:
    """nodes (source, node, parent) with path: the node numbers from the root; a join for each level that there is."""
    done = front = materialize(nodes.where("parent IS NULL").select("source", "node", F.array("node").alias("path")))
    rest = nodes.where("parent IS NOT NULL").select("source", "node", F.col("parent").alias("above"))
    while True:
        front = materialize(rest.join(front.select("source", F.col("node").alias("above"), "path"), ["source", "above"]).select("source", "node", F.concat("path", F.array("node")).alias("path")))
        if front.isEmpty():
            return done
        done = done.union(front)


def probed(chunks: DataFrame, docs: DataFrame, nodes: DataFrame, length: int = 60, skip: int = 0) -> DataFrame:
    """doc_id, ord, node: the deepest section in which a chunk begins, by its first characters in the document's text; the first section (the root) where they aren't found or no section holds them.

    chunks: doc_id, ord, content; docs: doc_id, text; nodes: doc_id, node, depth, char_start, char_end. skip: so many lines at a chunk's head don't
    count, such as a breadcrumb, which no text has. Of sections as deep, the first by node. Each text meets the beginnings of all its chunks at once. Null and blank chunks belong to the root; chunks of documents without sections have none."""
    body = F.array_join(F.slice(F.split(F.coalesce("content", F.lit("")), "\n"), skip + 1, 1_000_000_000), "\n") if skip else F.coalesce("content", F.lit(""))
    begins = chunks.select("doc_id", F.struct("ord", F.substring(body, 1, length).alias("probe")).alias("c")).groupBy("doc_id").agg(F.collect_list("c").alias("c"))
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(begins, "doc_id").select("doc_id", F.explode(F.transform("c", lambda c: F.struct(c["ord"].alias("point"), F.when(c["probe"] != "", F.position(c["probe"], F.col("text")) - 1).otherwise(-1).cast("long").alias("pos")))).alias("p"))
    points = materialize(found.select("doc_id", "p.*"))
    spans = nodes.select("doc_id", "node", "depth", F.col("char_start").cast("long").alias("start"), F.col("char_end").cast("long").alias("end"))
    held = deepest(points.where("pos >= 0"), spans, "doc_id", 4096).select("doc_id", "point", "node")
    roots = nodes.groupBy("doc_id").agg(F.min("node").alias("root"))
    return points.join(held, ["doc_id", "point"], "left").join(roots, "doc_id", "left").select("doc_id", F.col("point").alias("ord"), F.coalesce("node", "root").alias("node"))


def cited(hits: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """hits (doc_id and others) with citation: the titles of the section a document stands in; null where it stands in none. members: doc_id, source, node; nodes: source, node, titles."""
    return hits.join(members.select("doc_id", "source", "node"), "doc_id", "left").join(nodes.select("source", "node", F.col("titles").alias("citation")), ["source", "node"], "left").drop("node")


def deep(paths: list[DataFrame], fast: DataFrame, n: int = 8) -> DataFrame:
    """The fusion of all paths' rankings (query_id, doc_id, rank): query_id, doc_id, score (rounded to 4 places), rank, mode. A query for which no path has anything gets its fast hits."""
    fused = top(rrf(paths, "doc_id").withColumn("sort", F.round("rrf", 10)), n, "sort", "doc_id").select("query_id", "doc_id", F.round("rrf", 4).alias("score"), "rank", F.lit("deep").alias("mode"))
    rest = fast.where(F.col("rank") < n).join(fused.select("query_id").distinct(), "query_id", "left_anti")
    return fused.union(rest.select("query_id", "doc_id", "score", "rank", F.lit("fast")))


def records(hits: DataFrame) -> DataFrame:
    """hits (query_id, rank, content, score, title, source_id, citation) as records: content, score from 0 to 1, title, and metadata that is never null."""
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("score", F.lit(0.0))))
    source = F.coalesce(F.col("source_id").cast("string"), F.lit(""))
    meta = F.named_struct(F.lit("source_id"), source, F.lit("document_id"), source, F.lit("section_path"), F.col("citation"))
    return hits.select("query_id", "rank", F.coalesce("content", F.lit("")).alias("content"), score.alias("score"), F.coalesce(F.nullif("title", F.lit("")), F.lit("untitled")).alias("title"), meta.alias("metadata"))
