"""Queries of deep retrieval: tree search, citations, the fusion of all paths, records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import recall, retrieval
from quern.plans import catalog
from quern.plans.registry import SQL, query
from quern.sources.tables import materialize, small, table

#: Sources as trees of two levels: a root, and a section for each language, with the beginning of its first document as summary.
SECTIONS = r"""sections AS (SELECT source, lang AS node, lang AS title, left(arg_min(text, doc_id), 160) AS summary, row_number() OVER (PARTITION BY source ORDER BY lang) AS ord FROM documents GROUP BY source, lang),
  s_words AS (SELECT source, node, unnest(list_distinct(regexp_extract_all(lower(title || ' — ' || summary), '[\p{L}\p{N}]+'))) AS w FROM sections),
  s_grams AS (SELECT DISTINCT source, node, substr('  ' || w || ' ', i::INT, 3) AS gram FROM (SELECT source, node, w, unnest(range(1, length(w) + 2)) AS i FROM s_words)),
  s_size AS (SELECT source, node, count(*) AS n FROM s_grams GROUP BY ALL),
  s_shared AS (SELECT query_id, source, node, count(*) AS m FROM s_grams JOIN q_grams USING (gram) GROUP BY ALL),
  hand AS (
    SELECT r.query_id, r.source, r.source_rank, s.node, s.ord, round(coalesce(m / (q.n + z.n - m)::DOUBLE, 0), 10) AS score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, source) AS source_rank FROM routed) r JOIN sections s USING (source) JOIN q_size q USING (query_id) JOIN s_size z USING (source, node) LEFT JOIN s_shared USING (query_id, source, node)),
  picked AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, ord) AS place FROM hand QUALIFY place <= 2),
  turns AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source_rank, place, node) AS turn FROM picked QUALIFY turn <= 8),
  firsts AS (SELECT source, lang AS node, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents QUALIFY n <= 12),
  tree AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY turn, n) - 1 AS rank, source, node FROM turns JOIN firsts USING (source, node))"""


def sections(spark, d) -> tuple[DataFrame, DataFrame]:
    """The nodes of all sources' trees, and the documents below each."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.col("lang").alias("node"), F.substring("text", 1, 160).alias("summary"))
    kids = docs.groupBy("source", "node").agg(F.min_by("summary", "doc_id").alias("summary")).select("source", "node", F.lit("root").alias("parent"), F.col("node").alias("ord"), F.col("node").alias("title"), "summary", F.array("source", "node").alias("titles"))
    roots = docs.select("source").distinct().select("source", F.lit("root").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit("").alias("ord"), F.col("source").alias("title"), F.lit("").alias("summary"), F.array("source").alias("titles"))
    return kids.union(roots), docs.select("doc_id", "source", "node", F.col("doc_id").alias("ord"))


def tree_hits(spark, d, hits: list[DataFrame]) -> DataFrame:
    nodes, members = sections(spark, d)
    return retrieval.tree_search(recall.asked(catalog.benchmark(spark, d)), catalog.routed(spark, d, hits), nodes, members)


@query(rf"WITH {catalog.RRF}, {catalog.ROUTED}, {SECTIONS} SELECT query_id, doc_id, rank, source, node FROM tree")
def tree_search(spark, d):
    return tree_hits(spark, d, catalog.thirty(spark, d))


@query("SELECT doc_id, source || ' / ' || lang AS citation FROM documents")
def citations_join(spark, d):
    """Each document with the titles of the section it stands in."""
    nodes, members = sections(spark, d)
    hits = table(spark, d, "documents").select("doc_id")
    return retrieval.cited(hits, members, nodes).select("doc_id", F.array_join("citation", " / ").alias("citation"))


PATHS = rf"""{catalog.RRF}, {catalog.ROUTED}, {SECTIONS},
  near5 AS (SELECT query_id, vec_id FROM nearest WHERE rank < 5),
  {catalog.SEMANTIC},
  parts AS (SELECT query_id, unnest(u) AS x, unnest(range(len(u))) AS pos FROM near5 JOIN units USING (vec_id)),
  means AS (SELECT query_id, list(m ORDER BY pos) AS c FROM (SELECT query_id, pos, avg(x) AS m FROM parts GROUP BY ALL) GROUP BY query_id),
  moved AS (SELECT means.query_id, list_transform(list_zip(u, c), lambda z: z[1] + 0.75 * z[2]) AS q FROM means JOIN units ON vec_id = means.query_id),
  prf AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(e, q::DOUBLE[]), 10) DESC, vec_id) - 1 AS rank FROM base, moved QUALIFY rank < 20),
  five AS (
    SELECT query_id // 50 AS query_id, vec_id AS doc_id, rank FROM prf JOIN benchmark ON item_id = query_id // 50
    UNION ALL SELECT query_id, doc_id, rank FROM lexical WHERE rank < 20
    UNION ALL SELECT query_id, doc_id, rank FROM tree
    UNION ALL SELECT query_id, doc_id, rank FROM graph
    UNION ALL SELECT query_id // 50, vec_id, rank FROM semantic JOIN benchmark ON item_id = query_id // 50)"""


def deep_hits(spark, d) -> DataFrame:
    """Vector recall with feedback, lexical recall, tree search, graph recall and semantic recall, fused; without any, the fast hits."""
    own, vectors = catalog.item_vectors(spark, d), catalog.vectors(spark, d)
    hits = catalog.thirty(spark, d)
    lexical, by_vector = (x.where("rank < 20") for x in hits)
    first = recall.feedback_recall(own, vectors, 20).withColumnRenamed("vec_id", "doc_id")
    last = catalog.by_label(spark, d, own).withColumnRenamed("vec_id", "doc_id")
    paths = [materialize(x.select("query_id", "doc_id", "rank")) for x in (first, lexical, tree_hits(spark, d, hits), catalog.word_graph_hits(spark, d), last)]
    return materialize(retrieval.deep(paths, recall.hybrid(lexical, by_vector)))


def of_hits(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """The rows (doc_id and others) of documents that are hits; these are broadcast if they are few, so rows of others aren't shuffled."""
    return rows.join(small(hits.select("doc_id").distinct()), "doc_id", "left_semi")


DEEP = "WITH graph AS (" + SQL["graph_recall"] + "), " + PATHS + r""",
  fused AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 10) AS rrf FROM five GROUP BY ALL),
  best AS (SELECT query_id, doc_id, round(rrf, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_id) - 1 AS rank FROM fused QUALIFY rank < 8)"""


@query(f"{DEEP} SELECT query_id, doc_id, score, rank, 'deep' AS mode, source || ' / ' || lang AS citation FROM best LEFT JOIN documents USING (doc_id)")
def retrieve_deep(spark, d):
    nodes, members = sections(spark, d)
    hits = deep_hits(spark, d)
    cited = retrieval.cited(hits, of_hits(members, hits), nodes)
    return cited.select("query_id", "doc_id", "score", "rank", "mode", F.array_join("citation", " / ").alias("citation"))


@query(f"{DEEP} SELECT query_id, rank, md5(text) AS content_md5, least(1, score) AS score, CASE WHEN lang = 'en' THEN 'untitled' ELSE lang END AS title, doc_id::VARCHAR AS document, source || ' / ' || lang AS section FROM best JOIN documents USING (doc_id)")
def external_records(spark, d):
    """Deep hits in the form that other programs take; English documents have no title here."""
    nodes, members = sections(spark, d)
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"), F.when(F.col("lang") != "en", F.col("lang")).otherwise("").alias("title"))
    hits = deep_hits(spark, d)
    cited = retrieval.cited(hits, of_hits(members, hits), nodes).drop("source")
    rows = retrieval.records(cited.join(of_hits(docs, hits), "doc_id").withColumn("source_id", F.col("doc_id")))
    return rows.select("query_id", "rank", F.md5("content").alias("content_md5"), "score", "title", F.col("metadata.document_id").alias("document"), F.array_join("metadata.section_path", " / ").alias("section"))


@query(f"WITH {catalog.GRAMS} SELECT query_id, doc_id FROM lexical WHERE rank < 20 AND query_id % 2 = 0")
def blank_queries(spark, d):
    """Every other query is blank and finds nothing."""
    queries = catalog.benchmark(spark, d).withColumn("query", F.when(F.col("query_id") % 2 == 0, F.col("query")).otherwise(F.lit(" \n\t")))
    return recall.lexical_recall(queries, catalog.texts(spark, d)).select("query_id", "doc_id")
