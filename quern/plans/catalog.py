"""The queries of the engine over the test tables, each with SQL for a comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import graph, incremental, intervals, lexical, platform, recall
from quern.plans.registry import QUERIES, SQL, query  # noqa: F401
from quern.sources.tables import materialize, scratch_dir, small, table
from quern.streaming import events as streams

def texts(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "source", "lang")


def benchmark(spark, d) -> DataFrame:
    """The query set: all items of benchmark."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding", "label")


def vector_queries(spark, d) -> DataFrame:
    """The query set: every fiftieth vector."""
    return vectors(spark, d).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("q_label"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


GRAMS = r"""
  q_words AS (SELECT item_id AS query_id, text AS query, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS w FROM benchmark),
  q_grams AS (SELECT DISTINCT query_id, substr('  ' || w || ' ', i::INT, 3) AS gram FROM (SELECT query_id, w, unnest(range(1, length(w) + 2)) AS i FROM q_words)),
  d_words AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS w FROM documents),
  d_grams AS (SELECT DISTINCT doc_id, substr('  ' || w || ' ', i::INT, 3) AS gram FROM (SELECT doc_id, w, unnest(range(1, length(w) + 2)) AS i FROM d_words)),
  q_size AS (SELECT query_id, count(*) AS n FROM q_grams GROUP BY 1), d_size AS (SELECT doc_id, count(*) AS n FROM d_grams GROUP BY 1),
  trigram AS (
    SELECT query_id, doc_id, m / (q.n + d.n - m)::DOUBLE AS score
    FROM (SELECT query_id, doc_id, count(*) AS m FROM q_grams JOIN d_grams USING (gram) GROUP BY ALL) JOIN q_size q USING (query_id) JOIN d_size d USING (doc_id)),
  holds AS (SELECT item_id AS query_id, doc_id FROM documents JOIN benchmark ON contains(lower(documents.text), lower(trim(benchmark.text, e' \\t\\n\\r')))),
  found AS (SELECT query_id, doc_id, coalesce(score, 0) AS score FROM (SELECT * FROM trigram WHERE score > 0.05) FULL JOIN holds USING (query_id, doc_id)),
  lexical AS (
    SELECT query_id, doc_id, coalesce(t.score, 0) AS score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(t.score, 0) DESC, doc_id) - 1 AS rank
    FROM found LEFT JOIN trigram t USING (query_id, doc_id) QUALIFY rank < 30)"""
COSINES = """
  base AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
  asked AS (SELECT vec_id AS query_id, e AS q, label AS q_label FROM base WHERE vec_id % 50 = 0),
  scored AS (SELECT query_id, vec_id, label, q_label, round(list_cosine_similarity(e, q), 10) AS score FROM base, asked),
  nearest AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM scored)"""


@query(f"WITH {GRAMS} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM trigram) WHERE rank < 10")
def trigram_similarity_topk(spark, d):
    return rounded(recall.trigram_recall(benchmark(spark, d), texts(spark, d)), "score").withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {GRAMS} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM lexical WHERE rank < 20")
def lexical_recall(spark, d):
    return rounded(recall.lexical_recall(benchmark(spark, d), texts(spark, d)), "score").withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {COSINES} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM nearest WHERE rank < 10")
def vector_topk(spark, d):
    return rounded(recall.vector_recall(vector_queries(spark, d), vectors(spark, d)), "score").withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {COSINES}, own AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM scored WHERE label = q_label) SELECT query_id, vec_id, round(score, 6) AS score, rank FROM own WHERE rank < 10")
def vector_topk_filtered(spark, d):
    hits = recall.vector_recall(vector_queries(spark, d), vectors(spark, d), same=("q_label", "label"))
    return rounded(hits, "score").withColumn("rank", F.col("rank").cast("long"))


LINKED = f"""{GRAMS}, {COSINES},
  vec AS (SELECT query_id // 50 AS query_id, vec_id AS doc_id, score, rank FROM nearest JOIN benchmark ON item_id = query_id // 50 WHERE rank < 30)"""


def item_vectors(spark, d) -> DataFrame:
    """The vectors of the query set of benchmark: item k has the vector 50 k, if there is one (a link made up for the test tables; a document has the vector of its id)."""
    own = vector_queries(spark, d).select((F.col("query_id") / 50).cast("long").alias("query_id"), "q")
    return own.join(benchmark(spark, d).select("query_id"), "query_id", "left_semi")


def linked_vector_hits(spark, d, n: int = 20) -> DataFrame:
    """Vector recall for the query set of benchmark, by document."""
    return recall.vector_recall(item_vectors(spark, d), vectors(spark, d), n).withColumnRenamed("vec_id", "doc_id")


@query(f"""WITH {LINKED}, fused AS (
  SELECT query_id, doc_id, round(greatest(coalesce(l.score, 0), coalesce(v.score, 0)), 4) AS score FROM (SELECT * FROM lexical WHERE rank < 20) l FULL JOIN (SELECT query_id::BIGINT AS query_id, doc_id, score FROM vec WHERE rank < 20) v USING (query_id, doc_id)),
  best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM fused)
SELECT query_id, doc_id, score, rank, source FROM best JOIN documents USING (doc_id) WHERE rank < 10""")
def hybrid_fast(spark, d):
    hits = recall.hybrid(recall.lexical_recall(benchmark(spark, d), texts(spark, d)), linked_vector_hits(spark, d))
    return hits.join(texts(spark, d).select("doc_id", "source"), "doc_id").select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"), "source")


RRF = f"{LINKED}, paths AS (SELECT query_id::BIGINT AS query_id, doc_id, rank, 0 AS path FROM lexical UNION ALL SELECT query_id::BIGINT, doc_id, rank, 1 FROM vec)"


@query(f"WITH {RRF} SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS rrf, count(*) AS n_paths, min(path) AS first_path FROM paths WHERE rank < 20 GROUP BY ALL")
def rrf_fusion(spark, d):
    return rounded(recall.rrf([recall.lexical_recall(benchmark(spark, d), texts(spark, d)), linked_vector_hits(spark, d)], "doc_id"), "rrf")


def thirty(spark, d) -> list[DataFrame]:
    """30 lexical and 30 vector hits of each query of benchmark, written once."""
    return [materialize(recall.lexical_recall(benchmark(spark, d), texts(spark, d), 30)), materialize(linked_vector_hits(spark, d, 30))]


def routed(spark, d, hits: list[DataFrame]) -> DataFrame:
    """query_id, source, rrf, rank: the four best sources by the fusion of hits."""
    fused = recall.rrf(hits, "doc_id")
    by_source = fused.join(texts(spark, d).select("doc_id", "source"), "doc_id").groupBy("query_id", "source").agg(F.round(F.sum("rrf"), 6).alias("rrf"))
    return recall.top(by_source, 4, "rrf", "source")


ROUTED = """routed AS (
  SELECT * FROM (SELECT query_id, source, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS rrf FROM paths JOIN documents USING (doc_id) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, source) <= 4)"""


@query(f"WITH {RRF}, {ROUTED} SELECT query_id, source, rrf FROM routed")
def cross_doc_routing(spark, d):
    return routed(spark, d, thirty(spark, d)).drop("rank")


@query(f"WITH {RRF} SELECT query_id, doc_id, path, n - 1 AS rank FROM (SELECT query_id, doc_id, path, row_number() OVER (PARTITION BY query_id ORDER BY path, pos) AS n FROM (SELECT query_id, doc_id, min(path) AS path, arg_min(rank, path) AS pos FROM paths WHERE rank < 20 GROUP BY ALL)) WHERE n <= 6")
def multi_kb_search(spark, d):
    """Lexical hits, then vector hits that aren't among them, the first six of each query."""
    return recall.first_seen([recall.lexical_recall(benchmark(spark, d), texts(spark, d)), linked_vector_hits(spark, d)], "doc_id", 6)


@query(f"""WITH {COSINES}, seeds AS (SELECT query_id, vec_id FROM nearest WHERE rank < 5),
  units AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM base),
  parts AS (SELECT query_id, unnest(u) AS x, unnest(range(len(u))) AS pos FROM seeds JOIN units USING (vec_id)),
  means AS (SELECT query_id, list(m ORDER BY pos) AS c FROM (SELECT query_id, pos, avg(x) AS m FROM parts GROUP BY ALL) GROUP BY query_id),
  moved AS (SELECT means.query_id, list_transform(list_zip(u, c), lambda z: z[1] + 0.75 * z[2]) AS q FROM means JOIN units ON vec_id = means.query_id),
  again AS (SELECT query_id, vec_id, round(list_cosine_similarity(e, q::DOUBLE[]), 10) AS score FROM base, moved)
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM again) WHERE rank < 10""")
def rocchio_prf(spark, d):
    return rounded(recall.feedback_recall(vector_queries(spark, d), vectors(spark, d)), "score").withColumn("rank", F.col("rank").cast("long"))


SEMANTIC = """units AS (SELECT label, vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM base),
  label_parts AS (SELECT label, unnest(u) AS x, unnest(range(len(u))) AS pos FROM units),
  label_means AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS m FROM label_parts GROUP BY ALL) GROUP BY label),
  close AS (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q, c), 10) DESC, label) AS near FROM asked, label_means QUALIFY near <= 3),
  members AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place FROM base QUALIFY place <= 8),
  semantic AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY near, place, vec_id) - 1 AS rank FROM close JOIN members USING (label) QUALIFY rank < 12)"""


def by_label(spark, d, queries: DataFrame) -> DataFrame:
    """Semantic recall with the labels as clusters."""
    centres = recall.centroids(vectors(spark, d).select("label", "vec_id"), vectors(spark, d), by="label").select(F.col("label").alias("vec_id"), F.col("centroid").alias("embedding"))
    return recall.semantic_recall(queries, centres, vectors(spark, d).select(F.col("label").alias("cluster"), "vec_id"))


@query(f"WITH {COSINES}, {SEMANTIC} SELECT query_id, vec_id, rank FROM semantic")
def semantic_recall(spark, d):
    return by_label(spark, d, vector_queries(spark, d))


@query()
def semantic_clusters(spark, d):
    """k-means over all vectors, with k of a tenth of them, from 2 to 12; tests compare it with numpy."""
    own = vectors(spark, d)
    return recall.clusters(own, max(2, min(12, own.count() // 10)))[0]


@query(f"WITH {COSINES}, best AS (SELECT query_id, vec_id, score, max(score) OVER (PARTITION BY query_id) AS b FROM nearest WHERE rank BETWEEN 1 AND 10) SELECT query_id, vec_id, round(score, 6) AS score FROM best WHERE score >= 0.4 OR b < 0.4")
def soft_threshold(spark, d):
    hits = recall.vector_recall(vector_queries(spark, d), vectors(spark, d), 11).where("rank > 0")
    return rounded(recall.soft_threshold(hits, 0.4).drop("rank"), "score")


@query(r"""SELECT conv_id, turn, length(t) >= 10 OR regexp_matches(t, '(?i)对比|相比|区别|差异|为什么|为何|原因|依据|条款|规定|影响|关系|如何|怎样|怎么|列出|总结|归纳|多少|哪些|哪个|是否|能否|可否|需要|流程|申请|步骤|手续|标准|政策|要求|增长|变化|趋势|吗|呢|compare|versus|\bvs\b|why|reason|differ|difference|according|clause|impact|relationship|how\s|summar|list\s|trend|change|between|process|require|policy|step|should') OR regexp_matches(t, '[?？]') AS deep,
  greatest(1, length(text) // 4) AS tokens FROM (SELECT *, trim(text, e' \t\n\r') AS t FROM conversations)""")
def route_classify(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.is_deep(F.col("text")).alias("deep"), T.token_estimate(F.col("text")).alias("tokens"))


EDGES = """edges AS (SELECT DISTINCT 's' || l_suppkey AS src, 'o' || l_orderkey AS dst FROM lineitem),
  both_ AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"""


def supply(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("o"), "l_orderkey").alias("dst"))


@query(f"""WITH {EDGES}, seeds AS (SELECT 's' || s_suppkey AS seed FROM supplier WHERE s_suppkey % 50 = 0),
  one AS (SELECT DISTINCT seed, dst AS node FROM seeds JOIN both_ ON src = seed), two AS (SELECT DISTINCT seed, dst AS node FROM one JOIN both_ ON src = node)
SELECT seed, node, min(hop)::BIGINT AS hop FROM (SELECT seed, seed AS node, 0 AS hop FROM seeds UNION ALL SELECT seed, node, 1 FROM one UNION ALL SELECT seed, node, 2 FROM two) GROUP BY ALL""")
def graph_multihop(spark, d):
    seeds = table(spark, d, "supplier").where("s_suppkey % 50 = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("seed"))
    return graph.multihop(seeds, supply(spark, d).distinct())


@query()
def connected_components(spark, d):
    """Of all orders and suppliers by lines; tests compare it with union and find."""
    return graph.components(supply(spark, d))


@query("""WITH first AS (SELECT item_id, string_split(lower(text), ' ') AS w FROM benchmark),
  edges AS (SELECT DISTINCT w[i] AS src, w[i + 1] AS dst FROM (SELECT w, unnest(range(1, len(w))) AS i FROM first) WHERE w[i] <> '' AND w[i + 1] <> ''),
  both_ AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
  seeds AS (SELECT item_id AS query_id, w[1] AS seed FROM first WHERE w[1] <> ''),
  near AS (SELECT query_id, node, min(hop) AS hop FROM (
    SELECT query_id, seed AS node, 0 AS hop FROM seeds UNION ALL SELECT query_id, dst, 1 FROM seeds JOIN both_ ON src = seed
    UNION ALL SELECT query_id, b.dst, 2 FROM seeds JOIN both_ a ON a.src = seed JOIN both_ b ON b.src = a.dst) GROUP BY ALL),
  sought AS (SELECT query_id, node FROM near QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hop, node) <= 40),
  held AS (SELECT doc_id, node FROM documents JOIN (SELECT DISTINCT node FROM sought) ON contains(lower(text), node)),
  hits AS (SELECT query_id, doc_id, count(*) AS hits FROM held JOIN sought USING (node) GROUP BY ALL)
SELECT query_id, doc_id, hits, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, doc_id) - 1 AS rank FROM hits QUALIFY rank < 12""")
def graph_recall(spark, d):
    """Neighbouring words of the benchmark's texts as a graph; from a query's first word to documents that contain what is near it."""
    return word_graph_hits(spark, d)


def word_graph_hits(spark, d) -> DataFrame:
    words = benchmark(spark, d).select("query_id", F.split(F.lower("query"), " ").alias("w"))
    pairs = F.transform("w", lambda x, i: F.struct(x.alias("src"), F.get("w", i + 1).alias("dst")))
    edges = words.select(F.explode(pairs).alias("e")).select("e.*").where("src <> '' AND dst <> ''").distinct()
    seeds = words.select("query_id", F.get("w", F.lit(0)).alias("seed")).where("seed <> ''")
    return recall.graph_recall(seeds, edges, texts(spark, d))


@query("SELECT d.doc_id, count(*) AS hits, min(item_id) AS first_item FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text)) GROUP BY d.doc_id")
def entity_containment(spark, d):
    items = table(spark, d, "benchmark").select("item_id", F.lower("text").alias("name"))
    found = lexical.contained(texts(spark, d), items).join(small(items), "name")
    return found.groupBy("doc_id").agg(F.count("*").alias("hits"), F.min("item_id").alias("first_item"))


@query("""WITH bases AS (SELECT DISTINCT source AS kb FROM documents UNION ALL SELECT 'empty'),
  rows AS (SELECT source AS kb, CASE WHEN length(trim(text)) < 100 THEN 'failed' ELSE 'parsed' END AS status, vec_id IS NOT NULL AS embedded FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
  counts AS (SELECT kb, count(*) AS n_sources, count(*) FILTER (status = 'failed') AS n_failed, count(*) FILTER (embedded) AS n_embedded FROM rows GROUP BY kb),
  all_ AS (SELECT kb, coalesce(n_sources, 0) AS n_sources, coalesce(n_failed, 0) AS n_failed, coalesce(n_embedded, 0) AS n_embedded, kb >= 'src3' AS graph, kb >= 'src7' AS wiki FROM bases LEFT JOIN counts USING (kb))
SELECT kb, n_sources, n_failed, n_sources AS n_chunks, n_embedded,
  greatest(0, 100 - CASE WHEN n_failed > 0 THEN 40 ELSE 0 END - CASE WHEN n_embedded < n_sources THEN 25 ELSE 0 END - CASE WHEN n_sources > 0 AND NOT graph THEN 10 ELSE 0 END - CASE WHEN n_sources > 0 AND NOT wiki THEN 10 ELSE 0 END)::BIGINT AS score,
  concat_ws(',', CASE WHEN n_sources = 0 THEN 'no_sources' END, CASE WHEN n_failed > 0 THEN 'failed_sources' END, CASE WHEN n_embedded < n_sources THEN 'unembedded' END, CASE WHEN n_sources > 0 AND NOT graph THEN 'no_graph' END, CASE WHEN n_sources > 0 AND NOT wiki THEN 'no_wiki' END) AS issues
FROM all_""")
def health_score(spark, d):
    """Sources as bases; short documents as failed ones; some bases have a graph, and a wiki."""
    docs = texts(spark, d).withColumnRenamed("source", "kb")
    bases = docs.select("kb").distinct().union(spark.createDataFrame([("empty",)], "kb string"))
    status = F.when(F.length(F.trim("text")) < 100, "failed").otherwise("parsed")
    chunks = docs.join(vectors(spark, d), F.col("vec_id") == F.col("doc_id"), "left").select("kb", F.col("vec_id").isNotNull().alias("embedded"))
    return platform.health(bases, docs.select("kb", status.alias("status")), chunks, bases.where("kb >= 'src3'"), bases.where("kb >= 'src7'"))


@query("SELECT sha256(trim(text, e' \\t\\n\\r')) AS sha, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1")
def content_hash_dedup(spark, d):
    return incremental.hash_groups(texts(spark, d))


@query("""WITH old AS (SELECT sha256(trim(text, e' \\t\\n\\r')) AS sha, min(doc_id) AS carried_from FROM documents JOIN embeddings ON vec_id = doc_id WHERE doc_id % 2 = 0 GROUP BY 1)
SELECT doc_id, carried_from, carried_from IS NULL AS embed_anew FROM documents LEFT JOIN old ON sha = sha256(trim(text, e' \\t\\n\\r'))""")
def incremental_carry_forward(spark, d):
    """All documents arrive anew; those of even ids were there before, with vectors."""
    old = texts(spark, d).where("doc_id % 2 = 0").join(vectors(spark, d), F.col("vec_id") == F.col("doc_id")).select(F.col("doc_id").alias("old_id"), "text", "embedding")
    return incremental.carry_forward(texts(spark, d), old).select("doc_id", "carried_from", F.col("carried_from").isNull().alias("embed_anew"))


@query("SELECT o_custkey AS kb, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey")
def source_counts(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("kb")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT c_custkey AS user_id, c_name AS name, n_name AS workspace, coalesce(n, 0) AS n_orders FROM customer JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def member_listing(spark, d):
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    users = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(counts, "c_custkey", "left")
    return users.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("n_name").alias("workspace"), F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("""SELECT event_id, user_id, event_type, total FROM (SELECT *, count(*) OVER () AS total FROM events WHERE starts_with(event_type, 'p') AND value >= 10) ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 50""")
def audit_page(spark, d):
    rows = table(spark, d, "events").where(F.startswith(F.col("event_type"), F.lit("p")) & (F.col("value") >= 10))
    return platform.page(rows, 50, 2, F.col("ts").desc(), F.col("event_id").desc()).select("event_id", "user_id", "event_type", "total")


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_per_key(spark, d):
    return platform.latest(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS no FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 8")
def recent_messages(spark, d):
    return platform.last_rows(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 8)


@query("""WITH bases AS (SELECT n_nationkey AS kb, n_nationkey % 10 + 1 AS owner, n_regionkey AS workspace, n_nationkey % 2 = 0 AS open_ FROM nation),
  members AS (SELECT c_custkey AS user_id, c_nationkey AS kb, CASE WHEN c_acctbal > 0 THEN 'editor' ELSE 'viewer' END AS role, (c_custkey % 5)::INT AS workspace FROM customer),
  ways AS (SELECT owner AS user_id, kb, 'owner' AS role, 0 AS o FROM bases UNION ALL SELECT user_id, kb, role, 1 FROM members
    UNION ALL SELECT DISTINCT user_id, bases.kb, 'viewer', 2 FROM members JOIN bases USING (workspace) WHERE open_)
SELECT user_id::BIGINT AS user_id, kb, arg_min(role, (o, role)) AS role FROM ways GROUP BY ALL""")
def access_roles(spark, d):
    bases = table(spark, d, "nation").select(F.col("n_nationkey").alias("kb"), (F.col("n_nationkey") % 10 + 1).cast("long").alias("owner"), F.col("n_regionkey").alias("workspace"), F.when(F.col("n_nationkey") % 2 == 0, "workspace").otherwise("private").alias("visibility"))
    members = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("kb"), F.when(F.col("c_acctbal") > 0, "editor").otherwise("viewer").alias("role"), (F.col("c_custkey") % 5).cast("int").alias("workspace"))
    return platform.visible(bases, members)


@query("SELECT user_id, epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS bucket, count(*) AS n, count(*) > 3 AS limited FROM events GROUP BY ALL")
def rate_limit_tumbling(spark, d):
    return streams.rate_counts(table(spark, d, "events"))


@query("""WITH marked AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 2 HOUR, true)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM marked)
SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, floor(epoch(max(ts) + INTERVAL 2 HOUR))::BIGINT AS "end", count(*) AS n FROM numbered GROUP BY user_id, s""")
def idle_sessions(spark, d):
    return streams.idle_sessions(table(spark, d, "events"))


@query(f"WITH {COSINES} SELECT query_id, count(*) AS n_shown, string_agg(vec_id, ',' ORDER BY rank) AS shown FROM nearest WHERE rank < 10 GROUP BY query_id")
def impressions_nested(spark, d):
    hits = recall.vector_recall(vector_queries(spark, d), vectors(spark, d)).withColumnRenamed("vec_id", "doc_id")
    return platform.impressions(hits).select("query_id", "n_shown", F.array_join(F.transform("shown", lambda s: s["doc_id"].cast("string")), ",").alias("shown"))


@query(f"""WITH {COSINES}, wanted AS (SELECT query_id, count(*) AS n FROM scored WHERE label = q_label GROUP BY 1),
  found AS (SELECT query_id, sum(1 / log2(rank + 2)) AS dcg, count(*) AS hits FROM nearest WHERE rank < 10 AND label = q_label GROUP BY 1)
SELECT query_id, round(coalesce(dcg, 0) / list_sum(list_transform(range(least(n, 10)), lambda i: 1 / log2(i + 2))), 6) AS ndcg, round(coalesce(hits, 0) / n, 6) AS recall FROM wanted LEFT JOIN found USING (query_id)""")
def ndcg_at_10(spark, d):
    """Relevant to a vector are all of its label."""
    hits = recall.vector_recall(vector_queries(spark, d), vectors(spark, d)).withColumnRenamed("vec_id", "doc_id")
    labels = vectors(spark, d)
    asked = vector_queries(spark, d).join(labels.groupBy(F.col("label").alias("q_label")).agg(F.count("*").alias("n")), "q_label")
    found = hits.join(labels.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id").join(asked.select("query_id", "q_label"), "query_id").where("label = q_label")
    return rounded(platform.ndcg(found, asked.select("query_id", "n")), "ndcg", "recall")


@query("""WITH v AS (SELECT user_id, value FROM events), m AS (SELECT *, coalesce(value - lag(value) OVER w > 0.5, false)::INT AS new FROM v WINDOW w AS (PARTITION BY user_id ORDER BY value)),
  n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY value) AS island FROM m)
SELECT user_id, island::BIGINT AS island, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM n GROUP BY user_id, island""")
def cluster_1d_islands(spark, d):
    return intervals.islands(table(spark, d, "events"), "user_id", "value", 0.5)


@query("""WITH s AS (SELECT l_suppkey AS key, epoch(l_shipdate)::BIGINT // 86400 AS a, epoch(l_shipdate)::BIGINT // 86400 + l_quantity::BIGINT // 10 AS b FROM lineitem),
  r AS (SELECT key, a AS "to", max(b) OVER (PARTITION BY key ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS "from" FROM s)
SELECT key, "from", "to" FROM r WHERE "from" < "to" """)
def valleys(spark, d):
    days = F.unix_timestamp("l_shipdate").cast("long")
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.floor(days / 86400).alias("a"), (F.floor(days / 86400) + F.floor(F.floor("l_quantity") / 10)).alias("b"))
    return intervals.valleys(rows, "key", "a", "b")


@query("""WITH e AS (SELECT user_id, event_id, epoch(ts)::BIGINT AS s, event_type FROM events)
SELECT a.user_id AS key, a.event_id AS a_id, b.event_id AS b_id FROM e a JOIN e b USING (user_id) WHERE a.event_type = 'purchase' AND b.event_type = 'error' AND b.s + 600 > a.s AND b.s < a.s + 600""")
def overlap_join(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", T.nearest_second(F.col("ts")).alias("s"), "event_type")
    side = lambda kind, x: rows.where(F.col("event_type") == kind).select("key", F.col("event_id").alias(f"{x}_id"), F.col("s").alias(f"{x}_start"), (F.col("s") + 600).alias(f"{x}_end"))
    return intervals.overlaps(side("purchase", "a"), side("error", "b"), "key", 600)


@query("""WITH nodes AS (SELECT conv_id AS key, turn AS node, turn % 3 AS depth, turn AS start, turn + 3 AS "end" FROM conversations), points AS (SELECT conv_id AS key, turn AS point, turn + 1 AS pos FROM conversations)
SELECT key, point, arg_min(node, (-depth, node)) AS node, max(depth) AS depth FROM points JOIN nodes USING (key) WHERE start <= pos AND pos < "end" GROUP BY ALL""")
def deepest_node_range_join(spark, d):
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("key"), "turn")
    nodes = turns.select("key", F.col("turn").alias("node"), (F.col("turn") % 3).alias("depth"), F.col("turn").alias("start"), (F.col("turn") + 3).alias("end"))
    return intervals.deepest(turns.select("key", F.col("turn").alias("point"), (F.col("turn") + 1).alias("pos")), nodes, "key", 4)


@query("""SELECT user_id, count(*) AS n, first_page, least(first_page + 15, n_pages)::BIGINT AS last_page FROM (
  SELECT user_id, n_pages, unnest(range(1, n_pages + 1, 16)) AS first_page FROM (SELECT user_id, count(*) AS n_pages FROM events GROUP BY 1)) GROUP BY ALL""")
def page_windows(spark, d):
    pages = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n_pages"))
    rows = pages.select("user_id", "n_pages", F.explode(F.expr("sequence(1L, n_pages, 16L)")).alias("first_page"))
    return rows.select("user_id", F.lit(1).cast("long").alias("n"), "first_page", F.least(F.col("first_page") + 15, F.col("n_pages")).alias("last_page"))


@query("SELECT strftime(date_trunc('month', ts), '%Y-%m-%d') AS low, strftime(date_trunc('month', ts) + INTERVAL 1 MONTH, '%Y-%m-%d') AS high, count(*) AS n FROM events GROUP BY ALL")
def monthly_partitions(spark, d):
    month = F.trunc("ts", "month")
    return table(spark, d, "events").groupBy(month.cast("string").alias("low"), F.add_months(month, 1).cast("string").alias("high")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, md5(string_agg('[' || turn || '] ' || text, e'\\n\\n' ORDER BY turn)) AS context_md5, count(*) AS n FROM conversations GROUP BY conv_id")
def context_assembly(spark, d):
    block = F.concat(F.lit("["), "turn", F.lit("] "), "text")
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", block.alias("block")))).alias("b"), F.count("*").alias("n"))
    return rows.select("conv_id", F.md5(F.array_join(F.transform("b", lambda b: b["block"]), "\n\n")).alias("context_md5"), "n")


@query("SELECT page_id, left(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40) AS slug FROM pages")
def slugs(spark, d):
    return table(spark, d, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query("""WITH asked AS (SELECT conv_id, arg_max(turn, turn) AS last_turn FROM conversations WHERE role = 'user' GROUP BY 1)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS rank FROM conversations JOIN asked USING (conv_id) WHERE turn < last_turn QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5""")
def memory_window(spark, d):
    """The five turns before each conversation's last question, newest first."""
    turns = table(spark, d, "conversations")
    asked = turns.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    before = turns.join(asked, "conv_id").where("turn < last_turn").select("conv_id", "turn", (F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").desc())) - 1).cast("long").alias("rank"))
    return before.where("rank < 5")


@query("SELECT user_id, epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS bucket, count(*) AS n FROM events GROUP BY ALL")
def stream_events_windowed(spark, d):
    """The counters of rate_limit_tumbling, from a stream over the files of events, to the end of what is there, by a table in the shared folder."""
    files = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).option("pathGlobFilter", "*").parquet(f"{d}/events*.parquet")
    folder = scratch_dir(spark)
    return streams.drain_counts(spark, files.withColumn("ts", F.col("ts").cast("timestamp")), f"{folder}/table", f"{folder}/state")


from quern.plans import documents, pages, retrieval, services  # noqa: E402, F401  (they add their queries)
