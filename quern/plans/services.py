"""Queries of a knowledge base's services: listings, updates, jobs, sessions, memories, feedback, audit, graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import graph, merging, platform
from quern.plans.registry import SQL, query
from quern.sources.tables import scratch_dir, small, table
from quern.streaming import events as streams


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def three_way_lookup(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    bases = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, d, "orders").join(small(users), "o_custkey").join(small(bases), "c_nationkey").select("o_orderkey", "c_name", "n_name")


@query("SELECT n_nationkey, n_name, coalesce(r_name, '—') AS workspace, coalesce(n, 0) AS members FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 2) ON r_regionkey = n_regionkey LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = n_nationkey")
def base_listing(spark, d):
    """Bases with the names of their workspaces, a dash for one that is gone, and the number of their members."""
    spaces = table(spark, d, "region").where("r_regionkey <> 2").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    members = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    rows = table(spark, d, "nation").join(spaces, "n_regionkey", "left").join(members, "n_nationkey", "left")
    return rows.select("n_nationkey", "n_name", F.coalesce("r_name", F.lit("—")).alias("workspace"), F.coalesce("n", F.lit(0)).alias("members"))


@query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN 'Owner' ELSE 'Member' END AS role FROM customer WHERE contains(lower(c_name), '00000001') OR contains(lower(c_mktsegment), 'build')")
def member_search(spark, d):
    """Members by a part of two fields, with the roles that some have (by workspace and user), Member for others."""
    roles = table(spark, d, "customer").where("c_custkey % 3 = 0").select("c_nationkey", "c_custkey", F.lit("Owner").alias("role"))
    users = table(spark, d, "customer")
    found = platform.matching(users, "00000001", "c_name", "c_mktsegment").unionByName(platform.matching(users, " BUILD ", "c_name", "c_mktsegment")).distinct()
    return found.join(roles, ["c_nationkey", "c_custkey"], "left").select("c_custkey", "c_name", "c_nationkey", F.coalesce("role", F.lit("Member")).alias("role"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal >= 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = 1)")
def active_members(spark, d):
    """Members who aren't deleted (negative accounts), have orders, and whose base isn't gone."""
    users = table(spark, d, "customer").where("c_acctbal >= 0")
    gone = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return users.join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").join(gone, "c_nationkey", "left_anti").select("c_custkey")


@query("SELECT event_id, user_id, event_type FROM events WHERE user_id IN (1, 2, 3) AND event_type IN ('click', 'view') AND value BETWEEN 10 AND 100 ORDER BY ts DESC, event_id DESC LIMIT 200")
def recent_filtered(spark, d):
    """The last 200 of some users' events, by several conditions."""
    rows = table(spark, d, "events").where(F.col("user_id").isin(1, 2, 3) & F.col("event_type").isin("click", "view") & F.col("value").between(10, 100))
    return rows.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(200).select("event_id", "user_id", "event_type")


@query("SELECT p_partkey, p_size * p_retailprice AS area FROM part ORDER BY area DESC, p_partkey LIMIT 60")
def largest_figures(spark, d):
    area = (F.col("p_size") * F.col("p_retailprice")).alias("area")
    return table(spark, d, "part").select("p_partkey", area).orderBy(F.col("area").desc(), "p_partkey").limit(60)


@query("SELECT event_type AS method, (event_id % 3)::BIGINT AS status, count(*) AS n, round(sum(value), 6) AS seconds FROM events GROUP BY ALL")
def request_metrics(spark, d):
    return platform.metrics(table(spark, d, "events").select(F.col("event_type").alias("method"), (F.col("event_id") % 3).alias("status"), F.col("value").alias("duration")))


@query("SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 100 WHEN vec_id % 7 = 1 THEN label ELSE label END::BIGINT AS label FROM embeddings")
def bulk_update(spark, d):
    """Changes by key; a null among them leaves the old value."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    changes = rows.where("vec_id % 7 < 2").select("vec_id", F.when(F.col("vec_id") % 7 == 0, 100).cast("long").alias("label"))
    return merging.updated(rows, changes, "vec_id", "label")


@query("SELECT source, doc_id, n_chars FROM documents WHERE source NOT IN ('src1', 'src2') UNION ALL SELECT 'src1', -doc_id, n_chars FROM documents WHERE source = 'src1' AND doc_id % 3 = 0")
def replace_source(spark, d):
    """One source's rows replaced by fewer, in a written table; then those of a source that is gone are dropped."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "source")
    new = docs.where("source = 'src1' AND doc_id % 3 = 0").withColumn("doc_id", -F.col("doc_id"))
    left = docs.where("source <> 'src2'").select("source")
    return merging.orphans_dropped(merging.replaced(docs, new, "source"), left, "source").select("source", "doc_id", "n_chars")


@query(r"""WITH parsed AS (SELECT doc_id AS source, sha256(trim(text, e' \t\n\r')) AS sha FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id AS source FROM documents WHERE NOT EXISTS (SELECT 1 FROM parsed WHERE source = doc_id AND doc_id % 5 <> 0)""")
def changed_files(spark, d):
    """All files arrive again, every fifth with a change; of every third, the old content is there."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("source"), "text")
    parsed = docs.where("source % 3 = 0").select("source", T.content_sha(F.col("text")).alias("sha"), F.lit("parsed").alias("status"))
    arriving = docs.withColumn("text", F.when(F.col("source") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.concat(F.lit("\n"), "text", F.lit(" "))))
    return merging.unparsed(arriving, parsed).select("source")


@query("""WITH jobs AS (SELECT o_orderkey AS job, o_custkey AS source, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'queued' END AS status, o_orderkey % 4 AS attempts, o_orderdate AS day FROM orders),
  last AS (SELECT source, arg_max(job, (day, job)) AS job, arg_max(attempts, (day, job)) AS attempts FROM jobs WHERE status <> 'done' GROUP BY 1)
SELECT job, c_custkey AS source, 'running' AS status, (coalesce(attempts, 0) + 1)::BIGINT AS attempts FROM customer LEFT JOIN last ON source = c_custkey""")
def enter_jobs(spark, d):
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_custkey").alias("source"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("queued").alias("status"), (F.col("o_orderkey") % 4).alias("attempts"), F.col("o_orderdate").alias("created_at"))
    return merging.jobs_entered(jobs, table(spark, d, "customer").select(F.col("c_custkey").alias("source")))


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch(ts)::BIGINT AS x, floor(epoch(ts))::BIGINT AS s FROM events),
  m AS (SELECT user_id, s, coalesce(s - lag(s) OVER (PARTITION BY user_id ORDER BY s) >= 7200, true) AS fresh FROM e),
  starts AS (SELECT user_id, min(s) AS start FROM m GROUP BY 1
    UNION SELECT user_id, min(s) FROM (SELECT st.user_id, st.start, m.s FROM starts st JOIN m ON m.user_id = st.user_id AND m.s > st.start AND (m.s >= st.start + 21600 OR m.fresh)) GROUP BY user_id, start),
  ranged AS (SELECT user_id, start, lead(start) OVER (PARTITION BY user_id ORDER BY start) AS next FROM starts)
SELECT r.user_id, start, least(max(s) + 7200, start + 21600) AS "end", count(*) AS n FROM ranged r JOIN e ON e.user_id = r.user_id AND s >= start AND (next IS NULL OR s < next) GROUP BY r.user_id, start""")
def capped_sessions(spark, d):
    """Two hours idle, six hours at most."""
    return streams.sessions(table(spark, d, "events"), 7200, 21_600)


@query("""WITH RECURSIVE f AS (SELECT user_id, floor(epoch(ts))::BIGINT AS s FROM events WHERE event_type = 'error'),
  starts AS (SELECT user_id, min(s) AS start FROM f GROUP BY 1
    UNION SELECT user_id, min(s) FROM (SELECT st.user_id, st.start, f.s FROM starts st JOIN f ON f.user_id = st.user_id AND f.s >= st.start + 43200) GROUP BY user_id, start)
SELECT st.user_id, start, count(*) AS n, CASE WHEN count(*) >= 3 THEN max(s) + 43200 END AS locked_until FROM starts st JOIN f ON f.user_id = st.user_id AND s >= start AND s < start + 43200 GROUP BY st.user_id, start""")
def lockouts(spark, d):
    """Three errors in twelve hours."""
    return streams.lockouts(table(spark, d, "events").where("event_type = 'error'"), 3, 43_200)


MEMORIES = """memories AS (SELECT conv_id AS user_id, turn AS id, text AS content FROM conversations WHERE role <> 'user'),
  asked AS (SELECT conv_id AS user_id, turn AS query_id, text AS query FROM conversations WHERE role = 'user'),
  w AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS w FROM conversations),
  grams AS (SELECT conv_id, turn, list_distinct(flatten(list(list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i::INT, 3))))) AS g FROM w GROUP BY ALL)"""


@query(f"""WITH {MEMORIES}, pairs AS (
  SELECT m.user_id, query_id, id, content, query, len(list_intersect(x.g, y.g)) AS both_, len(x.g) AS a, len(y.g) AS b
  FROM memories m JOIN asked USING (user_id) JOIN grams x ON x.conv_id = m.user_id AND x.turn = id JOIN grams y ON y.conv_id = m.user_id AND y.turn = query_id),
  scored AS (SELECT *, both_ / (a + b - both_)::DOUBLE AS sim FROM pairs)
SELECT user_id, query_id, id, round(sim, 4) AS score FROM scored WHERE sim > 0.05 OR contains(lower(content), lower(query)) QUALIFY row_number() OVER (PARTITION BY user_id, query_id ORDER BY round(sim, 10) DESC, id) <= 5""")
def memory_recall(spark, d):
    """For each question of a user (a conversation), the five most similar of that user's memories (what others said there)."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("user_id"), "turn", "role", "text")
    memories = rows.where("role <> 'user'").select("user_id", F.col("turn").alias("id"), F.col("text").alias("content"))
    asked = rows.where("role = 'user'").select("user_id", F.col("turn").alias("query_id"), F.col("text").alias("query"))
    return platform.memories_recalled(memories, asked)


@query("""WITH memories AS (SELECT conv_id * 100 + turn AS id, text AS content, 'fact' AS kind FROM conversations WHERE role = 'user'),
  changes AS (SELECT CASE WHEN turn % 4 = 1 THEN 'ADD' ELSE 'UPDATE' END AS op, conv_id * 100 + turn - 1 AS id, left(text, 20) AS content, CASE WHEN turn % 3 = 0 THEN 'event' ELSE 'other' END AS kind, 100000000 + conv_id * 100 + turn AS new_id FROM conversations WHERE role = 'assistant'),
  ups AS (SELECT id, arg_max(trim(content), new_id) AS new, arg_max(kind, new_id) AS new_kind FROM changes WHERE op = 'UPDATE' AND id % 100 >= 2 AND trim(content) <> '' GROUP BY id)
SELECT id, md5(coalesce(new, content)) AS content_md5, CASE WHEN new_kind = 'event' THEN 'event' ELSE kind END AS kind FROM memories LEFT JOIN ups USING (id)
UNION ALL SELECT new_id, md5(trim(content)), kind FROM changes WHERE op = 'ADD' AND trim(content) <> ''""")
def memory_merge(spark, d):
    """Answers as operations on the memories of questions: new ones, and changes of those that were recalled (from the third turn on)."""
    rows = table(spark, d, "conversations").withColumn("key", F.col("conv_id") * 100 + F.col("turn"))
    memories = rows.where("role = 'user'").select(F.col("key").alias("id"), F.col("text").alias("content"), F.lit("fact").alias("kind"))
    op = F.when(F.col("turn") % 4 == 1, "add").otherwise("update").alias("op")
    changes = rows.where("role = 'assistant'").select(op, (F.col("key") - 1).alias("id"), F.substring("text", 1, 20).alias("content"), F.when(F.col("turn") % 3 == 0, "event").otherwise("other").alias("kind"), (F.col("key") + 100_000_000).alias("at"))
    merged = merging.consolidated(memories, changes, memories.where("id % 100 >= 2"))
    return merged.select("id", F.md5("content").alias("content_md5"), "kind")


@query("""WITH signals AS (SELECT user_id AS id, ts, CASE WHEN event_type = 'click' THEN floor(value / 50)::BIGINT - 2 END AS thumb, CASE WHEN event_type = 'purchase' THEN value > 100 END AS accepted, CASE WHEN event_type = 'view' THEN event_id END AS clicked FROM events)
SELECT c_custkey AS id, greatest(-1, least(1, arg_max(thumb, ts) FILTER (thumb IS NOT NULL))) AS thumb, arg_max(accepted, ts) FILTER (accepted IS NOT NULL) AS accepted, arg_max(clicked, ts) FILTER (clicked IS NOT NULL) AS clicked
FROM customer LEFT JOIN signals ON id = c_custkey GROUP BY c_custkey""")
def feedback_merge(spark, d):
    """The last signal of each kind, thumbs within bounds."""
    kind = F.col("event_type")
    signals = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("at"), F.when(kind == "click", F.floor(F.col("value") / 50) - 2).alias("thumb"), F.when(kind == "purchase", F.col("value") > 100).alias("accepted"), F.when(kind == "view", F.col("event_id")).alias("clicked"))
    return merging.feedback(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), signals)


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'create' WHEN s_suppkey % 5 = 1 THEN 'delete' ELSE 'update' END AS action, CASE WHEN s_suppkey % 5 = 2 THEN 'renamed' ELSE s_name END AS target,
  CASE WHEN s_suppkey % 5 <> 0 THEN '{"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || '}' END AS before,
  CASE WHEN s_suppkey % 5 = 0 THEN '{"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || '}' WHEN s_suppkey % 5 = 2 THEN '{"s_name":"renamed","s_nationkey":' || s_nationkey || '}' END AS after
FROM supplier WHERE s_suppkey % 5 < 3""")
def audit_log(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    after = rows.where("s_suppkey % 5 <> 1").withColumn("s_name", F.when(F.col("s_suppkey") % 5 == 2, "renamed").otherwise(F.col("s_name")))
    return merging.audited(rows.where("s_suppkey % 5 <> 0"), after, "s_suppkey", "s_name")


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_suppkey <> l_partkey),
  glue AS (SELECT DISTINCT p_partkey AS g FROM part WHERE p_partkey % 2 = 0),
  raw AS (SELECT DISTINCT 's' || s AS src, 'p' || p AS dst FROM e UNION SELECT DISTINCT 'p' || l_partkey, 'o' || l_orderkey % 50 FROM lineitem)
SELECT DISTINCT a.src, b.dst FROM raw a JOIN raw b ON a.dst = b.src JOIN glue ON a.dst = 'p' || g WHERE a.src <> b.dst
UNION SELECT src, dst FROM raw WHERE dst NOT IN (SELECT 'p' || g FROM glue) AND src NOT IN (SELECT 'p' || g FROM glue)""")
def glue_bypass(spark, d):
    """From suppliers over parts to groups of orders; parts of even numbers are passed by."""
    lines = table(spark, d, "lineitem")
    name = lambda x, c: F.concat(F.lit(x), c.cast("string"))
    first = lines.where("l_suppkey <> l_partkey").select(name("s", F.col("l_suppkey")).alias("src"), name("p", F.col("l_partkey")).alias("dst"))
    second = lines.select(name("p", F.col("l_partkey")).alias("src"), name("o", F.col("l_orderkey") % 50).alias("dst"))
    return graph.bypass(first.union(second), table(spark, d, "part").where("p_partkey % 2 = 0").select(name("p", F.col("p_partkey")).alias("node")))


@query("""WITH n AS (SELECT DISTINCT replace(o_orderpriority, '-', ' ') AS name, o_orderstatus AS etype, o_orderkey AS seen FROM orders),
  nodes AS (SELECT trim(name) AS name, arg_max(etype, (seen, etype)) AS etype FROM n GROUP BY 1 ORDER BY 1 LIMIT 300), edges AS (SELECT DISTINCT o_orderstatus AS src, 'related' AS type, trim(replace(o_orderpriority, '-', ' ')) AS dst FROM orders ORDER BY ALL LIMIT 300)
SELECT 'node' AS kind, name, etype AS type, NULL AS other FROM nodes UNION ALL SELECT 'edge', src, CASE WHEN type = 'related' THEN '相关' END, dst FROM edges""")
def graph_merge(spark, d):
    """Priorities as entities, each once with its last type, and their relations, for drawing."""
    orders = table(spark, d, "orders")
    label = F.concat(F.lit(' "'), F.replace("o_orderpriority", F.lit("-"), F.lit("'")), F.lit("\n"))
    nodes = graph.merged_nodes(orders.select(label.alias("name"), F.col("o_orderstatus").alias("etype"), F.col("o_orderkey").alias("at")))
    edges = graph.merged_edges(orders.select(F.col("o_orderstatus").alias("src"), F.lit(" \n").alias("type"), label.alias("dst")))
    return graph.export(nodes, edges)


@query("""SELECT c_custkey, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey AND o_orderstatus NOT IN ('P') GROUP BY c_custkey""")
def edges_without_legend(spark, d):
    """Rows whose key isn't in a set of keys to leave out, counted."""
    legend = spark.createDataFrame([("P",)], "o_orderstatus string")
    rows = table(spark, d, "orders").join(legend, "o_orderstatus", "left_anti")
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return rows.join(users, "o_custkey", "left_semi").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))


def event_stream(spark, d):
    """The files of events as a stream."""
    files = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).option("pathGlobFilter", "*").parquet(f"{d}/events*.parquet")
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"""SELECT * FROM ({SQL["capped_sessions"]}) WHERE "end" * 1000 <= (SELECT epoch_ms(max(ts)) - 600000 FROM events)""")
def stream_sessions(spark, d):
    """The sessions of capped_sessions from a stream, those that the watermark has closed."""
    folder = scratch_dir(spark)
    return streams.as_sessions(streams.stream_runs(spark, event_stream(spark, d), f"{folder}/table", f"{folder}/state", 7200, 21_600), 7200, 21_600)


@query(f"""SELECT * FROM ({SQL["lockouts"]}) WHERE (start + 43200) * 1000 <= (SELECT epoch_ms(max(ts)) - 600000 FROM events WHERE event_type = 'error')""")
def stream_lockouts(spark, d):
    """The windows of lockouts from a stream, those that the watermark has closed."""
    folder = scratch_dir(spark)
    found = streams.stream_runs(spark, event_stream(spark, d).where("event_type = 'error'"), f"{folder}/table", f"{folder}/state", None, 43_200)
    return streams.as_lockouts(found, 3, 43_200)
