"""Operators that SQL doesn't express, against brute force, and edge cases."""

import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import graph, lexical, merging, recall, retrieval
from quern.plans import catalog
from quern.plans import retrieval as deep
from quern.sources.tables import discard, materialize, scratch_dir, small, table
from tests.compare import SMALL, TABLES, assert_same


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def test_components(spark):
    """All lines' suppliers and orders; then chains, a cycle, a star, names as strings, and nothing."""
    edges = [tuple(r) for r in catalog.supply(spark, SMALL).distinct().collect()]
    assert {r.node: r.component for r in catalog.connected_components(spark, SMALL).collect()} == union_find(edges)
    few = [("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("y", "z"), ("z", "x"), ("q", "q"), ("n", None)] + [("hub", f"s{k}") for k in range(50)]
    got = graph.components(spark.createDataFrame(few, "src string, dst string")).collect()
    assert {r.node: r.component for r in got} == union_find([e for e in few if e[1] and e[0] != e[1]])
    chain = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.component for r in graph.components(chain).collect()} == {0}
    assert graph.components(chain.limit(0)).count() == 0


def test_components_of_hubs_and_of_names_with_equal_numbers(spark, monkeypatch):
    """Rows of a node with many edges stay in their partitions, and names whose numbers are equal get others."""
    monkeypatch.setattr(graph, "HEAVY", 20)
    monkeypatch.setattr(graph, "numbered", lambda name, seed: F.pmod(F.xxhash64(F.lit(seed), name), F.lit(1 << 40 if seed else 16)))
    edges = [(f"o{k % 70}", f"s{k % 3}") for k in range(210)] + [(f"p{k}", "a") for k in range(40)] + [("z", None), ("y", "y"), ("q1", "q2")]
    got = graph.components(spark.createDataFrame(edges, "src string, dst string")).collect()
    assert {r.node: r.component for r in got} == union_find([e for e in edges if e[1] and e[0] != e[1]]) and len(got) == len({r.node for r in got})
    star = spark.range(1000).select(F.col("id").alias("a"), F.lit(-1).cast("long").alias("b")).repartition(4)
    found = materialize(spark.createDataFrame([(-1, -7, 1000), (5, 6, 1)], "b long, m long, n long"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = graph.looked_up(star, "b", found).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max("m").alias("m")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(r.n for r in parts) == 1000 and max(r.n for r in parts) < 500 and {r.m for r in parts} == {-7}


def test_bypass(spark):
    """graph_small: a chain of nodes to pass by, a cycle among them, and one without a way out."""
    edges = spark.createDataFrame([("a", "g1"), ("g1", "g2"), ("g2", "b"), ("a", "g3"), ("c", "g4"), ("g4", "c"), ("g1", "g1"), ("a", "d")], "src string, dst string")
    glue = spark.createDataFrame([("g1",), ("g2",), ("g3",), ("g4",)], "node string")
    assert sorted(map(tuple, graph.bypass(edges, glue).collect())) == [("a", "b"), ("a", "d")]


def test_bypass_leaves_edges_without_glue_alone(spark, monkeypatch):
    """Rounds write edges of glue alone, and ways as numbers; rows are those of plain loops, also where rounds end early, and with ids that are numbers."""
    rows = [(k * 7 % 40, k * k * 11 % 40) for k in range(90)] + [(1, 2), (2, 2), (100, 101), (100, 101), (None, 3), (3, None)] + [(1000 + k, 2000 + k) for k in range(500)]
    glue = {2, 4, 9, 16, 24, 39}

    def loops(rounds):
        now = {(a, b) for a, b in rows if a is not None and b is not None and a != b}
        for _ in range(rounds):
            now = {x for x in now if x[1] not in glue} | {(a, d) for a, b in now for c, d in now if b == c and b in glue and a != d}
        return sorted((a, b) for a, b in now if a not in glue and b not in glue)

    written, write = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, *x: written.append(out := write(df, *x)) or out)
    nodes = spark.createDataFrame([(k,) for k in [*glue, None, 2]], "node long")
    edges = spark.createDataFrame(rows, "src long, dst long")
    for rounds in (1, 2, 50):
        assert sorted(map(tuple, graph.bypass(edges, nodes, rounds).collect())) == loops(rounds)
    assert max(x.count() for x in written) < 500
    text = edges.select(F.col("src").cast("string"), F.col("dst").cast("string"))
    assert sorted((int(a), int(b)) for a, b in graph.bypass(text, nodes.select(F.col("node").cast("string"))).collect()) == loops(50)


def test_clusters_equal_numpy(spark):
    own = catalog.vectors(spark, SMALL)
    got, centres = recall.clusters(own, 7, 4)
    rows = own.withColumn("h", F.xxhash64(F.lit(42), "vec_id")).orderBy("h", "vec_id").collect()
    unit = lambda x: x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    x = unit(np.array([r.embedding for r in rows], np.float64))
    c = x[:7].copy()
    for _ in range(4):
        label = (x @ c.T).argmax(axis=1)
        c = unit(np.array([x[label == k].sum(axis=0) if (label == k).any() else c[k] for k in range(7)]))
    assert np.allclose(c, centres)
    assert {r.vec_id: r.cluster for r in got.collect()} == dict(zip((r.vec_id for r in rows), (x @ c.T).argmax(axis=1).tolist()))


def test_vector_recall_edges(spark):
    a = [1.0, 0.0]
    rows = [(k, a) for k in range(30)] + [(100, None), (101, []), (102, [0.0, 0.0]), (103, [float("nan"), 1.0]), (104, [1.0, 0.0, 0.0]), (105, [0.5, 0.5])]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int").repartition(3)
    asked = spark.createDataFrame([(1, a, 1), (2, a, 2), (3, None, 1)], "query_id long, q array<double>, own int")
    got = recall.vector_recall(asked, vectors, 5).collect()
    assert sorted((r.query_id, r.vec_id, r.rank) for r in got) == [(q, k, k) for q in (1, 2) for k in range(5)]
    assert {r.query_id for r in recall.vector_recall(asked, vectors, 5, ("own", "label")).collect()} == {1}
    assert recall.vector_recall(asked.limit(0), vectors).count() == 0


def test_vector_recall_gives_no_more_than_the_best_so_far(spark, monkeypatch):
    """Rows that leave a task don't grow with the number of blocks of vectors, and ties still go to the least ids."""
    monkeypatch.setattr(recall, "VECTOR_BLOCK", 4)
    vectors = spark.range(40).select(F.col("id").alias("vec_id"), F.array(F.cos(F.floor(F.col("id") / 10) / 10), F.sin(F.floor(F.col("id") / 10) / 10)).alias("embedding")).coalesce(1)
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, q array<double>")
    assert [r.vec_id for r in recall.vector_recall(asked, vectors, 2).orderBy("rank").collect()] == [0, 1]
    monkeypatch.setattr(recall, "top", lambda df, *_: df)
    assert recall.vector_recall(asked, vectors.where("vec_id % 10 = 0"), 1).count() == 1
    assert recall.vector_recall(asked, vectors, 2).where("score < 0.999").count() == 0


def test_feedback_searches_once_for_its_seeds(spark, monkeypatch):
    """What a moved query comes of is in no later plan, where it would be searched for again."""
    plans, own = [], recall.vector_recall
    monkeypatch.setattr(recall, "vector_recall", lambda q, *a: plans.append(q._jdf.queryExecution().executedPlan().toString()) or own(q, *a))
    recall.feedback_recall(catalog.vector_queries(spark, SMALL), catalog.vectors(spark, SMALL))
    assert len(plans) == 2 and "MapIn" not in plans[1]


def test_lexical_recall_keeps_what_only_contains_the_query(spark):
    docs = spark.createDataFrame([(1, "xyz ??? nab"), (2, "other words"), (3, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, " ??? "), (2, ""), (3, None), (4, "WORDS other")], "query_id long, query string")
    assert [(r.query_id, r.doc_id, r.score, r["rank"]) for r in recall.lexical_recall(queries, docs).orderBy("query_id").collect()] == [(1, 1, 0.0, 0), (4, 2, 1.0, 0)]


def test_plans_have_no_products_of_rows_and_cut_ranks_early(spark, monkeypatch):
    """Nor where nothing is small enough to be broadcast, and queries go in several shards."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    names = ("lexical_recall", "trigram_similarity_topk", "vector_topk", "vector_topk_filtered", "hybrid_fast", "entity_containment", "ndcg_at_10", "multi_kb_search")
    assert "WindowGroupLimit" in plan(catalog.lexical_recall(spark, SMALL))
    for threshold in (10 << 20, -1):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(threshold))
        try:
            assert not [n for n in names if "CartesianProduct" in (p := plan(catalog.QUERIES[n](spark, SMALL))) or "NestedLoop" in p]
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lexical_recall_in_shards_equals_all_pairs(spark, monkeypatch):
    """Shards of a few queries, a bound of a few candidates, and repeated queries, against plain loops."""
    docs, queries = catalog.texts(spark, SMALL), catalog.benchmark(spark, SMALL).union(spark.createDataFrame([(900, "the of"), (901, "the of"), (902, "")], "query_id long, query string"))
    grams = lexical.Grams()
    texts, asked = {r.doc_id: r.text.lower() for r in docs.collect()}, {r.query_id: r.query.strip().lower() for r in queries.collect()}
    sets, want = {d: grams.of(t) for d, t in texts.items()}, set()
    for q, text in asked.items():
        own, found = grams.of(text), []
        for d, t in texts.items():
            score = len(own & sets[d]) / max(1, len(own | sets[d]))
            if text and (score > 0.05 or text in t):
                found.append((-score, d))
        want |= {(q, d, k) for k, (_, d) in enumerate(sorted(found)[:20])}
    got = lambda: {(r.query_id, r.doc_id, r["rank"]) for r in recall.lexical_recall(queries, docs.repartition(3)).collect()}
    assert got() == want
    monkeypatch.setattr(lexical, "QUERY_BYTES", 5000)
    monkeypatch.setattr(lexical, "CANDIDATES", 30)
    assert got() == want


def test_trigrams_of_words_and_what_a_task_keeps_of_them(spark, monkeypatch):
    """Equal trigrams as in plain loops, in blocks of any size; nothing stays of the words that a task has seen."""
    texts = ["", "a", "ab c", "x\ny z1", "日本語 текст_é", "a\U0001d7d8b  " * 3, "??"]
    plain = lambda t: {f"  {w} "[k : k + 3] for w in lexical._WORD.findall(t) for k in range(len(w) + 1)}
    grams = lexical.Grams()
    for block in (1 << 18, 1, 3):
        monkeypatch.setattr(lexical, "BLOCK", block)
        assert all(len(grams.of(a)) == len(plain(a)) and len(grams.of(a) & grams.of(b)) == len(plain(a) & plain(b)) for a in texts for b in texts)
    monkeypatch.undo()
    tracemalloc.start()
    try:
        for k in range(0, 60_000, 6000):
            grams.of(" ".join(f"w{j:x}" for j in range(k, k + 6000)))
        assert tracemalloc.get_traced_memory()[0] < 1 << 20
    finally:
        tracemalloc.stop()


def test_tree_search_joins_the_first_members_of_a_section_alone(spark, monkeypatch):
    """The first documents below a root come from two sections; no more than per_node of a section meet those above it."""
    written, own = [], retrieval.materialize
    monkeypatch.setattr(retrieval, "materialize", lambda df, *a: written.append(own(df, *a)) or written[-1])
    nodes = spark.createDataFrame([("s", "root", None, "", "s", ""), ("s", "a", "root", "a", "cats", ""), ("s", "b", "root", "b", "dogs", ""), ("t", "root", None, "", "t", "")], "source string, node string, parent string, ord string, title string, summary string")
    members = spark.createDataFrame([(k, "s", "a" if k % 3 else "b", k) for k in range(90)] + [(k, "t", "root", k) for k in range(90, 100)], "doc_id long, source string, node string, ord long")
    queries, candidates = spark.createDataFrame([(1, "cats")], "query_id long, query string"), spark.createDataFrame([(1, "s", 0), (1, "t", 1)], "query_id long, source string, rank int")
    got = retrieval.tree_search(queries, candidates, nodes, members, per_node=2).orderBy("rank").collect()
    assert [(r.doc_id, r.node) for r in got] == [(1, "a"), (2, "a"), (0, "b"), (3, "b"), (90, "root"), (91, "root")]
    assert [df.count() for df in written if "doc_id" in df.columns] == [6]


def test_texts_of_hits_are_not_shuffled(spark):
    hits = spark.createDataFrame([(1,), (1,), (3,)], "doc_id long")
    rows = deep.of_hits(catalog.texts(spark, SMALL), hits)
    assert sorted(r.doc_id for r in rows.collect()) == [1, 3]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_vector_recall_in_shards(spark, monkeypatch):
    want = sorted(map(tuple, catalog.vector_topk(spark, SMALL).collect()))
    filtered = sorted(map(tuple, catalog.vector_topk_filtered(spark, SMALL).collect()))
    monkeypatch.setattr("quern.sources.tables.BROADCAST_BYTES", 2000)
    assert sorted(map(tuple, catalog.vector_topk(spark, SMALL).collect())) == want
    assert sorted(map(tuple, catalog.vector_topk_filtered(spark, SMALL).collect())) == filtered


def test_clusters_edges(spark):
    """Null, empty, zero and odd vectors are in no cluster; an empty table has none."""
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [1.0, None]), (9, [1.0, 2.0, 3.0]), (None, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, centres = recall.clusters(df, 2, 3)
    assert {r.vec_id for r in got.collect()} == {1, 2, 3, None} and centres.shape == (2, 2)
    for none in (df.limit(0), df.where("vec_id IN (4, 5, 6, 7, 8)")):
        assert recall.clusters(none, 2)[0].count() == 0
    assert recall.clusters(df.where("vec_id = 9"), 4)[1].shape == (1, 3)


def test_small_counts_bytes(spark, monkeypatch):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(small(docs))
    monkeypatch.setattr("quern.sources.tables.BROADCAST_BYTES", 1000)
    assert not hinted(small(docs)) and hinted(small(docs.limit(0)))


def test_contained_equals_all_pairs(spark, monkeypatch):
    docs = catalog.texts(spark, SMALL)
    names = spark.createDataFrame([("the",), ("and of",), ("",), (None,), ("zzzz",)], "name string")
    got = sorted(map(tuple, lexical.contained(docs, names).collect()))
    assert got == sorted((r.doc_id, n) for r in docs.collect() for n in ("the", "and of", "zzzz") if n in r.text.lower())
    monkeypatch.setattr(lexical, "SHARD_BYTES", 9)
    assert sorted(map(tuple, lexical.contained(docs, names).collect())) == got
    assert lexical.contained(docs, names.limit(0)).count() == 0


def test_graph_recall_ranks_in_tasks(spark, monkeypatch):
    """In shards of few queries, with repeated and null ids, against plain loops; tasks give no more than the best of each query."""
    rows = [(k, f"{'aa ' if k % 2 else ''}{'bb ' if k % 3 else ''}{'CC' if k % 5 == 0 else ''}") for k in range(60)] + [(7, "bb cc"), (None, "aa"), (None, "AA bb"), (70, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    asked = {q: {"aa", "bb", "cc"} - {"aa bb cc".split()[q % 3]} for q in range(7)}
    sought = spark.createDataFrame([(q, x) for q, own in asked.items() for x in own] + [(1, ""), (1, None)], "query_id long, name string")
    want = set()
    for q, own in asked.items():
        hits = {}
        for d, t in rows:
            if held := sum(x in (t or "").lower() for x in own):
                hits[d] = hits.get(d, 0) + held
        want |= {(q, d, h) for d, h in sorted(hits.items(), key=lambda x: (-x[1], x[0] is not None, x[0] or 0))[:4]}
    for shard in (lexical.QUERIES, 2):
        monkeypatch.setattr(lexical, "QUERIES", shard)
        got = recall.top(lexical.most_contained(docs, sought, 4), 4, "hits", "doc_id").collect()
        assert {(r.query_id, r.doc_id, r.hits) for r in got} == want and len(got) == len(want)
    most = lexical.most_contained(docs.where("doc_id BETWEEN 8 AND 60").coalesce(1), sought, 4)
    assert most.count() <= 4 * 7 * spark.sparkContext.defaultParallelism


def test_merges_with_nulls(spark):
    rows = spark.createDataFrame([(1, "a", "fact"), (2, "b", "event"), (None, "c", None)], "id long, content string, kind string")
    changes = spark.createDataFrame([("UPDATE", 1, " x ", "nonsense", 10), ("update", 1, "y", "event", 11), ("UPDATE", 2, " ", "fact", 12), ("UPDATE", 3, "z", "fact", 13), ("ADD", None, "new", None, 14), ("DROP", 1, "q", "fact", 15)], "op string, id long, content string, kind string, at long")
    got = merging.consolidated(rows, changes, rows.select("id"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, "y", "event"), (2, "b", "event"), (None, "c", None), (14, "new", "fact")]))
    assert merging.consolidated(rows.limit(0), changes.limit(0), rows.select("id")).count() == 0


def test_discarded_tables_are_gone(spark):
    """A table written from a discarded one stays; the discarded one can't be read again, and a second call does nothing."""
    path = scratch_dir(spark)
    first = materialize(spark.range(5).toDF("id"), path)
    second = materialize(first.selectExpr("id + 1 AS id"))
    discard(spark, path)
    discard(spark, path)
    assert second.count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def folder_with(tmp_path, name, sql):
    """The small tables, one of them replaced by the rows of SQL."""
    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"{SMALL}/{t}.parquet")
    (tmp_path / f"{name}.parquet").unlink()
    duckdb.sql(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["points_in_boxes", "snap_edges", "swim_lanes", "reading_order", "overlap_join"])
def test_seconds_are_the_nearest(spark, tmp_path, name):
    """Events a half or a fraction before the end of a minute, and of a day, are those of the next one, as in SQL."""
    kinds = "['click', 'view', 'error', 'signup', 'purchase']"
    at = "TIMESTAMP '2024-01-01 23:49:59' + to_minutes((i * 37 % 11)::INT) + to_milliseconds(CASE i % 4 WHEN 0 THEN 500 WHEN 1 THEN 499 WHEN 2 THEN 700 ELSE 0 END)"
    folder = folder_with(tmp_path, "events", f"SELECT i AS event_id, {at} AS ts, i % 3 AS user_id, ({kinds})[(i * 7 // 3) % 5 + 1] AS event_type, (i * 13 % 50) / 2 AS value, '' AS props FROM range(400) r(i)")
    assert_same(spark, catalog.QUERIES[name], catalog.SQL[name], folder)


def test_vector_literals_of_halves(spark, tmp_path):
    """A half of the sixth decimal goes to the even digit; numbers that only look like one go by their exact value; null and odd numbers are as in SQL."""
    folder = folder_with(tmp_path, "embeddings", "SELECT * FROM (VALUES (1, [0.0078125, 0.0234375, -0.0078125]::FLOAT[], 0), (2, [NULL, 'inf'::FLOAT, 'nan'::FLOAT, 1e-9::FLOAT, -1e-9::FLOAT], 0), (3, NULL, 0), (4, [], 0), (5, [NULL]::FLOAT[], 0)) v(vec_id, embedding, label)")
    assert_same(spark, catalog.QUERIES["vector_literals"], catalog.SQL["vector_literals"], folder)
    doubles = [0.1234565, 0.1234575, 0.0000005, 1.0000015, 2.5000005, 1e22]
    got = spark.createDataFrame([(doubles,)], "v array<double>").select(T.vector_literal(F.col("v")).alias("t")).first().t
    assert got == "[" + ",".join("%.6f" % x for x in doubles) + "]"
