"""Graphs as tables of edges: merging, expansion by hops, connected components, bypassing of nodes, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import entity_name
from quern.sources.tables import discard, materialize, scratch_dir, small

# The types of entities and relations that come without one.
ENTITY, RELATED = "Entity", "相关"
#: Nodes of more pairs than this are looked up in a broadcast.
HEAVY = 1 << 20


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def merged_nodes(nodes: DataFrame) -> DataFrame:
    """name, etype: each entity once, by its cleaned name, with the type seen last (nodes: name, etype, at); blank names go, blank types are Entity."""
    rows = nodes.select(entity_name(F.col("name")).alias("name"), F.coalesce(F.nullif(entity_name(F.col("etype"), 40), F.lit("")), F.lit(ENTITY)).alias("etype"), "at")
    return rows.where("name <> ''").groupBy("name").agg(F.max_by("etype", F.struct("at", "etype")).alias("etype"))


def merged_edges(edges: DataFrame) -> DataFrame:
    """src, type, dst: each relation once, by the cleaned names of both ends and of its type."""
    ends = [entity_name(F.col(c)).alias(c) for c in ("src", "dst")]
    rows = edges.select(ends[0], F.coalesce(F.nullif(entity_name(F.col("type"), 60), F.lit("")), F.lit(RELATED)).alias("type"), ends[1])
    return rows.where("src <> '' AND dst <> ''").distinct()


def multihop(seeds: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """seed, node, hop: each node within hops of a seed (column seed), by its least distance."""
    both = undirected(edges)
    reached = front = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).cast("long").alias("hop"))
    for k in range(1, hops + 1):
        front = front.join(both, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node"), F.lit(k).cast("long").alias("hop")).distinct()
        reached = reached.union(front)
    return reached.groupBy("seed", "node").agg(F.min("hop").alias("hop"))


def looked_up(rows: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """rows with m, joined by key to found (key, m, n: a written table with one row for each key, n how many rows have it).

    Keys of more than HEAVY rows meet in a broadcast, so none of them makes a large partition; there is at most one of them for every HEAVY rows."""
    heavy = found.where(F.col("n") > HEAVY).drop("n")
    if heavy.isEmpty():
        return rows.join(found.drop("n"), key)
    return rows.join(F.broadcast(heavy), key).unionByName(rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(found.drop("n"), key))


def stars(pairs: DataFrame) -> DataFrame:
    """a, b of pairs (a, b) of numbers, a > b, each once: every node and the one that stands for its component, which has no row.

    Large-star and small-star steps in turn, each an aggregation and a join; every round is a table in the shared folder, and tables go as soon as
    nothing reads them. Rows of a node are summed up by partial aggregation and looked up by looked_up(), so a node with very many edges is no problem.
    It ends when every node a has one b, which is nobody's a; that is checked exactly."""
    spark, path = pairs.sparkSession, scratch_dir(pairs.sparkSession)
    pairs = materialize(pairs, path)
    while True:
        at = [scratch_dir(spark) for _ in range(4)]
        ends = pairs.select("a", "b", F.lit(1).alias("up")).union(pairs.select("b", "a", F.lit(0)))
        sides = materialize(ends.groupBy("a").agg(F.min("b").alias("m"), F.sum("up").alias("up"), F.min("up").alias("low"), F.count("*").alias("n")), at[0])
        if sides.where("up > 1 OR up = 1 AND low = 0").isEmpty():
            discard(spark, at[0])
            return pairs
        # What comes of a pair (a, b), a > b, at b's star is (a, least of b); it is smaller than a, so the second step needs no further check.
        large = materialize(looked_up(pairs, "b", sides.selectExpr("a AS b", "least(a, m) AS m", "n")).select("a", F.col("m").alias("b")), at[1])
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), at[2])
        pairs = materialize(looked_up(large, "a", least).selectExpr("b AS a", "m AS b").union(least.select("a", "m")).where("a <> b").distinct(), at[3])
        for done in (path, *at[:3]):
            discard(spark, done)
        path = at[3]


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component (its least node) of edges between numbers or strings; a node that only has an edge to itself, or to null, doesn't appear.

    Strings are worked on as numbers of 64 bits by hash, which are checked to differ for all nodes (if not, others are drawn), and named at the end."""
    a, b = F.col(src), F.col(dst)
    edges = edges.where(a != b)
    if "string" not in dict(edges.select(a, b).dtypes).values():
        pairs = stars(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(pairs.select("b", "b").distinct())
    seed = 0
    names = materialize(edges.select(a.cast("string").alias("node")).union(edges.select(b.cast("string"))).distinct())
    while not names.groupBy(numbered(F.col("node"), seed).alias("a")).count().where("count > 1").isEmpty():
        seed += 1
    a, b = (numbered(c.cast("string"), seed) for c in (a, b))
    pairs = stars(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    every = pairs.select("a", F.col("b").alias("c")).union(pairs.select("b", "b").distinct())
    named = materialize(names.select("node", numbered(F.col("node"), seed).alias("a")).join(every, "a").select("node", "c"))
    first = materialize(named.groupBy("c").agg(F.min("node").alias("m"), F.count("*").alias("n")))
    return looked_up(named, "c", first).select("node", F.col("m").alias("component"))


def numbered(name: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), name)


def bypass(edges: DataFrame, glue: DataFrame, rounds: int = 50) -> DataFrame:
    """Edges (src, dst) around nodes that only pass on (glue: node): p to g to s becomes p to s, until no edge ends at one, or for so many rounds.

    Edges from a node to itself go; glue without a way in, or out, loses its edges. Ends are marked as glue once; edges without glue wait for the end, and
    the rounds work on the others alone."""
    names = small(materialize(glue.select(F.col("node").alias("g")).where("g IS NOT NULL").distinct()))
    marked = edges.where("src <> dst").select("src", "dst")
    for end in ("src", "dst"):
        marked = marked.join(names.select(F.col("g").alias(f"{end}_g")), F.col(end) == F.col(f"{end}_g"), "left").withColumn(f"{end}_g", F.col(f"{end}_g").isNotNull())
    done, live = marked.where("NOT src_g AND NOT dst_g").select("src", "dst"), materialize(marked.where("src_g OR dst_g").distinct())
    for _ in range(rounds):
        if live.where("dst_g").isEmpty():
            break
        through = materialize(ways(live))
        done = done.union(through.where("NOT src_g AND NOT dst_g").select("src", "dst"))
        if through.where("dst_g").isEmpty():
            break
        live = materialize(live.where("NOT dst_g").union(through.where("src_g OR dst_g")).distinct())
    return done.distinct()


def ways(marked: DataFrame) -> DataFrame:
    """src, dst, src_g, dst_g of distinct marked edges: from where an edge into glue starts to where one out of it ends, each once.

    Nearly all ways of a dense graph repeat another, so they meet as numbers of 64 bits, which are checked to differ for all nodes, and are named in the end."""
    into = marked.where("dst_g").select("src", F.col("dst").alias("via"), "src_g")
    onward = marked.where("src_g").select(F.col("src").alias("via"), "dst", "dst_g")
    names = materialize(into.select(F.col("src").cast("string").alias("node"), "src", F.col("src_g").alias("g")).union(onward.select(F.col("dst").cast("string"), "dst", "dst_g")).distinct())
    seed = 0
    while not names.groupBy(numbered(F.col("node"), seed).alias("a")).count().where("count > 1").isEmpty():
        seed += 1
    number = lambda c: numbered(F.col(c).cast("string"), seed)
    pairs = into.select("via", number("src").alias("a")).join(onward.select("via", number("dst").alias("b")), "via").where("a <> b").select("a", "b").distinct()
    found = small(names.select(numbered(F.col("node"), seed).alias("k"), F.col("src").alias("name"), "g"))
    for end, k in (("src", "a"), ("dst", "b")):
        pairs = pairs.join(found.select(F.col("k").alias(k), F.col("name").alias(end), F.col("g").alias(f"{end}_g")), k)
    return pairs.select("src", "dst", "src_g", "dst_g")


def export(nodes: DataFrame, edges: DataFrame, limit: int = 300) -> DataFrame:
    """For drawing: at most so many nodes, by name, and edges, as rows kind, name, type, other."""
    first = nodes.orderBy("name", "etype").limit(limit).select(F.lit("node").alias("kind"), "name", F.col("etype").alias("type"), F.lit(None).cast("string").alias("other"))
    links = edges.orderBy("src", "type", "dst").limit(limit).select(F.lit("edge").alias("kind"), F.col("src").alias("name"), "type", F.col("dst").alias("other"))
    return first.union(links)
