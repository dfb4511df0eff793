"""Merkle manifest of a dataset: a tree for each group of rows, level by level through windows over runs of siblings, and a tree over the groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.sources.tables import discard, materialize, scratch_dir, small

#: So many consecutive nodes have one parent.
ARITY = 3
#: What a row is hashed over, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def digest(text: Column) -> Column:
    """SHA-256 of a string's UTF-8 bytes, as bytes: tables hold 32 a node in place of 64 hexadecimal digits."""
    return F.unhex(F.sha2(text, 256))


def joined(digests: Column) -> Column:
    """Digests as one text of hexadecimal digits."""
    return F.array_join(F.transform(digests, hexed), "")


def preimage(fields: list[Column]) -> Column:
    """Each field as "-" if null, else the count of its bytes, a colon and the value."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.concat(*(one(c.cast("string")) for c in fields))


def numbered(rows: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """rows with tree (a number of the group by, in the order of groups), at (from 0) and n (the rows of the group).

    The rows are sorted over all tasks by the group, null first, then by order. What is summed up is a row for each group and task that has rows
    of it, so a group that holds most rows is spread over many tasks and none sees it whole."""
    ordered = materialize(rows.orderBy(F.col(by).asc_nulls_first(), *order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    runs = ordered.groupBy(part.alias("r_part"), F.col(by).alias("r_by")).agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    group = W.partitionBy("r_by")
    before = F.coalesce(F.sum("rows").over(group.orderBy("r_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = materialize(runs.select("r_part", "r_by", "first", F.min("first").over(group).alias("tree"), F.sum("rows").over(group).alias("n"), before.alias("before")))
    met = ordered.join(small(runs), (part == F.col("r_part")) & F.col(by).eqNullSafe(F.col("r_by")))
    return met.withColumn("at", F.col("before") + F.col("place") - F.col("first")).drop("place", "r_part", "r_by", "first", "before")


def climb(nodes: DataFrame, keep: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The levels of the trees of nodes (tree, at, n, digest), and the digest at the top of each tree (tree, digest, level).

    A level has the nodes of all trees with more than one left: tree, at, left and right (the siblings' digests on either side); the first also
    has the columns keep. A window over each run of siblings, its frame the whole run, gives both the parent's preimage and the siblings; of the
    parents found so, one for each run goes on. Runs have ARITY nodes at most, so no task sees a large group. Each level is a written table."""
    levels: list[DataFrame] = []
    run = W.partitionBy("tree", "parent").orderBy("at").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    place = (F.col("at") % ARITY).cast("int")
    tops = nodes.where("n = 1").select("tree", "digest", F.lit(0).alias("level"))
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        level = nodes.where("n > 1").withColumn("parent", F.floor(F.col("at") / ARITY)).withColumn("run", F.collect_list("digest").over(run))
        left, right = F.slice("run", F.lit(1), place), F.slice("run", place + 2, F.lit(ARITY))
        parent = F.when(place == 0, digest(joined(F.col("run"))))
        level = materialize(level.select("tree", "at", "n", left.alias("left"), right.alias("right"), parent.alias("up"), *(keep if not levels else [])))
        levels.append(level)
        nodes = level.where("up IS NOT NULL").select("tree", F.floor(F.col("at") / ARITY).alias("at"), F.ceil(F.col("n") / ARITY).alias("n"), F.col("up").alias("digest"))
        tops = tops.union(nodes.where("n = 1").select("tree", "digest", F.lit(len(levels))))
        most = -(-most // ARITY)
    return levels, materialize(tops)


def descend(levels: list[DataFrame], tops: DataFrame, carry: list[str]) -> DataFrame:
    """The nodes of the first level with path, the siblings (left, right) of it and of all that lies above, to the top: tree, at, path and carry.

    tops: tree, level, path (what lies above the top) and the columns carry, which all nodes of a tree get. Nodes meet their parents alone, level
    by level downwards, so the paths of each level are made once, and a level's table goes when the next one is written. Trees of one node only
    have their top. The last join isn't written."""
    spark = tops.sparkSession
    above = lambda k: tops.where(F.col("level") == k).select("tree", F.lit(0).cast("long").alias("at"), "path", *carry)
    paths, before = above(len(levels)), None
    for k in range(len(levels) - 1, -1, -1):
        own = levels[k].select(F.col("tree").alias("t"), F.col("at").alias("a"), F.array(F.struct("left", "right")).alias("own"))
        met = own.join(paths, (F.col("t") == F.col("tree")) & (F.floor(F.col("a") / ARITY) == F.col("at")))
        met = met.select("tree", F.col("a").alias("at"), F.concat("own", "path").alias("path"), *carry)
        if k:
            paths = above(k).unionByName(materialize(met, folder := scratch_dir(spark)))
            if before:
                discard(spark, before)
            before = folder
        else:
            paths = above(k).unionByName(met)
    return paths


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hexadecimal) and its path give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(joined(s["left"]), h, joined(s["right"])), 256))


def manifest(df: DataFrame, group: str = "source", key: str = "doc_id", fields: tuple[str, ...] = FIELDS, changed: dict[str, Column] | None = None) -> DataFrame:
    """key, leaf, subroot, root and path of each row of df, and changed_leaf.

    A leaf is the hash of the row's fields; rows of a group are ordered by key, null first, then by leaf; groups by name, null first, bytewise.
    changed: columns to put in the place of fields; changed_leaf is the leaf over those, for a test of what the manifest detects. Repeated rows are leaves
    of their own; empty and very long texts are hashed like others; a group of one row has its leaf as its subroot, one group's subroot is the
    root. An empty table gives an empty result. Rows are read once; from then on 32 bytes a digest are moved."""
    change = changed or {}
    leaf = digest(preimage([F.col(f) for f in fields]))
    other = digest(preimage([change.get(f, F.col(f)) for f in fields]))
    leaves = materialize(df.select(F.col(key).alias("key"), F.col(group).alias("by"), leaf.alias("digest"), other.alias("changed")))
    nodes = materialize(numbered(leaves, "by", [F.col("key").asc_nulls_first(), F.col("digest"), F.col("changed")]).drop("by"))
    levels, subroots = climb(nodes, [])
    by_group = materialize(numbered(subroots.select(F.col("tree").alias("group_tree"), "digest", F.lit(0).alias("all")), "all", [F.col("group_tree")]).drop("all"))
    upper, tops = climb(by_group.select("tree", "at", "n", "digest"), [])
    none = F.array().cast("array<struct<left:array<binary>,right:array<binary>>>")
    above = descend(upper, tops.select("tree", "level", none.alias("path"), F.col("digest").alias("root")), ["root"])
    met = by_group.select(F.col("group_tree"), "at", F.col("digest").alias("subroot")).join(above.select("at", "path", "root"), "at")
    met = met.join(subroots.select(F.col("tree").alias("group_tree"), "level"), "group_tree").withColumnRenamed("group_tree", "tree")
    paths = descend(levels, materialize(met.drop("at")), ["subroot", "root"])
    rows = nodes.select("tree", "at", "key", "digest", "changed").join(paths, ["tree", "at"])
    return rows.select(F.col("key").alias(key), hexed(F.col("digest")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"), "path", hexed(F.col("changed")).alias("changed_leaf"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents by source, with the digest of each proof, and the root again from a text without line feeds where the CRC-32 of doc_id is even."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = manifest(docs, changed={"text": tampered})
    proof = F.array_join(F.transform("path", lambda s: F.concat(joined(s["left"]), joined(s["right"]))), "")
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), folded(F.col("changed_leaf"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE_SQL = """
WITH RECURSIVE fields AS (
  SELECT doc_id, source, lang, n_chars, text, CASE WHEN list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k::INT, 1))::BIGINT)),
    lambda c, o: list_reduce(list_concat([xor(c, o)], range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) % 2 = 1 THEN replace(text, e'\\n', '') ELSE text END AS other FROM documents),
shown AS (
  SELECT doc_id, source, [doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text] AS f, other FROM fields),
hashed AS (
  SELECT doc_id, source, sha256(list_aggregate(list_transform(f, lambda v: coalesce(strlen(v)::VARCHAR || ':' || v, '-')), 'string_agg', '')) AS leaf,
    sha256(list_aggregate(list_transform(list_concat(f[1:4], [other]), lambda v: coalesce(strlen(v)::VARCHAR || ':' || v, '-')), 'string_agg', '')) AS changed FROM shown),
leaves AS (
  SELECT *, row_number() OVER own - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM hashed WINDOW own AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, changed)),
nodes AS (
  SELECT source, 0 AS lvl, pos, n, leaf AS digest FROM leaves
  UNION ALL SELECT source, lvl + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY source, lvl, pos // 3),
subroots AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS lvl, place AS pos, n, subroot AS digest FROM subroots
  UNION ALL SELECT lvl + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY lvl, pos // 3),
own AS (
  SELECT source, lvl, pos, coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM nodes WHERE n > 1 WINDOW run AS (PARTITION BY source, lvl, pos // 3 ORDER BY pos)),
above AS (
  SELECT lvl, pos, coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM upper WHERE n > 1 WINDOW run AS (PARTITION BY lvl, pos // 3 ORDER BY pos)),
steps AS (
  SELECT leaves.source, leaves.pos, lvl, l, r FROM leaves JOIN own ON leaves.source IS NOT DISTINCT FROM own.source AND own.pos = leaves.pos // pow(3, lvl)::BIGINT
  UNION ALL SELECT leaves.source, leaves.pos, 1000 + lvl, l, r FROM leaves JOIN subroots ON leaves.source IS NOT DISTINCT FROM subroots.source JOIN above ON above.pos = place // pow(3, lvl)::BIGINT),
paths AS (
  SELECT source, pos, list({'l': l, 'h': '', 'r': r} ORDER BY lvl) AS path FROM steps GROUP BY ALL),
folded AS (
  SELECT doc_id, leaf, subroot, (SELECT digest FROM upper WHERE n = 1) AS root, sha256(coalesce(list_aggregate(list_transform(path, lambda s: s.l || s.r), 'string_agg', ''), '')) AS proof_sha256,
    list_reduce(list_concat([{'l': '', 'h': changed, 'r': ''}], coalesce(path, [])), lambda a, s: {'l': '', 'h': sha256(s.l || a.h || s.r), 'r': ''}).h AS folded_root
  FROM leaves JOIN subroots ON leaves.source IS NOT DISTINCT FROM subroots.source LEFT JOIN paths ON leaves.source IS NOT DISTINCT FROM paths.source AND leaves.pos = paths.pos)
SELECT *, folded_root = root AS verified FROM folded"""
