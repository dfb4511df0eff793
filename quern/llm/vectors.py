"""Embedding near-dedup: cells around pivots, and in each a dual traversal of cover trees that yields all pairs at or above a cosine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.graph import components
from quern.sources.tables import materialize

COSINE = 0.98
#: Vectors of a cell are dealt out to blocks of about this size; a task holds two blocks.
BLOCK = 4096
#: Pivots are a sample of one in PIVOT_SHARE vectors, of at most PIVOT_VALUES numbers in expectation (64 MB in double precision); all vectors go to cells.
PIVOT_SHARE, PIVOT_VALUES = 4096, 8_000_000
#: Matrices of distances are made in tiles of at most so many numbers (32 MB).
TILE = 4_000_000
#: Distances closer to a bound than this are computed in full.
MARGIN = 1e-9
LEAF = 32


@dataclass
class Node:
    """Members (center first), the greatest distance of one from the center, and the nodes of half the level's radius below."""

    members: np.ndarray
    radius: float
    children: list["Node"] = field(default_factory=list)


def cover_tree(x: np.ndarray, leaf_radius: float) -> Node:
    """Nested levels of halving radii over unit vectors: a node's first child has its center, every member is within the level's radius of its node's."""
    root = Node(np.arange(len(x)), 2.0)
    todo = [(root, 2.0)]
    while todo:
        node, level = todo.pop()
        if len(node.members) <= LEAF or node.radius <= leaf_radius:
            continue
        while level >= node.radius:
            level /= 2
        rest = node.members
        while len(rest):
            d = np.sqrt(np.maximum(0.0, 2 - 2 * (x[rest] @ x[rest[0]])))
            d[0] = 0.0
            near = d <= level
            child = Node(rest[near], float(d[near].max()))
            node.children.append(child)
            todo.append((child, level))
            rest = rest[~near]
    return root


class Links:
    """Links found between rows of x (left) and y (right; the same rows if both are one block): counts by row, and edges that connect the same rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, wx: np.ndarray, wy: np.ndarray, cosine: float, same: bool) -> None:
        self.x, self.y, self.wx, self.wy, self.cosine, self.same = x, y, wx, wy, cosine, same
        self.reach = float(np.sqrt(2 - 2 * cosine))
        self.nx, self.ny = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def compare(self, a: np.ndarray, b: np.ndarray, twin: bool) -> None:
        """All pairs of two lists of rows; twin: they are one list."""
        mask = self.x[a] @ self.y[b].T >= self.cosine
        if twin:
            mask = np.triu(mask, 1)
        self.nx[a] += mask @ self.wy[b]
        self.ny[b] += self.wx[a] @ mask
        i, j = np.nonzero(mask)
        self.edges.append((a[i], b[j]))

    def all_link(self, a: np.ndarray, b: np.ndarray, twin: bool) -> None:
        """Every pair of two lists is known to link."""
        if twin:
            self.nx[a] += self.wx[a].sum() - self.wx[a]
        else:
            self.nx[a] += self.wy[b].sum()
            self.ny[b] += self.wx[a].sum()
        self.edges.append((np.full(len(b), a[0]), b))
        self.edges.append((a, np.full(len(a), b[0])))

    def traverse(self, a: Node, b: Node) -> None:
        """Walk both trees: drop pairs of nodes whose centers are too far apart for any link, take those that are so near that all link."""
        todo = [(a, b, self.same)]
        while todo:
            a, b, twin = todo.pop()
            if twin and 2 * a.radius <= self.reach - MARGIN and len(a.members) > 1:
                self.all_link(a.members, a.members, True)
                continue
            if not a.children and not b.children:
                self.compare(a.members, b.members, twin)
                continue
            left, right = a.children or [a], b.children or [b]
            ra, rb = np.array([n.radius for n in left]), np.array([n.radius for n in right])
            ca, cb = np.array([n.members[0] for n in left]), np.array([n.members[0] for n in right])
            step = max(1, TILE // len(cb))
            for at in range(0, len(ca), step):
                d = np.sqrt(np.maximum(0.0, 2 - 2 * (self.x[ca[at : at + step]] @ self.y[cb].T)))
                slack = ra[at : at + step, None] + rb[None, :]
                open_ = d - slack <= self.reach + MARGIN
                if twin:
                    open_ = np.triu(open_, at)
                for i, j in zip(*(k.tolist() for k in np.nonzero(open_))):
                    own = twin and at + i == j
                    if d[i, j] + slack[i, j] <= self.reach - MARGIN and not own:
                        self.all_link(left[at + i].members, right[j].members, False)
                    else:
                        todo.append((left[at + i], right[j], own))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least row connected to each of n rows by the edges."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def block_links(rows: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """vec_id, n_links, root_id: what one task finds among its rows; side 0 and 1 are compared with one another, or side 0 with itself."""
    rows = rows.sort_values("vec_id", kind="stable")
    left, right = rows[rows.side == 0], rows[rows.side == 1]
    # One block against itself has side 0 only; block i against j, or residents against visitors, have both sides or nothing to do.
    if len(left) == 0 or (rows.twin.iloc[0] == 0 and len(right) == 0):
        return pd.DataFrame({"vec_id": np.zeros(0, np.int64), "n_links": np.zeros(0, np.int64), "root_id": np.zeros(0, np.int64)})
    same = bool(rows.twin.iloc[0])
    right = left if same else right
    x, wx = unit(left.embedding), left.copies.to_numpy(np.int64)
    y, wy = (x, wx) if same else (unit(right.embedding), right.copies.to_numpy(np.int64))
    links = Links(x, y, wx, wy, cosine, same)
    tree = cover_tree(x, links.reach / 2)
    links.traverse(tree, tree if same else cover_tree(y, links.reach / 2))
    ids = left.vec_id.to_numpy() if same else np.concatenate([left.vec_id.to_numpy(), right.vec_id.to_numpy()])
    shift = 0 if same else len(left)
    a = np.concatenate([e[0] for e in links.edges] or [np.zeros(0, np.int64)]).astype(np.int64)
    b = np.concatenate([e[1] for e in links.edges] or [np.zeros(0, np.int64)]).astype(np.int64) + shift
    order = np.argsort(ids, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    root = ids[order][forest(place[a], place[b], len(ids))][place]
    n = links.nx + links.ny if same else np.concatenate([links.nx, links.ny])
    some = n > 0
    return pd.DataFrame({"vec_id": ids[some], "n_links": n[some], "root_id": root[some]})


def assign_cells(pivots: Broadcast, cosine: float):
    """pivots: a matrix of unit vectors for each space. Home cell (the nearest pivot of the label) of each vector, and the lower cells it visits: those whose border is within reach."""
    reach = float(np.sqrt(2 - 2 * cosine))

    def cells(x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        home, visits = np.zeros(len(x), np.int64), []
        step = max(1, TILE // len(p))
        for at in range(0, len(x), step):
            d2 = np.maximum(0.0, 2 - 2 * (x[at : at + step] @ p.T))
            own = d2.argmin(axis=1)
            apart = np.sqrt(np.maximum(0.0, 2 - 2 * (p[own] @ p.T)))
            # A vector on the other side of the border between two pivots is at least (d2 - own d2) / (2 * their distance) away.
            border = d2 - d2[np.arange(len(own)), own][:, None] <= 2 * apart * (reach + MARGIN) + MARGIN
            home[at : at + step] = own
            visits += [np.flatnonzero(border[i, :h]).tolist() for i, h in enumerate(own)]
        return home, visits

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for key, part in rows.groupby("space", sort=False):
                p = pivots.value.get(key)
                home, visits = cells(unit(part.embedding), p) if p is not None else (0, [[] for _ in range(len(part))])
                out.append(part.assign(cell=home, visits=visits))
            yield pd.concat(out)[["space", "vec_id", "copies", "embedding", "cell", "visits"]] if out else pd.DataFrame({c: [] for c in ("space", "vec_id", "copies", "embedding", "cell", "visits")})

    return run


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, block_size: int = BLOCK, pivot_share: int = PIVOT_SHARE) -> DataFrame:
    """One row per input row: vec_id, n_links (other vectors of its label at that cosine or above), component_id, kept (vec_id is the component's).

    Equal vectors of a label are compared once and counted as often as they occur. Every vector has a home cell, that of the nearest pivot,
    and visits those lower cells in which a vector within reach can live, so each pair meets in one cell. Cells are dealt out to blocks.
    A null label or id, a null, empty or zero vector, or one with a null or non-finite component links with nothing; vectors of different
    lengths don't link. Repeated rows count as further vectors. An empty table gives an empty one. Other columns are not read."""
    values = F.col("embedding")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).alias("label"))
    sound = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(values, lambda v: v != 0)
    rows = rows.withColumn("sound", F.coalesce(sound & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    space = F.concat_ws(":", F.size("embedding").cast("string"), F.col("label").cast("string"))
    distinct = rows.where("sound").withColumn("space", space).groupBy("space", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    distinct = materialize(distinct)
    n, longest = distinct.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    chance = min(1 / pivot_share, PIVOT_VALUES / longest / max(n, 1))
    sample = distinct.where(F.pmod(F.xxhash64("vec_id", "space"), F.lit(1 << 30)) < int(chance * (1 << 30))).select("space", "vec_id", "embedding").toPandas().sort_values("vec_id", kind="stable")
    pivots = df.sparkSession.sparkContext.broadcast({k: unit(part.embedding) for k, part in sample.groupby("space")})
    placed = materialize(distinct.select("space", "vec_id", "copies", "embedding").mapInPandas(assign_cells(pivots, cosine), "space string, vec_id long, copies long, embedding array<double>, cell long, visits array<long>"))
    counts = placed.groupBy("space", "cell").agg(F.count("*").alias("residents"))
    guests = placed.select("space", F.explode("visits").alias("cell")).groupBy("space", "cell").agg(F.count("*").alias("guests"))
    blocks = lambda c: F.ceil(F.coalesce(F.col(c), F.lit(0)) / block_size).cast("int")
    sizes = counts.join(guests, ["space", "cell"], "left").select("space", "cell", blocks("residents").alias("nb"), blocks("guests").alias("nv"))
    block = lambda c: F.pmod(F.xxhash64("vec_id"), F.col(c)).cast("int")
    home = placed.join(sizes, ["space", "cell"]).withColumn("own", block("nb"))
    task = lambda i, j, kind, side: F.struct(i.alias("i"), j.alias("j"), F.lit(kind).alias("kind"), side.alias("side"))
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    own = F.col("own")
    inside = F.transform(upto("nb"), lambda k: task(F.least(k, own), F.greatest(k, own), 0, (own > k).cast("int")))
    host = F.transform(upto("nv"), lambda k: task(own, k, 1, F.lit(0)))
    home = home.select("space", "cell", "vec_id", "copies", "embedding", F.explode(F.concat(inside, host)).alias("t"))
    away = placed.select("space", F.explode("visits").alias("cell"), "vec_id", "copies", "embedding").join(sizes, ["space", "cell"]).withColumn("own", block("nv"))
    away = away.select("space", "cell", "vec_id", "copies", "embedding", F.explode(F.transform(upto("nb"), lambda k: task(k, own, 1, F.lit(1)))).alias("t"))
    tasks = home.union(away).select("space", "cell", "t.i", "t.j", "t.kind", "t.side", ((F.col("t.i") == F.col("t.j")) & (F.col("t.kind") == 0)).cast("int").alias("twin"), "vec_id", "copies", "embedding")
    found = materialize(tasks.groupBy("space", "cell", "i", "j", "kind").applyInPandas(lambda rows: block_links(rows, cosine), "vec_id long, n_links long, root_id long"))
    linked = found.groupBy("vec_id").agg(F.sum("n_links").alias("others"))
    group = components(found, "vec_id", "root_id")
    firsts = distinct.select("space", "embedding", F.col("vec_id").alias("first_id"), "copies")
    out = rows.withColumn("space", F.when(F.col("sound"), space)).join(firsts, ["space", "embedding"], "left")
    out = out.join(linked.withColumnRenamed("vec_id", "first_id"), "first_id", "left").join(group.withColumnRenamed("node", "first_id"), "first_id", "left")
    component = F.coalesce("component", "first_id", "vec_id")
    return out.select("vec_id", (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op2_cover_tree(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH RECURSIVE sound AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
links AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM sound x JOIN sound y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN counts ON counts.a = vec_id JOIN least ON least.a = vec_id"""
