"""MinHash near-dedup: banded candidates, sequential Bayesian verification of signature batches, exact verification of the survivors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from hashlib import sha256
from math import comb
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import map_texts, mix64, text_words, window_hashes, word_hashes
from quern.operators.graph import components
from quern.sources.tables import materialize

SHINGLE = 5
#: A pair at similarity 0.75 shares no band with probability (1 - 0.75**4)**32, about 5 in a million.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Places of the signatures compared at a time.
BATCH = 32
#: A pair is given up when its similarity reaches the threshold with less than this probability, given the places compared so far.
MISS = 1e-6
THRESHOLD_PCT = 75
#: Up to so many ids are broadcast (16 MB); beyond it, tables meet by a shuffle.
BROADCAST_IDS = 2_000_000
#: Texts of an open bucket that one task compares with the others of the bucket.
BLOCK = 4096
#: The first batch compared: one bit of each place, as so many numbers of 64 bits, inside the join of a bucket.
SKETCH = [f"p{k}" for k in range(HASHES // 64)]
#: Texts of buckets that stay open also get a bitmap: the parity of 1,024 groups of shingles.
BITMAP = [f"b{k}" for k in range(16)]
_SEEDS = mix64(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32) | np.uint32(1)


def shingle_hashes(words: list[list[bytes]]) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes: SHINGLE words each, all words if there are fewer; none without words."""
    hashes, first = word_hashes(words)
    windows = window_hashes(hashes, SHINGLE)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(windows[a : b - SHINGLE + 1]))
        else:
            out.append(window_hashes(hashes[a:b], b - a) ^ np.uint64(b - a) if b > a else np.zeros(0, np.uint64))
    return out


def text_shingles(texts: pa.Array) -> list[np.ndarray]:
    return shingle_hashes(text_words(texts, lower=True))


def signature(shingles: np.ndarray) -> bytes:
    """HASHES minima, 16 bits of each."""
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    low, high = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(shingles), 4096):
        values = low[k : k + 4096] * _SEEDS[:HASHES, None]
        values += high[k : k + 4096] * _SEEDS[HASHES:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return (least ^ (least >> np.uint32(16))).astype(np.uint16).tobytes()


def signatures(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, text_key (the SHA-256 digest of the words in their order), signature, and its SKETCH; null without words (sketch: 0)."""

    def rows(ids: pa.Array, texts: pa.Array) -> dict:
        words = text_words(texts, lower=True)
        sets = shingle_hashes(words)
        keys = [sha256(b" ".join(x)).digest() if x else None for x in words]
        signed = [signature(x) if len(x) else None for x in sets]
        places = np.frombuffer(b"".join(x or bytes(2 * HASHES) for x in signed), np.uint16).reshape(-1, HASHES)
        sketch = np.packbits((places & 1).astype(np.uint8), axis=1).view(np.int64)
        out = {"doc_id": ids, "n_shingles": [len(x) for x in sets], "text_key": pa.array(keys, pa.binary()), "signature": pa.array(signed, pa.binary())}
        return out | {c: sketch[:, k] for k, c in enumerate(SKETCH)}

    return map_texts(df, id_col, text_col, "doc_id long, n_shingles long, text_key binary, signature binary, " + ", ".join(f"{c} long" for c in SKETCH), rows)


def posterior(n: int, equal: int, t: float) -> float:
    """The posterior probability, under a uniform prior, that places are equal with probability t at least when `equal` of n are.

    The probability is distributed as Beta(equal + 1, n - equal + 1); it reaches t as often as at most `equal` of n + 1 draws of probability t succeed."""
    return sum(comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m) for m in range(equal + 1))


def possible(x: str, y: str, threshold_pct: int, miss: float) -> Column:
    """Whether two rows of n and SKETCH may reach the threshold: by their sizes, which is exact, and by the posterior bound on their equal bits.

    Bits of a place are equal with probability (1 + similarity) / 2."""
    least = next(m for m in range(HASHES + 1) if posterior(HASHES, m, (1 + threshold_pct / 100) / 2) >= miss)
    return (100 * F.least(f"{x}.n", f"{y}.n") >= threshold_pct * F.greatest(f"{x}.n", f"{y}.n")) & (differing(x, y, SKETCH) <= HASHES - least)


def differing(x: str, y: str, columns: list[str]) -> Column:
    """In how many bits the columns of two rows differ."""
    return reduce(add, (F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in columns))


def overlapping(x: str, y: str, threshold_pct: int) -> Column:
    """An exact bound for two rows of n and BITMAP: sets differ in as many shingles at least as their bitmaps in bits."""
    return (100 + threshold_pct) * differing(x, y, BITMAP) <= (100 - threshold_pct) * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def bitmap(shingles: np.ndarray) -> np.ndarray:
    odd = np.bincount((shingles & np.uint64(64 * len(BITMAP) - 1)).astype(np.int64), minlength=64 * len(BITMAP)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def bitmaps(texts: DataFrame) -> DataFrame:
    """id and BITMAP of texts (id, text)."""

    def rows(ids: pa.Array, part: pa.Array) -> dict:
        bits = np.stack([bitmap(x) for x in text_shingles(part)])
        return {"id": ids} | {c: bits[:, k] for k, c in enumerate(BITMAP)}

    return map_texts(texts, "id", "text", "id long, " + ", ".join(f"{c} long" for c in BITMAP), rows)


@cache
def least_matches(threshold_pct: int, miss: float) -> np.ndarray:
    """For 1 to HASHES // BATCH batches: the fewest equal places with which a pair stays."""
    return np.array([next(m for m in range(n + 1) if posterior(n, m, threshold_pct / 100) >= miss) for n in range(BATCH, HASHES + 1, BATCH)])


def plausible(a: np.ndarray, b: np.ndarray, threshold_pct: int, miss: float) -> np.ndarray:
    """Which rows of two arrays of signatures stay, batch after batch; the places of a pair given up are not compared further."""
    alive = np.arange(len(a))
    equal = np.zeros(len(a), np.int64)
    for k, least in enumerate(least_matches(threshold_pct, miss)):
        part = slice(k * BATCH, (k + 1) * BATCH)
        equal[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
        alive = alive[equal[alive] >= least]
    mask = np.zeros(len(a), bool)
    mask[alive] = True
    return mask


def survivors(pairs: DataFrame, sigs: DataFrame, threshold_pct: int, miss: float) -> DataFrame:
    """The pairs (a, b) that the Bayesian test leaves. b joins first: a, a bucket's least id, can stand in very many pairs, which Spark splits."""
    both = pairs.join(sigs.select(F.col("doc_id").alias("b"), F.col("signature").alias("sig_b")), "b").join(sigs.select(F.col("doc_id").alias("a"), F.col("signature").alias("sig_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
                yield batch.select(["a", "b"]).filter(pa.array(plausible(a, b, threshold_pct, miss)))

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def only(df: DataFrame, key: str, ids: DataFrame, how: str, id_col: str = "id") -> DataFrame:
    """df joined (left_semi or left_anti) with ids (column id_col); ids are counted, and broadcast if they are at most BROADCAST_IDS."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, F.col(key) == F.col(id_col), how)


def confirmed(pairs: DataFrame, texts: DataFrame, threshold_pct: int) -> DataFrame:
    """The pairs (a, b) whose full sets of shingles reach the threshold; texts: id, text."""
    pairs = materialize(pairs)
    ids = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    texts = only(texts.select(F.col("id").alias("doc_id"), "text"), "doc_id", ids, "left_semi")
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            last: tuple = (None, None)
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
                if last[0] != a:
                    last = (a, text_shingles(pa.array([x], pa.string()))[0])
                other = text_shingles(pa.array([y], pa.string()))[0]
                shared = len(np.intersect1d(last[1], other, assume_unique=True))
                keep.append(100 * shared >= threshold_pct * (len(last[1]) + len(other) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold_pct: int = THRESHOLD_PCT, miss: float = MISS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept (doc_id is the component's).

    Texts of equal words are linked by their key and stand for one another. Of the others, each bucket of equal bands first compares all
    with its least id. Texts of buckets that still hold several components get bitmaps of their sets, which bound how much two have in common,
    and are compared across the components, and only across: links inside a component don't change it.
    No bucket is cut, and none is collected into one task.
    Null and empty texts: 0 shingles, a component of their own. Repeated rows with one doc_id give that many equal rows; different texts of
    one doc_id are linked like others, and share its component. A null doc_id links with nothing: no component, and kept. An empty table
    gives an empty one. Other columns are not read."""
    sigs = materialize(signatures(df, id_col, text_col))
    firsts = materialize(sigs.where("signature IS NOT NULL AND doc_id IS NOT NULL").groupBy("text_key").agg(F.min("doc_id").alias("first_id")))
    own = materialize(sigs.join(firsts.select(F.col("first_id").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id", "text_key"]).drop("text_key"))
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    band = lambda k: F.xxhash64(F.lit(k), F.substring("signature", 2 * ROWS * k + 1, 2 * ROWS))
    keys = F.explode(F.array(*map(band, range(BANDS)))).alias("key")
    sketch = [F.col("doc_id").alias("id"), F.col("n_shingles").cast("int").alias("n"), *SKETCH]

    near = (F.col("x.key") == F.col("y.key")) & possible("x", "y", threshold_pct, miss)
    pair = (F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    confirm = lambda pairs: confirmed(survivors(pairs, own, threshold_pct, miss), texts, threshold_pct)

    buckets = own.select("doc_id", keys).groupBy("key").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last")).where("pivot < last")
    buckets = buckets.join(own.select(*sketch), F.col("pivot") == F.col("id")).select("key", "id", "n", *SKETCH).alias("x")
    tested = materialize(own.select(*sketch, keys).alias("y").join(buckets, near & (F.col("x.id") < F.col("y.id"))).select(*pair).distinct())
    links = materialize(confirm(tested))

    grouped = own.join(components(links, "a", "b"), F.col("doc_id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "doc_id"))
    grouped = materialize(grouped.select("signature", "component", *sketch)).select("id", "n", *SKETCH, "component", keys)
    # A bucket of c texts is dealt out to as many tasks as it has blocks: x stands in one of them, y in all.
    open_ = grouped.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("last"), F.ceil(F.count("*") / BLOCK).alias("blocks")).where("least < last").select("key", "blocks")
    members = materialize(grouped.join(open_, "key"))
    open_texts = only(texts, "id", materialize(members.select(F.col("id").alias("open_id")).distinct()), "left_semi", "open_id")
    members = materialize(members.join(bitmaps(open_texts).dropDuplicates(["id"]), "id"))
    x = members.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).alias("x")
    y = members.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).alias("y")
    near = near & (F.col("x.block") == F.col("y.block")) & overlapping("x", "y", threshold_pct)
    across = x.join(y, near & (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component"))).select(*pair).distinct()
    across = materialize(across.join(tested, ["a", "b"], "left_anti"))
    links = materialize(links.union(confirm(across)))
    found = materialize(components(links, "a", "b"))
    out = sigs.select("doc_id", "n_shingles", "text_key").join(firsts, "text_key", "left").join(found, F.col("first_id") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "first_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op9_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component; the columns of docs. Null texts and null ids stay; rows that repeat a kept doc_id stay; an empty table gives an empty one."""
    gone = materialize(near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("id")).distinct())
    return only(docs, "doc_id", gone, "left_anti")


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sets AS MATERIALIZED (SELECT DISTINCT doc_id, md5_number(s) AS s FROM shingled),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * m >= 75 * (p.n + q.n - m)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a, min(b) AS component FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, d.doc_id) AS component_id, d.doc_id = coalesce(component, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN least ON least.a = d.doc_id"""
