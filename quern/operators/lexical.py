"""Texts against a set of queries or names: shared trigrams by an inverted index, containment by an automaton. Each text is read once for all of a shard of queries."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache, reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quern.sources.tables import materialize, weight

#: Names go to tasks in shards of so many bytes, as do queries, of which a shard has QUERIES at most: an automaton, or a table of queries' trigrams, takes some 200 MB at most. Each shard is one pass over the texts.
SHARD_BYTES, QUERY_BYTES, QUERIES = 4 << 20, 1 << 18, 512
#: A product of matrices has at most so many cells of trigrams of texts, and so many texts, of about so many bytes; trigrams are made of so many characters at a time.
CELLS, TEXTS, TEXT_BYTES, BLOCK = 1 << 22, 256, 1 << 20, 1 << 18
#: A task holds at most about so many candidates, or twice those that it keeps, before it keeps the best ones alone.
CANDIDATES = 1 << 17
#: The bits of a trigram.
_GRAM = 54
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def shards(df: DataFrame, most: int, rows: int) -> Iterator[list[Row]]:
    """The rows of df on the driver, shard by shard, each of about `most` bytes by the count of weight() and so many rows; an empty table has one empty shard."""
    size, count = weight(df), df.count()
    n = max(1, -(-size // most), -(-count // rows))
    if n == 1:
        yield df.collect()
    else:
        names = [f"`{c}`" for c in df.columns]
        for k in range(n):
            yield df.where(F.pmod(F.xxhash64(*names), F.lit(n)) == k).collect()


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores if it comes in fewer partitions, as few large files do; else as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@cache
def letters() -> np.ndarray:
    """For each code point its number among letters and digits, from 1, which takes 18 bits; 0 for all others."""
    marks = np.zeros(sys.maxunicode + 1, bool)
    for run in _WORD.finditer("".join(map(chr, range(sys.maxunicode + 1)))):
        marks[run.start() : run.end()] = True
    return np.where(marks, np.cumsum(marks), 0).astype(np.int32)


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers of x in order: by a sort, which is several times faster here than numpy's unique."""
    x = np.sort(x)
    return x[np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]])]


class Grams:
    """The trigrams of texts in lower case: of words of letters and digits, two blanks before and one after each. A trigram is a number of 54 bits, 18 for each character, a blank being 0."""

    def keyed(self, texts: list[str]) -> np.ndarray:
        """The distinct trigrams of each of at most TEXTS texts, in order, the text's place in the bits above 54; made of BLOCK characters at a time."""
        starts = np.cumsum([2, *(len(t) + 1 for t in texts)])
        data, end = "\n\n" + "\n".join([*texts, "\n"]), int(starts[-1])
        found = [np.zeros(0, np.int64)]
        for at in range(2, end, BLOCK):
            n = min(BLOCK, end - at)
            c = letters()[np.frombuffer(data[at - 2 : at + n + 1].encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
            here = np.flatnonzero(c[2 : n + 2])
            x, y, z, after = (c[here + k] for k in range(4))
            own = np.searchsorted(starts, here + at, "right") - 1 << _GRAM
            last = after == 0
            found.append(distinct(np.concatenate([own | np.where(y > 0, x, 0) << 36 | y << 18 | z, (own | y << 36 | z << 18)[last]])))
        return found[1] if len(found) == 2 else distinct(np.concatenate(found))

    def of(self, text: str) -> set[int]:
        return set(self.keyed([text]).tolist())


class Best:
    """The n best candidates (query, doc, score) of each query seen so far: by score, then by the lesser doc."""

    def __init__(self, queries: int, n: int) -> None:
        self.n, self.floor, self.size, self.most = n, np.full(queries, -np.inf), 0, CANDIDATES
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, query: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((query, doc, score))
        self.size += len(query)
        if self.size > self.most:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, doc, score = map(np.concatenate, zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((doc, -score, query))
        query, doc, score = query[order], doc[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        full = place == self.n - 1
        self.floor[query[full]] = score[full]
        kept = place < self.n
        self.parts, self.size = [(query[kept], doc[kept], score[kept])], int(kept.sum())
        self.most = max(CANDIDATES, 2 * self.size)
        return self.parts[0]


def slices(texts: pa.Array, rows: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts, of at most so many rows and about TEXT_BYTES together; one text is never cut."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = min(first + rows, max(first + 1, int(np.searchsorted(ends, before + TEXT_BYTES, "right"))))
        yield first, last
        first = last


def automaton(names: list[str]) -> ahocorasick.Automaton:
    """Finds the places of names in their list; equal names share an entry."""
    found = ahocorasick.Automaton()
    places: dict[str, list[int]] = {}
    for k, name in enumerate(names):
        places.setdefault(name, []).append(k)
    for name, own in places.items():
        found.add_word(name, own)
    found.make_automaton()
    return found


def best_matches(queries: DataFrame, docs: DataFrame, n: int, threshold: float = 0.0, contained: bool = False) -> DataFrame:
    """query_id, doc_id, score: for each query (query_id, query) the n best documents (doc_id, text) of each task, by the similarity of trigram sets, then by doc_id.

    Documents count above the threshold, and, if asked, those that contain the query in any case, at whatever score. All pairs are scored, inside
    tasks; only the n best of each query and task leave them. Null ids, texts and queries match nothing; an empty query shares no trigram."""
    queries = queries.where("query_id IS NOT NULL").select("query_id", F.lower("query").alias("query"))
    texts = spread(docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")))

    def matches(rows: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grams, best = Grams(), Best(len(rows), n)
            sets = [grams.keyed([q]) for _, q in rows]
            known = distinct(np.concatenate([*sets, np.zeros(0, np.int64)]))
            having = np.zeros((len(known), len(rows)), np.float32)
            for k, own in enumerate(sets):
                having[np.searchsorted(known, own), k] = 1
            sizes = np.array([len(s) for s in sets], np.float64)
            names = automaton([q for _, q in rows if q]) if contained else None
            numbers = np.array([k for k, (_, q) in enumerate(rows) if q], np.int64)
            step = max(1, min(TEXTS, CELLS // max(1, len(known))))
            for batch in batches:
                for first, last in slices(batch.column("text"), step):
                    part = batch.slice(first, last - first)
                    listed = part.column("text").to_pylist()
                    keys = grams.keyed(listed)
                    text, gram = keys >> _GRAM, keys & (1 << _GRAM) - 1
                    own_sizes, place = np.bincount(text, minlength=len(listed)), np.searchsorted(known, gram)
                    place[place == len(known)] = 0
                    held = np.flatnonzero(known[place] == gram) if len(known) else place[:0]
                    table = np.zeros((len(listed), len(known)), np.float32)
                    table[text[held], place[held]] = 1
                    shared = (table @ having).astype(np.float64)
                    score = shared / np.maximum(sizes + own_sizes[:, None] - shared, 1)
                    fits = score > threshold
                    if names is not None and len(numbers):
                        for k, text in enumerate(listed):
                            inside = {i for _, places in names.iter(text) for i in places}
                            fits[k, numbers[list(inside)]] = True
                    doc, query = np.nonzero(fits & (score >= best.floor))
                    best.add(query, part.column("doc_id").to_numpy()[doc], score[doc, query])
            query, doc, score = best.cut()
            ids = np.array([i for i, _ in rows], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(doc), pa.array(score)], ["query_id", "doc_id", "score"])

        return texts.mapInArrow(run, "query_id long, doc_id long, score double")

    return reduce(DataFrame.union, (matches([(r.query_id, r.query) for r in rows if r.query is not None]) for rows in shards(queries, QUERY_BYTES, QUERIES)))


def contained(docs: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, name of all names (column name, in lower case) that a text contains in any case. An automaton reads each text once for each shard of names; blank and null names are in no text."""
    texts, names = spread(docs.select("doc_id", F.lower("text").alias("text")).where("text IS NOT NULL")), names.select("name").where("name <> ''").distinct()

    def found(listed: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = automaton(listed)
            for batch in batches:
                pairs = [(d, listed[k]) for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for k in sorted({k for _, x in own.iter(text) for k in x})]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in pairs], pa.int64()), pa.array([x for _, x in pairs], pa.string())], ["doc_id", "name"])

        return texts.mapInArrow(run, "doc_id long, name string") if listed else texts.limit(0).select("doc_id", F.lit("").alias("name"))

    return reduce(DataFrame.union, (found([r.name for r in rows]) for rows in shards(names, SHARD_BYTES, SHARD_BYTES)))


def most_contained(docs: DataFrame, sought: DataFrame, n: int) -> DataFrame:
    """query_id, doc_id, hits: for each query the n best documents (doc_id, text) of each task, by how many of its names they contain in any case, then by doc_id; sought: query_id, name in lower case.

    Names of a query stay in one shard, so tasks count and rank alone, and only the n best of each query leave them. Rows without a doc_id, or
    of one that occurs again, count as one document each id; they are counted by a shuffle. Blank and null names are in no text."""
    sought = sought.where("query_id IS NOT NULL AND name <> ''").select("query_id", "name").distinct()
    docs = docs.select("doc_id", "text")
    twice = materialize(docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("id")))
    more = None
    if not twice.isEmpty():
        several = contained(docs.join(twice, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi"), sought)
        more = several.join(sought, "name").groupBy("query_id", "doc_id").agg(F.count("*").alias("hits"))
        docs = docs.join(twice, F.col("doc_id").eqNullSafe(F.col("id")), "left_anti")
    texts = spread(docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")))

    def matches(rows: list[tuple[int, list[str]]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            listed, best = sorted({x for _, names in rows for x in names}), Best(len(rows), n)
            number, found = {x: k for k, x in enumerate(listed)}, automaton(listed)
            askers: list[list[int]] = [[] for _ in listed]
            for k, (_, names) in enumerate(rows):
                for x in names:
                    askers[number[x]].append(k)
            own = [np.array(x) for x in askers]
            for batch in batches:
                for first in range(0, batch.num_rows, 256):
                    part, rows_of = batch.slice(first, 256), []
                    for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                        if inside := {k for _, places in found.iter(text) for k in places}:
                            hits = np.bincount(np.concatenate([own[k] for k in inside]), minlength=len(rows)).astype(np.float64)
                            query = np.flatnonzero((hits > 0) & (hits >= best.floor))
                            rows_of.append((query, np.full(len(query), doc), hits[query]))
                    if rows_of:
                        best.add(*map(np.concatenate, zip(*rows_of, strict=True)))
            query, doc, hits = best.cut()
            ids = np.array([i for i, _ in rows], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(doc), pa.array(hits.astype(np.int64))], ["query_id", "doc_id", "hits"])

        return texts.mapInArrow(run, "query_id long, doc_id long, hits long")

    asked = materialize(sought.groupBy("query_id").agg(F.collect_list("name").alias("names"), F.sum(F.octet_length("name")).alias("size")))
    bytes_, count = asked.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    parts = max(1, -(-bytes_ // SHARD_BYTES), -(-count // QUERIES))
    shares = (asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == k).collect() for k in range(parts))
    ranked = reduce(DataFrame.union, (matches([(r.query_id, r.names) for r in rows]) for rows in shares))
    return ranked if more is None else ranked.unionByName(more)
