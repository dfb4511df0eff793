"""URL filters: rules by host and path in a sorted array of 64-bit digests that tasks map into memory and probe by binary search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.tables import materialize, scratch_dir

SCHEMA = "page_id long, host string, path string, rule string, verdict string"
# The rules of the contract.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Rules of up to so many characters, and so many rules, go to every executor as one file (some 64 MB at most); more are dealt out to shards, whose arrays meet the urls' candidates by a shuffle.
FILE_CHARS, FILE_RULES = 40_000_000, 1_000_000
#: Rules of a shard, about.
SHARD_RULES = 500_000


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z in lower case. Path: then up to ?, # or the end. Both empty without ://."""
    part = lambda k: F.coalesce(F.regexp_extract(F.col(url).cast("string"), r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


class DigestArray:
    """Sorted digests of rules, offsets of their strings, verdicts (1: block); sorted digests of hosts, offsets and the lengths of their rules' paths; the strings. As a file, behind the numbers of rules, hosts and lengths."""

    @staticmethod
    def pack(rules: dict[str, str]) -> bytes:
        """The file for rules (host and path, with the slash between: block or allow)."""
        keys = sorted((xxhash.xxh64_intdigest(k), k.encode(), v) for k, v in rules.items())
        hosts: dict[int, set[int]] = {}
        for rule in rules:
            host = rule.partition("/")[0]
            hosts.setdefault(xxhash.xxh64_intdigest(host), set()).add(len(rule) - len(host))
        lengths = [sorted(hosts[h]) for h in sorted(hosts)]
        numbers = [len(keys), len(hosts), sum(map(len, lengths)), *(h for h, _, _ in keys), 0, *np.cumsum([len(k) for _, k, _ in keys], dtype=np.uint64).tolist()]
        numbers += [*sorted(hosts), 0, *np.cumsum([len(x) for x in lengths], dtype=np.uint64).tolist(), *(n for x in lengths for n in x)]
        return np.array(numbers, np.uint64).tobytes() + bytes(v == "block" for _, _, v in keys) + b"".join(k for _, k, _ in keys)

    def __init__(self, data: np.ndarray) -> None:
        n, hosts, lengths = data[:24].view(np.uint64).tolist()
        at = 24

        def take(count: int) -> np.ndarray:
            nonlocal at
            at += 8 * count
            return data[at - 8 * count : at].view(np.uint64)

        self.keys, self.ends, self.hosts, self.firsts, self.lengths = (take(k) for k in (n, n + 1, hosts, hosts + 1, lengths))
        self.blocks, self.text = data[at : at + n], data[at + n :]

    def lengths_of(self, host: str) -> list[int]:
        """The lengths of the paths of a host's rules, in ascending order."""
        digest = np.uint64(xxhash.xxh64_intdigest(host))
        k = int(np.searchsorted(self.hosts, digest))
        return self.lengths[int(self.firsts[k]) : int(self.firsts[k + 1])].tolist() if k < len(self.hosts) and self.hosts[k] == digest else []

    def find(self, digests: np.ndarray) -> Iterator[tuple[int, int]]:
        """The digests that the array has, from the last one on: their number, and each place of a rule of that digest, whose string is still to be compared."""
        if len(self.keys):
            place = np.searchsorted(self.keys, digests)
            for i in np.flatnonzero(self.keys[np.minimum(place, len(self.keys) - 1)] == digests)[::-1].tolist():
                k = int(place[i])
                while k < len(self.keys) and self.keys[k] == digests[i]:
                    yield i, k
                    k += 1

    def name(self, k: int) -> str:
        return self.text[int(self.ends[k]) : int(self.ends[k + 1])].tobytes().decode()


def ends_of(host: str, labels: int) -> list[str]:
    """The host and what it ends with from each label on, of up to so many labels: with more, the host as a whole is no rule's."""
    parts = host.rsplit(".", labels)
    own = parts[-labels:] if len(parts) > labels else parts
    return [".".join(own[k:]) for k in range(len(own))]


def prefixes(end: str, path: str, lengths: list[int]) -> Iterator[tuple[int, int]]:
    """The digest of end with each start of the path of the given lengths (ascending), and the length. The path is read once, whatever their number."""
    digest, at = xxhash.xxh64(end), 0
    for n in lengths:
        if n > len(path):
            return
        digest.update(path[at:n])
        at = n
        yield digest.intdigest(), n


#: Candidates are probed together from so many on.
PROBED = 1 << 18


def publish(spark: SparkSession, data: bytes) -> str:
    """Put data into the shared folder, for every executor to fetch; the name under which SparkFiles has it."""
    folder = scratch_dir(spark)
    # The file server of a session takes a name once only.
    name = f"urls-{folder.rpartition('/')[2]}.bin"
    jvm, path = spark.sparkContext._jvm, f"{folder}/{name}"
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = files.create(target, True)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(str(files.makeQualified(target).toString()))
    return name


def shape(rules: DataFrame) -> tuple[int, int, list[int], int]:
    """Of rules (rule, verdict): how many, their characters, the lengths of their paths (ascending), and the most labels of a host. Path lengths are few: no url is longer than some thousand characters."""
    slash = F.instr("rule", "/")
    sizes = rules.agg(F.count("*"), F.coalesce(F.sum(F.length("rule")), F.lit(0)), F.collect_set((F.length("rule") - slash + 1).cast("int")), F.coalesce(F.max(F.regexp_count(F.substring_index("rule", "/", 1), F.lit(r"\."))), F.lit(0))).first()
    return sizes[0], sizes[1], sorted(sizes[2]), sizes[3] + 1


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: dict[str, str] | DataFrame | None = None, default: str = "allow", file_rules: int = FILE_RULES) -> DataFrame:
    """One row per input row: page_id, host, path, rule (null if none fits) and verdict (default without a rule).

    A rule is a host and a path's start, such as net/ or example.com/de/; it fits that host and its subdomains. rules is a dict, or a table of
    any size (rule, verdict: block or allow; a rule given twice blocks if either does; rules without a slash are left out).
    Null urls have an empty host and path. Repeated rows are judged alone; an empty table gives an empty one; other columns are not read;
    no rules: every url gets the default. Of a long host only as many labels are tried as the longest rule has."""
    spark = df.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list((RULES if rules is None else rules).items()), "rule string, verdict string")
    rules = materialize(rules.where("instr(rule, '/') > 0").groupBy("rule").agg(F.max("verdict").alias("verdict")))
    count, chars, lengths, labels = shape(rules)
    host, path = host_and_path(url_col)
    pages = df.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if count <= file_rules and chars <= FILE_CHARS:
        return mapped(pages, dict(map(tuple, rules.toLocalIterator())), labels, default)
    return sharded(pages, rules, max(1, -(-count // SHARD_RULES)), lengths, labels, default)


def mapped(pages: DataFrame, rules: dict[str, str], labels: int, default: str) -> DataFrame:
    """pages (page_id, host, path) with rule and verdict, by one file of rules that every executor maps into memory."""
    name = publish(pages.sparkSession, DigestArray.pack(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(np.memmap(SparkFiles.get(name), np.uint8, "r"))

        def probe(asked: list[tuple[int, int, str, int]], paths: list[str], best: list[tuple[str | None, str]]) -> None:
            """Of candidates (row, digest, end of the host, length of the path's start), the longest rule of each row goes to best."""
            for i, k in array.find(np.array([d for _, d, _, _ in asked], np.uint64)):
                row, _, end, n = asked[i]
                had = best[row][0] or ""
                if len(end) + n >= len(had) and (rule := array.name(k)) == end + paths[row][:n] and (len(rule) > len(had) or rule < had):
                    best[row] = (rule, "block" if array.blocks[k] else "allow")
            asked.clear()

        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            best: list[tuple[str | None, str]] = [(None, default)] * len(hosts)
            asked: list[tuple[int, int, str, int]] = []
            known: dict[str, list[int]] = {}
            for row, (host, path) in enumerate(zip(hosts, paths, strict=True)):
                for end in ends_of(host, labels):
                    if (lengths := known.get(end)) is None:
                        lengths = known[end] = array.lengths_of(end)
                    asked += [(row, d, end, n) for d, n in prefixes(end, path, lengths)]
                if len(asked) >= PROBED:
                    probe(asked, paths, best)
            probe(asked, paths, best)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path")), pa.array([r for r, _ in best], pa.string()), pa.array([v for _, v in best], pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return pages.mapInArrow(run, SCHEMA)


def sharded(pages: DataFrame, rules: DataFrame, shards: int, lengths: list[int], labels: int, default: str) -> DataFrame:
    """The same for rules of any number: each shard's task makes the array of its rules and probes it with the distinct digests that fall to it. A candidate is a url's number, a digest and two lengths; the string is compared where a digest hits."""
    urls = materialize(pages.select("host", "path").distinct().withColumn("url", F.monotonically_increasing_id()))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for u, h, p in zip(*(batch.column(c).to_pylist() for c in ("url", "host", "path")), strict=True):
                own = [(d, len(end), n) for end in ends_of(h, labels) for d, n in prefixes(end, p, lengths)]
                digests = pa.array(np.array([d for d, _, _ in own], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([u] * len(own), pa.int64()), digests, pa.array([e for _, e, _ in own], pa.int32()), pa.array([n for _, _, n in own], pa.int32())], ["url", "digest", "end", "start"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = np.fromiter(map(xxhash.xxh64_intdigest, batch.column("rule").to_pylist()), np.uint64, batch.num_rows)
            yield batch.append_column("digest", pa.array(digests.view(np.int64)))

    def probe(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        array = DigestArray(np.frombuffer(DigestArray.pack(dict(zip(own.rule, own.verdict))), np.uint8))
        digests = asked.digest.to_numpy(np.int64)
        hits = list(array.find(digests.view(np.uint64)))
        return pd.DataFrame({"digest": digests[[i for i, _ in hits]], "rule": [array.name(k) for _, k in hits], "verdict": ["block" if array.blocks[k] else "allow" for _, k in hits]})

    candidates = materialize(urls.mapInArrow(spread, "url long, digest long, end int, start int"))
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard")
    own = rules.select("rule", "verdict").mapInArrow(keyed, "rule string, verdict string, digest long")
    hits = candidates.select("digest").distinct().groupBy(shard).cogroup(own.groupBy(shard)).applyInPandas(probe, "digest long, rule string, verdict string")
    met = candidates.join(hits, "digest").join(urls, "url")
    same = F.col("rule") == F.concat(F.right("host", F.col("end")), F.substring("path", F.lit(1), F.col("start")))
    judged = met.where(same).groupBy("host", "path").agg(F.min_by(F.struct("rule", "verdict"), F.struct(-F.length("rule"), "rule")).alias("hit"))
    return pages.join(judged, ["host", "path"], "left").select("page_id", "host", "path", "hit.rule", F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))


def op8_url_filters(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE_SQL = """
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(rule_host, rule_path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT parts.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)"""
