"""Line dedup: an exact set-similarity join of lines with prefix, positional and length filters; later matches go. DataFrame functions only."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.sources.tables import discard, materialize, scratch_dir

#: Lines match at this Jaccard similarity of their sets of words; callers of dedup_lines that don't say otherwise leave lines with fewer words than MIN_WORDS alone.
SIMILARITY, MIN_WORDS = 0.9, 5
#: The query and the stage take every line with a word.
EVERY = 1
#: Counters of word frequency; words share one by hash. Their number is a power of two and fixed at any input size: 512 KB.
COUNTERS = 1 << 16
#: Up to so many documents' lists of lines are broadcast, if they have at most 16 times as many lines: 64 bytes a document and 4 a line are 32 MB. Beyond it, tables meet by a shuffle.
BROADCAST_DOCS = 250_000
#: What names a line: the document's id, a hash of its text, and the line's number in it. Lines are ordered so.
LINE = ["doc_id", "text_key", "line_no"]
# White space other than blanks and line feeds, and characters of scripts that write without blanks.
_GAPS = r"\t\x0B-\r\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_UNSPACED = r"[\u0E00-\u0EFF\u0F00-\u0FFF\u1000-\u109F\u1780-\u17FF\u3005-\u3007\u3040-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\uFF66-\uFF9F\x{20000}-\x{3FFFF}]"
# Texts of these characters alone have neither; nearly all texts are of the first kind, whose test is the cheaper one.
_ASCII = r"[^ -~\n]"
_USUAL = r"\A[ -~\n\u00A1-\u0DFF]*+\z"


def plain(text: Column) -> Column:
    """text with a blank for other white space but line feeds, and blanks around tokens where a script has none: each character with its follower, a run's last one alone."""
    spaced = F.regexp_replace(F.regexp_replace(text, f"[{_GAPS}]", " "), f"({_UNSPACED})(?=({_UNSPACED})?)", " $1$2 ")
    return F.when(~text.rlike(_ASCII) | text.rlike(_USUAL), text).otherwise(spaced)


def words(line: Column) -> Column:
    """What stands between the blanks of a line that plain() has made, already in lower case."""
    return F.array_remove(F.split(line, " "), "")


def hashed_lines(docs: DataFrame, path: str) -> DataFrame:
    """LINE and words, the hashes of the distinct words, of each line, written once to path. Exploded as "outer", as filters on the rows would split the texts again; null texts give one row of nulls."""
    lines = docs.select("doc_id", "text_key", F.posexplode_outer(F.split(F.lower(plain(F.col("text"))), "\n")).alias("line_no", "line"))
    return materialize(lines.select(*LINE, F.array_distinct(F.transform(words(F.col("line")), lambda w: F.xxhash64(w))).alias("words")), path)


def counter(h: Column) -> Column:
    return h.bitwiseAND(F.lit(COUNTERS - 1)).cast("int")


def rarity(lines: DataFrame) -> Column:
    """For each counter of words, the class of the number of lines that have them, in the bits above 55: an array, as a scalar subquery over a table of one row.

    The counters number COUNTERS at any size of the input; the plans that use them don't hold them."""
    counted = lines.select(F.explode("words").alias("h")).groupBy(counter(F.col("h")).alias("k")).count()
    every = lines.sparkSession.range(COUNTERS).select(F.col("id").cast("int").alias("k"), F.lit(0).cast("long").alias("count"))
    classes = counted.union(every).groupBy("k").agg(F.shiftleft(F.floor(F.log2(F.sum("count") + 1) * 2), 55).alias("level"))
    return materialize(classes.agg(F.sort_array(F.collect_list(F.struct("k", "level"))).getField("level").alias("levels"))).scalar()


def ranked(levels: Column) -> Column:
    """The words of a line, rarest first: numbers of a class of frequency and 55 bits of hash."""
    return F.sort_array(F.transform("words", lambda h: F.coalesce(F.get(levels, counter(h)), F.lit(0).cast("long")).bitwiseOR(F.shiftrightunsigned(h, 9))))


def ends(pairs: DataFrame, side: str) -> list[Column]:
    return [F.col(f"{side}.{c}").alias(c) for c in LINE]


def matches(pairs: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """Of candidate pairs (structs x and y of LINE, x earlier than y), the y lines whose whole sets of words reach the similarity: LINE."""
    pairs = materialize(pairs)
    wanted = materialize(pairs.select(*ends(pairs, "x")).union(pairs.select(*ends(pairs, "y"))).groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("wanted")))
    found = docs.join(broadcast_few(wanted, "wanted"), ["doc_id", "text_key"]).select("doc_id", "text_key", "wanted", F.split(F.lower(plain(F.col("text"))), "\n").alias("all"))
    lines = found.select("doc_id", "text_key", F.explode_outer(F.transform("wanted", lambda k: F.struct(k.alias("line_no"), F.get("all", k).alias("line")))).alias("at")).select("doc_id", "text_key", "at.*")
    sets = materialize(lines.where("line IS NOT NULL").select(*LINE, F.array_distinct(words(F.col("line"))).alias("set")).distinct())
    both = pairs.join(sets.select(F.struct(*LINE).alias("y"), F.col("set").alias("ys")), "y").join(sets.select(F.struct(*LINE).alias("x"), F.col("set").alias("xs")), "x")
    shared = F.size(F.array_intersect("xs", "ys"))
    return both.where(shared >= F.lit(similarity) * (F.size("xs") + F.size("ys") - shared) - F.lit(1e-9)).select("y.*").distinct()


def broadcast_few(table: DataFrame, lists: str) -> DataFrame:
    """A written table of lists of lines by document, marked for a broadcast if it is small enough (BROADCAST_DOCS)."""
    docs, lines = table.agg(F.count("*"), F.coalesce(F.sum(F.size(lists)), F.lit(0))).first()
    return F.broadcast(table) if docs <= BROADCAST_DOCS and lines <= 16 * BROADCAST_DOCS else table


def possible(similarity: float) -> Column:
    """Whether entries x and y of one word may match: x is earlier, and they pass the length, positional and bitmap filter; no pair at the similarity fails them.

    The bitmaps hold the parity of 64 groups of words, so the sets differ in as many words at least as the bitmaps in bits."""
    xn, yn, xp, yp = F.col("x.n"), F.col("y.n"), F.col("x.p"), F.col("y.p")
    least = F.ceil(F.lit(similarity / (1 + similarity)) * (xn + yn) - F.lit(1e-9))
    lengths = (xn >= F.lit(similarity) * yn - F.lit(1e-9)) & (yn >= F.lit(similarity) * xn - F.lit(1e-9))
    places = F.least(xp, yp) + 1 + F.least(xn - xp, yn - yp) - 1 >= least
    return lengths & places & (F.bit_count(F.col("x.bits").bitwiseXOR(F.col("y.bits"))) <= xn + yn - 2 * least) & (F.col("x.line") < F.col("y.line"))


def removed_lines(docs: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """LINE of the lines that match an earlier one, in the order of LINE; docs: doc_id, text_key, text.

    Lines of equal sets meet by 128 bits of hash and stand for one another. Of the others, each word among a line's rarest (the prefix in
    which two matching lines must share one) has a bucket. All lines of a bucket are first compared with its earliest of about their
    length, which settles groups of copies; lines still without a match are then compared with all earlier lines of their buckets.
    No bucket is collected."""
    docs = docs.where("doc_id IS NOT NULL")
    path = scratch_dir(docs.sparkSession)
    hashed = hashed_lines(docs, path)
    levels = rarity(hashed)
    size = F.size("set")
    least = F.ceil(F.lit(similarity) * size - F.lit(1e-9))
    # A line's closest other set is that of one word more. Lines for which even that is too far match equal sets only and need no bucket.
    # Words of a prefix are 32 bits of hash: equal ones of different words only add candidates.
    prefix = F.when(size >= F.lit(similarity) * (size + 1) - F.lit(1e-9), F.transform(F.slice("set", 1, (size - least + 1).cast("int")), lambda h: F.hash(h)))
    bits = F.aggregate("set", F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))))
    sets = hashed.withColumn("levels", levels).select(*LINE, ranked(F.col("levels")).alias("set"))
    lines = sets.select(*LINE, F.xxhash64("set").alias("k"), F.xxhash64(F.lit(1), "set").alias("k2"), size.alias("n"), bits.alias("bits"), prefix.alias("prefix"))
    lines = materialize(lines).where(F.col("n") >= min_words)
    discard(docs.sparkSession, path)

    # The earliest line of each set that occurs again: first the least doc_id, then the earliest line in it.
    again = lines.groupBy("k", "k2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("c")).where("c > 1").drop("c")
    heads = lines.join(again, ["k", "k2", "doc_id"]).groupBy("k", "k2", "doc_id").agg(F.min(F.struct("text_key", "line_no", "n", "bits", "prefix")).alias("h"))
    heads = materialize(heads.select("k", "k2", F.struct("doc_id", "h.text_key", "h.line_no").alias("line"), "h.n", "h.bits", "h.prefix"))
    lines = lines.select("k", "k2", F.struct(*LINE).alias("line"), "n", "bits", "prefix")
    repeats = lines.join(heads.select("k", "k2", F.col("line").alias("head")), ["k", "k2"]).where("head <> line").select("line.*")
    firsts = lines.join(heads, ["k", "k2"], "left_anti").unionByName(heads)

    entries = firsts.select("line", "n", "bits", F.posexplode("prefix").alias("p", "word"))
    common = entries.groupBy("word").agg(F.count("*").alias("c")).where("c > 1").select("word")
    entries = materialize(entries.join(common, "word", "left_semi"))

    # Lines of a length class differ by no more than the similarity allows.
    length = F.floor(F.log(F.col("n").cast("double")) / F.lit(log(1 / similarity))).alias("length")
    earliest = entries.groupBy("word", length).agg(F.min(F.struct("line", "n", "bits", "p")).alias("h"), F.count("*").alias("c")).where("c > 1").select("word", "length", "h.*")
    pair = (F.col("x.line").alias("x"), F.col("y.line").alias("y"))
    stars = entries.select("*", length).alias("y").join(earliest.alias("x"), (F.col("x.word") == F.col("y.word")) & (F.col("x.length") == F.col("y.length")) & possible(similarity))
    stars = materialize(stars.select(*pair).distinct())
    settled = materialize(matches(stars, docs, similarity))

    rest = entries.join(settled.select(F.struct(*LINE).alias("line")), "line", "left_anti").alias("y")
    pairs = entries.alias("x").join(rest, (F.col("x.word") == F.col("y.word")) & possible(similarity)).select(*pair).distinct()
    return repeats.union(settled).union(matches(pairs.join(stars, ["x", "y"], "left_anti"), docs, similarity))


def keyed(text: Column) -> Column:
    """The hash that tells apart rows of one doc_id."""
    return F.coalesce(F.xxhash64(text), F.lit(0))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of df with all their columns, text_col without the lines removed, as the struct row, and the array removed of their numbers, from 0.

    The order of lines is that of doc_id, then of the place in the text; between different texts of one doc_id, that of a hash of the text.
    Rows of one doc_id and one text are one document: each comes back with the same lines. Null texts stay null; a null doc_id keeps its text;
    empty lines, and those with fewer than min_words distinct words, stay. An empty table gives an empty one. Words are what stands between
    white space, in lower case; of scripts without blanks, pairs of characters. Very long texts are split into lines like others."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_key", keyed(F.col("text")))
    gone = materialize(removed_lines(docs, similarity, min_words).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("line_no")).alias("removed")))
    gone = broadcast_few(gone, "removed").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"), "removed")
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("gone_id"), keyed(F.col(text_col).cast("string")).alias("gone_key")).join(gone, ["gone_id", "gone_key"], "left")
    text = F.col("row").getField(text_col)
    left = F.array_join(F.filter(F.split(text, "\n"), lambda _, k: ~F.array_contains("removed", k)), "\n")
    row = F.col("row").withField(f"`{text_col}`", F.when(F.col("removed").isNull(), text).otherwise(left))
    return rows.select(row.alias("row"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_removed, removed (numbers of lines, from 0), and the SHA-256 digest of the text left."""
    rows = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_words=EVERY)
    return rows.select("row.doc_id", F.size("removed").cast("long").alias("n_removed"), "removed", F.sha2("row.text", 256).alias("text_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines removed; those without a word left, copies of earlier ones, go. The columns of docs.

    Nulls, empty tables and repeated rows as in dedup_lines: null texts and null ids stay."""
    columns = docs.columns
    rows = dedup_lines(docs, min_words=EVERY).where((F.size("removed") == 0) | F.col("row.text").rlike(r"[^\x20\x09-\x0D]")).select("row.*")
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*columns) if "n_chars" in columns else rows
