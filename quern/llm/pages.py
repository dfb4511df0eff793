"""HTML extraction: blocks of each page by its markup; a suffix array over the pages of a host decides on the blocks that markup leaves open."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import mix64, window_hashes
from quern.llm.urls import host_and_path
from quern.sources.tables import materialize, small

#: A run of so many words that stands on at least MIN_PAGES pages of a host is boilerplate.
RUN, MIN_PAGES = 8, 3
#: In articles, a run goes that stands in this share of the different articles of a host, if it has so many; not from an article that would lose over half of its words, which is a copy of others.
ARTICLE_SHARE, ARTICLES = 0.8, 32
#: Pages of a host are put into suffix arrays in groups of about this size, dealt out by hash; what repeats is summed up over all groups of a host.
GROUP_PAGES = 256

# Without a < in it, a tag that never ends is given up at the next one, so broken pages take no longer than others.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title)\b[^<>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    # A quote opens a value only behind an equals sign.
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9-]*+)(?P<rest>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^<>])*+)>"
    r"|<[!?/][^<>]*+>",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|\bstyle\s*=\s*["'][^"']*display\s*:\s*none""", re.I)
_WORDS = re.compile(r"[a-z]+|[0-9]+")
_SPACE = re.compile(r"\s+")
# Fixed values of HTML: elements without content, elements that stand in blocks of their own, elements that aren't main text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
ASIDES = frozenset("nav footer aside form button select option label input menu dialog head noscript template iframe object svg canvas".split())
CONTENT = frozenset(["article", "main"])
EMBEDDED = frozenset(["svg", "iframe", "object", "canvas"])
#: A class, id or role marks a block as no main text if it has one of these words, and but such words and general ones.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription "
    "sidebar nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer header masthead topbar toolbar comment comments respond disqus replies social share sharing related recommended recommendations "
    "widget widgets login signin signup search searchform contentinfo complementary dialog".split()
)
GENERAL = frozenset("site page main post posts article entry content box block area wrap wrapper container section list item items inner outer bar top bottom left right side primary secondary global form links link text group row col the and".split())


#: A block is no main text if a class, id or role has one of these words, whatever the others, unless one of them says that it isn't the thing itself.
ALWAYS = frozenset("ad ads advert adverts advertisement advertising sponsored comment comments disqus".split())
RATHER = frozenset("no not has with without open closed free enabled disabled is allow off on policy".split())
#: In an article, an id of one word is the name of a section to link to; only these mark it.
PARTS = ALWAYS | frozenset("sidebar nav navbar menu breadcrumb breadcrumbs pagination pager cookie cookies newsletter footer".split())


def marked(tag: str, rest: str, inside: bool) -> bool:
    """Whether a tag and its attributes tell that it holds no main text: a whole class, id or role does, not a word in one (has-sidebar doesn't); inside: in an article."""
    if "=" not in rest and "hidden" not in rest:
        return False
    if _HIDDEN.search(rest):
        return True
    for attribute, a, b, c in _NAMES.findall(rest):
        for name in (a or b or c).lower().split():
            words = [w for w in _WORDS.findall(name) if not w.isdigit()]
            if inside and attribute.lower() == "id" and len(words) == 1 and words[0] not in PARTS:
                continue
            if not MARKS.isdisjoint(words) and all(w in MARKS or w in GENERAL for w in words):
                return True
            if tag in BLOCKS and not ALWAYS.isdisjoint(words) and RATHER.isdisjoint(words):
                return True
    return False


def blocks(html: str) -> list[tuple[str, bool, bool]]:
    """The blocks of a page in order: text, whether it stands in an article, and whether its markup tells that it is no main text. Linear in the page's length."""
    out: list[tuple[str, bool, bool]] = []
    text: list[str] = []
    stack: list[tuple[str, bool]] = []
    held: Counter[str] = Counter()
    closed: dict[str, int] = {}
    asides = articles = 0

    def flush() -> None:
        if text:
            block = _SPACE.sub(" ", unescape("".join(text))).strip()
            if block:
                out.append((block, articles > 0, asides > 0))
            text.clear()

    def close() -> None:
        nonlocal asides, articles
        tag, aside = stack.pop()
        held[tag] -= 1
        asides -= aside
        articles -= tag in CONTENT

    at = 0
    for m in _MARKUP.finditer(html):
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            flush()
        elif tag in ("br", "td", "th"):
            text.append(" ")
        if m["end"]:
            if held[tag]:
                # Elements still open in the one that ends, end with it.
                while stack[-1][0] != tag:
                    if stack[-1][1]:
                        flush()
                    close()
                if stack[-1][1]:
                    flush()
                close()
            continue
        if tag in VOID:
            continue
        if tag in EMBEDDED:
            # One that isn't closed any more holds nothing.
            if tag not in closed:
                closed[tag] = max((c.start() for c in re.finditer(f"</{tag}", html, re.I)), default=-1)
            if closed[tag] < at:
                continue
        if stack and (tag in BLOCKS and stack[-1][0] == "p" or tag == stack[-1][0] and tag in ("li", "dt", "dd", "option", "tr", "td", "th")):
            close()
        # A page's header is none of its text; an article's own is.
        aside = tag in ASIDES or tag == "header" and not articles or tag not in ("html", "body", "article", "main") and marked(tag, m["rest"], articles > 0)
        if aside:
            flush()
        stack.append((tag, aside))
        held[tag] += 1
        asides += aside
        articles += tag in CONTENT
    text.append(html[at:])
    flush()
    return out


def judged(html: str) -> list[tuple[bool, str]]:
    """The blocks that may be main text, and whether that is open.

    What markup tells to be something else is left out. Blocks in an article are main text; the others are open."""
    return [(not inside, block) for block, inside, aside in blocks(html) if not aside]


def suffix_array(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of numbered words in order, and how many words each has in common with the one before it (0 for the first), by prefix doubling.

    Doubling ends when all suffixes differ; the ranks of every step then tell the common words, the longest step first."""
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    steps = [rank]
    while len(steps) < 64 and len(rank) and rank.max() + 1 < len(rank):
        step = 1 << len(steps) - 1
        following = np.zeros(len(rank), np.int64)
        following[:-step or None] = rank[step:] + 1
        rank = np.unique(rank << 32 | following, return_inverse=True)[1].astype(np.int64)
        steps.append(rank)
    order = np.argsort(rank, kind="stable")
    common = np.zeros(len(order), np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(steps) - 1, -1, -1):
        fits = np.flatnonzero((a + (1 << k) <= len(rank)) & (b + (1 << k) <= len(rank)))
        same = fits[steps[k][a[fits]] == steps[k][b[fits]]]
        a[same] += 1 << k
        b[same] += 1 << k
        common[same + 1] += 1 << k
    return order, common


def joined(streams: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all pages' streams as 64-bit hashes, and the page of each; behind every page stands a word of its own, so no run goes beyond it."""
    ends = mix64(np.arange(1, len(streams) + 1, dtype=np.uint64) + np.uint64(1 << 63))
    words = [np.append(np.fromiter(map(xxhash.xxh64_intdigest, s), np.uint64, len(s)), end) for s, end in zip(streams, ends)]
    return np.concatenate(words) if words else np.zeros(0, np.uint64), np.repeat(np.arange(len(streams)), [len(w) for w in words])


def runs(streams: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of RUN words in the pages' streams, as hashes, and on how many pages each stands.

    Neighbours in the suffix array with RUN words in common start one run."""
    words, page = joined(streams)
    order, common = suffix_array(words)
    first = np.cumsum(common < RUN) - 1
    # A suffix that reaches its page's end within RUN words starts no run.
    whole = order[order + RUN <= len(words)]
    inside = np.zeros(len(words), bool)
    inside[whole] = page[whole] == page[np.minimum(whole + RUN, len(words) - 1)]
    kept = inside[order]
    pairs = np.unique(np.stack([first[kept], page[order[kept]]]), axis=1)
    number, count = np.unique(pairs[0], return_counts=True)
    start = np.zeros(len(order) + 1, np.int64)
    start[first[kept]] = order[kept]
    return window_hashes(words, RUN)[start[number]], count


def covered(streams: list[list[str]], known: np.ndarray) -> list[np.ndarray]:
    """Which words of each page's stream stand in one of the known runs (hashes)."""
    words, page = joined(streams)
    starts = np.flatnonzero(np.isin(window_hashes(words, RUN), known))
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + RUN, -1)
    mask = np.cumsum(change[:-1]) > 0
    ends = np.cumsum([len(s) + 1 for s in streams])
    return [mask[e - len(s) - 1 : e - 1] for s, e in zip(streams, ends)]


def unique_words(words: list[str], mask: np.ndarray) -> list[str]:
    """The words of a block without covered stretches; a stretch of fewer than RUN words goes only with the whole block, as it belongs to a run that ends or starts in another one."""
    if mask.all():
        return []
    out: list[str] = []
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    at = 0
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if b - a >= RUN:
            out += words[at:a]
            at = b
    return out + words[at:]


def main_text(parts: list[tuple[bool, str]], mask: np.ndarray) -> str:
    """The blocks joined by line feeds, open ones less the words of repeated runs (mask: those of the open blocks' words)."""
    out, at = [], 0
    for is_open, block in parts:
        if is_open:
            n = block.count(" ") + 1
            own = mask[at : at + n]
            at += n
            if own.any():
                block = " ".join(unique_words(block.split(" "), own))
        if block:
            out.append(block)
    return "\n".join(out)


def packed(parts: list[tuple[bool, str]], packer: zstandard.ZstdCompressor) -> bytes:
    return packer.compress("\n".join(f"{int(is_open)}{block}" for is_open, block in parts).encode("utf-8", "replace"))


def unpacked(data: bytes, unpacker: zstandard.ZstdDecompressor) -> list[tuple[bool, str]]:
    return [(x[0] == "1", x[1:]) for x in unpacker.decompress(data).decode().split("\n") if x]


def open_streams(rows: pd.DataFrame) -> tuple[list[list[tuple[bool, str]]], list[list[str]]]:
    unpacker = zstandard.ZstdDecompressor()
    parts = [unpacked(p, unpacker) for p in rows.packed]
    return parts, [[w for is_open, block in page if is_open for w in block.split(" ")] for page in parts]


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group_pages: int = GROUP_PAGES) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    Text in an article (or main) is main text, what markup tells to be something else isn't; but runs of RUN words that stand in nearly all articles of a
    host go from them (common_runs), for pages all of whose text is in articles. Of other text, which is all of it in pages without
    an article, runs of RUN words go that stand on MIN_PAGES pages of the host or more; unique runs stay. Pages with such open text are put
    into suffix arrays in groups of a host, dealt out by hash, so a host may hold any share of them; the pages of each run are summed up
    over all groups of the host before it is judged, so the groups don't change the result.
    Null html: empty text. Null urls, and those without ://, form one host. Rows of one id and url are one page when runs are
    counted, without an id those of one url and open text. Very long pages take time by their length. An empty table gives an empty one. Other columns are not read."""
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts: list[str | None] = []
                left: list[bytes | None] = []
                for html in part.column("html").to_pylist():
                    found = judged(html or "")
                    is_open = any(x for x, _ in found)
                    texts.append(None if is_open else "\n".join(block for _, block in found))
                    left.append(packed(found, packer) if is_open else None)
                columns = [part.column(c) for c in ("page_id", "url", "host")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(left, pa.binary())], ["page_id", "url", "host", "text", "packed"])

    parsed = materialize(pages.withColumn("host", host_and_path("url")[0]).mapInArrow(parse, "page_id long, url string, host string, text string, packed binary"))
    page = F.when(F.col("page_id").isNotNull(), F.xxhash64("page_id", "url")).otherwise(F.xxhash64("url", "content"))
    waiting = parsed.where("packed IS NOT NULL").withColumn("content", F.sha2("packed", 256)).withColumn("page", page)
    done = without_common_runs(parsed.where("packed IS NULL").select("page_id", "url", "host", "text"), group_pages)
    if waiting.isEmpty():
        return measured(done)
    once = waiting.dropDuplicates(["host", "page", "content"]).select("host", "page", "content", "packed")
    sizes = once.groupBy("host").agg(F.ceil(F.count("*") / group_pages).alias("groups"))
    once = materialize(once.join(sizes, "host").withColumn("part", F.pmod(F.col("page"), F.col("groups"))).drop("groups"))

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        # Rows of one page and different texts are one page.
        streams = [[w for own in open_streams(same)[1] for w in [*own, f"\n{k}"]] for k, (_, same) in enumerate(rows.groupby("page", sort=False))]
        run, n = runs(streams)
        return pd.DataFrame({"host": rows.host.iloc[0], "part": rows.part.iloc[0], "run": run.view(np.int64), "n": n})

    found = materialize(once.groupBy("host", "part").applyInPandas(count, "host string, part long, run long, n long"))
    known = found.groupBy("host", "run").agg(F.sum("n").alias("pages")).where(F.col("pages") >= MIN_PAGES).select("host", "run")
    here = found.join(known, ["host", "run"], "left_semi").select("host", "part", "run")

    def clean(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"host": [], "page": [], "content": [], "text": []})
        parts, streams = open_streams(rows)
        masks = covered(streams, own.run.to_numpy(np.int64).view(np.uint64))
        return rows[["host", "page", "content"]].assign(text=[main_text(p, m) for p, m in zip(parts, masks)])

    texts = once.groupBy("host", "part").cogroup(here.groupBy("host", "part")).applyInPandas(clean, "host string, page long, content string, text string")
    rest = waiting.drop("text", "packed").join(texts, ["host", "page", "content"]).select("page_id", "url", "text")
    return measured(done.union(rest))


def without_common_runs(articles: DataFrame, group_pages: int) -> DataFrame:
    """page_id, url, text of articles (and host), without the runs that stand in ARTICLE_SHARE of the different articles of their host.

    A run of that share of a host has it in one of the host's groups at least, so a first pass over suffix arrays of groups gives a few
    candidates; only where there are some, their articles are counted over all groups of the host. Copies of a text count once."""
    rows = articles.withColumn("key", F.xxhash64("text"))
    sizes = rows.where("text <> ''").groupBy("host").agg(F.count_distinct("key").alias("n")).where(F.col("n") >= ARTICLES)
    sizes = materialize(sizes)
    grouped = rows.where("text <> ''").join(small(sizes), "host").select("host", "key", F.pmod("key", F.ceil(F.col("n") / group_pages)).alias("part"), "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = pa.array([packer.compress(t.encode("utf-8", "replace")) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("host", "key", "part")), texts], ["host", "key", "part", "packed"])

    def candidates(own: pd.DataFrame) -> pd.DataFrame:
        unpacker = zstandard.ZstdDecompressor()
        texts = [unpacker.decompress(t) for t in own.drop_duplicates("key").packed]
        run, n = runs([t.decode().split() for t in texts])
        return pd.DataFrame({"host": own.host.iloc[0], "run": run[n >= ARTICLE_SHARE * len(texts)].view(np.int64)})

    # Dealt out by host and part, so a host with most pages is spread; texts are packed for it.
    dealt = grouped.mapInArrow(pack, "host string, key long, part long, packed binary").repartition("host", "part")
    common = materialize(dealt.groupBy("host", "part").applyInPandas(candidates, "host string, run long").distinct())
    if common.isEmpty():
        return articles.select("page_id", "url", "text")
    # A page's words bound the runs that most pages of its group share.
    by_host = common.groupBy("host").agg(F.collect_list("run").alias("runs"))

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for host, text, own in zip(batch.host, batch.text, batch.runs, strict=True):
                here = np.intersect1d(window_hashes(joined([text.split()])[0][:-1], RUN).view(np.int64), np.asarray(own, np.int64))
                yield pd.DataFrame({"host": host, "run": here})

    met = rows.where("text <> ''").dropDuplicates(["host", "key"]).join(small(by_host), "host").select("host", "text", "runs")
    counts = met.mapInPandas(found, "host string, run long").groupBy("host", "run").agg(F.count("*").alias("pages"))
    known = materialize(counts.join(sizes, "host").where(F.col("pages") >= ARTICLE_SHARE * F.col("n")).groupBy("host").agg(F.collect_list("run").alias("runs")))

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [text if own is None else kept(text, np.asarray(own, np.int64).view(np.uint64)) for text, own in zip(batch.text, batch.runs, strict=True)]
            yield batch[["page_id", "url"]].assign(text=texts)

    return rows.join(small(known), "host", "left").select("page_id", "url", "text", "runs").mapInPandas(clean, "page_id long, url string, text string")


def kept(text: str, known: np.ndarray) -> str:
    """An article without known runs; the whole one if they are over half of its words."""
    mask = covered([text.split()], known)[0]
    if 2 * mask.sum() > len(mask):
        return text
    return main_text([(True, block) for block in text.split("\n")], mask)


def measured(rows: DataFrame) -> DataFrame:
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_html(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
