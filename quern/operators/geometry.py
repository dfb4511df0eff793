"""Geometry of pages, for all pages at once: words to lines, reading order by cuts, tables with spans and their detection, figure regions, sections by style.

A page (or table) is a key: its rows meet by it, and it has as many as a page can show; pages are spread over tasks. Coordinates grow to the right
and downwards. Rows with a null coordinate, or without extent where one is wanted, are left out; other columns may have any name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quern.functions.text import SPACE, numbering_depth, stripped
from quern.operators.graph import components
from quern.sources.tables import materialize

# The shares, distances and counts of the rules below.
#: A box wider than the median by this and across a gutter is left out of the cuts; a gutter counts from this share of the median height, and 3, on.
SPAN, GUTTER, LEAST_GUTTER = 1.3, 0.6, 3.0
#: Columns are cut first if their gaps are over this share of the rows' gaps, or if each side of a gutter has this share of the height and of the boxes.
DENSITY, COLUMN_HEIGHT, COLUMN_BOXES = 0.9, 0.6, 0.12
DEPTH = 64
#: Words of a line lie within so many points of its first one; a gap over so many times the type size parts two segments.
LINE, PART = 3.0, 1.5
#: Pages are taken from a batch by so many words.
WORDS = 1 << 16
#: Edges within these shares of the median height are one column, one row.
COLUMN, ROW, PAD = 1.2, 0.7, 0.4
#: A rule is at most so thick and longer than that; levels within 3 points are one, and count if they cover this share.
THICK, LONG, LEVEL, COVERED = 2.0, 8.0, 3.0, 0.55
#: A figure's share of its page, the margin in which small ones are marks, cells of the raster, and what a drawing has.
FIGURE, MARGIN, MARK, CELLS, STROKES, CURVES = (0.015, 0.96), 0.10, 0.06, 24, 24, 8


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def median_of(values: Column) -> Column:
    """The median of an array, null for an empty one."""
    at = lambda v, k: F.get(v, F.floor((F.size(v) - k) / 2).cast("int"))
    return let(F.sort_array(values), lambda v: 0.5 * at(v, 1) + 0.5 * at(v, 0))


def visible(c: Column) -> Column:
    """Whether a text begins with a visible character of ASCII, which a comparison of bytes tells."""
    return (c >= "!") & (c < "\x7f")


def lines_of_words(words: DataFrame, page: str) -> DataFrame:
    """page, line, segment, x0, y0, x1, y1, text, size, bold of words (page, word, x0, y0, x1, y1, text, size, bold).

    Words in the order of their tops (to a tenth) and left edges are one line while they lie within LINE of its first word. A line is parted where the
    gap is over PART times the type size (that of the word, else of the one before, else 10). Blank words go; a segment is bold if more than half
    of its characters are in bold words."""
    rows = words.select(F.col(page).alias("page"), "word", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", "size")), "text", F.when(F.col("bold"), F.length("text")).otherwise(0).alias("heavy"))
    rows = rows.where(F.col("page").isNotNull() & (visible(F.col("text")) | F.regexp_like("text", F.lit(f"[^{SPACE}]"))) & F.col("x0").isNotNull() & F.col("y0").isNotNull())
    lists = rows.groupBy("page").agg(F.sort_array(F.collect_list(F.struct(F.round("y0", 1).alias("tenth"), "x0", "word", "y0", "x1", "y1", "size", "text", "heavy"))).alias("l"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch.column("l").offsets.to_numpy()
            cuts = np.unique(np.append(np.searchsorted(offsets[:-1], np.arange(offsets[0], offsets[-1], WORDS)), batch.num_rows))
            for first, last in zip(cuts[:-1], cuts[1:], strict=True):
                yield segments_of(batch.slice(first, last - first))

    kind = StructType([StructField("page", lists.schema["page"].dataType), *StructType.fromDDL("line int, segment int, x0 double, y0 double, x1 double, y1 double, text string, size double, heavy long")])
    # Only texts whose ends may be white space of any kind are searched for it.
    text = F.col("text")
    found = lists.mapInArrow(run, kind).withColumn("text", F.when(visible(text) & visible(F.right(text, F.lit(1))), text).otherwise(stripped(text)))
    return found.withColumn("bold", F.col("heavy") > 0.5 * F.length("text")).drop("heavy").withColumnRenamed("page", page)


def segments_of(pages: pa.RecordBatch) -> pa.RecordBatch:
    """The segments of pages (page, l), where l are a page's words by tenth and left edge. Comparisons are as in SQL, where NaN is the greatest number."""
    lists = pages.column("l")
    counts = np.diff(lists.offsets.to_numpy())
    words = dict(zip((f.name for f in lists.type.value_type), lists.flatten().flatten(), strict=True))
    x0, y0, x1, y1, heavy = (words[c].to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1", "heavy"))
    size = words["size"].fill_null(0.0).to_numpy()
    no_x1, no_y1 = (words[c].is_null().to_numpy(zero_copy_only=False) for c in ("x1", "y1"))
    of = np.repeat(np.arange(len(counts)), counts)
    fresh = np.diff(of, prepend=-1) > 0
    begun = anchored(fresh.tolist(), y0.tolist(), LINE)
    line = np.cumsum(begun)
    # By line and left edge; lines and pages stay where they are.
    order = np.lexsort((x0, line))
    x0, y0, x1, y1, heavy, size, no_x1, no_y1 = (x[order] for x in (x0, y0, x1, y1, heavy, size, no_x1, no_y1))
    with np.errstate(invalid="ignore"):
        gap, limit = x0[1:] - x1[:-1], PART * np.where(size[1:] != 0, size[1:], np.where(size[:-1] != 0, size[:-1], 10.0))
    apart = ((gap > limit) | np.isnan(gap) & ~np.isnan(limit)) & ~no_x1[:-1]
    starts = np.flatnonzero(begun | np.append(True, apart))
    ends = np.append(starts[1:], len(line))
    number = np.arange(len(starts))
    in_line = number - np.maximum.accumulate(np.where(begun[starts], number, 0))
    in_page = (line - np.maximum.accumulate(np.where(fresh, line, 0)))[starts]
    sizes = size[np.lexsort((size, np.repeat(number, ends - starts)))]
    middle = 0.5 * sizes[(starts + ends - 1) // 2] + 0.5 * sizes[(starts + ends) // 2]
    greatest = lambda x, none: pa.array(np.maximum.reduceat(np.where(none, -np.inf, x), starts), mask=np.logical_and.reduceat(none, starts))
    texts = pa.ListArray.from_arrays(pa.array(np.append(starts, len(line)), pa.int32()), words["text"].take(pa.array(order)))
    columns = {
        "page": pages.column("page").take(pa.array(of[starts])), "line": pa.array(in_page, pa.int32()), "segment": pa.array(in_line, pa.int32()), "x0": pa.array(x0[starts]), "y0": pa.array(np.fmin.reduceat(y0, starts)),
        "x1": greatest(x1, no_x1), "y1": greatest(y1, no_y1), "text": pc.binary_join(texts, " "), "size": pa.array(middle), "heavy": pa.array(np.add.reduceat(heavy, starts, dtype=np.int64))}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def anchored(fresh: list[bool], values: list[float], width: float) -> np.ndarray:
    """Whether a group begins at each value: at the first of a page, and where a value is further than width from its group's first one."""
    begun, first = np.zeros(len(values), bool), 0.0
    for k, (new, v) in enumerate(zip(fresh, values, strict=True)):
        if new or not abs(v - first) <= width:
            begun[k], first = True, v
    return begun


def gaps(start: str, end: str, keys: list[str]) -> tuple[Column, Column]:
    """The empty band before a row, from the furthest end of those before it in the order of starts (null if there is none), and the furthest end."""
    order = W.partitionBy(*keys).orderBy(start, end, "box")
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    return F.when(F.col(start) > reach, F.col(start) - reach), reach


def cut_order(boxes: DataFrame, page: str) -> DataFrame:
    """page, box, place (from 1) of boxes (page, box, x0, y0, x1, y1) in the order of reading, by recursive cuts along empty bands.

    Wide boxes across a gutter of the narrow ones are set aside. A round takes all open regions of all pages: windows over a region find its bands on
    both axes, the axis is chosen, and each box's path gets the number of bands before it; a region without a band is done, in the order of tops. So
    there are as many rounds as the deepest page has cuts, at most DEPTH. The axis is that of columns if a gutter has columns of nearly full
    height on both sides or the columns' gaps are wide; then axes take turns, one without a band giving way to the other. Wide boxes then go
    before or behind the nearest box, one after the other by box. Equal boxes are ordered by box; null pages are one page."""
    rows = boxes.select(F.col(page).alias("page"), "box", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1"))).where("x1 > x0 AND y1 > y0")
    w = F.col("x1") - F.col("x0")
    rows = rows.withColumn("long", SPAN * F.median(w).over(W.partitionBy("page")))
    # The gutters of the narrow boxes; of all, if fewer than two are narrow. At most a few for each page.
    narrow = rows.withColumn("of", w <= F.col("long")).withColumn("of", F.col("of") | (F.sum(F.col("of").cast("int")).over(W.partitionBy("page")) < 2)).where("of")
    band, reach = gaps("x0", "x1", ["page"])
    least = F.greatest(F.lit(LEAST_GUTTER), GUTTER * F.median(F.col("y1") - F.col("y0")).over(W.partitionBy("page")))
    found = narrow.select("page", F.col("x0").alias("to"), band.alias("band"), reach.alias("from"), least.alias("least")).where("band >= least")
    found = found.groupBy(F.col("page").alias("g_page")).agg(F.collect_list(F.struct("from", "to")).alias("gutters"))
    across = F.coalesce((w >= F.col("long")) & F.exists("gutters", lambda g: (F.col("x0") < g["from"]) & (F.col("x1") > g["to"])), F.lit(False))
    rows = materialize(rows.join(found, F.col("page").eqNullSafe(F.col("g_page")), "left").select("page", "box", "x0", "y0", "x1", "y1", across.alias("wide")))
    ordered = uncut_rows(rows.where(~F.col("wide")).drop("wide"))
    wide = rows.where("wide").groupBy("page").agg(F.sort_array(F.collect_list(F.struct("box", "x0", "y0", "x1", "y1"))).alias("wide"))
    plain = F.struct("box", "x0", "y0", "x1", "y1")
    pages = ordered.join(wide.select(F.col("page").alias("p"), "wide"), F.col("page").eqNullSafe(F.col("p")), "left")
    done = pages.where("wide IS NULL").select("page", "box", F.row_number().over(W.partitionBy("page").orderBy("path", "y0", "x0", "box")).alias("place"))
    lists = pages.where("wide IS NOT NULL").groupBy("page").agg(F.sort_array(F.collect_list(F.struct("path", "y0", "x0", "box", plain.alias("b")))).alias("l"), F.first("wide").alias("wide"))
    placed = lists.select("page", F.posexplode(F.aggregate("wide", F.transform("l", lambda x: x["b"]), put_in)).alias("place", "b"))
    return done.union(placed.select("page", "b.box", F.col("place") + 1)).withColumnRenamed("page", page)


def put_in(listed: Column, wide: Column) -> Column:
    """A list of boxes with a wide one: before the nearest box if it isn't lower, else behind. The distance counts heights whole, widths by 0.3, and the greater width where the two don't overlap."""
    mid = lambda b, a: (b[f"{a}0"] + b[f"{a}1"]) / 2
    away = lambda b: (
        F.abs(mid(b, "y") - mid(wide, "y")) + 0.3 * F.abs(mid(b, "x") - mid(wide, "x"))
        + F.when((b["x0"] < wide["x1"]) & (b["x1"] > wide["x0"]), 0.0).otherwise(F.greatest(wide["x1"] - wide["x0"], b["x1"] - b["x0"])))
    near = F.array_min(F.transform(listed, lambda b, k: F.struct(away(b).alias("d"), k.alias("k"), (mid(wide, "y") > mid(b, "y")).cast("int").alias("behind"))))
    at = F.coalesce(near["k"] + near["behind"], F.lit(0))
    return F.concat(F.slice(listed, F.lit(1), at), F.array(wide), F.slice(listed, at + 1, F.size(listed)))


def uncut_rows(rows: DataFrame) -> DataFrame:
    """rows with path: the numbers of the slices that the cuts put each box in."""
    keys = ["page", "path"]
    region, n = W.partitionBy(*keys), F.count("*").over(W.partitionBy(*keys))
    whole = lambda w: w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    open_ = rows.withColumns({"path": F.array().cast("array<int>"), "axis": F.lit(None).cast("int"), "depth": F.lit(0)})
    done: DataFrame | None = None
    while True:
        least = F.greatest(F.lit(LEAST_GUTTER), GUTTER * F.median(F.col("y1") - F.col("y0")).over(region))
        (x_band, x_reach), (y_band, _) = gaps("x0", "x1", keys), gaps("y0", "y1", keys)
        by_x, by_y = W.partitionBy(*keys).orderBy("x0", "x1", "box"), W.partitionBy(*keys).orderBy("y0", "y1", "box")
        before, behind = by_x.rowsBetween(W.unboundedPreceding, -1), by_x.rowsBetween(0, W.unboundedFollowing)
        rows = open_.withColumns({
            "n": n, "least": least, "x_band": x_band, "y_band": y_band, "height": F.max("y1").over(region) - F.min("y0").over(region), "left": F.count("*").over(before),
            "left_height": F.max("y1").over(before) - F.min("y0").over(before), "right_height": F.max("y1").over(behind) - F.min("y0").over(behind)})
        even = F.least("left", F.col("n") - F.col("left")) >= F.greatest(F.lit(2), F.floor(F.col("n") * COLUMN_BOXES))
        tall = F.least("left_height", "right_height") >= COLUMN_HEIGHT * F.col("height")
        column = F.coalesce((F.col("n") >= 4) & (F.col("x_band") >= F.col("least")) & even & tall, F.lit(False))
        cut = lambda a: F.coalesce(F.col(f"{a}_band") >= F.col("least"), F.lit(False)).cast("int")
        rows = rows.withColumns({
            "columns": F.max(column).over(region), "x_cut": F.sum(cut("x")).over(by_x.rowsBetween(W.unboundedPreceding, 0)), "y_cut": F.sum(cut("y")).over(by_y.rowsBetween(W.unboundedPreceding, 0)),
            "x_gap": F.coalesce(F.sum("x_band").over(whole(region)), F.lit(0.0)), "y_gap": F.coalesce(F.sum("y_band").over(whole(region)), F.lit(0.0))})
        first = F.coalesce("axis", F.when(F.col("columns") | ((F.col("n") >= 2) & (F.col("x_gap") / (F.col("y_gap") + 1e-6) > DENSITY)), 0).otherwise(1))
        rows = rows.withColumns({"x_cuts": F.max("x_cut").over(region), "y_cuts": F.max("y_cut").over(region), "first": first})
        own = F.when(F.col("first") == 0, F.col("x_cuts")).otherwise(F.col("y_cuts")) > 0
        other = F.when(F.col("first") == 0, F.col("y_cuts")).otherwise(F.col("x_cuts")) > 0
        used = F.when(own, F.col("first")).otherwise(1 - F.col("first"))
        rows = rows.withColumns({"used": used, "deep": F.col("depth") + F.when(own, 1).otherwise(2)})
        rows = rows.withColumn("split", (F.col("n") > 1) & (own | other) & (F.col("deep") <= DEPTH + 1))
        path = F.when(F.col("split"), F.concat("path", F.array(F.when(F.col("used") == 0, F.col("x_cut")).otherwise(F.col("y_cut")).cast("int")))).otherwise(F.col("path"))
        rows = materialize(rows.select("page", "box", "x0", "y0", "x1", "y1", path.alias("path"), (1 - F.col("used")).alias("axis"), F.col("deep").alias("depth"), "split"))
        ended = rows.where(~F.col("split")).select("page", "box", "x0", "y0", "x1", "y1", "path")
        done = ended if done is None else done.union(ended)
        open_ = rows.where("split").drop("split")
        if open_.isEmpty():
            return done


def clusters(values: Column, width: Column) -> Column:
    """The means of the clusters of an array of sorted values, a new one where the gap to the last value is over width."""
    start = F.struct(F.array().cast("array<double>").alias("means"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(None).cast("double").alias("last"))
    state = lambda means, total, n, last: F.struct(means.alias("means"), total.alias("sum"), n.alias("n"), last.alias("last"))
    closed = lambda s: F.concat(s["means"], F.array(s["sum"] / s["n"]))
    add = lambda s, v: F.when(v - s["last"] > width, state(closed(s), v, F.lit(1), v)).otherwise(state(s["means"], s["sum"] + v, s["n"] + 1, v))
    return F.aggregate(values, start, add, lambda s: F.when(s["n"] > 0, closed(s)).otherwise(s["means"]))


def upto(lines: Column, v: Column) -> Column:
    return F.size(F.filter(lines, lambda at: at <= v))


def below(lines: Column, v: Column) -> Column:
    return F.size(F.filter(lines, lambda at: at < v))


def nearest(lines: Column, v: Column) -> Column:
    """The number of the line nearest to v in an array of sorted lines, the lesser of two."""
    return let(upto(lines, v), lambda u: F.when(u == 0, 0).when((u == F.size(lines)) | (v - F.get(lines, u - 1) <= F.get(lines, u) - v), u - 1).otherwise(u))


def middle_of(heights: Column) -> Column:
    """The median of the positive numbers of an array, 10 without any."""
    return F.coalesce(median_of(F.filter(heights, lambda h: h > 0)), F.lit(10.0))


def inside(cell: Column, r: Column, c: Column) -> Column:
    return (cell["r"] <= r) & (r < cell["r"] + cell["rows"]) & (cell["c"] <= c) & (c < cell["c"] + cell["columns"])


def cell_lists(boxes: DataFrame, table: str) -> DataFrame:
    """table, n_rows, n_columns, cells (r, c, rows, columns, text; sorted) of table_cells: a row for each table. Its boxes meet in one shuffle, and all else is done on its own arrays."""
    rows = boxes.select(F.col(table), "box", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")), stripped(F.col("text")).alias("text")).where((F.col("text") != "") & F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col(table).isNotNull())
    lists = rows.groupBy(table).agg(F.collect_list(F.struct("x0", "y0", "x1", "y1", "box", "text")).alias("b")).where(F.size("b") >= 2)
    lists = lists.withColumn("med", middle_of(F.transform("b", lambda b: b["y1"] - b["y0"])))
    line = lambda k, share: clusters(F.sort_array(F.transform("b", lambda b: b[k])), share * F.col("med"))
    lists = lists.withColumns({"xs": line("x0", COLUMN), "ys": line("y0", ROW)}).withColumns({"n_rows": F.size("ys"), "n_columns": F.size("xs")}).where("n_rows >= 2 AND n_columns >= 2")
    pad, xs, ys = PAD * F.col("med"), F.col("xs"), F.col("ys")
    columns = lambda b: F.greatest(F.lit(1), upto(xs, b["x1"] + pad) - below(xs, b["x0"] - pad)).alias("columns")
    span = lambda b: let(nearest(ys, b["y0"]), lambda r: F.struct(
        r.alias("r"), nearest(xs, b["x0"]).alias("c"), b["x0"].alias("x0"), b["box"].alias("box"), b["text"].alias("text"),
        F.greatest(F.lit(1), upto(ys, b["y1"] + pad) - F.greatest(below(ys, b["y0"] - pad), r)).alias("rows"), columns(b)))
    lists = lists.withColumn("spans", F.sort_array(F.transform("b", span)))
    spans = F.col("spans")
    same = lambda a, b: F.coalesce((a["r"] == b["r"]) & (a["c"] == b["c"]), F.lit(False))
    text = lambda s, k: F.when(same(F.get(spans, k + 1), s), F.array_join(F.transform(F.filter(spans, lambda o: same(o, s)), lambda o: o["text"]), " ")).otherwise(s["text"])
    # Of the boxes of one cell, which stand side by side, the first makes it.
    cell = lambda s, k: F.when(~same(F.get(spans, k - 1), s), F.struct(
        s["r"].alias("r"), s["c"].alias("c"), F.least(s["rows"], F.col("n_rows") - s["r"]).alias("rows"), F.least(s["columns"], F.col("n_columns") - s["c"]).alias("columns"), text(s, k).alias("text")))
    lists = lists.withColumn("cells", F.filter(F.transform(spans, cell), lambda c: c.isNotNull()))
    none = F.slice("cells", 1, 0)
    add = lambda s, x: F.when(F.exists(s["wide"], lambda a: inside(a, x["r"], x["c"])), s).otherwise(F.struct(
        F.concat(s["seen"], F.array(x)).alias("seen"), F.when((x["rows"] > 1) | (x["columns"] > 1), F.concat(s["wide"], F.array(x))).otherwise(s["wide"]).alias("wide")))
    shown = F.aggregate("cells", F.struct(none.alias("seen"), none.alias("wide")), add, lambda s: s["seen"])
    return lists.select(table, "n_rows", "n_columns", shown.alias("cells"))


def table_cells(boxes: DataFrame, table: str) -> DataFrame:
    """table, r, c, rows, columns, text, n_rows, n_columns: the cells of each table's boxes (table, box, x0, y0, x1, y1, text), those that others cover left out.

    Left edges are clustered to columns, tops to rows. A cell begins in the column and row nearest its corner and spans those whose lines lie in
    its extent; boxes of one cell are joined from left to right, the first giving the extent. In the order of rows, then columns, a cell that one
    before it covers isn't shown. Blank boxes don't count; tables of fewer than two boxes, columns or rows have none."""
    return cell_lists(boxes, table).select(table, "n_rows", "n_columns", F.explode_outer("cells").alias("cell")).select(table, "cell.*", "n_rows", "n_columns")


def table_html(boxes: DataFrame, table: str) -> DataFrame:
    """table, html of each table with two rows and columns at least: cells with their spans, empty ones where nothing stands and no cell reaches."""
    attribute = lambda name, n: F.when(n > 1, F.concat(F.lit(f' {name}="'), n, F.lit('"'))).otherwise("")

    def td(cell: Column) -> Column:
        text = cell["text"]
        for mark, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            text = F.replace(text, F.lit(mark), F.lit(reference))
        return F.concat(F.lit("<td"), attribute("colspan", cell["columns"]), attribute("rowspan", cell["rows"]), F.lit(">"), text, F.lit("</td>"))

    def drawn(parts: Column) -> Column:
        place = lambda r, c: let(F.array_position(parts["at"], r * F.col("n_columns") + c).cast("int"), lambda k: F.when(k > 0, F.get(parts["td"], k - 1)).when(F.exists(parts["wide"], lambda w: inside(w, r, c)), "").otherwise("<td></td>"))
        # A row all of whose cells are covered from above is there, and empty.
        row = lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(F.sequence(F.lit(0), F.col("n_columns") - 1), lambda c: place(r, c)), ""), F.lit("</tr>"))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.col("n_rows") - 1), row), "")

    parts = F.struct(
        F.transform("cells", lambda c: c["r"] * F.col("n_columns") + c["c"]).alias("at"), F.transform("cells", td).alias("td"), F.filter("cells", lambda c: (c["rows"] > 1) | (c["columns"] > 1)).alias("wide"))
    return cell_lists(boxes, table).select(table, F.concat(F.lit("<table>"), let(parts, drawn), F.lit("</table>")).alias("html"))


def separators(edges: Column, tolerance: float, least: Column) -> Column:
    """The lines of a grid from an array of edges; least is the smallest cell: clusters within tolerance at their mean, whole; then those behind the last one kept by less than least go, but for the outer ones."""
    lines = F.transform(clusters(F.sort_array(edges), F.lit(float(tolerance))), lambda at: F.floor(at).cast("double"))
    keep = lambda kept, v: F.when((F.size(kept) == 0) | (v - F.element_at(kept, -1) >= least), F.concat(kept, F.array(v))).otherwise(kept)
    # The last line stays; the one kept before it goes if it is too near.
    ended = lambda last: lambda kept: F.concat(F.when(last - F.element_at(kept, -1) >= least, kept).otherwise(F.slice(kept, F.lit(1), F.size(kept) - 1)), F.array(last))
    spaced = lambda at: F.aggregate(F.slice(at, F.lit(1), F.size(at) - 1), F.array().cast("array<double>"), keep, ended(F.element_at(at, -1)))
    return let(lines, lambda at: F.when(F.size(at) <= 2, at).otherwise(spaced(at)))


def grid_cells(cells: DataFrame, pages: DataFrame, page: str, tolerance: float = 6.0, share: tuple[float, float] = (0.02, 0.012)) -> DataFrame:
    """page, cell, r, c, rows, columns of drawn cells (page, cell, x0, y0, x1, y1) on pages (page, width, height): the nearest lines of the grid that all edges of a page make. Cells between equal lines, and grids of fewer than two lines on an axis, are left out.

    share: of the page's width and height, the smallest cell. A page's cells meet in one shuffle; all else is done on its own arrays."""
    lists = cells.where(F.col(page).isNotNull()).select(page, F.struct("cell", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1"))).alias("b")).groupBy(page).agg(F.collect_list("b").alias("b"))
    sized = lists.join(pages.select(page, F.floor(F.col("width") * share[0]).cast("double").alias("lx"), F.floor(F.col("height") * share[1]).cast("double").alias("ly")).hint("shuffle_hash"), page)
    side = lambda name: F.transform("b", lambda b: b[name])
    edges = lambda k: F.filter(F.concat(side(f"{k}0"), side(f"{k}1")), lambda at: at.isNotNull())
    sized = sized.withColumns({f"{k}s": separators(edges(k), tolerance, F.col(f"l{k}")) for k in "xy"})
    at = lambda k, v: F.when(v.isNotNull() & (F.size(f"{k}s") >= 2), nearest(F.col(f"{k}s"), v))
    place = lambda b: F.struct(b["cell"].alias("cell"), at("y", b["y0"]).alias("r"), at("x", b["x0"]).alias("c"), at("y", b["y1"]).alias("r1"), at("x", b["x1"]).alias("c1"))
    found = sized.select(page, F.explode_outer(F.transform("b", place)).alias("b")).select(page, "b.*").where("r1 > r AND c1 > c")
    return found.select(page, "cell", "r", "c", (F.col("r1") - F.col("r")).alias("rows"), (F.col("c1") - F.col("c")).alias("columns"))


def rulings(lines: DataFrame, rects: DataFrame, page: str) -> DataFrame:
    """page, axis (y: a level rule at y = at from low to high; x: an upright one), at, low, high of drawn lines and of the edges of rectangles (page, x0, y0, x1, y1): thin ones longer than LONG."""
    ordered = [F.least("x0", "x1"), F.greatest("x0", "x1"), F.least("y0", "y1"), F.greatest("y0", "y1")]
    rule = lambda axis, at, low, high: F.struct(F.lit(axis).alias("axis"), at.cast("double").alias("at"), low.cast("double").alias("low"), high.cast("double").alias("high"))
    level = (F.abs(F.col("y0") - F.col("y1")) <= THICK) & (F.abs(F.col("x0") - F.col("x1")) > LONG)
    upright = (F.abs(F.col("x0") - F.col("x1")) <= THICK) & (F.abs(F.col("y0") - F.col("y1")) > LONG)
    drawn = lines.select(page, F.when(level, rule("y", F.col("y0"), *ordered[:2])).when(upright, rule("x", F.col("x0"), *ordered[2:])).alias("r")).where("r IS NOT NULL")
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    flat, tall = x1 - x0 > LONG, y1 - y0 > LONG
    edges = F.array(F.when(flat, rule("y", y0, x0, x1)), F.when(flat, rule("y", y1, x0, x1)), F.when(tall, rule("x", x0, y0, y1)), F.when(tall, rule("x", x1, y0, y1)))
    boxed = rects.select(page, F.explode(edges).alias("r")).where("r IS NOT NULL")
    return drawn.union(boxed).select(page, "r.*")


def bands_of(middles: Column, width: Column) -> Column:
    """The number of the band, from 0, of each of an array of sorted middles: the last band if its mean so far is within width, else a new one. No band before can be nearer."""
    start = F.struct(F.array().cast("array<int>").alias("bands"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    state = lambda bands, total, n: F.struct(bands.alias("bands"), total.alias("sum"), n.alias("n"))
    last = lambda s: F.coalesce(F.try_element_at(s["bands"], F.lit(-1)), F.lit(-1))
    add = lambda s, v: F.when((s["n"] > 0) & (F.abs(v - s["sum"] / F.greatest(s["n"], F.lit(1))) <= width), state(F.concat(s["bands"], F.array(last(s))), s["sum"] + v, s["n"] + 1)).otherwise(state(F.concat(s["bands"], F.array(last(s) + 1)), v, F.lit(1)))
    return F.aggregate(middles, start, add, lambda s: s["bands"])


def candidate_lists(boxes: DataFrame, page: str) -> DataFrame:
    """page, region, med, xs, b: a row for each region of table_candidates; xs are its columns, b its boxes (band, box, x0, y0, x1, y1, text). A page's boxes meet in one shuffle, and all else is done on its own arrays."""
    rows = boxes.select(page, "box", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")), "text").where(F.col(page).isNotNull() & F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull())
    box = F.struct(((F.col("y0") + F.col("y1")) / 2).alias("cy"), "box", "x0", "y0", "x1", "y1", "text")
    lists = rows.groupBy(page).agg(F.collect_list(box).alias("l")).where(F.size("l") >= 4)
    lists = lists.withColumns({"l": F.sort_array("l"), "med": middle_of(F.transform("l", lambda b: b["y1"] - b["y0"]))})
    lists = lists.withColumn("bands", bands_of(F.transform("l", lambda b: b["cy"]), ROW * F.col("med")))
    sizes = F.transform(F.sequence(F.lit(0), F.element_at("bands", -1)), lambda k: F.size(F.filter("bands", lambda b: b == k)))
    lists = lists.withColumn("sizes", sizes)
    # A band of one box parts two runs: a band's run is the last such band before it.
    run = lambda k: F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), k), lambda j: F.get("sizes", j) < 2)), F.lit(-1))
    placed = F.transform("l", lambda b, i: let(F.get("bands", i), lambda k: F.when(F.get("sizes", k) >= 2, F.struct(
        F.get("runs", k).alias("run"), k.alias("band"), b["box"].alias("box"), *(b[c].alias(c) for c in ("x0", "y0", "x1", "y1")), b["text"].alias("text")))))
    lists = lists.withColumn("runs", F.transform("sizes", lambda n, k: run(k))).withColumn("placed", F.filter(placed, lambda b: b.isNotNull()))
    bare = lambda b: F.struct(*(b[c].alias(c) for c in ("band", "box", "x0", "y0", "x1", "y1", "text")))
    regions = F.transform(F.array_distinct(F.transform("placed", lambda b: b["run"])), lambda r: F.struct(r.alias("run"), F.transform(F.filter("placed", lambda b: b["run"] == r), bare).alias("b")))
    found = lists.select(page, "med", F.explode_outer(regions).alias("r")).select(page, F.concat_ws(":", page, "r.run").alias("region"), "med", F.col("r.b").alias("b")).where("b IS NOT NULL")
    xs = clusters(F.sort_array(F.transform("b", lambda b: b["x0"])), COLUMN * F.col("med"))
    length = median_of(F.transform("b", lambda b: F.coalesce(F.length(b["text"]), F.lit(0))))
    # One column of all, so that no filter computes them a second time.
    judged = found.withColumn("j", F.struct(xs.alias("xs"), F.size(F.array_distinct(F.transform("b", lambda b: b["band"]))).alias("bands"), length.alias("length")))
    return judged.where("j.bands >= 2 AND size(j.xs) >= 2 AND (j.bands >= 3 OR size(j.xs) >= 3) AND j.length < 40").select(page, "region", "med", "j.xs", "b")


def table_candidates(boxes: DataFrame, page: str) -> DataFrame:
    """boxes (page, box, x0, y0, x1, y1, text) that stand in a candidate for a table, with region and med, the page's median height.

    Runs of consecutive bands of two boxes or more; of two bands at least, with three bands or three columns, two columns, and a median text
    under 40 characters. Pages of fewer than four boxes have none."""
    return of_regions(candidate_lists(boxes, page), page)


def of_regions(regions: DataFrame, page: str) -> DataFrame:
    return regions.select(page, "region", "med", F.explode_outer("b").alias("b")).select(page, "region", *(f"b.{c}" for c in ("box", "x0", "y0", "x1", "y1", "text")), "med")


def real_tables(boxes: DataFrame, rules: DataFrame, curves: DataFrame, page: str) -> DataFrame:
    """The boxes of table_candidates whose region is a table: ruled, or a regular grid, without curves.

    rules as rulings gives them: levels that cross a region, covering COVERED of it, count; those within LEVEL are one.
    curves (page, x0, y0, x1, y1): more than two that touch a region speak for a drawing. Ruled is a region with two levels of rules across and two
    upright, or two columns; or two upright, one across and two columns. A grid has three bands or more of several boxes, three quarters of them
    of one number of boxes, and edges within 0.6 of the height from their columns in the median; a column of marks of two characters at most
    beside one of 28 in the median is a list."""
    ruled = rules.groupBy(F.col(page).alias("r_page")).agg(F.collect_list(F.struct("axis", "at", "low", "high")).alias("rules"))
    drawn = curves.groupBy(F.col(page).alias("c_page")).agg(F.collect_list(F.struct(*(F.col(k).cast("double").alias(k) for k in ("x0", "y0", "x1", "y1")))).alias("curves"))
    # Hash joins: the lists of boxes aren't sorted.
    regions = candidate_lists(boxes, page).join(ruled.hint("shuffle_hash"), F.col(page) == F.col("r_page"), "left").join(drawn.hint("shuffle_hash"), F.col(page) == F.col("c_page"), "left")
    side = lambda k: F.transform("b", lambda b: b[k])
    regions = regions.withColumns({"x0": F.array_min(side("x0")), "y0": F.array_min(side("y0")), "x1": F.array_max(side("x1")), "y1": F.array_max(side("y1"))})
    touching = F.size(F.filter("curves", lambda c: (c["x1"] >= F.col("x0")) & (c["x0"] <= F.col("x1")) & (c["y1"] >= F.col("y0")) & (c["y0"] <= F.col("y1"))))

    def levels(axis: str, along: str) -> Column:
        a, b = F.col(f"{along}0"), F.col(f"{along}1")
        crosses = lambda r: (r["axis"] == axis) & r["at"].between(F.col(f"{axis}0") - LEVEL, F.col(f"{axis}1") + LEVEL) & (b > a) & (F.least(r["high"], b) - F.greatest(r["low"], a) >= COVERED * (b - a))
        return F.coalesce(F.size(clusters(F.sort_array(F.transform(F.filter("rules", crosses), lambda r: r["at"])), F.lit(LEVEL))), F.lit(0))

    length = F.transform("b", lambda b: F.struct(nearest(F.col("xs"), b["x0"]).alias("near"), F.length(stripped(F.coalesce(b["text"], F.lit("")))).alias("n"), b["x0"].alias("x0")))
    regions = regions.withColumns({"near": length, "counts": let(F.transform("b", lambda b: b["band"]), lambda of: F.transform(F.array_distinct(of), lambda k: F.size(F.filter(of, lambda o: o == k))))})
    off = median_of(F.transform("near", lambda n: F.abs(F.get("xs", n["near"]) - n["x0"])))
    alike = F.array_max(F.transform("counts", lambda k: F.size(F.filter("counts", lambda o: o == k))))
    own = lambda k: F.transform(F.filter("near", lambda n: n["near"] == k), lambda n: n["n"])
    marks, prose = (lambda k: F.array_max(own(k)) <= 2), (lambda k: median_of(own(k)) >= 28)
    is_list = (F.size("xs") == 2) & F.coalesce(F.greatest(marks(0), marks(1)), F.lit(False)) & F.coalesce(F.greatest(prose(0), prose(1)), F.lit(False)) & (F.size(F.array_distinct(F.transform("near", lambda n: n["near"]))) == 2)
    judged = regions.withColumn("j", F.struct(F.coalesce(touching, F.lit(0)).alias("curves"), levels("y", "x").alias("y"), levels("x", "y").alias("x"), F.size("xs").alias("columns"), F.size("counts").alias("bands"), (alike / F.size("counts")).alias("share"), (off / F.col("med")).alias("off"), is_list.alias("list")))
    fine = judged.where("j.curves <= 2 AND (j.y >= 2 AND (j.x >= 2 OR j.columns >= 2) OR j.x >= 2 AND j.y >= 1 AND j.columns >= 2 OR j.bands >= 3 AND j.share >= 0.75 AND j.off <= 0.6 AND NOT j.list)")
    return of_regions(fine, page)


def area(x0: str | Column, y0: str | Column, x1: str | Column, y1: str | Column) -> Column:
    c = [F.col(x) if isinstance(x, str) else x for x in (x0, y0, x1, y1)]
    return (c[2] - c[0]) * (c[3] - c[1])


def shared(p: str = "a", q: str = "b") -> tuple[Column, Column]:
    """How far two boxes of a pair overlap on each axis; below 0, how far they are apart."""
    return tuple(F.least(F.col(f"{p}.{k}1"), F.col(f"{q}.{k}1")) - F.greatest(F.col(f"{p}.{k}0"), F.col(f"{q}.{k}0")) for k in "xy")


def overlapping(fraction: float) -> Callable[[], Column]:
    """Boxes a and b share at least a fraction of the smaller one."""
    x, y = shared()
    of = lambda s: area(*(F.col(f"{s}.{c}") for c in ("x0", "y0", "x1", "y1")))
    return lambda: (x > 0) & (y > 0) & (x * y >= fraction * F.least(of("a"), of("b")))


def neighbouring(share: float = 0.16, wide: float = 0.5) -> Callable[[], Column]:
    """Boxes a and b of a page (width, height) are near on both axes, or stand side by side, half of the smaller one's side in common, with a gap of at most wide times the page's greater side."""
    x, y = shared()
    width, height = F.col("a.width"), F.col("a.height")
    side = lambda k: F.greatest(F.lit(1.0), F.least(F.col(f"a.{k}1") - F.col(f"a.{k}0"), F.col(f"b.{k}1") - F.col(f"b.{k}0")))
    most = wide * F.greatest(width, height)
    return lambda: ((-x <= share * width) & (-y <= share * height)) | ((y >= 0.5 * side("y")) & (-x <= most)) | ((x >= 0.5 * side("x")) & (-y <= most))


def meeting(boxes: DataFrame, page: str, reach: float) -> DataFrame:
    """Pairs a, b (structs, a.box < b.box) of a page's boxes that a cell of a raster of 8 x 8 has both of, each box taking reach times the page's greater side more: once each."""
    more = reach * F.greatest("width", "height")
    cell = lambda c, size: F.floor(c / (size / 8)).cast("int")
    x = F.sequence(cell(F.col("x0") - more, F.col("width")), cell(F.col("x1") + more, F.col("width")))
    y = F.sequence(cell(F.col("y0") - more, F.col("height")), cell(F.col("y1") + more, F.col("height")))
    one = boxes.select(page, F.struct("box", "x0", "y0", "x1", "y1", "width", "height").alias("b"), F.explode(x).alias("gx"), y.alias("ys")).select(page, "b", "gx", F.explode("ys").alias("gy"))
    met = one.withColumnRenamed("b", "a").join(one, [page, "gx", "gy"]).where("a.box < b.box")
    return met.select(page, "a", "b").distinct()


def merged_boxes(boxes: DataFrame, page: str, test: Callable[[], Column], reach: float = 0.0) -> DataFrame:
    """page, box (the least of those merged), x0, y0, x1, y1, width, height and n: boxes (page, box, x0, y0, x1, y1, width, height; n if there) merged until no two of a page pass the test.

    A round finds the pairs that pass among neighbours in a raster, takes connected components and unites their boxes; it ends when there are none.
    All pairs of a round merge at once; as tests may fail again for larger boxes, another order of merging could leave others apart."""
    now = materialize(boxes.select(page, "box", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", "width", "height")), (F.col("n") if "n" in boxes.columns else F.lit(1)).cast("long").alias("n")))
    while True:
        pairs = materialize(meeting(now, page, reach).where(test()).select(F.col(page), F.col("a.box").alias("src"), F.col("b.box").alias("dst")))
        if pairs.isEmpty():
            return now
        name = lambda c: F.struct(F.col(page).alias("p"), F.col(c).alias("box"))
        groups = components(pairs.select(name("src").alias("src"), name("dst").alias("dst"))).select(F.col("node.p").alias(page), F.col("node.box").alias("box"), F.col("component.box").alias("into"))
        known = now.join(groups, [page, "box"], "left").withColumn("box", F.coalesce("into", "box"))
        now = materialize(known.groupBy(page, "box").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.first("width").alias("width"), F.first("height").alias("height"), F.sum("n").alias("n")))


def stroke_clusters(strokes: DataFrame, pages: DataFrame, page: str) -> DataFrame:
    """page, box, x0, y0, x1, y1, width, height, n, curves: what the strokes (page, x0, y0, x1, y1, curve) of a page draw.

    A raster of CELLS x CELLS lies over each page (page, width, height); cells that hold the middle of a stroke are connected with the eight
    around them, and each component with STROKES strokes, CURVES of them curves, is a cluster. box is its least cell's number."""
    rows = strokes.select(page, *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")), "curve").join(pages.select(page, F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height")), page)
    at = lambda a, b, size: F.least(F.lit(CELLS - 1), F.greatest(F.lit(0), F.floor((F.col(a) + F.col(b)) / 2 / (F.when(F.col(size) > 0, F.col(size) / CELLS).otherwise(1.0))))).cast("int")
    rows = rows.where("x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL").withColumns({"gx": at("x0", "x1", "width"), "gy": at("y0", "y1", "height")})
    cells = rows.groupBy(page, "gx", "gy").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.first("width").alias("width"), F.first("height").alias("height"), F.count("*").alias("n"), F.count_if("curve").alias("curves"))
    cells = materialize(cells.withColumn("box", F.col("gx") * CELLS + F.col("gy")))
    around = F.explode(F.array(*(F.struct((F.col("gx") + i).alias("gx"), (F.col("gy") + j).alias("gy")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1)))))
    near = cells.select(page, "box", around.alias("to")).select(page, F.col("box").alias("own"), "to.*").join(cells.select(page, "gx", "gy", "box"), [page, "gx", "gy"])
    name = lambda c: F.struct(F.col(page).alias("p"), F.col(c).alias("box"))
    groups = components(near.select(name("own").alias("src"), name("box").alias("dst"))).select(F.col("node.p").alias(page), F.col("node.box").alias("box"), F.col("component.box").alias("into"))
    found = cells.join(groups, [page, "box"], "left").withColumn("box", F.coalesce("into", "box")).groupBy(page, "box").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.first("width").alias("width"), F.first("height").alias("height"), F.sum("n").alias("n"), F.sum("curves").alias("curves"))
    return found.where((F.col("n") >= STROKES) & (F.col("curves") >= CURVES))


def figure_regions(strokes: DataFrame, images: DataFrame, pages: DataFrame, page: str) -> DataFrame:
    """page, place (from 1, in the order of reading), x0, y0, x1, y1: the figures of pages (page, width, height) from images and strokes (page, x0, y0, x1, y1; curve).

    Images count if they take a share of the page between FIGURE's bounds, small ones only outside the margins at top and bottom. Clusters of strokes are
    merged with their neighbours; where the union is too large, those of its clusters that are not. One that an image mostly covers
    goes. Of what is left, overlapping boxes are merged. Pages without extent have none."""
    sized = pages.select(page, F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height")).where("width > 0 AND height > 0")
    share = area("x0", "y0", "x1", "y1") / (F.col("width") * F.col("height"))
    fits = share.between(*FIGURE)
    middle_y = (F.col("y0") + F.col("y1")) / 2
    central = middle_y.between(F.col("height") * MARGIN, F.col("height") * (1 - MARGIN)) | (share >= MARK)
    pictures = images.select(page, *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1"))).join(sized, page).where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) & fits & central)
    drawn = materialize(stroke_clusters(strokes, sized, page).drop("n", "curves"))
    unions = merged_boxes(drawn, page, neighbouring(), 0.5).drop("n")
    large = unions.where(~fits).select(page, F.struct("box", "x0", "y0", "x1", "y1").alias("b"))
    names = ["box", "x0", "y0", "x1", "y1", "width", "height"]
    parts = drawn.select(page, F.struct(*names).alias("a")).join(large, page).where(overlapping(0.5)()).select(page, "a.*")
    kept = unions.where(fits).select(page, *names).union(parts.where(fits).select(page, *names).distinct())
    held = kept.select(page, F.struct(*names).alias("a")).join(pictures.select(page, F.struct("x0", "y0", "x1", "y1").alias("b")), page).where(overlapping(0.6)()).select(page, F.col("a.box").alias("box"))
    kept = kept.join(held.distinct(), [page, "box"], "left_anti")
    every = kept.select(page, *names[1:]).union(pictures.select(page, *names[1:]))
    order = W.partitionBy(page).orderBy("y0", "x0", "y1", "x1")
    found = merged_boxes(every.withColumn("box", F.row_number().over(order)), page, overlapping(0.35))
    return found.select(page, F.row_number().over(W.partitionBy(page).orderBy(F.round(F.col("y0") / 8), "x0", "y0", "box")).alias("place"), "x0", "y0", "x1", "y1")


def sections_by_style(boxes: DataFrame, document: str) -> DataFrame:
    """document, ord, level, parent, page_start, page_end, title: the sections of documents' boxes in reading order (document, ord, text, size, bold, page); parent is the ord of the section above, null at the top.

    A heading is numbered, or larger than the most frequent size by a twentieth, or bold and under 80 characters; not blank, over 200 characters or a
    bullet. Its level is its number's depth, else the rank of its style (size, bold, capitals) among the document's headings. A section is below
    the last one of a lower level before it. Its pages are those of the boxes up to the next section, and of all sections below it."""
    text = stripped(F.coalesce("text", F.lit("")))
    rows = boxes.select(F.col(document).alias("d"), "ord", text.alias("text"), F.coalesce(F.col("size").cast("double"), F.lit(0.0)).alias("size"), F.coalesce("bold", F.lit(False)).alias("bold"), F.col("page").cast("long").alias("page"))
    # The most frequent size; of several, the one that comes first.
    sizes = rows.where("size > 0").groupBy("d", "size").agg(F.count("*").alias("n"), F.min("ord").alias("at")).groupBy("d").agg(F.max_by("size", F.struct("n", -F.col("at"))).alias("body"))
    rows = rows.join(sizes, "d", "left")
    depth, n = numbering_depth(F.col("text")), F.length("text")
    bullet = F.substring("text", 1, 1).isin(*"•·-*▪◦") & F.substring("text", 2, 1).isin(" ", "\t")
    heading = (n > 0) & (n <= 200) & ~bullet & (depth.isNotNull() | (F.col("size") > 1.05 * F.coalesce("body", F.lit(0.0))) | (F.col("bold") & (n < 80)))
    first = F.substring("text", 1, 40)
    capitals = (F.upper(first) == first) & (F.lower(first) != first)
    rows = materialize(rows.withColumns({"heading": heading, "depth": F.when(heading, depth), "style": F.struct((-F.bround("size")).alias("a"), (~F.col("bold")).alias("b"), (~capitals).alias("c"))}))
    rank = F.dense_rank().over(W.partitionBy("d").orderBy("style"))
    found = rows.where("heading").withColumn("level", F.coalesce("depth", rank).cast("int"))
    # The last heading before of each lower level, as an array by level: what a heading of a level closes are the entries from it on.
    before = W.partitionBy("d").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    listed = found.withColumn("seen", F.collect_list(F.struct("ord", "level")).over(before))
    # Above is the latest heading before of a lower level: any later one of a level not lower doesn't hold it, and nothing of a lower level came since.
    above = F.array_max(F.transform(F.filter("seen", lambda s: s["level"] < F.col("level")), lambda s: s["ord"]))
    own = materialize(listed.select("d", "ord", "level", above.alias("parent"), F.substring("text", 1, 300).alias("title")))
    within = rows.join(own.select("d", "ord", F.col("ord").alias("s")), ["d", "ord"], "left").withColumn("s", F.last("s", ignorenulls=True).over(W.partitionBy("d").orderBy("ord"))).where("s IS NOT NULL")
    pages = materialize(within.groupBy("d", "s").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end")))
    # Each section's pages go to all above it: one join for each level that there is.
    up = own.select("d", F.col("ord").alias("s"), "parent")
    level = every = pages
    while True:
        level = materialize(level.join(up, ["d", "s"]).where("parent IS NOT NULL").groupBy("d", F.col("parent").alias("s")).agg(F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end")))
        if level.isEmpty():
            break
        every = every.union(level)
    every = every.groupBy("d", "s").agg(F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"))
    return own.join(every.withColumnRenamed("s", "ord"), ["d", "ord"]).select(F.col("d").alias(document), "ord", "level", "parent", "page_start", "page_end", "title")


def spliced_figures(documents: DataFrame, figures: DataFrame) -> DataFrame:
    """doc_id, text of documents (doc_id, text) with their figures (doc_id, page, ord, snippet) behind the first marker of each page; those of pages without one at the end, by page, under a marker of their own. Null texts are empty; blank lines stand around each figure."""
    lists = figures.where("snippet IS NOT NULL").groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "snippet"))), lambda s: s["snippet"]), "\n\n").alias("shown"))
    by_page = lists.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("page").cast("long").alias("page"), "shown"))).alias("figures"))
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(by_page, "doc_id", "left")
    lines = F.split("text", "\n")
    number = lambda line: F.regexp_extract(line, r"^<!--\s*Page\s+(\d+)\s*-->\s*$", 1)
    marked = F.transform(lines, lambda x: F.struct(x.alias("line"), F.when(number(x) != "", number(x).try_cast("long")).alias("page")))
    pages = F.col("pages")
    own = lambda p: F.element_at(F.filter("figures", lambda f: f["page"] == p), 1)["shown"]
    rows = rows.withColumn("marked", marked).withColumn("pages", F.transform("marked", lambda m: m["page"]))
    put = F.transform("marked", lambda m, k: F.when(m["page"].isNotNull() & (F.array_position(pages, m["page"]) == k + 1) & F.exists("figures", lambda f: f["page"] == m["page"]), F.concat(m["line"], F.lit("\n\n"), own(m["page"]), F.lit("\n"))).otherwise(m["line"]))
    rest = F.filter("figures", lambda f: ~F.array_contains(F.filter(pages, lambda p: p.isNotNull()), f["page"]))
    tail = F.array_join(F.transform(rest, lambda f: F.concat(F.lit("\n<!-- Page "), f["page"].cast("string"), F.lit(" -->\n\n"), f["shown"])), "\n")
    return rows.select("doc_id", F.when(F.col("figures").isNull(), F.col("text")).otherwise(F.concat(F.array_join(put, "\n"), F.when(F.size(rest) > 0, F.concat(F.lit("\n"), tail)).otherwise(""))).alias("text"))
