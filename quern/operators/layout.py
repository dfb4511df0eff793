"""Layout of pages and sheets: cells, points in boxes, lanes, signatures that repeat, tables as Markdown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# MIME types by extension, and the error codes of spreadsheets.
MIME = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".mp4": "video/mp4",
    ".mov": "video/quicktime",
    ".avi": "video/x-msvideo",
    ".webm": "video/webm",
    ".mkv": "video/x-matroska",
}
ERRORS = ["#REF!", "#NAME?", "#VALUE!", "#DIV/0!", "#N/A", "#NULL!", "#NUM!", "#SPILL!", "#CALC!", "#GETTING_DATA"]


def mime_of(name: Column) -> Column:
    """The MIME type of a file's name, by its extension in any case; null for others."""
    extension = F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))
    return reduce(lambda c, x: c.when(extension == x[0], x[1]), list(MIME.items())[1:], F.when(extension == ".pdf", MIME[".pdf"]))


def grid_markdown(cells: DataFrame, merged: DataFrame) -> DataFrame:
    """sheet, markdown: the cells (sheet, r, c, text) of each sheet as a table of pipes, the first row as header, without rows and columns that are empty.

    Of merged cells (sheet, r0, c0, r1, c1) only the first counts. Error codes and blanks are empty; bars are escaped."""
    text = F.trim("text")
    sound = cells.withColumn("text", text).where((F.col("text") != "") & ~F.col("text").isin(ERRORS))
    covered = merged.select("sheet", "r0", "c0", F.explode(F.sequence("r0", "r1")).alias("r"), "c1").select("sheet", "r0", "c0", "r", F.explode(F.sequence("c0", "c1")).alias("c"))
    shown = sound.join(covered.where("r <> r0 OR c <> c0").select("sheet", "r", "c"), ["sheet", "r", "c"], "left_anti")
    columns = shown.groupBy("sheet").agg(F.sort_array(F.collect_set("c")).alias("cs"))
    escaped = F.replace("text", F.lit("|"), F.lit("\\|"))
    rows = shown.groupBy("sheet", "r").agg(F.map_from_entries(F.collect_list(F.struct("c", escaped))).alias("row")).join(columns, "sheet")
    line = F.concat(F.lit("| "), F.array_join(F.transform("cs", lambda c: F.coalesce(F.element_at("row", c), F.lit(" "))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform("cs", lambda _: F.lit("---")), " | "), F.lit(" |"))
    lines = rows.groupBy("sheet").agg(F.sort_array(F.collect_list(F.struct("r", line.alias("line")))).alias("lines"), F.first(rule).alias("rule"))
    texts = F.transform("lines", lambda x: x["line"])
    return lines.select("sheet", F.array_join(F.concat(F.slice(texts, 1, 1), F.array("rule"), F.slice(texts, F.lit(2), F.size(texts))), "\n").alias("markdown"))


def placed(points: DataFrame, boxes: DataFrame, page: str) -> DataFrame:
    """page, point, box: the first box (box, x0, y0, x1, y1) of the page that holds a point (point, x, y), else the one whose centre is nearest; ties by box.

    Points and boxes meet by page; a page has as many as one can show."""
    met = points.join(boxes, page)
    holds = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    away = F.pow((F.col("x0") + F.col("x1")) / 2 - F.col("x"), F.lit(2)) + F.pow((F.col("y0") + F.col("y1")) / 2 - F.col("y"), F.lit(2))
    cost = F.struct(F.when(holds, 0).otherwise(1).alias("a"), F.when(holds, 0.0).otherwise(F.round(away, 6)).alias("b"), F.col("box").alias("c"))
    return met.groupBy(page, "point").agg(F.min_by("box", cost).alias("box"))


def snapped(ends: DataFrame, nodes: DataFrame, sheet: str) -> DataFrame:
    """sheet, edge, node: for each open end (edge, own, r, c) the nearest other node (node, r, c) of its sheet, a row counting as a hundred columns; ties by node."""
    met = ends.join(nodes.select(sheet, "node", F.col("r").alias("nr"), F.col("c").alias("nc")), sheet).where("node <> own")
    return met.groupBy(sheet, "edge").agg(F.min_by("node", F.struct(F.abs(F.col("nr") - F.col("r")) * 100 + F.abs(F.col("nc") - F.col("c")), "node")).alias("node"))


def laned(shapes: DataFrame, lanes: DataFrame, sheet: str) -> DataFrame:
    """shapes (sheet, shape, at) with lane: the last of the sheet's lanes (lane, start) that starts at or before it, the first one for shapes left of all. One sort of both; no join of ranges."""
    marks = lanes.select(sheet, F.col("start").alias("at"), "lane", F.lit(None).cast("long").alias("shape"), F.lit(0).alias("kind"))
    all_ = marks.union(shapes.select(sheet, "at", F.lit(None).cast(lanes.schema["lane"].dataType), "shape", F.lit(1)))
    order = W.partitionBy(sheet).orderBy("at", "kind", "lane")
    before = F.last("lane", ignorenulls=True).over(order)
    after = F.first("lane", ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))
    return all_.withColumn("found", F.coalesce(before, after)).where("kind = 1").select(sheet, "shape", F.col("found").alias("lane"))


def chrome(images: DataFrame, by: str, pages: int = 40, least: int = 4) -> DataFrame:
    """by, signature of images (by, page, signature) that stand on so many of the first pages: logos of headers and footers."""
    return images.where(F.col("page") <= pages).groupBy(by, "signature").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= least)


def modal(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, mode, share: the most frequent value of each group (the least of several) and its share of the rows."""
    counts = df.groupBy(F.col(by).alias("by"), F.col(value).alias("value")).agg(F.count("*").alias("times"))
    found = counts.groupBy("by").agg(F.max_by("value", F.struct("times", -F.col("value"))).alias("mode"), F.round(F.max("times") / F.sum("times"), 6).alias("share"))
    return found.withColumnRenamed("by", by)


def page_class(chars: Column, grid: Column) -> Column:
    """What a page is: digital with 24 characters or more, else a scanned table or scanned prose."""
    return F.when(chars >= 24, "digital").when(grid, "scanned_table").otherwise("scanned_prose")


def in_reading_order(boxes: DataFrame, page: str, height: float = 8.0) -> DataFrame:
    """boxes (page, box, x, y) with place, from 1: by rows of about a height, then from left to right."""
    order = W.partitionBy(page).orderBy(F.round(F.col("y") / height), "x", "box")
    return boxes.select(page, "box", F.row_number().over(order).cast("long").alias("place"))


def missing_units(kept: DataFrame, seen: DataFrame, by: str, least: int = 6) -> DataFrame:
    """by, unit of seen (by, page, unit) whose text, without white space and punctuation, isn't in kept (by, text); each once, with its first page. Short ones don't count."""
    # What doesn't count in a comparison.
    bare = lambda c: F.regexp_replace(c, r"[\s　，。、；：;:,.<>/|（）()【】\[\]\"'`*#\-—_·]+", "")
    units = seen.withColumn("bare", bare(F.replace("unit", F.lit("<br>"), F.lit("")))).where(F.length("bare") >= least)
    once = units.groupBy(by, "bare").agg(F.min(F.struct("page", "unit")).alias("first"))
    return once.join(kept.select(by, bare(F.col("text")).alias("hay")), by).where(~F.contains("hay", F.col("bare"))).select(by, "first.page", "first.unit")
