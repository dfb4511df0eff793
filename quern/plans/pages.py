"""Queries over pages made of the rows of tables: lines of words, reading order, tables, figures, sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import chunking, geometry, retrieval
from quern.plans.documents import MARKDOWN, sheets, talks
from quern.plans.registry import QUERIES, query  # noqa: F401
from quern.sources.tables import materialize, table

#: A task has about so many lines of orders, as each becomes five words, which are sorted there.
SHEET_LINES = 400_000


def order_lines(spark, d, rows_a_task: int | None = None) -> DataFrame:
    """One row for each number of a line of an order: sheet, n, and fields as texts. Rows are dealt out by orders, so what goes by sheet needs no other shuffle.

    With rows_a_task there are as many tasks, by whole numbers of the cores, as leave each at most about so many rows."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_partkey", "l_suppkey", "l_quantity")
    cores = spark.sparkContext.defaultParallelism
    tasks = [cores * max(1, -(-lines.count() // (cores * rows_a_task)))] if rows_a_task else []
    lines = lines.repartition(*tasks, "l_orderkey")
    rows = lines.groupBy(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("n"))
    return rows.agg(F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"), F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"), F.min("l_quantity").cast("int").alias("quantity"))


def sheet_words(spark, d) -> DataFrame:
    """Each line of an order as five words, some a little lower, some far apart, some blank: sheet, word, x0, y0, x1, y1, text, size, bold."""
    rows = order_lines(spark, d, SHEET_LINES)
    texts = F.array("flag", F.concat("status", F.lit("-"), "status"), F.col("part").cast("string"), F.when(F.col("quantity") % 5 == 0, " ").otherwise("of"), F.col("quantity").cast("string"))
    words = rows.select("sheet", "n", "part", "supp", F.posexplode(texts).alias("k", "text"))
    x0 = (F.col("k") * 30 + F.when(F.col("k") >= 3, F.col("part") % 60).otherwise(0)).cast("double")
    y0 = F.col("n") * 7.0 + (F.col("k") * F.col("supp")) % 5
    return words.select("sheet", (F.col("n") * 10 + F.col("k")).alias("word"), x0.alias("x0"), y0.alias("y0"), (x0 + 24).alias("x1"), (y0 + 6).alias("y1"), "text", F.when(F.col("k") == 2, 0.0).otherwise(9.0).alias("size"), (F.col("k") < 2).alias("bold"))


@query()
def text_segments(spark, d):
    """Words of orders to lines and segments; tests compare it with plain loops."""
    return geometry.lines_of_words(sheet_words(spark, d), "sheet")


def sheet_boxes(spark, d) -> DataFrame:
    """Events of a user and day as boxes in two or three columns, those of sign-ups as wide ones: sheet, box, x0, y0, x1, y1."""
    rows = sheets(spark, d)
    x0 = F.when(F.col("event_type") == "signup", 0.0).otherwise((F.col("event_id") % F.when(F.col("sheet") % 2 == 0, 2).otherwise(3)) * 210.0)
    width = F.when(F.col("event_type") == "signup", 600.0).otherwise(180.0 + F.col("event_id") % 7)
    y0 = F.col("y").cast("double")
    return rows.select("sheet", F.col("event_id").alias("box"), x0.alias("x0"), y0.alias("y0"), (x0 + width).alias("x1"), (y0 + 10 + F.col("event_id") % 5).alias("y1"))


@query()
def column_order(spark, d):
    """The order of reading of columns under wide boxes; tests compare it with a plain recursion."""
    return geometry.cut_order(sheet_boxes(spark, d), "sheet")


def sheet_cells(spark, d) -> DataFrame:
    """Lines of orders as rows of a table of four columns: some cells reach over the next column or the next row, some are blank."""
    rows = order_lines(spark, d)
    texts = F.array(F.concat("flag", F.lit("<"), "status"), F.col("part").cast("string"), F.when(F.col("part") % 4 == 0, " ").otherwise("&"), F.col("quantity").cast("string"))
    cells = rows.select("sheet", "n", "part", "supp", F.posexplode(texts).alias("k", "text"))
    x0, y0 = F.col("k") * 60.0 + F.col("part") % 4, F.col("n") * 20.0 + F.col("supp") % 3
    width, height = F.when((F.col("part") % 5 == 0) & (F.col("k") == 1), 90.0).otherwise(30.0), F.when((F.col("part") % 7 == 0) & (F.col("k") == 0), 30.0).otherwise(10.0)
    return cells.select("sheet", (F.col("n") * 10 + F.col("k")).alias("box"), x0.alias("x0"), y0.alias("y0"), (x0 + width).alias("x1"), (y0 + height).alias("y1"), "text")


@query()
def table_markup(spark, d):
    """Tables with spans, from boxes; tests compare it with plain loops."""
    return geometry.table_html(sheet_cells(spark, d), "sheet")


@query()
def tables_found(spark, d):
    """Which boxes of orders stand in a table: some orders have rules, some curves."""
    cells = sheet_cells(spark, d)
    ends = cells.groupBy("sheet").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    rects = ends.where("sheet % 3 = 0")
    lines = ends.where("sheet % 3 = 1").select("sheet", "x0", F.explode(F.array("y0", "y1")).alias("y0"), "x1").select("sheet", "x0", "y0", "x1", F.col("y0").alias("y1"))
    curves = ends.where("sheet % 5 = 0").select("sheet", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"), "x0", "y0", "x1", "y1").drop("k")
    found = geometry.real_tables(cells, geometry.rulings(lines, rects, "sheet"), curves, "sheet")
    return found.select("sheet", "region", "box")


@query()
def grid_spans(spark, d):
    """Cells of orders, with edges drawn twice or a little off, in the grid that they make."""
    cells = sheet_cells(spark, d).select("sheet", F.col("box").alias("cell"), (F.col("x0") * 4).alias("x0"), (F.col("y0") * 4).alias("y0"), (F.col("x1") * 4).alias("x1"), (F.col("y1") * 4).alias("y1"))
    pages = cells.select("sheet").distinct().select("sheet", F.lit(1200.0).alias("width"), F.lit(1600.0).alias("height"))
    return geometry.grid_cells(cells, pages, "sheet")


def sheet_strokes(spark, d) -> DataFrame:
    """A user's events of a week as strokes of a page of 600 x 800, gathered around a few places, and as images: sheet, kind, x0, y0, x1, y1, curve."""
    s = F.unix_timestamp("ts")
    rows = table(spark, d, "events").select((F.col("user_id") * 1000 + F.floor(s / 604800) % 1000).alias("sheet"), "event_id", "event_type", F.floor(s % 86400 / 60).alias("minute"), "value")
    kind = F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 4 == 0), "image").otherwise("stroke")
    x0 = F.when(kind == "image", F.col("value") % 400).otherwise(F.col("sheet") % 3 * 170 + 40 + F.round(F.col("value") % 120))
    y0 = F.when(kind == "image", F.col("minute") / 2).otherwise(F.when(F.col("event_id") % 9 == 0, 650).otherwise(150) + F.col("minute") % 130)
    size = F.when(kind == "image", 90.0 + F.col("event_id") % 50).otherwise(8.0)
    x0, y0 = F.round(x0, 3).cast("double"), y0.cast("double")
    return rows.select("sheet", kind.alias("kind"), x0.alias("x0"), y0.alias("y0"), (x0 + size).alias("x1"), (y0 + size).alias("y1"), F.col("event_type").isin("click", "view").alias("curve"))


@query()
def figure_areas(spark, d):
    """The figures of pages of strokes and images; tests compare it with plain loops."""
    rows = materialize(sheet_strokes(spark, d))
    pages = rows.select("sheet").distinct().select("sheet", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    return geometry.figure_regions(rows.where("kind = 'stroke'"), rows.where("kind = 'image'"), pages, "sheet")


@query(r"""WITH boxes AS (SELECT conv_id, turn, role, text, turn * 2 AS ord, turn % 3 AS k, 'turn ' || role AS title FROM conversations),
  heads AS (SELECT conv_id, ord, turn, title, CASE WHEN turn % 3 = 0 THEN 1 ELSE 2 END AS own FROM boxes),
  ranked AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY own) AS level FROM heads),
  placed AS (SELECT *, max(CASE WHEN level = 1 THEN ord END) OVER (PARTITION BY conv_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above, lead(turn) OVER (PARTITION BY conv_id ORDER BY ord) AS nxt FROM ranked),
  ends AS (SELECT *, CASE WHEN level = 1 THEN coalesce(min(CASE WHEN level = 1 THEN turn END) OVER (PARTITION BY conv_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - 1, max(turn) OVER (PARTITION BY conv_id)) ELSE turn END AS last FROM placed)
SELECT conv_id, ord, level::INT AS level, CASE WHEN level > 1 THEN above END AS parent, turn + 1 AS page_start, last + 1 AS page_end, title FROM ends""")
def style_sections(spark, d):
    """Turns as sections by the size of their headings: every third one is larger than the two behind it."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role")
    head = turns.select("conv_id", (F.col("turn") * 2).alias("ord"), F.concat(F.lit("turn "), "role").alias("text"), F.when(F.col("turn") % 3 == 0, 18.0).otherwise(14.0).alias("size"), F.lit(True).alias("bold"), (F.col("turn") + 1).alias("page"))
    body = turns.select("conv_id", F.col("turn") * 2 + 1, F.lit("some words of the turn, which are no heading at all"), F.lit(10.0), F.lit(False), F.col("turn") + 1)
    return geometry.sections_by_style(head.union(body), "conv_id")


@query(rf"""WITH {MARKDOWN}, figure AS (SELECT conv_id, turn, '![' || role || '](f' || turn || ')' AS snippet FROM conversations WHERE turn % 2 = 0),
  parts2 AS (SELECT conv_id, turn, '## ' || role || ' ' || turn || e' ##\n<!-- Page ' || (turn + 1) || ' -->' || coalesce(e'\n\n' || snippet || e'\n', '') || e'\n' || text || e'\n\n' AS part FROM conversations LEFT JOIN figure USING (conv_id, turn))
SELECT conv_id AS doc_id, md5('# Talk ' || conv_id || e'\n\n' || string_agg(part, '' ORDER BY turn) || e'\n\n<!-- Page 999 -->\n\n![end](e)') AS text_md5 FROM parts2 GROUP BY conv_id""")
def figure_splices(spark, d):
    """Figures behind the page markers of every other turn, and one of a page that has none."""
    turns = table(spark, d, "conversations")
    shown = turns.where("turn % 2 = 0").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), F.lit(0).alias("ord"), F.concat(F.lit("!["), "role", F.lit("](f"), "turn", F.lit(")")).alias("snippet"))
    last = turns.select("conv_id").distinct().select("conv_id", F.lit(999), F.lit(0), F.lit("![end](e)"))
    return geometry.spliced_figures(talks(spark, d), shown.union(last)).select("doc_id", F.md5("text").alias("text_md5"))


@query(rf"""WITH {MARKDOWN}, md AS (SELECT conv_id, '# Talk ' || conv_id || e'\n\n' || string_agg(part, '' ORDER BY turn) AS text FROM placed GROUP BY conv_id),
  probes AS (SELECT conv_id, turn, strpos(md.text, substr(c.text, 1, 60)) - 1 AS pos, turn % 4 = 3 AS off FROM conversations c JOIN md USING (conv_id)),
  nodes AS (SELECT conv_id, char_start, char_start + length(part) AS char_end, 1 + row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS no FROM placed)
SELECT p.conv_id AS doc_id, turn AS ord, lpad(CASE WHEN any_value(off) THEN '0' ELSE coalesce(min(no), 1)::VARCHAR END, 4, '0') AS node
FROM probes p LEFT JOIN nodes n ON n.conv_id = p.conv_id AND pos >= char_start AND pos < char_end GROUP BY p.conv_id, turn""")
def probed_sections(spark, d):
    """Turns as chunks under a breadcrumb, linked to the sections of their conversation; of every fourth one the beginning isn't in it."""
    tree = chunking.tree_table(talks(spark, d), "title").select("doc_id", F.col("node_no").alias("node"), "depth", "char_start", "char_end")
    body = F.when(F.col("turn") % 4 == 3, F.concat(F.lit("~ "), "text")).otherwise(F.col("text"))
    chunks = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.concat(F.lit("Talk / turn\n"), body).alias("content"))
    return retrieval.probed(chunks, talks(spark, d), materialize(tree), skip=1)
