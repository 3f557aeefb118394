"""Queries of page geometry, over lines and boxes made of ``lineitem``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.adapters import table
from strandline.operators import geometry as G

Q, S = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


def _words(s, d):
    k = F.col("l_partkey")
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("cell"), (F.col("l_linenumber") * 5 + k % 4).cast("double").alias("top"), F.col("l_quantity").cast("double").alias("x0"), (F.col("l_quantity") + 8).cast("double").alias("x1"), F.concat(F.lit("w"), (k % 50).cast("string")).alias("text"), (k % 3 == 0).alias("bold"))


@query()
def word_lines(s, d):
    """Words of a cell to visual lines (tested by golden values)."""
    return G.word_lines(_words(s, d), "cell")


@query("""WITH l AS (SELECT l_orderkey AS cell, l_linenumber AS line, 't' || l_partkey AS text, l_partkey % 3 = 0 AS bold, l_partkey % 6 = 0 AS mixed FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity) = 1),
b AS (SELECT *, NOT bold OR mixed AS body FROM l), s AS (SELECT *, CASE WHEN bold AND coalesce(lag(body) OVER (PARTITION BY cell ORDER BY line), false) THEN 1 ELSE 0 END AS new FROM b), g AS (SELECT *, sum(new) OVER (PARTITION BY cell ORDER BY line) AS segment FROM s),
h AS (SELECT *, bold AND NOT coalesce(bool_or(body) OVER (PARTITION BY cell, segment ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS heading FROM g)
SELECT cell, CAST(segment AS INTEGER) AS segment, string_agg(text, chr(10) ORDER BY line) AS text, string_agg(text, chr(10) ORDER BY line) FILTER (WHERE heading) AS heading FROM h GROUP BY ALL""")
def cell_segments(s, d):
    one = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_quantity")
    k = F.col("l_partkey")
    rows = table(s, d, "lineitem").withColumn("r", F.row_number().over(one)).where("r = 1")
    return G.cell_segments(rows.select(F.col("l_orderkey").alias("cell"), F.col("l_linenumber").alias("line"), F.concat(F.lit("t"), k.cast("string")).alias("text"), (k % 3 == 0).alias("bold"), (k % 6 == 0).alias("mixed")), "cell")


_BOXES = """bx AS (SELECT l_suppkey % 20 AS doc, CAST(l_orderkey % 10 AS INTEGER) AS page, l_orderkey * 10 + l_linenumber AS box_id, CAST(l_quantity * 4 AS DOUBLE) AS x0, CAST(l_quantity * 4 + 60 AS DOUBLE) AS x1, CAST(l_partkey % 300 AS DOUBLE) AS y0, CAST(l_partkey % 300 + 12 AS DOUBLE) AS y1,
  CASE l_linenumber % 3 WHEN 0 THEN 'Title' WHEN 1 THEN 'text' ELSE 'figure' END AS kind, 'b' || l_partkey || '  x' AS text FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity, l_suppkey) = 1),
tb AS (SELECT s_suppkey % 20 AS doc, CAST(s_suppkey % 10 AS INTEGER) AS page, -s_suppkey AS table_id, 50.0::DOUBLE AS x0, 200.0::DOUBLE AS x1, 100.0::DOUBLE + s_suppkey % 90 AS y0, 300.0::DOUBLE AS y1 FROM supplier)"""


def _boxes(s, d):
    one = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_quantity", "l_suppkey")
    n, q, y = F.col("l_linenumber"), F.col("l_quantity") * 4, (F.col("l_partkey") % 300).cast("double")
    rows = table(s, d, "lineitem").withColumn("r", F.row_number().over(one)).where("r = 1")
    boxes = rows.select((F.col("l_suppkey") % 20).alias("doc"), (F.col("l_orderkey") % 10).cast("int").alias("page"), (F.col("l_orderkey") * 10 + n).alias("box_id"), q.cast("double").alias("x0"), (q + 60).cast("double").alias("x1"), y.alias("y0"), (y + 12).alias("y1"), F.when(n % 3 == 0, "Title").when(n % 3 == 1, "text").otherwise("figure").alias("kind"), F.concat(F.lit("b"), F.col("l_partkey").cast("string"), F.lit("  x")).alias("text"))
    k = F.col("s_suppkey")
    return boxes, table(s, d, "supplier").select((k % 20).alias("doc"), (k % 10).cast("int").alias("page"), (-k).alias("table_id"), F.lit(50.0).alias("x0"), F.lit(200.0).alias("x1"), (F.lit(100.0) + k % 90).alias("y0"), F.lit(300.0).alias("y1"))


@query(f"""WITH {_BOXES}, c AS (SELECT table_id, b.y0, b.y1, box_id, regexp_replace(text, '\\s+', ' ', 'g') AS text FROM tb t JOIN bx b ON b.doc = t.doc AND b.page = t.page AND lower(kind) <> 'figure' AND b.y1 <= t.y0 + 2 AND t.y0 - b.y1 <= 48 AND greatest(0, least(t.x1, b.x1) - greatest(t.x0, b.x0)) / least(t.x1 - t.x0, b.x1 - b.x0) >= 0.35),
r AS (SELECT *, row_number() OVER w AS n, lag(y0) OVER w AS below FROM c WINDOW w AS (PARTITION BY table_id ORDER BY y1 DESC, box_id)) SELECT table_id, string_agg(text, chr(10) ORDER BY n DESC) AS caption FROM r WHERE n = 1 OR (n = 2 AND below - y1 <= 18) GROUP BY table_id""")
def table_captions(s, d):
    boxes, tables = _boxes(s, d)
    return G.captions(tables, boxes)


_DIGITAL = """dt AS (SELECT s_suppkey AS table_id, s_suppkey % 4 AS doc, 1 AS page, 0.0::DOUBLE AS x0, 100.0::DOUBLE + s_suppkey % 7 * 10 AS x1, s_suppkey * 50.0::DOUBLE AS y0, s_suppkey * 50.0::DOUBLE + 60 AS y1, s_suppkey % 3 + 1 AS columns, s_name || ' alpha beta' AS text FROM supplier),
dg AS (SELECT table_id + 1000 AS digital_id, doc, page, x0, 110.0::DOUBLE AS x1, y0 + 5 AS y0, y1, CASE WHEN table_id % 5 = 0 THEN 9 ELSE columns END AS columns, CASE WHEN table_id % 6 = 0 THEN 'other words here and more' ELSE upper(text) END AS text FROM dt)"""


@query(f"""WITH {_DIGITAL}, o AS (SELECT table_id, digital_id, d.columns AS dc, g.columns AS gc, d.text AS dt, g.text AS gt, greatest(0, least(d.x1, g.x1) - greatest(d.x0, g.x0)) * greatest(0, least(d.y1, g.y1) - greatest(d.y0, g.y0)) AS inter, (d.x1 - d.x0) * (d.y1 - d.y0) + (g.x1 - g.x0) * (g.y1 - g.y0) AS total FROM dt d JOIN dg g ON g.doc = d.doc AND g.page = d.page),
b AS (SELECT *, inter / (total - inter) AS overlap FROM o WHERE inter > 0 QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY inter / (total - inter) DESC, digital_id) = 1),
w AS (SELECT table_id, w, count(*) AS n FROM (SELECT table_id, unnest(regexp_extract_all(lower(dt), '[\\p{{L}}\\p{{N}}]+')) AS w FROM b) GROUP BY ALL), v AS (SELECT table_id, w, count(*) AS m FROM (SELECT table_id, unnest(regexp_extract_all(lower(gt), '[\\p{{L}}\\p{{N}}]+')) AS w FROM b) GROUP BY ALL),
c AS (SELECT table_id, sum(length(w) * least(n, coalesce(m, 0))) / sum(length(w) * n) AS coverage FROM w LEFT JOIN v USING (table_id, w) GROUP BY table_id)
SELECT table_id, digital_id, round(overlap, 6) AS overlap, round(coverage, 6) AS coverage, overlap >= 0.75 AND dc = gc AND coverage >= 0.72 AND length(regexp_replace(gt, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= floor(length(regexp_replace(dt, '[^\\p{{L}}\\p{{N}}]', '', 'g')) * 0.75) AS replaced FROM b JOIN c USING (table_id)""")
def table_replacements(s, d):
    k = F.col("s_suppkey")
    y = (k * 50).cast("double")
    t = table(s, d, "supplier").select(k.alias("table_id"), (k % 4).alias("doc"), F.lit(1).alias("page"), F.lit(0.0).alias("x0"), (F.lit(100.0) + k % 7 * 10).alias("x1"), y.alias("y0"), (y + 60).alias("y1"), (k % 3 + 1).alias("columns"), F.concat("s_name", F.lit(" alpha beta")).alias("text"))
    n = F.col("table_id")
    g = t.select((n + 1000).alias("digital_id"), "doc", "page", "x0", F.lit(110.0).alias("x1"), (F.col("y0") + 5).alias("y0"), "y1", F.when(n % 5 == 0, 9).otherwise(F.col("columns")).alias("columns"), F.when(n % 6 == 0, "other words here and more").otherwise(F.upper("text")).alias("text"))
    return G.replacements(t, g)


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN NULL WHEN 2 THEN p_brand || chr(10) || p_name ELSE p_name END AS heading FROM part""")
def cell_headings(s, d):
    """Headings that repeat their column's header not at all, alone, after another line, or twice."""
    n = F.col("p_size") % 4
    two = F.concat_ws("\n", "p_brand", "p_type")
    own = F.when(n == 0, F.col("p_name")).when(n == 1, two).when(n == 2, F.concat_ws("\n", "p_brand", "p_name")).otherwise(F.concat_ws("\n", two, F.concat(F.lit("  "), two), "p_name"))
    return table(s, d, "part").select("p_partkey", G.cell_heading(own, two).alias("heading"))


@query()
def merged_titles(s, d):
    """Fragments of titles on made-up pages (tested by golden values)."""
    boxes, _ = _boxes(s, d)
    n = F.row_number().over(Window.partitionBy("doc", "page").orderBy("y0", "x0", "box_id"))
    return G.merge_titles(boxes.select("doc", "page", n.alias("n"), "kind", "text", "x0", "x1", "y0", "y1", F.lit(False).alias("named")))


@query("""WITH x AS (SELECT l_orderkey AS doc, l_linenumber AS n, l_partkey % 6 AS k, 't' || l_partkey AS text FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity) = 1),
s AS (SELECT doc, n, n * 10 AS body, 0 AS part, k, text, count(*) FILTER (WHERE k < 2) OVER (PARTITION BY doc ORDER BY n) AS nth FROM x),
b AS (SELECT doc, n, body, part, CASE WHEN k < 2 AND nth = 1 THEN 'TITLE' WHEN k < 3 THEN 'HEADING' WHEN k = 3 THEN 'LIST_ITEM' ELSE 'PARAGRAPH' END AS kind, CASE WHEN k < 2 AND nth > 1 THEN 1 WHEN k = 2 THEN 4 END AS level, text, CASE WHEN k < 2 AND nth > 1 THEN 'DOCUMENT_TITLE_FLATTENED' END AS warning FROM s
  UNION ALL SELECT doc, n, 25, 1, 'TABLE_CELL', NULL, 'cell ' || n, 'TABLE_STRUCTURE_FLATTENED' FROM x WHERE n % 2 = 0)
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY body, part, n) - 1 AS position, kind, CAST(level AS INTEGER) AS level, text, warning FROM b""")
def styled_blocks(s, d):
    one = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_quantity")
    k, n = F.col("l_partkey") % 6, F.col("l_linenumber")
    rows = table(s, d, "lineitem").withColumn("r", F.row_number().over(one)).where("r = 1")
    style = F.when(k == 0, " Title ").when(k == 1, "文档标题").when(k == 2, "Heading 4 Char").when(k == 3, "List Bullet").when(k == 4, "Normal")
    sections = rows.select(F.col("l_orderkey").alias("doc"), n.alias("n"), style.alias("style"), F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("text"), (n * 10).alias("body"))
    cells = rows.where(n % 2 == 0).select(F.col("l_orderkey").alias("doc"), n.alias("n"), F.concat(F.lit("cell "), n.cast("string")).alias("text"), F.lit(25).alias("body"))
    return G.styled_blocks(sections, cells)


@query("""WITH w AS (
  SELECT l_orderkey AS table_id, l_linenumber AS line, CAST(l_quantity AS DOUBLE) / 2 AS x0, CAST(l_quantity AS DOUBLE) / 2 + 15 AS x1, 'l' || l_partkey AS text FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) / 2 + 55, CAST(l_quantity AS DOUBLE) / 2 + 65, 'r' || l_suppkey FROM lineitem WHERE l_partkey % 8 > 0
  UNION ALL SELECT l_orderkey, l_linenumber, 45, 56, 'over' FROM lineitem WHERE l_partkey % 97 = 0),
n AS (SELECT l_orderkey AS table_id, count(DISTINCT l_linenumber) AS lines FROM lineitem GROUP BY l_orderkey),
us AS (SELECT o_orderkey AS table_id, lines FROM orders JOIN n ON n.table_id = o_orderkey WHERE o_orderkey % 5 > 0 AND o_orderkey % 4 > 0 AND lines >= 4),
sd AS (SELECT w.*, lines, x0 < 50 AND 50 < x1 AS crosses, CASE WHEN (x0 + x1) / 2 < 50 THEN 0 ELSE 1 END AS col FROM w JOIN us ON us.table_id = w.table_id),
rw AS (SELECT table_id, line, col, string_agg(text, ' ' ORDER BY x0, text) AS text, bool_or(crosses) AS crosses, max(lines) AS lines FROM sd GROUP BY table_id, line, col),
pl AS (SELECT table_id, line, count(*) = 2 AS paired, bool_or(crosses) AS crosses, max(lines) AS lines FROM rw GROUP BY table_id, line),
gd AS (SELECT table_id FROM pl GROUP BY table_id HAVING NOT bool_or(crosses) AND count(*) FILTER (WHERE paired) >= greatest(3, (max(lines) + 2) // 3))
SELECT rw.table_id, line AS "row", col AS "column", text FROM rw JOIN gd ON gd.table_id = rw.table_id""")
def two_column_tables(s, d):
    """Orders as tables of two columns; some have too few rows or sides, or a word across the separator."""
    l, x = table(s, d, "lineitem"), F.col("l_quantity").cast("double") / 2
    at = [F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("line")]
    word = lambda x0, x1, text: [*at, x0.alias("x0"), x1.alias("x1"), text.alias("text")]
    left = l.select(*word(x, x + 15, F.concat(F.lit("l"), F.col("l_partkey").cast("string"))))
    right = l.where("l_partkey % 8 > 0").select(*word(x + 55, x + 65, F.concat(F.lit("r"), F.col("l_suppkey").cast("string"))))
    over = l.where("l_partkey % 97 = 0").select(*word(F.lit(45.0), F.lit(56.0), F.lit("over")))
    k = F.col("o_orderkey")
    separators = table(s, d, "orders").select(k.alias("table_id"), F.lit(50.0).alias("x"), F.when(k % 5 > 0, 2).otherwise(3).alias("columns"), (k % 4 + 2).alias("rows"))
    return G.two_columns(l.select(*at), left.unionAll(right).unionAll(over), separators)


@query()
def glyph_lines(s, d):
    """Words of the geometry queries as glyphs of a page (tested by golden values)."""
    w = _words(s, d)
    glyphs = w.select("cell", F.col("top").alias("y"), F.col("x0").alias("x"), (F.col("x1") - F.col("x0")).alias("width"), F.lit(8.0).alias("height"), F.lit(10.0).alias("font_size"), F.when(F.col("bold"), "Serif-Bold").otherwise("Serif").alias("font"), "text", F.lit(100.0).alias("page_width"))
    return G.glyph_lines(glyphs, "cell")


QUERIES, SQL = Q, S
