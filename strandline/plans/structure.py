"""Queries of canonical assembly and layout. Blocks: lines of documents, short ones are headings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.adapters import dealt, table
from strandline.operators import canonical as C
from strandline.operators import layout as L

Q, S = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


@query(r"""WITH p AS (SELECT doc_id, replace(text, '.' || chr(10), chr(10) || chr(10)) AS t FROM documents), l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS n FROM p),
g AS (SELECT *, sum(CASE WHEN regexp_matches(line, '\S') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS island FROM l)
SELECT doc_id, min(n) AS start_line, max(n) AS end_line, md5(string_agg(line, chr(10) ORDER BY n)) AS digest FROM g WHERE regexp_matches(line, '\S') GROUP BY doc_id, island""")
def txt_paragraphs(s, d):
    t = F.replace(F.col("text"), F.lit(".\n"), F.lit("\n\n"))
    rows = table(s, d, "documents").select("doc_id", F.explode(C.paragraphs(t)).alias("p"))
    return rows.select("doc_id", "p.start_line", "p.end_line", F.md5("p.text").alias("digest"))


def _parsed(s, d):
    lines = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("src", "text"))
    short = F.size(F.split(F.trim("text"), " ")) <= 6
    return lines.select("doc_id", "src", F.when(short, "HEADING").otherwise("PARAGRAPH").alias("kind"), (F.length("text") % 6 + 1).alias("level"), "text")


BLOCKS = r"""pl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(0, len(string_split(text, chr(10))))) AS src FROM documents),
pk AS (SELECT doc_id, src, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS text, CASE WHEN len(string_split(trim(raw), ' ')) <= 6 THEN length(raw) % 6 + 1 END AS level FROM pl),
blocks AS (SELECT doc_id, src, row_number() OVER w - 1 AS ordinal, level, text, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM pk WHERE text <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY src))"""


@query(f"""WITH {BLOCKS} SELECT doc_id, CAST(doc_id AS VARCHAR) || ':b:' || lpad(CAST(ordinal AS VARCHAR), 6, '0') AS block_id, ordinal, CASE WHEN level IS NULL THEN 'PARAGRAPH' ELSE 'HEADING' END AS kind, start, start + length(text) AS end,
coalesce((SELECT max(h.ordinal) FROM blocks h WHERE h.doc_id = b.doc_id AND h.ordinal <= b.ordinal AND h.level IS NOT NULL), -1) AS heading FROM blocks b""")
def canonical_blocks(s, d):
    return C.assemble(_parsed(s, d)).select("doc_id", "block_id", "ordinal", "kind", "start", "end", "heading")


TREE = """h AS (SELECT doc_id, ordinal AS pos, level, text AS title FROM blocks WHERE level IS NOT NULL),
nb AS (SELECT doc_id, max(ordinal) + 1 AS n FROM blocks GROUP BY doc_id),
par AS (SELECT a.doc_id, a.pos, any_value(a.level) AS level, any_value(a.title) AS title, coalesce(max(b.pos), -1) AS parent FROM h a LEFT JOIN h b ON b.doc_id = a.doc_id AND b.pos < a.pos AND b.level < a.level GROUP BY a.doc_id, a.pos),
ends AS (SELECT a.doc_id, a.pos, least(coalesce(min(b.pos), 1000000000), any_value(nb.n)) AS section_end FROM h a JOIN nb USING (doc_id) LEFT JOIN h b ON b.doc_id = a.doc_id AND b.pos > a.pos AND b.level <= a.level GROUP BY a.doc_id, a.pos),
walk AS (SELECT doc_id, pos, 1 AS depth, title AS path FROM par WHERE parent = -1 UNION ALL SELECT p.doc_id, p.pos, w.depth + 1, w.path || ' > ' || p.title FROM par p JOIN walk w ON w.doc_id = p.doc_id AND w.pos = p.parent)"""


@query(f"""WITH RECURSIVE {BLOCKS}, {TREE} SELECT doc_id, pos, level, title, parent, depth, section_end, path, row_number() OVER (PARTITION BY doc_id, parent ORDER BY pos) - 1 AS sibling FROM par JOIN ends USING (doc_id, pos) JOIN walk USING (doc_id, pos)""")
def heading_tree(s, d):
    return C.heading_tree(C.assemble(_parsed(s, d)))


@query(f"""WITH {BLOCKS} SELECT doc_id, count(*) AS n_blocks, count(level) AS n_headings, max(start + length(text)) AS text_length, sha256(string_agg(text, chr(10) || chr(10) ORDER BY ordinal)) AS text_sha256 FROM blocks GROUP BY doc_id""")
def canonical_manifest(s, d):
    return C.manifest(C.assemble(_parsed(s, d)))


@query(f"""WITH RECURSIVE {BLOCKS}, {TREE} SELECT p.doc_id, 'HEADING_LEVEL_JUMP' AS code, p.pos FROM par p LEFT JOIN par q ON q.doc_id = p.doc_id AND q.pos = p.parent WHERE p.level > coalesce(q.level, 0) + 1
UNION ALL SELECT doc_id, 'NO_REAL_HEADINGS', NULL FROM blocks GROUP BY doc_id HAVING count(level) = 0""")
def canonical_warnings(s, d):
    blocks = C.assemble(_parsed(s, d))
    return C.warnings(C.heading_tree(blocks), blocks)


@query(f"""WITH {BLOCKS}, x AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 AND ordinal >= 2 THEN ordinal + 1 ELSE ordinal END AS ordinal, start + CASE WHEN doc_id % 7 = 0 AND ordinal = 1 THEN 1 ELSE 0 END AS start, start + length(text) AS end FROM blocks),
y AS (SELECT *, row_number() OVER w - 1 AS want, lag("end") OVER w AS last FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal, start))
SELECT doc_id, rule, count(*) AS n FROM (SELECT doc_id, 'ORDINAL_NOT_DENSE' AS rule FROM y WHERE ordinal <> want UNION ALL SELECT doc_id, 'RANGE_NOT_CONTIGUOUS' FROM y WHERE start <> coalesce(last + 2, 0) UNION ALL SELECT doc_id, 'RANGE_NEGATIVE' FROM y WHERE "end" < start) GROUP BY ALL""")
def canonical_violations(s, d):
    k, o = F.col("doc_id"), F.col("ordinal")
    spoilt = C.assemble(_parsed(s, d)).select("doc_id", "block_id", F.when((k % 9 == 0) & (o >= 2), o + 1).otherwise(o).alias("ordinal"), (F.col("start") + F.when((k % 7 == 0) & (o == 1), 1).otherwise(0)).alias("start"), "end")
    return C.violations(spoilt)


@query(f"""WITH RECURSIVE {BLOCKS}, {TREE} SELECT b.doc_id, b.ordinal, e.pos, w.depth FROM blocks b JOIN ends e ON e.doc_id = b.doc_id AND b.ordinal >= e.pos AND b.ordinal < e.section_end JOIN walk w ON w.doc_id = e.doc_id AND w.pos = e.pos""")
def blocks_in_sections(s, d):
    return C.in_sections(C.assemble(_parsed(s, d)))


_PIECES = """el AS (SELECT doc_id, src, row_number() OVER (PARTITION BY doc_id ORDER BY src) - 1 AS element, text, level FROM blocks),
pc AS (SELECT doc_id, element, level, text, length(text) > 120 AS long FROM el)"""


@query(f"""WITH {BLOCKS}, {_PIECES} SELECT doc_id, CASE WHEN long THEN CAST(doc_id AS VARCHAR) || ':c:' || lpad(CAST(element AS VARCHAR), 6, '0') END AS continuation, long, md5(regexp_replace(text, '\\s', '', 'g')) AS digest FROM pc""")
def continuation_groups(s, d):
    """Elements of more than 120 characters cut into blocks, put together again by their groups."""
    blocks = C.assemble(_parsed(s, d), 120)
    key = F.coalesce("continuation", F.col("block_id"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "")
    grouped = blocks.groupBy("doc_id", key.alias("key")).agg(F.max("continuation").alias("continuation"), (F.count(F.lit(1)) > 1).alias("long"), text.alias("t"))
    return grouped.select("doc_id", "continuation", "long", F.md5(F.regexp_replace("t", r"\s", "")).alias("digest"))


@query(f"""WITH {BLOCKS}, n AS (SELECT doc_id, count(*) AS n FROM blocks WHERE doc_id % 10 <> 3 GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_blocks, CASE WHEN n IS NULL THEN CASE WHEN d.doc_id % 20 = 3 THEN 'PDF_NO_EXTRACTABLE_TEXT' ELSE 'DOCUMENT_CORRUPT' END WHEN n > 8 THEN 'DOCUMENT_PARSE_LIMIT_EXCEEDED' END AS error FROM documents d LEFT JOIN n USING (doc_id)""")
def document_errors(s, d):
    k = F.col("doc_id")
    documents = table(s, d, "documents").select("doc_id", F.when(k % 20 == 3, "PDF").otherwise("TXT").alias("format"))
    return C.document_errors(documents, C.assemble(_parsed(s, d)).where(k % 10 != 3), 8)


@query("""SELECT doc_id, doc_id % 4 <> 1 AND doc_id % 4 <> 2 AS same_text, doc_id % 4 <> 2 AS same_letters FROM documents WHERE length(regexp_replace(text, '\\s', '', 'g')) > 0""")
def text_preservation(s, d):
    """Texts whose lines are re-wrapped, or also moved, or also changed."""
    docs = table(s, d, "documents").where(F.rlike("text", F.lit(r"\S")))
    k, t = F.col("doc_id"), F.col("text")
    before = docs.select("doc_id", F.lit(0).alias("position"), F.concat(F.lit("~"), t).alias("text"))
    after = F.when(k % 4 == 0, F.array(F.concat(F.lit("~ "), t))).when(k % 4 == 1, F.array(t, F.lit("~"))).when(k % 4 == 2, F.array(F.lit("~"), F.concat(t, F.lit("x")))).otherwise(F.array(F.lit("~"), F.replace(t, F.lit(" "), F.lit("\n"))))
    return C.text_preserved(before, docs.select("doc_id", F.posexplode(after).alias("position", "text")))


@query(f"""WITH RECURSIVE {BLOCKS}, {TREE}, n AS (SELECT doc_id, count(*) AS blocks, count(level) AS heads FROM blocks GROUP BY doc_id)
SELECT doc_id, rule, n FROM (
  SELECT doc_id, 'TEXT_MISMATCH' AS rule, 1 AS n FROM n WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, 'NOT_ONE_ROOT', 1 FROM n WHERE doc_id % 6 = 0
  UNION ALL SELECT doc_id, 'NO_SOURCE_BLOCK', heads FROM n WHERE doc_id % 7 = 0 AND heads > 0
  UNION ALL SELECT doc_id, 'BAD_SECTION', heads FROM n WHERE doc_id % 8 = 0 AND heads > 0
  UNION ALL SELECT p.doc_id, 'PARENT_AFTER_CHILD', count(*) FROM par p WHERE (p.doc_id % 6 = 0 AND p.parent = -1) OR (p.doc_id % 9 = 0 AND p.parent <> -1) GROUP BY p.doc_id
  UNION ALL SELECT b.doc_id, 'UNKNOWN_HEADING', count(*) FROM blocks b WHERE b.doc_id % 6 = 0 AND NOT EXISTS (SELECT 1 FROM blocks h WHERE h.doc_id = b.doc_id AND h.ordinal <= b.ordinal AND h.level IS NOT NULL) GROUP BY b.doc_id)""")
def structure_violations(s, d):
    """Documents whose manifest, root, source blocks, sections or heading order are spoilt."""
    k = F.col("doc_id")
    blocks = C.assemble(_parsed(s, d)).withColumnRenamed("heading", "node")
    tree = C.heading_tree(blocks.withColumnRenamed("node", "heading"))
    real = tree.select("doc_id", F.when(k % 9 == 0, -F.col("pos")).otherwise(F.col("pos") + 1).alias("n"), F.col("pos").alias("node"), "parent", "level", "depth", F.col("pos").alias("section_start"), F.when(k % 8 == 0, F.lit(1 << 29)).otherwise(F.col("section_end")).alias("section_end"), F.when(k % 7 != 0, F.col("pos")).alias("source"))
    null = F.lit(None).cast("int")
    ends = blocks.groupBy("doc_id").agg((F.max("ordinal") + 1).alias("e"))
    roots = ends.where(k % 6 != 0).select("doc_id", F.lit(-(1 << 29)).alias("n"), F.lit(-1).alias("node"), null.alias("parent"), F.lit(0).alias("level"), F.lit(0).alias("depth"), F.lit(0).alias("section_start"), F.col("e").alias("section_end"), null.alias("source"))
    stated = C.manifest(blocks).select("doc_id", "text_length", F.when(k % 5 == 0, "other").otherwise(F.col("text_sha256")).alias("text_sha256"))
    return C.structure_violations(blocks, real.unionByName(roots), stated)


@query(f"""WITH {BLOCKS}, b AS (SELECT *, coalesce((SELECT max(h.ordinal) FROM blocks h WHERE h.doc_id = x.doc_id AND h.ordinal <= x.ordinal AND h.level IS NOT NULL), -1) AS heading FROM blocks x)
SELECT a.doc_id, a.ordinal AS anchor, b.ordinal, CAST(b.doc_id AS VARCHAR) || ':b:' || lpad(CAST(b.ordinal AS VARCHAR), 6, '0') AS block_id FROM b a JOIN b ON b.doc_id = a.doc_id AND b.heading = a.heading AND abs(b.ordinal - a.ordinal) <= 3 WHERE a.ordinal % 10 = 5""")
def block_neighbours(s, d):
    blocks = C.assemble(_parsed(s, d))
    return C.neighbours(blocks, blocks.where("ordinal % 10 = 5"))


@query(f"""WITH {BLOCKS}, b AS (SELECT *, coalesce((SELECT max(h.ordinal) FROM blocks h WHERE h.doc_id = x.doc_id AND h.ordinal <= x.ordinal AND h.level IS NOT NULL), -1) AS heading FROM blocks x),
m AS (SELECT *, CASE WHEN lag(ordinal) OVER w IS NULL OR ordinal <> lag(ordinal) OVER w + 1 OR heading <> lag(heading) OVER w THEN 1 ELSE 0 END AS new FROM b WHERE ordinal % 4 <> 0 WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ordinal) AS g FROM m) SELECT doc_id, g, min(ordinal) AS first, max(ordinal) AS last, count(*) AS n FROM g GROUP BY doc_id, g""")
def evidence_groups(s, d):
    return C.evidence_groups(C.assemble(_parsed(s, d)).where("ordinal % 4 <> 0"))


LINES = """ln AS (SELECT l_suppkey AS doc, CAST(l_orderkey % 12 AS INTEGER) AS page, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS line, ((l_partkey * 7 + l_orderkey) % 1000) / 1000.0::DOUBLE AS y, 0.012::DOUBLE AS height, 8 + (l_partkey % 13) / 2.0::DOUBLE AS font, l_returnflag = 'A' AS bold, l_linenumber >= 6 AS large_gap, 'T' || CAST(l_partkey % 30 AS VARCHAR) || CASE WHEN l_linenumber = 1 THEN '.' ELSE ' x' END AS text FROM lineitem),
body AS (SELECT doc, arg_max(size, (w, -size)) AS body FROM (SELECT doc, round(font * 2) / 2 AS size, sum(greatest(1, length(text))) AS w FROM ln GROUP BY ALL) GROUP BY doc)"""


def _lines(s, d, numbered=True):
    """Without numbers no line need go to its document's others: for what is counted by document."""
    k = F.col("l_partkey")
    rows = table(s, d, "lineitem").select(F.col("l_suppkey").alias("doc"), "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_returnflag") == "A").alias("bold"))
    if numbered:
        # by the column that later steps take, so that one shuffle serves them too
        order = Window.partitionBy("doc").orderBy("l_orderkey", "l_linenumber", "l_partkey")
        rows = dealt(rows, "doc").withColumn("line", F.row_number().over(order))
    return rows.select(
        "doc", (F.col("l_orderkey") % 12).cast("int").alias("page"), *["line"] * numbered, ((k * 7 + F.col("l_orderkey")) % 1000 / 1000.0).alias("y"), F.lit(0.012).alias("height"),
        (8 + k % 13 / 2.0).alias("font"), "bold", (F.col("l_linenumber") >= 6).alias("large_gap"), F.concat(F.lit("T"), (k % 30).cast("string"), F.when(F.col("l_linenumber") == 1, ".").otherwise(" x")).alias("text"),
    )


@query(f"WITH {LINES} SELECT doc, page, count(*) FILTER (WHERE large_gap) AS n FROM ln GROUP BY ALL HAVING n >= 3")
def complex_pages(s, d):
    return L.complex_pages(_lines(s, d, False))


@query(f"""WITH {LINES}, p AS (SELECT doc, count(DISTINCT page) AS pages FROM ln GROUP BY doc), e AS (SELECT doc, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS key, count(DISTINCT page) AS n FROM ln WHERE y <= 0.12 OR y >= 0.88 GROUP BY ALL)
SELECT doc, key, n FROM e JOIN p USING (doc) WHERE n >= greatest(2, ceil(pages / 2.0))""".replace("\\\\", "\\"))
def repeated_margins(s, d):
    return L.repeated_margins(_lines(s, d, False))


@query(f"WITH {LINES} SELECT * FROM body")
def dominant_font(s, d):
    return L.dominant_font(_lines(s, d, False))


@query(f"""WITH {LINES}, g AS (SELECT *, y - lag(y) OVER (PARTITION BY doc, page ORDER BY y, line) AS gap FROM ln JOIN body USING (doc)),
f AS (SELECT * FROM g WHERE length(trim(text)) BETWEEN 2 AND 160 AND NOT regexp_matches(trim(text), '[.。;；,，!?！？]$') AND (font >= 1.25 * body OR (bold AND font >= 1.05 * body)) AND (gap IS NULL OR gap >= 0.8 * height))
SELECT doc, page, line, text, least(6, dense_rank() OVER (PARTITION BY doc ORDER BY round(font * 2) / 2 DESC)) AS level FROM f""")
def visible_headings(s, d):
    return L.headings(_lines(s, d), _lines(s, d, False))


@query(f"""WITH {LINES} SELECT doc, arg_min(text, (-font, y, line)) AS title FROM ln JOIN body USING (doc) JOIN (SELECT doc, min(page) AS page FROM ln GROUP BY doc) USING (doc, page) WHERE y < 0.55 AND font >= 1.55 * body AND length(text) <= 200 GROUP BY doc""")
def document_titles(s, d):
    return L.titles(_lines(s, d), _lines(s, d, False))


@query(f"""WITH {LINES}, m AS (SELECT *, CASE WHEN y - lag(y) OVER w <= greatest(1.45 * font / 1000, 1.6 * height) THEN 0 ELSE 1 END AS new FROM ln WINDOW w AS (PARTITION BY doc, page ORDER BY y, line)), p AS (SELECT *, sum(new) OVER (PARTITION BY doc, page ORDER BY y, line) AS p FROM m)
SELECT doc, page, p, string_agg(text, ' ' ORDER BY y, line) AS text, count(*) AS n FROM p GROUP BY doc, page, p""")
def layout_paragraphs(s, d):
    return L.assemble_paragraphs(_lines(s, d))


_HINTS = """hint AS (SELECT doc, lower(text) AS key, CASE WHEN page % 2 = 0 THEN page END AS pg, page % 4 + 1 AS level, 'o' AS kind FROM ln WHERE line % 11 = 0 UNION ALL SELECT doc, lower(text), CASE WHEN page % 2 = 0 THEN page END, page % 3 + 1, 't' FROM ln WHERE line % 13 = 0),
best AS (SELECT doc, key, pg, kind, min(level) AS level FROM hint GROUP BY ALL)"""
_HINT = "(SELECT level FROM best b WHERE b.doc = ln.doc AND b.key = lower(ln.text) AND b.kind = '{0}' AND b.pg = ln.page), (SELECT level FROM best b WHERE b.doc = ln.doc AND b.key = lower(ln.text) AND b.kind = '{0}' AND b.pg IS NULL)"


@query(f"""WITH {LINES}, {_HINTS}, x AS (SELECT doc, page, line, coalesce({_HINT.format("t")}) AS t, coalesce({_HINT.format("o")}) AS o FROM ln)
SELECT doc, page, line, coalesce(t, o) AS level, CASE WHEN t IS NOT NULL THEN 'TAG' ELSE 'OUTLINE' END AS source FROM x WHERE coalesce(t, o) IS NOT NULL""")
def outline_hints(s, d):
    ln = _lines(s, d)
    pick = lambda m, k: ln.where(F.col("line") % m == 0).select("doc", F.when(F.col("page") % 2 == 0, F.col("page")).alias("page"), "text", (F.col("page") % k + 1).alias("level"))
    return L.outline_hints(ln, pick(11, 4), pick(13, 3))


@query(f"""WITH {LINES}, e AS (SELECT doc, CASE WHEN line % 2 = 0 THEN page + line % 3 END AS pg, lower(text) || CASE WHEN line % 5 = 0 THEN '?' ELSE '' END AS key FROM ln WHERE line % 7 = 0)
SELECT doc, count(*) AS n FROM e WHERE NOT EXISTS (SELECT 1 FROM ln WHERE ln.doc = e.doc AND lower(ln.text) = e.key AND (e.pg IS NULL OR e.pg = ln.page)) GROUP BY doc""")
def unresolved_hints(s, d):
    ln, n = _lines(s, d), F.col("line")
    outline = ln.where(n % 7 == 0).select("doc", F.when(n % 2 == 0, F.col("page") + (n % 3).cast("int")).alias("page"), F.concat("text", F.when(n % 5 == 0, "?").otherwise("")).alias("text"))
    return L.unresolved_hints(_lines(s, d, False), outline)


@query(f"""WITH {LINES}, x AS (SELECT doc, page, line, y, CASE WHEN line % 9 = 0 THEN 'Page ' || page ELSE text END AS text FROM ln), n AS (SELECT doc, count(DISTINCT page) AS pages FROM x GROUP BY doc),
r AS (SELECT x.doc, lower(text) AS key FROM x JOIN n ON n.doc = x.doc WHERE y <= 0.12 OR y >= 0.88 GROUP BY x.doc, lower(text), pages HAVING count(DISTINCT page) >= greatest(2, ceil(pages / 2)))
SELECT doc, page, line FROM x WHERE NOT ((y <= 0.12 OR y >= 0.88) AND EXISTS (SELECT 1 FROM r WHERE r.doc = x.doc AND r.key = lower(x.text))) AND NOT (y >= 0.88 AND regexp_matches(lower(text), '^page [0-9]+$'))""")
def lines_without_margins(s, d):
    rows = _lines(s, d).withColumn("text", F.when(F.col("line") % 9 == 0, F.concat(F.lit("Page "), F.col("page").cast("string"))).otherwise(F.col("text")))
    return L.without_margins(rows).select("doc", "page", "line")


@query(f"""WITH {LINES}, p AS (SELECT doc, page, sum(length(text)) AS chars FROM ln GROUP BY ALL) SELECT doc, page, row_number() OVER w - 1 AS ordinal, coalesce(sum(chars + 2) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p WINDOW w AS (PARTITION BY doc ORDER BY page)""")
def page_offsets(s, d):
    return L.page_offsets(_lines(s, d, False).groupBy("doc", "page").agg(F.sum(F.length("text")).alias("chars")))


_CELLS = """c AS (SELECT l_orderkey AS table_id, CAST(l_linenumber AS BIGINT) AS row, l_suppkey % 3 AS col, CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS col_span, l_linenumber = 1 AS header, CASE WHEN l_partkey % 5 = 0 THEN ' ' ELSE '  c' || l_partkey || '  x' END AS text, l_partkey * 100 + l_quantity AS n FROM lineitem),
k AS (SELECT table_id, max(col + col_span) AS cols FROM c GROUP BY table_id), p AS (SELECT DISTINCT table_id, row, x FROM c, unnest(range(col, col + col_span)) t(x)),
f AS (SELECT table_id, count(*) AS rows, any_value(cols) AS cols, count(*) FILTER (WHERE n = cols) AS complete FROM (SELECT table_id, row, count(*) AS n FROM p GROUP BY ALL) JOIN k USING (table_id) GROUP BY table_id),
m AS (SELECT *, CASE WHEN rows >= 2 AND cols >= 2 AND complete >= greatest(1, (rows + 2) // 3) THEN 'ROW' ELSE 'COLUMN_FLOW' END AS mode FROM f)"""


def _cells(s, d):
    k = F.col("l_partkey")
    text = F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit("  c"), k.cast("string"), F.lit("  x")))
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").cast("long").alias("row"), (F.col("l_suppkey") % 3).alias("col"), F.when(F.col("l_returnflag") == "R", 2).otherwise(1).cast("long").alias("col_span"), (F.col("l_linenumber") == 1).alias("header"), text.alias("text"), (k * 100 + F.col("l_quantity")).alias("n"))


@query(f"WITH {_CELLS} SELECT table_id, rows, cols, complete, mode FROM m")
def table_layout_mode(s, d):
    return L.table_mode(_cells(s, d))


@query(f"""WITH {_CELLS}, h AS (SELECT table_id, x AS col, arg_min(trim(text), (c.col, trim(text))) AS header FROM c, unnest(range(col, col + col_span)) t(x) WHERE header AND row = 1 AND trim(text) <> '' GROUP BY ALL)
SELECT table_id, h.col, header FROM h JOIN k USING (table_id) WHERE cols = (SELECT count(*) FROM h h2 WHERE h2.table_id = h.table_id) AND (SELECT min(row) FROM c WHERE c.table_id = h.table_id) = 1""")
def table_column_headers(s, d):
    return L.column_headers(_cells(s, d))


@query(f"""WITH {_CELLS} SELECT table_id, row, arg_min(regexp_replace(trim(text), '\\s+', ' ', 'g'), n) AS header FROM c JOIN m USING (table_id) WHERE mode = 'ROW' AND col = 0 AND NOT header AND trim(text) <> '' GROUP BY ALL""")
def table_row_headers(s, d):
    cells = _cells(s, d)
    return L.row_headers(cells, L.table_mode(cells))


@query("""WITH t AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderkey AS table_id, o_orderkey % 2 AS cols, (o_orderkey % 50) / 200.0 AS top, 0.7 + (o_orderkey % 30) / 100.0 AS bottom, o_orderstatus AS header FROM orders),
l AS (SELECT *, coalesce(cols = lag(cols) OVER w AND lag(bottom) OVER w >= 0.8 AND top <= 0.25 AND header = lag(header) OVER w, false) AS linked FROM t WINDOW w AS (PARTITION BY doc ORDER BY page)),
g AS (SELECT *, sum(CASE WHEN linked THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY page) AS g FROM l) SELECT doc, page, table_id, linked, min(table_id) OVER (PARTITION BY doc, g) AS group_id FROM g""")
def table_continuation(s, d):
    k = F.col("o_orderkey")
    t = table(s, d, "orders").select(F.col("o_custkey").alias("doc"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(k)).alias("page"), k.alias("table_id"), (k % 2).alias("cols"), (k % 50 / 200.0).alias("top"), (0.7 + k % 30 / 100.0).alias("bottom"), F.col("o_orderstatus").alias("header"))
    return L.table_continuation(t)


@query("""WITH b AS (SELECT l_orderkey AS id, l_linenumber AS n, l_suppkey AS page, l_quantity AS x0, l_quantity + 4 AS x1, l_discount * 100 AS y0, l_discount * 100 + 2 AS y1, 'w' || CAST(l_partkey % 20 AS VARCHAR) AS text FROM lineitem),
t AS (SELECT s_suppkey AS page, 10.0 AS x0, 30.0 AS x1, 2.0 AS y0, 8.0 AS y1, 'w1 w12 w13 w14' AS text FROM supplier) SELECT id, n FROM b WHERE EXISTS (SELECT 1 FROM t WHERE t.page = b.page AND (b.x0 + b.x1) / 2 BETWEEN t.x0 AND t.x1 AND (b.y0 + b.y1) / 2 BETWEEN t.y0 AND t.y1 AND length(b.text) >= 3 AND contains(t.text, b.text))""")
def covered_boxes(s, d):
    q, y = F.col("l_quantity"), F.col("l_discount") * 100
    b = table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("page"), q.alias("x0"), (q + 4).alias("x1"), y.alias("y0"), (y + 2).alias("y1"), F.concat(F.lit("w"), (F.col("l_partkey") % 20).cast("string")).alias("text"))
    t = table(s, d, "supplier").select(F.col("s_suppkey").alias("page"), F.lit(10.0).alias("x0"), F.lit(30.0).alias("x1"), F.lit(2.0).alias("y0"), F.lit(8.0).alias("y1"), F.lit("w1 w12 w13 w14").alias("text"))
    return L.covered_boxes(b, t).select("id", "n")


@query("""WITH x AS (SELECT p_partkey, p_size % 11 = 0 AS outlined, p_size % 7 = 0 AS numbered, p_size % 3 = 0 AS band, count(*) OVER (PARTITION BY p_brand, p_size) AS reps, length(p_name) * (p_size % 13) AS chars, p_size % 5 = 0 AS chapter, p_size AS body FROM part)
SELECT p_partkey, CASE WHEN outlined THEN 'ACCEPT_OUTLINE' WHEN numbered THEN 'ACCEPT_NUMBER' WHEN band AND reps >= 2 THEN 'RUNNING_HEADER' WHEN reps >= 2 THEN 'REPEATED_LABEL' WHEN chars > 120 THEN 'TOO_LONG' WHEN chapter THEN 'ACCEPT_CHAPTER' WHEN body < 40 THEN 'NO_BODY' ELSE 'WEAK' END AS decision FROM x""")
def title_governance(s, d):
    n = F.col("p_size")
    reps = F.count(F.lit(1)).over(Window.partitionBy("p_brand", "p_size"))
    return table(s, d, "part").select("p_partkey", L.title_decision(n % 11 == 0, n % 7 == 0, n % 3 == 0, reps, F.length("p_name") * (n % 13), n % 5 == 0, n).alias("decision"))


@query("""WITH w AS (SELECT l_orderkey AS block, l_linenumber % 4 AS line, l_quantity * 2 + CASE WHEN l_linenumber > 3 THEN 60 ELSE 0 END AS x0, l_quantity * 2 + 8 + CASE WHEN l_linenumber > 3 THEN 60 ELSE 0 END AS x1 FROM lineitem),
g AS (SELECT block, line, x1 AS a, nx AS b FROM (SELECT *, lead(x0) OVER (PARTITION BY block, line ORDER BY x0) AS nx FROM w) WHERE nx - x1 >= 18), n AS (SELECT block, count(DISTINCT line) AS lines FROM w GROUP BY block),
c AS (SELECT DISTINCT block, x FROM (SELECT block, unnest([a, b, (a + b) / 2]) AS x FROM g) WHERE x BETWEEN 36 AND 164), s AS (SELECT c.block, x, count(DISTINCT line) AS coverage, sum(b - a) AS gap FROM c JOIN g ON g.block = c.block AND x >= a AND x <= b GROUP BY ALL)
SELECT block, x, coverage, lines FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY coverage DESC, gap DESC, x DESC) AS r FROM s) JOIN n USING (block) WHERE r = 1 AND coverage >= greatest(3, (lines + 2) // 3)""")
def column_separators(s, d):
    q = F.col("l_quantity") * 2 + F.when(F.col("l_linenumber") > 3, 60).otherwise(0)
    return L.column_separator(table(s, d, "lineitem").select(F.col("l_orderkey").alias("block"), (F.col("l_linenumber") % 4).alias("line"), q.alias("x0"), (q + 8).alias("x1")), 200.0)


_TITLES = """bx AS (SELECT l_suppkey AS doc, row_number() OVER w AS n, CASE WHEN l_partkey % 3 = 0 THEN 'Title' ELSE 'text' END AS kind, l_orderkey % 6 + 1 AS page, CAST(l_partkey % 90 AS DOUBLE) AS top, CAST(l_partkey % 90 + 8 AS DOUBLE) AS bottom, l_partkey, l_linenumber,
  CASE l_linenumber WHEN 1 THEN '2.3. Part ' || l_partkey WHEN 2 THEN 'Results:' WHEN 3 THEN 'LOUD TITLE ' || chr(65 + CAST(l_partkey % 26 AS INTEGER)) WHEN 4 THEN 'about ' || repeat('x', CAST(l_partkey % 150 AS INTEGER)) ELSE 'label ' || l_partkey END AS text
  FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity))"""


def _title_boxes(s, d):
    k, n = F.col("l_partkey"), F.col("l_linenumber")
    text = (
        F.when(n == 1, F.concat(F.lit("2.3. Part "), k.cast("string"))).when(n == 2, "Results:").when(n == 3, F.concat(F.lit("LOUD TITLE "), F.chr(F.lit(65) + k % 26)))
        .when(n == 4, F.concat(F.lit("about "), F.expr("repeat('x', cast(l_partkey % 150 as int))"))).otherwise(F.concat(F.lit("label "), k.cast("string")))
    )
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return table(s, d, "lineitem").select(F.col("l_suppkey").alias("doc"), F.row_number().over(order).alias("n"), F.when(k % 3 == 0, "Title").otherwise("text").alias("kind"), (F.col("l_orderkey") % 6 + 1).alias("page"), (k % 90).cast("double").alias("top"), (k % 90 + 8).cast("double").alias("bottom"), text.alias("text"))


@query(f"""WITH {_TITLES}, t AS (SELECT * FROM bx WHERE kind = 'Title'), f AS (SELECT doc, min(n) AS first FROM t WHERE page = 1 GROUP BY doc), e AS (SELECT doc, page, min(top) AS lo, max(bottom) AS hi FROM bx GROUP BY ALL),
o AS (SELECT doc, page, lower(text) AS key, least(6, n % 4 + 1) AS lv FROM bx WHERE n % 50 = 7), ob AS (SELECT doc, page, key, min(lv) AS lv FROM o GROUP BY ALL),
c AS (SELECT t.*, ob.lv AS outlined, CASE WHEN t.text LIKE '2.3. %' THEN 2 END AS numbered, CASE WHEN top <= lo + 0.12 * (hi - lo) THEN 'top' WHEN bottom >= hi - 0.12 * (hi - lo) THEN 'bottom' END AS margin,
  regexp_replace(regexp_replace(lower(t.text), '[0-9]+([.][0-9]+)*', '#', 'g'), '[^a-z#]', '', 'g') AS label FROM t LEFT JOIN f ON f.doc = t.doc JOIN e ON e.doc = t.doc AND e.page = t.page LEFT JOIN ob ON ob.doc = t.doc AND ob.page = t.page AND ob.key = lower(t.text) WHERE t.n IS DISTINCT FROM first),
x AS (SELECT *, margin IS NOT NULL AND count(*) OVER (PARTITION BY doc, label, margin) >= 2 AS running, count(*) OVER (PARTITION BY doc, label) >= 2 AS repeated, count(*) FILTER (WHERE outlined IS NOT NULL OR numbered IS NOT NULL) OVER (PARTITION BY doc) >= 4 AS rich, coalesce(lead(n) OVER (PARTITION BY doc ORDER BY n), 1000000000) AS nx FROM c),
y AS (SELECT x.*, coalesce((SELECT sum(length(b.text)) FROM bx b WHERE b.doc = x.doc AND b.kind <> 'Title' AND b.n > x.n AND b.n < x.nx), 0) AS body FROM x),
z AS (SELECT doc, n, CASE WHEN outlined IS NOT NULL THEN 'ACCEPT_OUTLINE' WHEN numbered IS NOT NULL THEN 'ACCEPT_NUMBER' WHEN running THEN 'RUNNING_HEADER' WHEN repeated THEN 'REPEATED_LABEL' WHEN length(text) > 120 THEN 'TOO_LONG' WHEN text = 'Results:' OR (NOT rich AND text LIKE 'LOUD TITLE %') THEN 'ACCEPT_CHAPTER' WHEN body < 40 THEN 'NO_BODY' ELSE 'WEAK' END AS decision, coalesce(outlined, numbered, 1) AS l FROM y)
SELECT doc, n, decision, CAST(CASE WHEN decision LIKE 'ACCEPT%' THEN l END AS INTEGER) AS level FROM z UNION ALL SELECT doc, first, 'DOCUMENT_TITLE', NULL FROM f""")
def governed_titles(s, d):
    """Titles of every kind with an outline of every fiftieth box."""
    boxes = _title_boxes(s, d)
    outline = boxes.where("n % 50 = 7").select("doc", "page", "text", (F.col("n") % 4).alias("depth"))
    return L.govern_titles(boxes, outline)


QUERIES, SQL = Q, S
