"""Queries of the parsers (tested by golden values)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.adapters import shared_dir, table
from strandline.sources.objects import put_parts
from strandline.sources.readers import parse_column


def markdown_blocks(s, d):
    """Documents read as Markdown, with their first line as a heading."""
    md = F.concat(F.lit("# "), F.replace("text", F.lit(".\n"), F.lit(".\n\n")))
    rows = parse_column(table(s, d, "documents").select("doc_id", md.alias("md")), "doc_id", "md", "MARKDOWN")
    return rows.select(F.col("id").alias("doc_id"), "src", "kind", "level", F.md5("text").alias("digest"), "start_line", "end_line", "error")


def html_tables(s, d):
    """Cells of the tables of every page."""
    return parse_column(table(s, d, "pages"), "page_id", "html", "HTML_TABLE").select("id", "table_no", "row", "col", "text")


def uploaded_objects(s, d):
    """Every document's text as an object, put in two parts by the tasks; size and digest as the bytes passed."""
    raw = F.coalesce("text", F.lit("")).cast("binary")
    half = F.floor(F.octet_length(raw) / 2).cast("int")
    parts = table(s, d, "documents").select(F.format_string("d%02d/%d", F.col("doc_id") % 50, F.col("doc_id")).alias("key"), F.posexplode(F.array(F.substr(raw, F.lit(1), half), F.substr(raw, half + 1))).alias("n", "part"))
    return put_parts(parts, f"{shared_dir(s)}/strandline/objects-{uuid.uuid4().hex}")


#: Tags that begin or end a block of text.
BLOCK_TAGS = "address|article|aside|blockquote|body|br|caption|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|legend|li|main|nav|ol|option|p|pre|section|summary|table|tbody|td|tfoot|th|thead|title|tr|ul"


def html_blocks(s, d):
    """All visible text of pages in blocks; headings are told apart, scripts, styles and comments go."""
    seen = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>", " ")
    marked = F.regexp_replace(F.regexp_replace(seen, r"[\ue010\ue011]", ""), r"(?i)<h([1-6])\b[^>]*>", "\ue010\ue011$1")
    cut = F.regexp_replace(marked, rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>", "\ue010")
    rows = table(s, d, "pages").select("page_id", F.posexplode(F.split(cut, "\ue010")).alias("at", "piece"))
    heading = F.startswith("piece", F.lit("\ue011"))
    text = F.regexp_replace(F.when(heading, F.substring("piece", F.lit(3), F.length("piece"))).otherwise(F.col("piece")), r"<[^<>]*>", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    blocks = rows.select("page_id", "at", F.when(heading, "HEADING").otherwise("PARAGRAPH").alias("kind"), text.alias("text")).where(F.length("text") > 0)
    return blocks.select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("at")) - 1).alias("src"), "kind", "text")


def html_table_fixture(s, d):
    """A table with spans and headers made for every customer (the pages of the test data hold none); the SQL states its grid."""
    html = F.format_string("<table><tr><th rowspan=2>%s</th><th colspan=2>B &amp; %d</th></tr><tr><td>x<td>%d</tr></table>", F.col("c_name"), F.col("c_custkey"), F.col("c_nationkey"))
    # many narrow rows lie in few splits, of which each gives a parser much to do
    customers = table(s, d, "customer").select("c_custkey", "c_name", "c_nationkey").repartition(4 * s.sparkContext.defaultParallelism)
    return parse_column(customers.select("c_custkey", html.alias("html")), "c_custkey", "html", "HTML_TABLE").select("id", "table_no", "row", "col", "row_span", "col_span", "header", "text")


SQL = {
    "html_table_fixture": """SELECT c_custkey AS id, 0 AS table_no, r AS row, c AS col, rs AS row_span, cs AS col_span, h AS header, CASE k WHEN 0 THEN c_name WHEN 1 THEN 'B & ' || c_custkey WHEN 2 THEN 'x' ELSE CAST(c_nationkey AS VARCHAR) END AS text
FROM customer, (VALUES (0, 0, 0, 2, 1, true), (1, 0, 1, 1, 2, true), (2, 1, 1, 1, 1, false), (3, 1, 2, 1, 1, false)) t(k, r, c, rs, cs, h)""",
    "uploaded_objects": "SELECT printf('d%02d/%d', doc_id % 50, doc_id) AS key, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size, sha256(coalesce(text, '')) AS sha256, CAST(NULL AS VARCHAR) AS error FROM documents",
}
QUERIES = {"markdown_blocks": markdown_blocks, "html_tables": html_tables, "html_blocks": html_blocks, "html_table_fixture": html_table_fixture, "uploaded_objects": uploaded_objects}
