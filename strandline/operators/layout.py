"""Layout rules over a table of text lines (doc, page, y, height, font, bold, text) and of boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.text import chapter_title, heading_level, narrow, title_key

PAGE_NUMBER = r"^\s*(?:page\s+)?[-–—]?\s*\d{1,4}\s*(?:/\s*\d{1,4})?\s*[-–—]?\s*$"


def complex_pages(lines: DataFrame, most: int = 3) -> DataFrame:
    """Pages with ``most`` or more lines that hold a large gap."""
    return lines.groupBy("doc", "page").agg(F.count_if("large_gap").alias("n")).where(F.col("n") >= most)


def repeated_margins(lines: DataFrame, band: float = 0.12) -> DataFrame:
    """Texts in the top or bottom band of at least half of a document's pages (and at least two)."""
    pages = lines.groupBy("doc").agg(F.countDistinct("page").alias("pages"))
    key = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    edge = lines.where((F.col("y") <= band) | (F.col("y") >= 1 - band)).groupBy("doc", key.alias("key")).agg(F.countDistinct("page").alias("n"))
    return edge.join(pages, "doc").where(F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("pages") / 2))).select("doc", "key", "n")


def without_margins(lines: DataFrame, band: float = 0.12) -> DataFrame:
    """Lines without those that repeat in the margins, and without page numbers in the bottom one."""
    key = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    bottom = F.col("y") >= 1 - band
    rows = lines.withColumn("__key", key).withColumn("__edge", (F.col("y") <= band) | bottom)
    repeated = repeated_margins(lines, band).select("doc", F.col("key").alias("__key"), F.lit(True).alias("__edge"))
    kept = rows.join(repeated, ["doc", "__key", "__edge"], "left_anti")
    return kept.where(~(bottom & F.rlike("__key", F.lit(PAGE_NUMBER)))).select(*lines.columns)


def dominant_font(lines: DataFrame) -> DataFrame:
    """The half-rounded font size that carries most characters; the smaller one on a tie."""
    size = (F.round(F.col("font") * 2) / 2).alias("size")
    weight = lines.groupBy("doc", size).agg(F.sum(F.greatest(F.lit(1), F.length("text"))).alias("w"))
    return weight.groupBy("doc").agg(F.max_by("size", F.struct("w", -F.col("size"))).alias("body"))


def headings(lines: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Visible headings with their level: larger or bold lines that end no sentence, levels by size.

    ``counted``: the same lines by a way that need not bring a document's lines together.
    """
    body = dominant_font(lines if counted is None else counted)
    order = Window.partitionBy("doc", "page").orderBy("y", "line")
    text = F.trim("text")
    shape = F.length(text).between(2, 160) & ~F.rlike(F.lower(text), F.lit(PAGE_NUMBER)) & ~F.rlike(text, F.lit(r"[.。;；,，!?！？]$"))
    big = (F.col("font") >= 1.25 * F.col("body")) | (F.col("bold") & (F.col("font") >= 1.05 * F.col("body")))
    # every line is sorted by place, but only with the text and size of those that may be headings
    rows = lines.join(body, "doc").withColumn("size", F.when(big & shape, F.round(F.col("font") * 2) / 2))
    rows = rows.select("doc", "page", "line", "y", "height", "size", F.when(F.col("size").isNotNull(), F.col("text")).alias("text")).withColumn("gap", F.col("y") - F.lag("y").over(order))
    found = rows.where(F.col("size").isNotNull() & (F.col("gap").isNull() | (F.col("gap") >= 0.8 * F.col("height"))))
    level = F.least(F.lit(6), F.dense_rank().over(Window.partitionBy("doc").orderBy(F.desc("size"))))
    return found.select("doc", "page", "line", "text", level.alias("level"))


def titles(lines: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """The largest line in the upper part of the first page, if much larger than the body; ``counted`` as for headings."""
    counted = lines if counted is None else counted
    first = counted.groupBy("doc").agg(F.min("page").alias("page"))
    rows = lines.join(first, ["doc", "page"]).join(dominant_font(counted), "doc").where((F.col("y") < 0.55) & (F.col("font") >= 1.55 * F.col("body")) & (F.length("text") <= 200))
    return rows.groupBy("doc").agg(F.min_by("text", F.struct(-F.col("font"), "y", "line")).alias("title"))


def assemble_paragraphs(lines: DataFrame) -> DataFrame:
    """Lines of a page joined by spaces until the vertical gap is large: paragraph number, text and line count."""
    order = Window.partitionBy("doc", "page").orderBy("y", "line")
    gap = F.col("y") - F.lag("y").over(order)
    marked = lines.withColumn("new", F.coalesce(gap > F.greatest(1.45 * F.col("font") / 1000, 1.6 * F.col("height")), F.lit(True)).cast("int"))
    numbered = marked.withColumn("p", F.sum("new").over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "line", "text"))), lambda x: x["text"]), " ")
    return numbered.groupBy("doc", "page", "p").agg(text.alias("text"), F.count(F.lit(1)).alias("n"))


def outline_hints(lines: DataFrame, outline: DataFrame, tags: DataFrame) -> DataFrame:
    """Level of each line from tags, else from the outline, matched by normalised text and, where the hint states one, by page."""
    key = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    rows = lines.withColumn("key", key)
    for hints, name in ((outline, "o"), (tags, "t")):
        hints = hints.withColumn("key", key)
        on_page = hints.where("page IS NOT NULL").groupBy("doc", "key", "page").agg(F.min("level").alias(f"{name}_page"))
        anywhere = hints.where("page IS NULL").groupBy("doc", "key").agg(F.min("level").alias(f"{name}_any"))
        rows = rows.join(on_page, ["doc", "key", "page"], "left").join(anywhere, ["doc", "key"], "left").withColumn(name, F.coalesce(f"{name}_page", f"{name}_any"))
    return rows.select("doc", "page", "line", F.coalesce("t", "o").alias("level"), F.when(F.col("t").isNotNull(), "TAG").when(F.col("o").isNotNull(), "OUTLINE").alias("source")).where("level IS NOT NULL")


def unresolved_hints(lines: DataFrame, outline: DataFrame) -> DataFrame:
    """``doc, n``: outline entries that name no visible line; each is a warning."""
    key = F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("key")
    seen = lines.select("doc", "page", key).distinct()
    entries = outline.select("doc", "page", key)
    on_page = entries.where("page IS NOT NULL").join(seen, ["doc", "page", "key"], "left_anti")
    anywhere = entries.where("page IS NULL").join(seen.drop("page").distinct(), ["doc", "key"], "left_anti")
    return on_page.select("doc").unionAll(anywhere.select("doc")).groupBy("doc").agg(F.count(F.lit(1)).alias("n"))


def page_offsets(pages: DataFrame) -> DataFrame:
    """Character offset and ordinal of each page; pages are joined by two characters."""
    order = Window.partitionBy("doc").orderBy("page")
    return pages.select("doc", "page", (F.row_number().over(order) - 1).alias("ordinal"), F.coalesce(F.sum(F.col("chars") + 2).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))


def table_mode(cells: DataFrame) -> DataFrame:
    """ROW if at least (rows + 2) / 3 of a table's rows fill every column, else COLUMN_FLOW, as is one of a single row or column.

    A cell fills the columns it spans in the row where it begins.
    """
    cols = cells.groupBy("table_id").agg(F.max(F.col("col") + F.col("col_span")).alias("cols"))
    place = cells.select("table_id", "row", F.explode(F.sequence("col", F.col("col") + F.col("col_span") - 1)).alias("c"))
    full = place.groupBy("table_id", "row").agg(F.countDistinct("c").alias("n")).join(cols, "table_id")
    per = full.groupBy("table_id", "cols").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("n") == F.col("cols")).alias("complete"))
    good = (F.col("rows") >= 2) & (F.col("cols") >= 2) & (F.col("complete") >= F.greatest(F.lit(1), F.floor((F.col("rows") + 2) / 3)))
    return per.select("table_id", "rows", "cols", "complete", F.when(good, "ROW").otherwise("COLUMN_FLOW").alias("mode"))


def column_headers(cells: DataFrame) -> DataFrame:
    """``table_id, col, header``: the header cells of a table's first row, if with their spans they name every column; the first one of a column counts."""
    facts = cells.groupBy("table_id").agg(F.min("row").alias("first"), F.max(F.col("col") + F.col("col_span")).alias("cols"))
    rows = cells.join(facts, "table_id").where(F.col("header") & (F.col("row") == F.col("first")) & (F.length(F.trim("text")) > 0))
    named = rows.select("table_id", "cols", F.col("col").alias("start"), F.trim("text").alias("text"), F.explode(F.sequence("col", F.least("cols", F.col("col") + F.col("col_span")) - 1)).alias("c"))
    best = named.groupBy("table_id", "cols", F.col("c").alias("col")).agg(F.min_by("text", F.struct("start", "text")).alias("header"))
    n = F.count(F.lit(1)).over(Window.partitionBy("table_id"))
    return best.withColumn("n", n).where(F.col("n") == F.col("cols")).select("table_id", "col", "header")


def row_headers(cells: DataFrame, modes: DataFrame) -> DataFrame:
    """``table_id, row, header``: in tables read by rows, the first text of a row's first column that is no header cell."""
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    rows = cells.where((F.col("col") == 0) & ~F.col("header")).join(modes.where("mode = 'ROW'").select("table_id"), "table_id", "left_semi")
    return rows.select("table_id", "row", text.alias("text"), "n").where(F.length("text") > 0).groupBy("table_id", "row").agg(F.min_by("text", "n").alias("header"))


def table_continuation(tables: DataFrame) -> DataFrame:
    """Tables that go on on the next page: equal columns, from the page's foot to the next one's head, equal header. ``group_id`` is the first table's."""
    a = tables.select("doc", (F.col("page") + 1).alias("page"), F.col("table_id").alias("prev"), F.col("cols").alias("c"), F.col("bottom").alias("b"), F.col("header").alias("h"))
    links = tables.join(a, ["doc", "page"], "left").withColumn("linked", F.coalesce((F.col("cols") == F.col("c")) & (F.col("b") >= 0.8) & (F.col("top") <= 0.25) & (F.col("header") == F.col("h")), F.lit(False)))
    order = Window.partitionBy("doc").orderBy("page")
    return links.withColumn("g", F.sum((~F.col("linked")).cast("int")).over(order)).select("doc", "page", "table_id", "linked", F.min("table_id").over(Window.partitionBy("doc", "g")).alias("group_id"))


def covered_boxes(boxes: DataFrame, tables: DataFrame) -> DataFrame:
    """Text boxes whose centre lies in a table of their page and whose text (3 characters or more) the table holds."""
    x, y = (F.col("b.x0") + F.col("b.x1")) / 2, (F.col("b.y0") + F.col("b.y1")) / 2
    inside = x.between(F.col("t.x0"), F.col("t.x1")) & y.between(F.col("t.y0"), F.col("t.y1")) & (F.length("b.text") >= 3) & F.contains("t.text", "b.text")
    return boxes.alias("b").join(tables.alias("t"), (F.col("b.page") == F.col("t.page")) & inside, "left_semi")


def govern_titles(boxes: DataFrame, outline: DataFrame, band: float = 0.12, least_body: int = 40, most_chars: int = 120, rich: int = 4) -> DataFrame:
    """What becomes of the boxes that a layout model calls titles: ``doc, n, decision, level``; no text is dropped, a downgraded title is text.

    ``boxes``: ``doc, n`` (reading order), ``kind, text, page, top, bottom``; ``outline``: ``doc, page, text, depth`` from 0.
    The first title of the first page is the document's.  The others by the first
    rule that applies: named by the outline on that page; numbered; in the same margin
    band twice or more; a label that occurs twice or more; too long; a chapter's name
    (also by its capitals, unless ``rich`` titles are named or numbered); too little text until the next title; else weak.
    """
    clean = F.trim("text")
    filled = F.length(clean) > 0
    title = F.coalesce((F.lower("kind") == "title") & filled, F.lit(False))
    body = F.when((F.lower("kind") != "title") & filled, F.length(clean))
    # all that a title needs of its document is told by windows over the document's boxes, which one shuffle serves
    whole, page, order = Window.partitionBy("doc"), Window.partitionBy("doc", "page"), Window.partitionBy("doc").orderBy("n")
    rows = boxes.select(
        "doc", "n", "text", "page", "top", "bottom", title.alias("title"), F.coalesce(F.sum(body).over(order), F.lit(0)).alias("upto"), F.coalesce(F.sum(body).over(whole), F.lit(0)).alias("all"),
        F.min(F.when(title & (F.col("page") == 1), F.col("n"))).over(whole).alias("first"), F.least(F.min("top").over(page), F.min("bottom").over(page)).alias("lo"), F.greatest(F.max("top").over(page), F.max("bottom").over(page)).alias("hi"),
    ).where("title").drop("title")
    plain = lambda c: F.regexp_replace(F.lower(narrow(c)), r"[^\p{L}\p{N}#]", "")
    named = outline.select("doc", "page", plain(F.col("text")).alias("key"), F.greatest(F.lit(1), F.least(F.lit(6), F.col("depth") + 1)).alias("outlined")).where(F.length("key") > 0).groupBy("doc", "page", "key").agg(F.min("outlined").alias("outlined"))
    rows = rows.withColumn("key", plain(clean)).join(named, ["doc", "page", "key"], "left").drop("key")
    span = F.col("hi") - F.col("lo")
    margin = F.when(span > 0, F.when(F.col("top") <= F.col("lo") + band * span, "top").when(F.col("bottom") >= F.col("hi") - band * span, "bottom"))
    rows = rows.select("doc", "n", "text", "upto", "all", "outlined", F.coalesce(F.col("n") == F.col("first"), F.lit(False)).alias("own"), title_key(clean).alias("label"), margin.alias("margin"), heading_level(clean).alias("numbered"))
    # the document's title stays apart from the others
    apart = Window.partitionBy("doc", "own")
    rows = rows.withColumn("structured", F.count_if(F.col("outlined").isNotNull() | F.col("numbered").isNotNull()).over(apart) >= rich)
    rows = rows.withColumn("end", F.lead("upto").over(apart.orderBy("n")))
    here = F.col("label") != ""
    n = lambda *keys: F.count(F.lit(1)).over(Window.partitionBy("doc", "own", *keys))
    rows = rows.withColumn("running", here & F.col("margin").isNotNull() & (n("label", "margin") >= 2)).withColumn("repeated", here & (n("label") >= 2))
    chars = F.coalesce("end", "all") - F.col("upto")
    chapter = F.when(F.col("structured"), chapter_title(clean, upper=False)).otherwise(chapter_title(clean))
    decision = (
        F.when(F.col("outlined").isNotNull(), "ACCEPT_OUTLINE").when(F.col("numbered").isNotNull(), "ACCEPT_NUMBER").when(F.col("running"), "RUNNING_HEADER").when(F.col("repeated"), "REPEATED_LABEL")
        .when(F.length(clean) > most_chars, "TOO_LONG").when(chapter, "ACCEPT_CHAPTER").when(chars < least_body, "NO_BODY").otherwise("WEAK")
    )
    level = F.coalesce("outlined", "numbered", F.lit(1))
    judged = rows.select("doc", "n", F.when(F.col("own"), "DOCUMENT_TITLE").otherwise(decision).alias("decision"), F.coalesce("outlined", "numbered", F.lit(1)).cast("int").alias("l"))
    return judged.select("doc", "n", "decision", F.when(F.startswith("decision", F.lit("ACCEPT")), F.col("l")).alias("level"))


def title_decision(outlined: Column, numbered: Column, in_band: Column, repeats: Column, chars: Column, chapter: Column, body_chars: Column) -> Column:
    """Why a candidate title is accepted, or to what it is downgraded; the first rule that applies."""
    return (
        F.when(outlined, "ACCEPT_OUTLINE").when(numbered, "ACCEPT_NUMBER").when(in_band & (repeats >= 2), "RUNNING_HEADER").when(repeats >= 2, "REPEATED_LABEL")
        .when(chars > 120, "TOO_LONG").when(chapter, "ACCEPT_CHAPTER").when(body_chars < 40, "NO_BODY").otherwise("WEAK")
    )


def column_separator(words: DataFrame, width: float, least_gap: float = 18.0) -> DataFrame:
    """The x that most lines of a block leave free in its middle 64 %, if enough do.

    ``block, line, x0, x1``: candidates are the middles and edges of wide gaps between
    neighbouring words; the best is covered by most lines, then by the widest gaps,
    then lies furthest right.
    """
    order = Window.partitionBy("block", "line").orderBy("x0")
    gaps = words.withColumn("to", F.lead("x0").over(order)).where(F.col("to") - F.col("x1") >= max(least_gap, 0.08 * width)).select("block", "line", F.col("x1").alias("a"), F.col("to").alias("b"))
    n = words.groupBy("block").agg(F.countDistinct("line").alias("lines"))
    candidates = gaps.select("block", F.explode(F.array("a", "b", (F.col("a") + F.col("b")) / 2)).alias("x")).where(F.col("x").between(0.18 * width, 0.82 * width)).distinct()
    held = candidates.join(gaps, "block").where((F.col("x") >= F.col("a")) & (F.col("x") <= F.col("b")))
    scored = held.groupBy("block", "x").agg(F.countDistinct("line").alias("coverage"), F.sum(F.col("b") - F.col("a")).alias("gap"))
    best = scored.groupBy("block").agg(F.max(F.struct("coverage", "gap", "x")).alias("m"))
    return best.join(n, "block").where(F.col("m.coverage") >= F.greatest(F.lit(3), F.floor((F.col("lines") + 2) / 3))).select("block", F.col("m.x").alias("x"), F.col("m.coverage").alias("coverage"), "lines")
