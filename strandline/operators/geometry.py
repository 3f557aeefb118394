"""Words and glyphs of a page to lines, cells and captions; replacing a detected table by a digital one.

The unit of work is a page, a cell or a table, so those steps that depend on all
that came before them on it are folds over one such group, whose rows pass sorted, as a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows that a fold gives on at once.
FOLD_ROWS = 10_000


def _folded(df: DataFrame, keys: list[str], order: list[str], fold, schema: str) -> DataFrame:
    """``fold(rows)`` → output tuples, for each group's rows in order; the keys come first.

    Partitions are sorted and read as a stream: ``fold`` gets an iterator, and no group is ever a row of its own.
    """
    names = [*keys, *order, *[c for c in df.columns if c not in keys and c not in order]]
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    fields = [f.split() for f in schema.split(", ")]

    def run(batches):
        from itertools import groupby

        import pyarrow as pa

        plain = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
        types: list = []

        def stream():
            for b in batches:
                types[:] = [b.schema.field(k).type for k in keys] + [plain[t] for _, t in fields]
                yield from (dict(zip(names, values, strict=True)) for values in zip(*(c.to_pylist() for c in b.columns), strict=True))

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[*keys, *[n for n, _ in fields]])

        out = []
        for key, rows in groupby(stream(), lambda r: tuple(r[k] for k in keys)):
            for x in fold(rows):
                out.append((*key, *x))
                if len(out) == FOLD_ROWS:
                    yield packed(out)
                    out = []
        if out:
            yield packed(out)

    kept = df.select(*names).repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*names)
    return kept.mapInArrow(run, kinds + ", " + schema)


def line_numbers(tops: list[float], tolerances: list[float]) -> list[int]:
    """The line of each word in order of its top; a line reaches as far from its first word as the tolerance says."""
    out, anchor = [], None
    for top, tolerance in zip(tops, tolerances, strict=True):
        if anchor is None or abs(top - anchor) > tolerance:
            anchor = top
            out.append(out[-1] + 1 if out else 0)
        else:
            out.append(out[-1])
    return out


def _lines(rows: list[dict], tolerance=lambda r: 2.0) -> list[list[dict]]:
    rows = [r for r in rows if (r["text"] or "").strip()]
    lines: list[list[dict]] = []
    for n, r in zip(line_numbers([r["top"] for r in rows], [tolerance(r) for r in rows]), rows, strict=True):
        if n == len(lines):
            lines.append([])
        lines[n].append(r)
    return [sorted(line, key=lambda r: r["x0"]) for line in lines]


def word_lines(words: DataFrame, *keys: str) -> DataFrame:
    """``keys, top, x0, x1, text, bold`` → ``keys, line, top, text, bold, mixed``: visual lines of each group.

    ``bold``: the line begins so; ``mixed``: it does, and goes on in plain.
    """

    def fold(rows):
        for n, line in enumerate(_lines(rows)):
            bold = [bool(r["bold"]) for r in line]
            yield n, min(r["top"] for r in line), " ".join(r["text"].strip() for r in line), bold[0], bold[0] and not all(bold)

    return _folded(words, list(keys), ["top", "x0"], fold, "line int, top double, text string, bold boolean, mixed boolean")


def glyph_lines(glyphs: DataFrame, *keys: str) -> DataFrame:
    """``keys, y, x, width, height, font_size, font, text, page_width`` → lines: ``keys, line, text, y, font_size, height, bold, large_gap``.

    A line takes glyphs within the greater of 2 and 0.4 of their height of its first.
    A space goes in where the gap to what was so far the line's end exceeds the greater of 1 and 0.22 of
    the font size; a gap of more than 18 % of the page is a large one.
    """

    def fold(rows):
        rows = [r | {"top": r["y"], "x0": r["x"]} for r in rows if r["text"]]
        lines: list[list[dict]] = []
        for n, r in zip(line_numbers([r["y"] for r in rows], [max(2.0, 0.4 * r["height"]) for r in rows]), rows, strict=True):
            if n == len(lines):
                lines.append([])
            lines[n].append(r)
        n = 0
        for line in lines:
            line.sort(key=lambda r: r["x"])
            text, end, large = "", None, False
            for r in line:
                gap = 0.0 if end is None else r["x"] - end
                if end is not None and gap > max(1.0, 0.22 * r["font_size"]) and not text[-1:].isspace() and not r["text"][0].isspace():
                    text += " "
                large = large or (end is not None and gap > 0.18 * r["page_width"])
                text += r["text"]
                end = max(r["x"] + r["width"], end if end is not None else float("-inf"))
            text = " ".join(text.split())
            if text:
                bold = any(w in (r["font"] or "").lower() for r in line for w in ("bold", "black"))
                yield n, text, line[0]["y"], max(r["font_size"] for r in line), max(r["height"] for r in line), bold, large
                n += 1

    return _folded(glyphs, list(keys), ["y", "x"], fold, "line int, text string, y double, font_size double, height double, bold boolean, large_gap boolean")


def cell_segments(lines: DataFrame, *keys: str) -> DataFrame:
    """Lines of a cell (``keys, line, text, bold, mixed``) → ``keys, segment, text, heading``.

    A bold line that follows body text begins a new segment; the bold lines before a
    segment's body are its heading.  Native: segments are a running count.
    """
    order = Window.partitionBy(*keys).orderBy("line")
    body = ~F.col("bold") | F.col("mixed")
    clean = lines.select(*keys, "line", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"), "bold", body.alias("body")).where(F.length("text") > 0)
    # a bold line right after a line with body, or after bold lines of which one had body, starts anew; between two starts body is seen once
    before = F.lag("body").over(order)
    starts = clean.withColumn("start", (F.col("bold") & F.coalesce(before, F.lit(False))).cast("int"))
    placed = starts.withColumn("segment", F.sum("start").over(order))
    seen = Window.partitionBy(*keys, "segment").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    marked = placed.withColumn("heading", F.col("bold") & ~F.coalesce(F.max("body").over(seen), F.lit(False)))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("line", "text")))), lambda x: x["text"]), "\n")
    grouped = marked.groupBy(*keys, "segment").agg(joined(F.lit(True)).alias("text"), joined(F.col("heading")).alias("heading"))
    return grouped.select(*keys, F.col("segment").cast("int").alias("segment"), "text", F.when(F.length("heading") > 0, F.col("heading")).alias("heading"))


def two_columns(lines: DataFrame, words: DataFrame, separators: DataFrame) -> DataFrame:
    """Tables rebuilt from words: ``table_id, row, column, text``, for tables that allow it.

    ``lines``: ``table_id, line`` of each word in ``words`` (``table_id, line, x0, x1, text``);
    ``separators``: ``table_id, x, columns, rows`` of what was detected.  It must have two
    columns and three rows, four lines or more, no word across the separator, and
    at least max(3, (lines + 2) / 3) lines with words on both sides.
    """
    n = lines.groupBy("table_id").agg(F.countDistinct("line").alias("lines"))
    usable = separators.where((F.col("columns") == 2) & (F.col("rows") >= 3)).join(n.where("lines >= 4"), "table_id")
    sided = words.join(usable, "table_id").select("table_id", "line", "x0", F.trim("text").alias("text"), "lines", ((F.col("x0") < F.col("x")) & (F.col("x") < F.col("x1"))).alias("crosses"), F.when((F.col("x0") + F.col("x1")) / 2 < F.col("x"), 0).otherwise(1).alias("column"))
    rows = sided.where(F.length("text") > 0).groupBy("table_id", "line", "column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ").alias("text"), F.max("crosses").alias("crosses"), F.first("lines").alias("lines"))
    per_line = rows.groupBy("table_id", "line").agg((F.countDistinct("column") == 2).alias("paired"), F.max("crosses").alias("crosses"), F.first("lines").alias("lines"))
    good = per_line.groupBy("table_id").agg(F.count_if("paired").alias("paired"), F.max("crosses").alias("crosses"), F.first("lines").alias("lines"))
    good = good.where(~F.col("crosses") & (F.col("paired") >= F.greatest(F.lit(3), F.floor((F.col("lines") + 2) / 3)))).select("table_id")
    return rows.join(good, "table_id").select("table_id", F.col("line").alias("row"), "column", "text")


def captions(tables: DataFrame, boxes: DataFrame, reach: float = 48.0, overlap: float = 0.35, gap: float = 18.0) -> DataFrame:
    """``table_id, caption``: the one or two text boxes right above a table, top one first.

    A box counts if it ends at most ``reach`` above the table and overlaps ``overlap`` of the
    narrower of both; the second is one that ends at most ``gap`` above the first.
    """
    place, band = ["doc", "page", "x0", "x1", "y0"], lambda y: F.floor(y / (reach + 2))
    # of boxes of one place the first three matter: a table takes two, and one may bear its own id
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    usable = boxes.select(*place, "y1", "box_id", text.alias("text"), F.lower("kind").alias("kind")).where(F.length("text").between(1, 240) & F.col("kind").isin("text", "title"))
    nth = Window.partitionBy("doc", "page", "x0", "x1", "y1").orderBy("box_id")
    few = usable.withColumn("nth", F.row_number().over(nth)).where("nth <= 3").withColumn("band", band(F.col("y1")))
    # tables of one place have the same boxes above them; bands of y as wide as the reach keep far boxes from being met
    places = tables.select(*place).distinct().withColumn("band", F.explode(F.sequence(band(F.col("y0") - reach), band(F.col("y0") + 2))))
    t, b = places.alias("t"), few.alias("b")
    wide = F.greatest(F.lit(0.0), F.least("t.x1", "b.x1") - F.greatest("t.x0", "b.x0"))
    narrower = F.least(F.greatest(F.lit(1.0), F.col("t.x1") - F.col("t.x0")), F.greatest(F.lit(1.0), F.col("b.x1") - F.col("b.x0")))
    near = (F.col("b.y1") <= F.col("t.y0") + 2) & (F.col("t.y0") - F.col("b.y1") <= reach) & (wide / narrower >= overlap)
    same = (F.col("t.doc") == F.col("b.doc")) & (F.col("t.page") == F.col("b.page")) & (F.col("t.band") == F.col("b.band"))
    above = t.join(b, same & near).select(*[F.col(f"t.{c}").alias(c) for c in place], F.col("b.y0").alias("top"), "b.y1", "b.text", "b.box_id")
    first = Window.partitionBy(*place).orderBy(F.desc("y1"), "box_id")
    above = above.withColumn("nth", F.row_number().over(first)).where("nth <= 3")
    found = tables.select("table_id", *place).join(above, place).where(F.col("table_id") != F.col("box_id")).select("table_id", F.col("top").alias("y0"), "y1", "text", "box_id")
    order = Window.partitionBy("table_id").orderBy(F.desc("y1"), "box_id")
    ranked = found.select("*", F.row_number().over(order).alias("n"), F.lag("y0").over(order).alias("below")).where((F.col("n") == 1) | ((F.col("n") == 2) & (F.col("below") - F.col("y1") <= gap)))
    return ranked.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "text"))), lambda x: x["text"]), "\n").alias("caption"))


def overlap_share(a: str, b: str) -> Column:
    """Intersection over union of two boxes ``x0, y0, x1, y1`` under the aliases ``a`` and ``b``."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(f"{a}.{hi}", f"{b}.{hi}") - F.greatest(f"{a}.{lo}", f"{b}.{lo}"))
    area = lambda x: F.greatest(F.lit(0.0), F.col(f"{x}.x1") - F.col(f"{x}.x0")) * F.greatest(F.lit(0.0), F.col(f"{x}.y1") - F.col(f"{x}.y0"))
    both = side("x0", "x1") * side("y0", "y1")
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def replacements(detected: DataFrame, digital: DataFrame, least_overlap: float = 0.75, least_length: float = 0.75, least_cover: float = 0.72) -> DataFrame:
    """``table_id, digital_id, overlap, coverage, replaced``: for each detected table the digital one it overlaps most.

    Both have ``doc, page, x0, y0, x1, y1, columns, text`` and an id.  It is replaced if
    they overlap enough, have as many columns, and the digital text is long enough and
    covers the detected text's words, weighted by their lengths.
    """
    d, g = detected.alias("d"), digital.alias("g")
    both = d.join(g, (F.col("d.doc") == F.col("g.doc")) & (F.col("d.page") == F.col("g.page"))).select("d.table_id", "g.digital_id", overlap_share("d", "g").alias("overlap"), F.col("d.columns").alias("dc"), F.col("g.columns").alias("gc"), F.col("d.text").alias("dt"), F.col("g.text").alias("gt")).where("overlap > 0")
    best = both.withColumn("n", F.row_number().over(Window.partitionBy("table_id").orderBy(F.desc("overlap"), "digital_id"))).where("n = 1")
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), 0)
    count = lambda c: best.select("table_id", F.explode(words(c)).alias("w")).groupBy("table_id", "w").agg(F.count(F.lit(1)).alias("n"))
    a, b = count("dt"), count("gt").withColumnRenamed("n", "m")
    cover = a.join(b, ["table_id", "w"], "left").groupBy("table_id").agg((F.sum(F.length("w") * F.least("n", F.coalesce("m", F.lit(0)))) / F.sum(F.length("w") * F.col("n"))).alias("coverage"))
    size = lambda c: F.length(F.array_join(words(c), ""))
    rows = best.join(cover, "table_id", "left")
    coverage = F.coalesce("coverage", F.lit(1.0))
    ok = (F.col("overlap") >= least_overlap) & (F.col("dc") >= 1) & (F.col("dc") == F.col("gc")) & (size("gt") > 0) & ((size("dt") == 0) | ((size("gt") >= F.greatest(F.lit(1), F.floor(size("dt") * least_length))) & (coverage >= least_cover)))
    return rows.select("table_id", "digital_id", F.round("overlap", 6).alias("overlap"), F.round(coverage, 6).alias("coverage"), ok.alias("replaced"))


def cell_heading(heading: Column, column_header: Column) -> Column:
    """A cell's heading without the column's header lines it begins with, as often as it does; null if nothing is left."""
    lines = lambda x: F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), "\n"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: F.length(s) > 0)
    head = lines(column_header)
    n = F.size(head)
    drop = lambda own, _: F.when((n > 0) & (F.size(own) >= n) & (F.slice(own, 1, F.greatest(n, F.lit(1))) == head), F.slice(own, n + 1, F.greatest(F.size(own), F.lit(1)))).otherwise(own)
    left = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(lines(heading)), F.lit(1))), lines(heading), drop)
    return F.when(F.size(left) > 0, F.array_join(left, "\n"))


def _narrowed(text: str) -> str:
    import unicodedata

    return unicodedata.normalize("NFKC", text).strip()


def is_number_only(text: str) -> bool:
    import re

    return re.fullmatch(r"(?i)(?:\d+(?:\.\d+){0,5}|[IVXLCDM]+)[.、)）:]?", _narrowed(text)) is not None


def is_numbered(text: str) -> bool:
    """Whether a title's number makes it a heading, as ``functions.text.heading_level`` tells of a column."""
    import re

    from strandline.functions.text import NUMBERED_TITLE, TOP_TITLES

    line = _narrowed(text)
    return any(re.match(p, line) for p in (NUMBERED_TITLE, *TOP_TITLES))


def beside(number: dict, title: dict) -> bool:
    """Whether a title stands on the line of a number, right after it: boxes ``x0, x1, y0, y1``."""
    low = min(max(1.0, b["y1"] - b["y0"]) for b in (number, title))
    high = max(max(1.0, b["y1"] - b["y0"]) for b in (number, title))
    shared = max(0.0, min(number["y1"], title["y1"]) - max(number["y0"], title["y0"]))
    starts = title["x0"] > number["x0"] or abs(title["x0"] - number["x0"]) <= 12
    return shared / low >= 0.6 and starts and -0.6 * low <= title["x0"] - number["x1"] <= max(24.0, 4.0 * high)


def below(first: dict, second: dict) -> bool:
    """Whether a box goes on where another ends: a small gap, and under it or flush with it."""
    heights = [max(1.0, b["y1"] - b["y0"]) for b in (first, second)]
    widths = [max(1.0, b["x1"] - b["x0"]) for b in (first, second)]
    gap = second["y0"] - first["y1"]
    shared = max(0.0, min(first["x1"], second["x1"]) - max(first["x0"], second["x0"]))
    return -0.25 * max(heights) <= gap <= max(3.0, 0.6 * min(heights)) and (shared / min(widths) >= 0.2 or abs(first["x0"] - second["x0"]) <= 12)


def one_title(first: dict, second: dict) -> bool:
    """Whether two title boxes, one after the other on a page, are fragments of one title.

    A bare number joins the title beside it; numbered titles and those that the
    outline names (``named``) stay as they are; others join what goes on below.
    """
    a, b = (first["text"] or "").strip(), (second["text"] or "").strip()
    if not a or not b:
        return False
    if is_number_only(a):
        return len(b) <= 120 and not is_number_only(b) and beside(first, second)
    return not (is_numbered(a) or is_numbered(b) or first["named"] or second["named"]) and below(first, second)


def merge_titles(boxes: DataFrame) -> DataFrame:
    """``doc, page, n, kind, text, x0, x1, y0, y1, named`` → the boxes with the fragments of titles joined: ``doc, page, n, kind, text, x0, x1, y0, y1, parts``.

    A fold over the boxes of each page in reading order; ``parts`` counts what a box was made of.
    """

    def fold(rows):
        shown = lambda r: (r["n"], r["kind"], r["text"], r["x0"], r["x1"], r["y0"], r["y1"], r["parts"])
        last = None
        for r in rows:
            if last and last["kind"].lower() == r["kind"].lower() == "title" and one_title(last, r):
                last |= {"text": f"{last['text'].strip()} {r['text'].strip()}", "x0": min(last["x0"], r["x0"]), "x1": max(last["x1"], r["x1"]), "y0": min(last["y0"], r["y0"]), "y1": max(last["y1"], r["y1"]), "named": False, "parts": last["parts"] + 1}
            else:
                if last:
                    yield shown(last)
                last = r | {"parts": 1}
        if last:
            yield shown(last)

    return _folded(boxes.select("doc", "page", F.col("n").cast("long").alias("n"), F.coalesce("kind", F.lit("")).alias("kind"), "text", "x0", "x1", "y0", "y1", "named"), ["doc", "page"], ["n"], fold, "n long, kind string, text string, x0 double, x1 double, y0 double, y1 double, parts int")


def styled_blocks(sections: DataFrame, cells: DataFrame) -> DataFrame:
    """Sections (``doc, n, style, text, body``) and table cells (``doc, n, text, body``) of a document by their styles → blocks in body order.

    The first title is the document's, later ones are headings of level 1 (a warning);
    heading styles give their level, list styles list items; cells keep their text without a grid (a warning).
    Result: ``doc, position, kind, level, text, warning``.
    """
    style = F.lower(F.trim(F.coalesce("style", F.lit(""))))
    text = F.trim("text")
    rows = sections.select("doc", "n", "body", style.alias("style"), text.alias("text")).where(F.length("text") > 0)
    title = F.col("style").isin("title", "文档标题")
    nth = F.count_if(title).over(Window.partitionBy("doc").orderBy("n"))
    level = F.regexp_extract("style", r"(?:heading|标题)\s*([1-6])", 1)
    kind = F.when(title & (nth == 1), "TITLE").when(title | (F.length(level) > 0), "HEADING").when(F.contains("style", F.lit("list")) | F.contains("style", F.lit("列表")), "LIST_ITEM").otherwise("PARAGRAPH")
    flat = title & (nth > 1)
    done = rows.select("doc", "body", "n", F.lit(0).alias("part"), kind.alias("kind"), F.when(flat, 1).when(~title & (F.length(level) > 0), level.cast("int")).alias("level"), "text", F.when(flat, "DOCUMENT_TITLE_FLATTENED").alias("warning"))
    flattened = cells.select("doc", "body", "n", F.lit(1).alias("part"), F.lit("TABLE_CELL").alias("kind"), F.lit(None).cast("int").alias("level"), text.alias("text"), F.lit("TABLE_STRUCTURE_FLATTENED").alias("warning")).where(F.length("text") > 0)
    order = Window.partitionBy("doc").orderBy("body", "part", "n")
    return done.unionByName(flattened).select("doc", (F.row_number().over(order) - 1).alias("position"), "kind", "level", "text", "warning")
