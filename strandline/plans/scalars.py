"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.adapters import table
from strandline.functions import hashing as H
from strandline.functions import text as T
from strandline.functions import vectors as V

Q, S = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


def docs(s, d):
    return table(s, d, "documents")


SP = r"[\x09-\x0D\x1C-\x20\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]"


@query(r"""SELECT doc_id, length(regexp_replace(regexp_replace(text, '^\x{FEFF}', ''), '\r\n?', chr(10), 'g')) AS n, md5(regexp_replace(regexp_replace(text, '^\x{FEFF}', ''), '\r\n?', chr(10), 'g')) AS digest, CAST(NULL AS VARCHAR) AS error FROM documents""")
def source_text(s, d):
    clean = T.clean_source(F.col("text"))
    return docs(s, d).select("doc_id", F.length(clean).cast("long").alias("n"), F.md5(clean).alias("digest"), T.source_error(F.col("text")).alias("error"))


@query(rf"""SELECT doc_id, md5(regexp_replace('  ' || x || chr(10), '^{SP}+|{SP}+$', '', 'g')) AS block, md5(regexp_replace(chr(10) || '  ' || x || ' ' || chr(10), '^\n+|\n+$', '', 'g')) AS code
FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\x{{FEFF}}', '', 'g') AS x FROM documents)""")
def normalize_blocks(s, d):
    a = T.normalize_block(F.concat(F.lit("  "), "text", F.lit("\n")), F.lit("PARAGRAPH"))
    b = T.normalize_block(F.concat(F.lit("\n  "), "text", F.lit(" \n")), F.lit("CODE_BLOCK"))
    return docs(s, d).select("doc_id", F.md5(a).alias("block"), F.md5(b).alias("code"))


@query(r"""SELECT doc_id, CAST(greatest(1, (a + 3) // 4 + n - a) AS BIGINT) AS tokens, CAST(n AS BIGINT) AS units FROM (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) AS a FROM documents)""")
def estimate_tokens(s, d):
    return docs(s, d).select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"), T.utf16_len(F.col("text")).alias("units"))


def _units(x: str, n: int) -> str:
    """SQL: the longest prefix of at most ``n`` UTF-16 units, found by trying every length."""
    return rf"left({x}, list_max(list_filter(range(0, {n + 1}), lambda k: k <= length({x}) AND k + length(regexp_replace(left({x}, k), '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')) <= {n})))"


@query(rf"""SELECT doc_id, {_units("wide", 50)} AS prefix, regexp_replace({_units("bare", 40)}, '{SP}+$', '') AS bounded
FROM (SELECT doc_id, wide, regexp_replace(wide, '^{SP}+|{SP}+$', '', 'g') AS bare FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '😀' || left(text, 25) || '😀😀' || text ELSE text END AS wide FROM documents))""")
def bounded_text(s, d):
    wide = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\U0001f600"), F.left("text", F.lit(25)), F.lit("\U0001f600\U0001f600"), "text")).otherwise(F.col("text"))
    return docs(s, d).select("doc_id", T.prefix(wide, 50).alias("prefix"), T.bounded(wide, 40).alias("bounded"))


@query(rf"""WITH x AS (SELECT doc_id, i, regexp_replace(left(regexp_replace(w, '^{SP}+|{SP}+$', '', 'g'), 6), '{SP}+$', '') AS item FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i FROM documents)),
y AS (SELECT doc_id, item, min(i) AS i FROM x WHERE item <> '' GROUP BY doc_id, item), z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM y)
SELECT d.doc_id, coalesce(string_agg(item, '|' ORDER BY i) FILTER (WHERE r <= 12), '') AS items, count(item) FILTER (WHERE r <= 12) BETWEEN 1 AND 12 AS valid FROM documents d LEFT JOIN z USING (doc_id) GROUP BY d.doc_id""")
def bounded_lists(s, d):
    items = T.bounded_list(F.split("text", " "), 12, 6)
    return docs(s, d).select("doc_id", F.array_join(items, "|").alias("items"), F.size(items).between(1, 12).alias("valid"))


@query(r"""SELECT n_nationkey, r_name || ' > ' || n_name || ' > ' || CAST(n_nationkey AS VARCHAR) AS path, n_name AS family FROM nation JOIN region ON r_regionkey = n_regionkey""")
def title_paths(s, d):
    rows = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = T.title_path(F.array("r_name", "n_name", F.col("n_nationkey").cast("string")))
    return rows.select("n_nationkey", path.alias("path"), F.get(T.split_path(path), F.lit(1)).alias("family"))


@query(r"""SELECT c_custkey, 'Document: ' || c_name || chr(10) || 'Section: ' || c_mktsegment || CASE WHEN c_acctbal > 0 THEN chr(10) || 'Topics: ' || c_mktsegment || ' | ' || CAST(c_nationkey AS VARCHAR) ELSE '' END AS text, sha256('x' || c_name) AS digest FROM customer""")
def embedding_templates(s, d):
    topics = F.when(F.col("c_acctbal") > 0, F.array("c_mktsegment", F.col("c_nationkey").cast("string"))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    return table(s, d, "customer").select("c_custkey", T.embedding_text(F.col("c_name"), F.col("c_mktsegment"), F.lit(""), topics, none, none).alias("text"), F.sha2(F.concat(F.lit("x"), "c_name"), 256).alias("digest"))


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(?i)\[\s*E[1-9][0-9]*(?:\s*[,，]\s*E[1-9][0-9]*)*\s*\]', '', 'g'), '[ \t]+([,.;:!?，。；：！？])', '\1', 'g'), '(?m)[ \t]+$', '', 'g'), '^{SP}+|{SP}+$', '', 'g') AS answer
FROM (SELECT doc_id, text || ' [E1, e22] .  ' || chr(10) || ' b [ e3 ] c' AS x FROM documents)""")
def sanitize_answers(s, d):
    return docs(s, d).select("doc_id", T.sanitize_answer(F.concat("text", F.lit(" [E1, e22] .  \n b [ e3 ] c"))).alias("answer"))


@query(r"""WITH x AS (SELECT c_custkey, unnest(['e' || c_nationkey, ' E' || (c_nationkey + 1) || ' ', 'E0', 'e' || c_nationkey, 'F1']) AS e, unnest([1, 2, 3, 4, 5]) AS i FROM customer),
y AS (SELECT c_custkey, upper(trim(e)) AS e, min(i) AS i FROM x WHERE regexp_matches(upper(trim(e)), '^E[1-9][0-9]*$') GROUP BY 1, 2) SELECT c_custkey, string_agg(e, ',' ORDER BY i) AS ids FROM y GROUP BY c_custkey""")
def evidence_id_lists(s, d):
    n = F.col("c_nationkey")
    raw = F.array(F.concat(F.lit("e"), n.cast("string")), F.concat(F.lit(" E"), (n + 1).cast("string"), F.lit(" ")), F.lit("E0"), F.concat(F.lit("e"), n.cast("string")), F.lit("F1"))
    return table(s, d, "customer").select("c_custkey", F.array_join(T.evidence_ids(raw), ",").alias("ids"))


@query(r"""SELECT p_partkey, lower(trim(regexp_replace('  ' || p_type || '   x ', '\s+', ' ', 'g'))) AS header, regexp_replace(regexp_replace(lower(p_name || ' 12.5'), '\d+(\.\d+)*', '#', 'g'), '[^\p{L}\p{N}#]', '', 'g') AS key, lower(regexp_replace(p_name, '\s+', '', 'g')) AS compact FROM part""")
def header_and_title_keys(s, d):
    return table(s, d, "part").select("p_partkey", T.normalize_header(F.concat(F.lit("  "), "p_type", F.lit("   x "))).alias("header"), T.title_key(F.concat("p_name", F.lit(" １２.5"))).alias("key"), T.compact(F.col("p_name")).alias("compact"))


@query(r"""SELECT l_orderkey, l_linenumber, array_to_string(regexp_extract_all(' ' || x, '(?:^|[^\w.])(-?\d+(?:\.\d+)?)', 1), ';') AS numbers FROM (SELECT l_orderkey, l_linenumber, 'q ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' and -' || CAST(l_linenumber AS VARCHAR) || '.5 v1.2' AS x FROM lineitem)""")
def number_tokens(s, d):
    x = F.concat(F.lit("q "), F.col("l_quantity").cast("int").cast("string"), F.lit(" and -"), F.col("l_linenumber").cast("string"), F.lit(".5 v1.2"))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(T.numbers(x), ";").alias("numbers"))


@query(r"""WITH x AS (SELECT p_partkey, p_name, p_size, ['', '1 ', '2. ', '3.4 ', '3.4.5 ', '1.2.3.4.5.6.7. ', '(7) ', '8)'][p_size % 8 + 1] || p_name AS t,
  CASE p_size % 7 WHEN 0 THEN 'Chapter ' || p_size || ': ' || p_name WHEN 1 THEN 'iv. ' || p_name WHEN 2 THEN 'IV ' || p_name WHEN 3 THEN 'unit b - ' || p_name WHEN 4 THEN 'Semester 2: Quarter 1' WHEN 5 THEN '十二、' || p_name ELSE 'Part ' || p_name END AS u FROM part)
SELECT p_partkey, CAST([NULL, NULL, 1, 1, 2, 6, NULL, 1][p_size % 8 + 1] AS BIGINT) AS level_t, CAST([1, 1, NULL, 1, 1, 1, NULL][p_size % 7 + 1] AS BIGINT) AS level_u,
  regexp_extract(t, '^\s*((?:\d+(?:\.\d+)*\.?)?)\s*(.*?)\s*$', 1) AS number, regexp_extract(t, '^\s*((?:\d+(?:\.\d+)*\.?)?)\s*(.*?)\s*$', 2) AS title,
  length(regexp_replace(t, '[^\p{L}]', '', 'g')) > 0 AND length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) * 10 >= length(regexp_replace(t, '[^\p{L}]', '', 'g')) * 9 AS upper FROM x""")
def heading_texts(s, d):
    """Numbered titles of every form; the SQL states the level of each form as a value."""
    n = F.col("p_size").cast("int")
    t = F.concat(F.get(F.array(*[F.lit(x) for x in ("", "1 ", "2. ", "3.4 ", "3.4.5 ", "1.2.3.4.5.6.7. ", "(7) ", "8)")]), n % 8), "p_name")
    forms = [F.concat(F.lit("Chapter "), n.cast("string"), F.lit(": "), "p_name"), F.concat(F.lit("iv. "), "p_name"), F.concat(F.lit("IV "), "p_name"), F.concat(F.lit("unit b - "), "p_name"), F.lit("Semester 2: Quarter 1"), F.concat(F.lit("十二、"), "p_name"), F.concat(F.lit("Part "), "p_name")]
    rows = table(s, d, "part").select("p_partkey", t.alias("t"), F.get(F.array(*forms), n % 7).alias("u"))
    return rows.select("p_partkey", T.heading_level(F.col("t")).alias("level_t"), T.heading_level(F.col("u")).alias("level_u"), T.split_number(F.col("t"))["number"].alias("number"), T.split_number(F.col("t"))["title"].alias("title"), T.mostly_upper(F.col("t")).alias("upper"))


@query(r"""WITH w AS (SELECT r, unnest(string_split(trim(line), ' ')) AS w FROM (SELECT row_number() OVER () AS r, trim(line) AS line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '')),
c AS (SELECT r, count(*) FILTER (WHERE w <> '') AS n, count(*) FILTER (WHERE w <> '' AND lower(w) NOT IN ('a', 'an', 'and', 'as', 'at', 'by', 'for', 'from', 'in', 'of', 'on', 'or', 'the', 'to', 'with')) AS big,
  count(*) FILTER (WHERE w <> '' AND lower(w) NOT IN ('a', 'an', 'and', 'as', 'at', 'by', 'for', 'from', 'in', 'of', 'on', 'or', 'the', 'to', 'with') AND regexp_matches(w, '^[\p{Lu}\p{N}]')) AS cap FROM w GROUP BY r)
SELECT n BETWEEN 1 AND 12 AND big > 0 AND cap * 4 >= big * 3 AS plausible, count(*) AS lines FROM c GROUP BY 1""")
def plausible_headings(s, d):
    lines = docs(s, d).select(F.explode(F.split("text", "\n")).alias("line")).where(F.length(F.trim("line")) > 0)
    return lines.groupBy(T.plausible_heading(F.col("line")).alias("plausible")).agg(F.count(F.lit(1)).alias("lines"))


@query(r"""SELECT source, lang, fmt AS format, count(*) AS n FROM (SELECT source, lang, CASE WHEN doc_id % 5 = 0 THEN 'PDF' WHEN doc_id % 5 = 1 THEN 'DOCX' WHEN doc_id % 5 = 2 THEN 'MARKDOWN' WHEN doc_id % 5 = 3 THEN 'TXT' END AS fmt FROM documents) GROUP BY ALL""")
def file_formats(s, d):
    names = F.array(*[F.lit(x) for x in ("a.PDF", "b.docx", "c.markdown", "d.txt", "e.exe")])
    return docs(s, d).groupBy("source", "lang", T.extension_format(F.get(names, (F.col("doc_id") % 5).cast("int"))).alias("format")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT l_orderkey, l_linenumber, coalesce(nullif(concat_ws(' / ', CASE WHEN l_returnflag <> 'N' THEN l_returnflag || ' / ' || l_linestatus END, CASE WHEN l_linenumber % 2 = 0 THEN '第 ' || l_linenumber || ' 页' WHEN l_linenumber % 3 = 0 THEN '第 ' || (l_orderkey + 1) || ' 行' END), ''), '文档正文') AS label FROM lineitem""")
def location_labels(s, d):
    path = F.when(F.col("l_returnflag") != "N", F.array("l_returnflag", "l_linestatus")).otherwise(F.array().cast("array<string>"))
    n = F.col("l_linenumber")
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", T.location_label(path, F.when(n % 2 == 0, n), F.when(n % 3 == 0, F.col("l_orderkey") + 1)).alias("label"))


@query(r"""SELECT p_partkey, [true, true, true, false, true, false][p_size % 6 + 1] AS chapter, CASE p_size % 4 WHEN 0 THEN '1.2. New Plate' WHEN 1 THEN '3.4.5. New Plate' WHEN 2 THEN '1.2.no plate is new' ELSE p_name END AS ordered,
  CASE p_size % 3 WHEN 0 THEN '2.1. The New Plate.' END AS heading, CASE p_size % 3 WHEN 0 THEN 'Body of ' || p_name WHEN 1 THEN '2.1. it is not one. Body' ELSE p_name END AS body FROM part""")
def title_forms(s, d):
    """Titles of every form; the SQL states what becomes of each."""
    n = F.col("p_size").cast("int")
    pick = lambda k, *xs: F.get(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in xs]), n % k)
    chapter = pick(6, "Ｍethods:", "参考文献", "ALL CAPS TITLe", "All Caps", "ABCD 12", "ABC")
    ordered = pick(4, "1.2.New Plate", "New Plate 3.4.5.", "1.2.no plate is new", F.col("p_name"))
    split = T.split_numbered(pick(3, F.concat(F.lit("2.1. The New Plate. Body of "), "p_name"), "2.1. it is not one. Body", F.col("p_name")))
    return table(s, d, "part").select("p_partkey", T.chapter_title(chapter).alias("chapter"), T.ordered_number(ordered).alias("ordered"), split["heading"].alias("heading"), split["body"].alias("body"))


@query("""SELECT p_partkey, replace(replace(replace(x, '!', '!!'), '%', '!%'), '_', '!_') AS pattern, true AS found FROM (SELECT p_partkey, p_name || '_50%!' AS x FROM part)""")
def escaped_patterns(s, d):
    x = F.concat("p_name", F.lit("_50%!"))
    rows = table(s, d, "part").select("p_partkey", x.alias("x"), T.like_escaped(x).alias("pattern"))
    return rows.select("p_partkey", "pattern", F.like(F.concat(F.lit("a "), "x"), F.concat(F.lit("%"), F.col("pattern")), F.lit("!")).alias("found"))


@query(r"""WITH m AS (SELECT doc_id, list_filter(list_transform(string_split(text, ' '), lambda w, i: {'text': w, 'matched': i % 2 = 0}), lambda x: x.text <> '') AS segs FROM documents)
SELECT doc_id, CAST(len(segs) AS BIGINT) AS segments, CAST(len(list_filter(segs, lambda x: x.matched)) AS BIGINT) AS matched, md5(array_to_string(list_transform(segs, lambda x: x.text || CASE WHEN x.matched THEN '+' ELSE '-' END), chr(10))) AS digest FROM m""")
def highlight_segments(s, d):
    """Whole texts, every second word marked as a match."""
    parts = F.transform(F.split("text", " "), lambda p, i: F.when(i % 2 == 1, F.concat(F.lit("\ue000"), p, F.lit("\ue001"))).otherwise(p))
    rows = docs(s, d).select("doc_id", T.highlight_segments(F.array_join(parts, "")).alias("s"))
    line = F.array_join(F.transform("s", lambda x: F.concat(x["text"], F.when(x["matched"], "+").otherwise("-"))), "\n")
    return rows.select("doc_id", F.size("s").cast("long").alias("segments"), F.size(F.filter("s", lambda x: x["matched"])).cast("long").alias("matched"), F.md5(line).alias("digest"))


@query(r"""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 7 = 0 OR o_orderkey % 7 = 3 ELSE contains(lower(regexp_replace(o_orderpriority, '\s+', '', 'g')), 'high') OR contains('high', lower(regexp_replace(o_orderpriority, '\s+', '', 'g'))) END AS matched FROM orders""")
def answer_matches(s, d):
    k = F.col("o_orderkey")
    answer = F.when(k % 2 == 0, F.concat(F.lit("about "), (k % 7).cast("string"), F.lit(".0 or "), (k % 7 - 3).cast("string"))).otherwise(F.col("o_orderpriority"))
    return table(s, d, "orders").select("o_orderkey", F.coalesce(T.match_answer(answer, F.when(k % 2 == 0, F.lit("0")).otherwise(F.lit("High"))), F.lit(False)).alias("matched"))


@query("""SELECT o_orderkey, sha256(o_orderstatus || chr(10) || CAST(o_custkey AS VARCHAR) || chr(10) || o_orderpriority) AS lines,
sha256(unhex(lpad(hex(octet_length(encode(o_orderstatus))), 8, '0') || hex(encode(o_orderstatus)) || lpad(hex(octet_length(encode(o_orderpriority))), 8, '0') || hex(encode(o_orderpriority)))) AS prefixed, sha256('seed|case|' || CAST(o_orderkey AS VARCHAR)) AS sample_key FROM orders""")
def fingerprints(s, d):
    return table(s, d, "orders").select(
        "o_orderkey", H.fingerprint_lines(F.col("o_orderstatus"), F.col("o_custkey"), F.col("o_orderpriority")).alias("lines"),
        H.fingerprint_prefixed(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("prefixed"), H.hash_order("seed", F.lit("case"), F.col("o_orderkey")).alias("sample_key"),
    )


@query("""SELECT event_id, 'open:{"id":"' || CAST(event_id AS VARCHAR) || '","type":"' || event_type || '"}' AS signature FROM events""")
def call_signatures(s, d):
    return table(s, d, "events").select("event_id", H.call_signature(F.lit("open"), F.create_map(F.lit("type"), F.col("event_type"), F.lit("id"), F.col("event_id").cast("string"))).alias("signature"))


@query("""SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'DIMENSION' WHEN vec_id % 7 = 1 THEN 'ZERO' WHEN vec_id % 7 = 2 THEN 'NOT_FINITE' END AS reason FROM embeddings""")
def vector_validity(s, d):
    e = F.col("embedding")
    k = F.col("vec_id") % 7
    spoilt = F.when(k == 0, F.slice(e, 1, 3)).when(k == 1, F.transform(e, lambda x: x * 0)).when(k == 2, F.transform(e, lambda x, i: F.when(i == 5, F.lit(float("nan"))).otherwise(x).cast("float"))).otherwise(e)
    return table(s, d, "embeddings").select("vec_id", V.invalid_reason(spoilt, 64).alias("reason"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN u > 0 THEN w * h / u ELSE 0 END, 9) AS iou, CAST(ceil(l_quantity / 7) AS BIGINT) AS ceil_div, round(l_tax * 200) / 2 AS half FROM (SELECT *, l_quantity * 10 + 15 * 8 - w * h AS u FROM (SELECT *, greatest(0.0, least(l_quantity, l_linenumber + 15) - l_linenumber) AS w, greatest(0.0, least(10.0, 12.0) - 4.0) AS h FROM lineitem))""")
def boxes_and_rounding(s, d):
    q, n = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    a = {"x0": F.lit(0.0), "y0": F.lit(0.0), "x1": q, "y1": F.lit(10.0)}
    b = {"x0": n, "y0": F.lit(4.0), "x1": n + 15, "y1": F.lit(12.0)}
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(V.iou(a, b), 9).alias("iou"), F.ceil(q / 7).cast("long").alias("ceil_div"), (F.round(F.col("l_tax") * 200) / 2).alias("half"))


@query("""SELECT event_id, CAST(date_diff('microsecond', ts, ts + to_microseconds(CAST(event_id * 1237 AS BIGINT))) // 1000 AS BIGINT) AS ms, ts - INTERVAL 15 MINUTES AS stale_before, ts - INTERVAL 90 DAYS AS expired_before FROM events""")
def durations(s, d):
    from strandline.operators.control import duration_ms

    ts = F.col("ts")
    later = (ts.cast("timestamp") + F.expr("make_dt_interval(0, 0, 0, event_id * 1237 / 1000000D)")).cast("timestamp_ntz")
    return table(s, d, "events").select("event_id", duration_ms(ts, later).alias("ms"), (ts - F.expr("INTERVAL 15 MINUTES")).alias("stale_before"), (ts - F.expr("INTERVAL 90 DAYS")).alias("expired_before"))


@query(r"""WITH RECURSIVE t AS (SELECT doc_id, text AS rest, 0 AS n, CAST(NULL AS VARCHAR) AS piece FROM (SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS text FROM documents)
UNION ALL SELECT doc_id, ltrim(substr(rest, k + 1), ' '), n + 1, trim(left(rest, k), ' ') FROM (
  SELECT *, CASE WHEN length(rest) <= 512 THEN length(rest) WHEN regexp_matches(substr(rest, 385, 128), '[.!?。！？]') THEN 384 + length(regexp_extract(substr(rest, 385, 128), '^.*[.!?。！？]')) ELSE 512 END AS k FROM t WHERE rest <> ''))
SELECT doc_id, count(*) AS pieces, sum(length(piece)) AS chars, max(length(piece)) AS longest FROM t WHERE piece <> '' GROUP BY doc_id""")
def safe_split(s, d):
    one_line = F.regexp_replace("text", r"\s+", " ")
    pieces = docs(s, d).select("doc_id", one_line.alias("t")).select("doc_id", F.explode(T.safe_split(512)("t")).alias("p"))
    return pieces.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.length("p")).alias("chars"), F.max(F.length("p")).cast("long").alias("longest"))


@query()
def vector_codec(s, d):
    """Vectors after a round trip through the stored form."""
    e = table(s, d, "embeddings")
    coded = e.select("vec_id", "embedding", V.encode()(F.col("embedding")).alias("payload"))
    return coded.select("vec_id", F.length("payload").alias("n"), F.sha2("payload", 256).alias("digest"), (V.decode()(F.col("payload")) == F.col("embedding")).alias("same"))


@query()
def folded_text(s, d):
    return docs(s, d).select("doc_id", F.md5(T.nfkc_fold()(F.col("text"))).alias("digest"))


QUERIES, SQL = Q, S
