"""Queries of retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.adapters import shared_dir, table
from strandline.functions import text as T
from strandline.operators import retrieve as E
from strandline.operators import search as R
from strandline.operators import vector_index as I

Q, S = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


_CJK = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}"
_LETTER = rf"[^\P{{L}}{_CJK}]"
#: A joining sign between letters or digits is marked, twice since matches do not overlap.
_MARK = chr(0xE005)
_PLAIN = rf"(?:{_LETTER}|[\p{{M}}\p{{N}}_])+(?:{_MARK}[.,''’](?:{_LETTER}|[\p{{M}}\p{{N}}_])+)*"


def _marked(x: str) -> str:
    for _ in range(2):
        x = rf"regexp_replace({x}, '(\p{{L}})([.''’])({_LETTER})', '\1{_MARK}\2\3', 'g')"
        x = rf"regexp_replace({x}, '(\p{{N}})([.,])(\p{{N}})', '\1{_MARK}\2\3', 'g')"
    return x


_UNMARKED = f"lambda t: replace(t, '{_MARK}', '')"
_STOPS = "['" + "', '".join(T.STOP_WORDS) + "']"
#: SQL of each analyzer, over a column ``text``.
ANALYZERS = {
    "plain": r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')",
    "standard": rf"list_transform(regexp_extract_all({_marked('lower(text)')}, '[\p{{Han}}\p{{Hiragana}}]|\p{{Katakana}}+|\p{{Hangul}}+|{_PLAIN}'), {_UNMARKED})",
    "bigram": rf"""list_filter(flatten(list_transform(regexp_extract_all({_marked('lower(text)')}, '[{_CJK}]+|{_PLAIN}'),
      lambda r: CASE WHEN length(r) > 1 AND regexp_matches(r, '^[{_CJK}]') THEN list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) ELSE [replace(r, '{_MARK}', '')] END)), lambda t: NOT list_contains({_STOPS}, t))""",
}


def _bm25_sql(name: str, docs: str, weight: str = "1", analyzer: str = "plain", queries: str = "SELECT item_id AS query_id, text FROM benchmark") -> str:
    return f"""
{name}_q AS (SELECT DISTINCT query_id, unnest({ANALYZERS[analyzer]}) AS term FROM ({queries})),
{name}_t AS (SELECT doc_id, {ANALYZERS[analyzer]} AS t FROM ({docs})),
{name}_s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM {name}_t),
{name}_p AS (SELECT term, doc_id, len, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM {name}_t) WHERE term IN (SELECT term FROM {name}_q) GROUP BY term, doc_id, len),
{name}_d AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
{name} AS (SELECT query_id, doc_id, round(round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) * {weight}, 6) AS score
  FROM {name}_p JOIN {name}_d USING (term) JOIN {name}_q USING (term), {name}_s GROUP BY query_id, doc_id)"""


def _queries(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {_bm25_sql('m', 'SELECT doc_id, text FROM documents')} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM m QUALIFY rank <= 5")
def bm25_topk(s, d):
    return R.bm25_top(table(s, d, "documents"), _queries(s, d), 5)


#: Chinese and Japanese sentences behind the texts and queries, so that the analyzers meet runs without spaces.
_WIDE = ["检索服务支持中文段落", "文档的段落检索", "かな交じりの文書サービス", "it's 3.5 or a.b", "段"]
_WIDE_SQL = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in _WIDE) + "]"
_WIDE_DOCS = f"SELECT doc_id, text || ' ' || {_WIDE_SQL}[doc_id % 5 + 1] AS text, split_part(text, chr(10), 1) || ' ' || {_WIDE_SQL}[doc_id % 3 + 1] AS heading, lang || ' ' || source AS title FROM documents"
_WIDE_QUERIES = f"SELECT item_id AS query_id, text || ' ' || {_WIDE_SQL}[(item_id + 1) % 5 + 1] AS text FROM benchmark"


def _wide(k):
    return F.get(F.array(*[F.lit(x) for x in _WIDE]), k.cast("int"))


def _wide_docs(s, d):
    k = F.col("doc_id")
    return table(s, d, "documents").select("doc_id", F.concat_ws(" ", "text", _wide(k % 5)).alias("text"), F.concat_ws(" ", F.substring_index("text", "\n", 1), _wide(k % 3)).alias("heading"), F.concat_ws(" ", "lang", "source").alias("title"))


def _wide_queries(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", "text", _wide((F.col("item_id") + 1) % 5)).alias("text"))


_FIELD_SQL = [("text", "bigram", 4.0), ("text", "standard", 3.0), ("heading", "bigram", 2.0), ("heading", "standard", 1.5), ("title", "bigram", 1.2), ("title", "standard", 1.0)]


@query(f"""WITH wd AS MATERIALIZED ({_WIDE_DOCS}), {", ".join(_bm25_sql(f"f{i}", f"SELECT doc_id, {c} AS text FROM wd", str(boost), a, _WIDE_QUERIES) for i, (c, a, boost) in enumerate(_FIELD_SQL))},
u AS (SELECT query_id, doc_id, max(score) AS score FROM ({" UNION ALL ".join(f"SELECT * FROM f{i}" for i in range(6))}) GROUP BY query_id, doc_id)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM u QUALIFY rank <= 50""")
def bm25_best_fields(s, d):
    return R.best_fields(_wide_docs(s, d), _wide_queries(s, d), 50)


@query(f"""WITH x AS (SELECT doc_id, text || ' ' || {_WIDE_SQL}[doc_id % 5 + 1] AS text FROM documents), y AS (SELECT doc_id, {ANALYZERS["standard"]} AS a, {ANALYZERS["bigram"]} AS b FROM x)
SELECT doc_id, CAST(len(a) AS BIGINT) AS n_standard, md5(array_to_string(a, ' ')) AS standard, CAST(len(b) AS BIGINT) AS n_bigram, md5(array_to_string(b, ' ')) AS bigram FROM y""")
def analyzers(s, d):
    rows = _wide_docs(s, d).select("doc_id", T.standard_tokens(F.col("text")).alias("a"), T.bigram_tokens(F.col("text")).alias("b"))
    line = lambda x: F.md5(F.array_join(x, " "))
    return rows.select("doc_id", F.size("a").cast("long").alias("n_standard"), line("a").alias("standard"), F.size("b").cast("long").alias("n_bigram"), line("b").alias("bigram"))


@query()
def highlights(s, d):
    """Fragments of the best five hits of each query (tested against a plain version)."""
    hits = R.bm25_top(_wide_docs(s, d), _wide_queries(s, d), 5, analyzer=T.bigram_tokens)
    found = R.highlight(hits.join(_wide_docs(s, d).select("doc_id", "text"), "doc_id"), _wide_queries(s, d))
    return found.select("query_id", "doc_id", F.posexplode(T.highlight_fragments(F.col("fragments"))).alias("n", "segments")).select("query_id", "doc_id", "n", F.size(F.filter("segments", lambda x: x["matched"])).alias("matches"), F.array_join("segments.text", "").alias("fragment"))


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0)
SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) DESC, e.vec_id) AS rank
FROM q JOIN embeddings e ON e.label = q.label QUALIFY rank <= 20""")
def knn_cosine_topk(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.col("label").alias("scope"), "embedding")
    return R.knn(e, e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 20)


@query()
def knn_approximate(s, d):
    """The same queries through the stored index of cells and codes (a test measures the recall against ``knn_cosine_topk``)."""
    e = table(s, d, "embeddings").select("vec_id", F.col("label").alias("scope"), "embedding")
    path = f"{shared_dir(s)}/strandline/vector-index-{uuid.uuid4().hex}"
    I.build(e, path)
    return I.search(s, path, e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 20)


HITS = """kw AS (SELECT l_suppkey AS query_id, l_orderkey % 50 AS version, CAST(l_partkey % 7 AS INTEGER) AS heading, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem WHERE l_returnflag = 'A' QUALIFY rank <= 50),
sem AS (SELECT l_suppkey AS query_id, l_orderkey % 50 AS version, CAST(l_partkey % 7 AS INTEGER) AS heading, l_linenumber = 7 AS is_profile, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem WHERE l_returnflag = 'R' QUALIFY rank <= 20)"""


def _hits(s, d, flag, measure, k):
    order = Window.partitionBy("l_suppkey").orderBy(F.desc(measure), "l_orderkey", "l_linenumber", "l_partkey")
    rows = table(s, d, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_suppkey").alias("query_id"), (F.col("l_orderkey") % 50).alias("version"), (F.col("l_partkey") % 7).cast("int").alias("heading"), (F.col("l_linenumber") == 7).alias("is_profile"), F.row_number().over(order).alias("rank"))
    return rows.where(F.col("rank") <= k)


def _keyword(s, d):
    return _hits(s, d, "A", "l_quantity", 50)


def _semantic(s, d):
    return _hits(s, d, "R", "l_extendedprice", 20)


@query(f"""WITH {HITS} SELECT query_id, version, heading, first, row_number() OVER (PARTITION BY query_id ORDER BY first, version, heading) AS compact FROM (SELECT query_id, version, heading, min(rank) AS first FROM kw GROUP BY ALL)""")
def compact_rank(s, d):
    return R.compact_rank(_keyword(s, d), "version", "heading")


FUSED = """a AS (SELECT query_id, version, heading, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), version, heading) AS kw FROM kw GROUP BY query_id, version, heading),
b AS (SELECT query_id, version, heading, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), version, heading) AS sem FROM (SELECT query_id, version, CASE WHEN is_profile THEN -1 ELSE heading END AS heading, rank FROM sem) GROUP BY query_id, version, heading),
u AS (SELECT query_id, version, heading, max(kw) AS kw, max(sem) AS sem FROM (SELECT query_id, version, heading, kw, NULL AS sem FROM a UNION ALL SELECT query_id, version, heading, NULL, sem FROM b WHERE heading >= 0) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, version ORDER BY least(coalesce(kw, 99999), coalesce(sem, 99999)), heading) AS r FROM u),
p AS (SELECT query_id, version, sem AS profile FROM b WHERE heading < 0),
j AS (SELECT r.query_id, r.version, r.heading, kw, CASE WHEN r.r = 1 THEN least(sem, profile) ELSE sem END AS s FROM r LEFT JOIN p USING (query_id, version)
      UNION ALL SELECT p.query_id, p.version, -1, NULL, profile FROM p WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.query_id = p.query_id AND u.version = p.version)),
fused AS (SELECT query_id, version, heading, round(coalesce(1.0::DOUBLE / (60 + kw), 0) + coalesce(1.0::DOUBLE / (60 + s), 0), 9) AS score, concat_ws('+', CASE WHEN kw IS NOT NULL THEN 'KEYWORD' END, CASE WHEN s IS NOT NULL THEN 'SEMANTIC' END) AS channels, least(kw, s) AS best FROM j),
ranked AS (SELECT query_id, version, heading, score, channels, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best, version, heading) AS rank FROM fused)"""


@query(f"WITH {HITS}, {FUSED} SELECT * FROM ranked")
def rrf_fusion(s, d):
    return R.fuse(_keyword(s, d), _semantic(s, d))


@query(f"""WITH {HITS}, {FUSED}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id, heading ORDER BY rank) AS rnd, min(rank) OVER (PARTITION BY query_id, heading) AS first FROM ranked)
SELECT query_id, version, heading, rank, row_number() OVER (PARTITION BY query_id ORDER BY rnd, first) AS position FROM f QUALIFY position <= 10""")
def coverage_round_robin(s, d):
    return R.round_robin(R.fuse(_keyword(s, d), _semantic(s, d)), "heading", 10).select("query_id", "version", "heading", "rank", "position")


@query(f"""WITH {HITS}, {FUSED}, t AS (SELECT *, CASE WHEN version % 5 > 0 THEN version % 2 END AS page FROM ranked WHERE rank <= 10)
SELECT query_id, count(*) AS results, count(DISTINCT version) AS documents, count(DISTINCT version || ':' || heading % 3) AS families, count(DISTINCT version || ':' || page) AS pages,
  count(*) >= 3 AND (count(DISTINCT version || ':' || heading % 3) <= 1 OR count(DISTINCT version || ':' || page) BETWEEN 1 AND 2) AS concentrated FROM t GROUP BY query_id""")
def search_coverage(s, d):
    top = R.fuse(_keyword(s, d), _semantic(s, d)).where("rank <= 10")
    v = F.col("version")
    return R.coverage(top.select("query_id", "version", (F.col("heading") % 3).alias("family")), top.select("query_id", "version", F.when(v % 5 > 0, v % 2).alias("page")))


@query("""SELECT event_id AS request_id, executed_mode, degraded, error FROM (SELECT event_id, CASE WHEN error IS NOT NULL THEN NULL WHEN mode = 'HYBRID' AND NOT s THEN 'KEYWORD' ELSE mode END AS executed_mode, mode = 'HYBRID' AND k AND NOT s AS degraded, error FROM
 (SELECT *, CASE WHEN mode <> 'SEMANTIC' AND NOT k THEN 'KEYWORD_FAILED' WHEN mode = 'SEMANTIC' AND NOT s THEN 'SEMANTIC_FAILED' END AS error FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'KEYWORD' WHEN 1 THEN 'SEMANTIC' ELSE 'HYBRID' END AS mode, user_id % 5 <> 0 AS k, event_type <> 'error' AS s FROM events)))""")
def degradation(s, d):
    k = F.col("event_id") % 3
    req = table(s, d, "events").select(F.col("event_id").alias("request_id"), F.when(k == 0, "KEYWORD").when(k == 1, "SEMANTIC").otherwise("HYBRID").alias("mode"), (F.col("user_id") % 5 != 0).alias("keyword_ok"), (F.col("event_type") != "error").alias("semantic_ok"))
    return R.execute_mode(req).select("request_id", "executed_mode", "degraded", "error")


@query("""SELECT doc_id AS request_id, n_chars, mode, top_k, CASE WHEN n_chars = 0 THEN 'EMPTY_QUERY' WHEN n_chars > 2000 THEN 'QUERY_TOO_LONG' WHEN mode NOT IN ('KEYWORD', 'SEMANTIC', 'HYBRID') THEN 'UNKNOWN_MODE' WHEN NOT top_k BETWEEN 1 AND 20 THEN 'BAD_TOP_K' END AS error
FROM (SELECT doc_id, CAST(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS BIGINT) AS n_chars, upper(CASE doc_id % 4 WHEN 0 THEN 'keyword' WHEN 1 THEN 'Hybrid' WHEN 2 THEN 'x' ELSE 'HYBRID' END) AS mode, CASE WHEN doc_id % 5 = 0 THEN 5 ELSE doc_id % 25 END AS top_k FROM documents)""".replace("\\\\", "\\"))
def request_normalization(s, d):
    k = F.col("doc_id")
    mode = F.when(k % 4 == 0, "keyword").when(k % 4 == 1, "Hybrid").when(k % 4 == 2, "x")
    req = table(s, d, "documents").select(k.alias("request_id"), F.col("text").alias("query"), mode.alias("mode"), F.when(k % 5 != 0, k % 25).alias("top_k"))
    return R.normalize_request(req)


BLOCKS = """bl AS (SELECT l_orderkey * 10 + l_linenumber AS block_id, l_orderkey AS section, CAST(l_linenumber AS INTEGER) AS ordinal, l_linenumber = 1 AS structural, CAST(l_quantity * 400 AS BIGINT) AS chars FROM lineitem WHERE l_linestatus = 'F'
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity) = 1),
h AS (SELECT o_custkey AS query_id, o_orderkey AS section, CAST(o_orderkey % 5 + 1 AS INTEGER) AS ordinal, CAST(o_orderkey % 3 + 1 AS INTEGER) AS rank FROM orders),
own AS (SELECT query_id, section, block_id, bl.ordinal, structural, chars, min(CASE WHEN bl.ordinal = h.ordinal THEN rank END) AS kw, min(abs(bl.ordinal - h.ordinal)) AS distance FROM bl JOIN h USING (section) GROUP BY ALL),
sel AS (SELECT *, row_number() OVER (PARTITION BY query_id, section ORDER BY kw NULLS LAST, distance, structural, ordinal) AS n FROM own QUALIFY n <= 3)"""


def _blocks(s, d):
    one = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_quantity")
    rows = table(s, d, "lineitem").where("l_linestatus = 'F'").withColumn("r", F.row_number().over(one)).where("r = 1")
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("block_id"), F.col("l_orderkey").alias("section"), F.col("l_linenumber").alias("ordinal"), (F.col("l_linenumber") == 1).alias("structural"), (F.col("l_quantity") * 400).cast("long").alias("chars"))


def _block_hits(s, d):
    k = F.col("o_orderkey")
    return table(s, d, "orders").select(F.col("o_custkey").alias("query_id"), k.alias("section"), (k % 5 + 1).cast("int").alias("ordinal"), (k % 3 + 1).cast("int").alias("rank"))


@query(f"WITH {BLOCKS} SELECT query_id, section, block_id, n FROM sel")
def select_blocks(s, d):
    return R.select_blocks(_blocks(s, d).drop("chars"), _block_hits(s, d)).select("query_id", "section", "block_id", "n")


@query(f"""WITH {BLOCKS}, x AS (SELECT query_id, dense_rank() OVER (PARTITION BY query_id ORDER BY section) AS rank, n, chars FROM sel),
a AS (SELECT *, least(chars, greatest(0, 12000 - coalesce(sum(chars) OVER (PARTITION BY query_id, rank ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS a FROM x),
b AS (SELECT *, CAST(least(a, greatest(0, 80000 - coalesce(sum(a) OVER (PARTITION BY query_id ORDER BY rank, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS used FROM a)
SELECT query_id, rank, n, chars, used, used < chars AS truncated FROM b WHERE used > 0""")
def evidence_budget(s, d):
    sel = R.select_blocks(_blocks(s, d).drop("chars"), _block_hits(s, d)).join(_blocks(s, d).select("block_id", "chars"), "block_id")
    ranked = sel.withColumn("rank", F.dense_rank().over(Window.partitionBy("query_id").orderBy("section")))
    return R.apply_budgets(ranked.select("query_id", "rank", "n", "chars"), 12_000, 80_000)


@query("""WITH r AS (SELECT l_orderkey AS query_id, l_linenumber AS rank, l_partkey AS item, l_suppkey % 100 AS sc FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey) = 1),
u AS (SELECT *, count(*) OVER (PARTITION BY query_id) >= 2 AND sum(CASE WHEN sc = 7 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) = 0 AS usable FROM r)
SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN usable THEN -sc END, rank, item) AS rank, usable AS reranked FROM u""")
def rerank_order(s, d):
    one = Window.partitionBy("l_orderkey", "l_partkey").orderBy("l_linenumber", "l_suppkey")
    rows = table(s, d, "lineitem").withColumn("r", F.row_number().over(one)).where("r = 1").select(F.col("l_orderkey").alias("query_id"), (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))).alias("rank"), F.col("l_partkey").alias("item"), (F.col("l_suppkey") % 100).cast("double").alias("score"))
    scores = rows.where("score <> 7").select("query_id", "item", "score")
    return R.rerank(rows.drop("score"), scores)


@query(f"""WITH {HITS} SELECT 'outside' AS check, count(*) AS n FROM kw WHERE version NOT IN (SELECT DISTINCT l_orderkey % 50 FROM lineitem WHERE l_linenumber = 6 AND l_orderkey % 50 < 48) UNION ALL SELECT 'missing', count(*) FROM (SELECT DISTINCT query_id FROM kw) a FULL JOIN (SELECT DISTINCT query_id FROM sem) b USING (query_id) WHERE a.query_id IS NULL OR b.query_id IS NULL""")
def containment_checks(s, d):
    snapshot = table(s, d, "lineitem").where("l_linenumber = 6 AND l_orderkey % 50 < 48").select((F.col("l_orderkey") % 50).alias("version")).distinct()
    kw, sem = _keyword(s, d), _semantic(s, d)
    outside = kw.join(snapshot, "version", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("outside").alias("check"), "n")
    a, b = kw.select("query_id").distinct().withColumn("a", F.lit(1)), sem.select("query_id").distinct().withColumn("b", F.lit(1))
    missing = a.join(b, "query_id", "full_outer").where("a IS NULL OR b IS NULL").agg(F.count(F.lit(1)).alias("n")).select(F.lit("missing").alias("check"), "n")
    return outside.union(missing)


_ADDRESS = """bl AS (SELECT l_orderkey AS version, l_orderkey || ':' || l_linenumber AS block_id, l_linenumber // 3 AS heading, l_linenumber AS ordinal, l_linenumber * 100 AS start, l_linenumber * 100 + CAST(l_quantity AS BIGINT) AS "end" FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity) = 1)"""


def _addressed(s, d):
    one = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_quantity")
    rows = table(s, d, "lineitem").withColumn("r", F.row_number().over(one)).where("r = 1")
    n = F.col("l_linenumber").cast("long")
    return rows.select(F.col("l_orderkey").alias("version"), F.concat_ws(":", F.col("l_orderkey").cast("string"), n.cast("string")).alias("block_id"), F.floor(n / 3).alias("heading"), n.alias("ordinal"), (n * 100).alias("start"), (n * 100 + F.col("l_quantity").cast("long")).alias("end"))


@query(f"""WITH {_ADDRESS} SELECT version, CASE WHEN version % 11 = 0 THEN block_id || 'x' ELSE block_id END AS block_id, CASE WHEN version % 7 = 0 THEN heading + 1 ELSE heading END AS heading, ordinal, start, CASE WHEN version % 5 = 0 THEN "end" + 1 ELSE "end" END AS "end",
CASE WHEN version % 11 = 0 OR version % 7 = 0 OR version % 5 = 0 THEN 'EVIDENCE_UNAVAILABLE' END AS error FROM bl""")
def hit_addresses(s, d):
    v = F.col("version")
    blocks = _addressed(s, d)
    hits = blocks.select("version", F.when(v % 11 == 0, F.concat("block_id", F.lit("x"))).otherwise(F.col("block_id")).alias("block_id"), F.when(v % 7 == 0, F.col("heading") + 1).otherwise(F.col("heading")).alias("heading"), "ordinal", "start", F.when(v % 5 == 0, F.col("end") + 1).otherwise(F.col("end")).alias("end"))
    return R.resolve_hits(hits, blocks)


@query(f"""WITH {_ADDRESS}, hd AS (SELECT version, heading, min(ordinal) AS start, max(ordinal) + 1 AS "end" FROM bl GROUP BY version, heading),
h AS (SELECT 1 AS query_id, version, heading, 'HEADING_NODE' AS card_type, 1 AS rank, start, "end", NULL AS cs FROM hd
  UNION ALL SELECT 1, version, heading, 'HEADING_SUBPARTITION', 2, start + CASE WHEN version % 6 = 0 THEN 9 ELSE 0 END, "end", CASE WHEN version % 4 = 1 THEN 0 END FROM hd WHERE version % 3 <> 2),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY version, heading ORDER BY card_type = 'HEADING_NODE', rank) = 1)
SELECT query_id, version, heading, card_type, start, "end", CASE WHEN card_type = 'HEADING_SUBPARTITION' AND (version % 6 = 0 OR (cs IS NOT NULL AND cs <> start * 100)) THEN 'EVIDENCE_UNAVAILABLE' END AS error FROM b""")
def semantic_addresses(s, d):
    blocks = _addressed(s, d)
    headings = blocks.groupBy("version", "heading").agg(F.min("ordinal").alias("start"), (F.max("ordinal") + 1).alias("end"))
    v, null = F.col("version"), F.lit(None).cast("long")
    full = headings.select(F.lit(1).alias("query_id"), "version", "heading", F.lit("HEADING_NODE").alias("card_type"), F.lit(1).alias("rank"), "start", "end", null.alias("canonical_start"), null.alias("canonical_end"))
    part = headings.where(v % 3 != 2).select(F.lit(1).alias("query_id"), "version", "heading", F.lit("HEADING_SUBPARTITION").alias("card_type"), F.lit(2).alias("rank"), (F.col("start") + F.when(v % 6 == 0, 9).otherwise(0)).alias("start"), "end", F.when(v % 4 == 1, F.lit(0).cast("long")).alias("canonical_start"), null.alias("canonical_end"))
    return R.semantic_addresses(full.unionByName(part), headings, blocks.select("version", "ordinal", F.col("start").alias("char_start"), F.col("end").alias("char_end")))


@query("""SELECT o_orderkey AS version, CASE WHEN mismatches <> '' THEN 'EVIDENCE_UNAVAILABLE' END AS error, mismatches FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'manifest' WHEN o_orderkey % 11 = 0 THEN 'object'
  ELSE concat_ws(',', CASE WHEN o_orderkey % 7 = 0 THEN 'tenant_id' END, CASE WHEN o_orderkey % 5 = 0 THEN 'size_bytes' END, CASE WHEN o_orderkey % 3 = 0 THEN 'text_sha256' END) END AS mismatches FROM orders)""")
def load_checks(s, d):
    k = F.col("o_orderkey")
    facts = {"tenant_id": F.col("o_custkey") % 5, "bucket": F.col("o_orderstatus"), "size_bytes": k * 7, "object_sha256": F.sha2("o_orderpriority", 256), "block_count": k % 9, "heading_count": k % 4, "warning_count": k % 2, "text_length": k * 3, "text_sha256": F.sha2("o_orderstatus", 256)}
    orders = table(s, d, "orders")
    spoilt = {"tenant_id": F.when(k % 7 == 0, F.lit(-1)).otherwise(facts["tenant_id"]), "size_bytes": F.when(k % 5 == 0, F.lit(0)).otherwise(facts["size_bytes"]), "text_sha256": F.when(k % 3 == 0, F.lit("x")).otherwise(facts["text_sha256"])}
    manifests = orders.where(k % 13 != 0).select(k.alias("version"), *[v.alias(c) for c, v in facts.items()])
    loaded = orders.where(k % 11 != 0).select(k.alias("version"), *[v.alias(c) for c, v in (facts | spoilt).items()])
    return R.load_errors(orders.select(k.alias("version")), manifests, loaded)


@query(f"""WITH {HITS}, {FUSED}, nn AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM ranked), pp AS (SELECT * FROM nn WHERE rank > 5 AND rank <= 10), cc AS (SELECT query_id, version, count(*) AS c FROM pp GROUP BY ALL)
SELECT query_id, version, heading, rank, count(DISTINCT version) OVER (PARTITION BY query_id) AS documents, count(DISTINCT heading) OVER (PARTITION BY query_id) AS families, max(c) OVER (PARTITION BY query_id) AS largest, CASE WHEN n > 10 THEN 10 END AS next_offset FROM pp JOIN cc USING (query_id, version)""")
def search_tool_page(s, d):
    """The second page of five of every query's fused ranking."""
    return R.search_page(R.fuse(_keyword(s, d), _semantic(s, d)).select("query_id", "version", "heading", "rank"), 5, 5)


@query(f"""WITH rq AS (SELECT item_id AS query_id, CASE WHEN item_id % 11 = 4 THEN ' ' ELSE text END AS text, ['HYBRID', 'KEYWORD', 'SEMANTIC'][item_id % 3 + 1] AS mode, item_id % 7 <> 0 AS k, item_id % 5 <> 0 AS s FROM benchmark),
e0 AS (SELECT *, CASE WHEN text = ' ' THEN 'EMPTY_QUERY' WHEN mode <> 'SEMANTIC' AND NOT k THEN 'KEYWORD_FAILED' WHEN mode = 'SEMANTIC' AND NOT s THEN 'SEMANTIC_FAILED' END AS error, text <> ' ' AND mode = 'HYBRID' AND k AND NOT s AS degraded FROM rq),
ex AS (SELECT *, CASE WHEN error IS NOT NULL THEN NULL WHEN degraded THEN 'KEYWORD' ELSE mode END AS executed FROM e0),
{_bm25_sql("m", "SELECT doc_id, text FROM documents", queries="SELECT query_id, text FROM ex WHERE executed IN ('KEYWORD', 'HYBRID')")},
kw AS (SELECT query_id, doc_id AS version, 0 AS heading, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM m QUALIFY rank <= 50),
cs AS (SELECT ex.query_id, e.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score FROM ex JOIN embeddings q ON q.vec_id = ex.query_id, embeddings e WHERE executed IN ('SEMANTIC', 'HYBRID') AND e.vec_id IN (SELECT doc_id FROM documents)),
sem AS (SELECT query_id, vec_id AS version, 0 AS heading, false AS is_profile, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM cs QUALIFY rank <= 20), {FUSED},
tx AS (SELECT r.*, length(d.text) AS chars, ex.degraded, least(length(d.text), 600) AS a FROM ranked r JOIN documents d ON d.doc_id = r.version JOIN ex ON ex.query_id = r.query_id WHERE r.rank <= 5),
ux AS (SELECT *, CAST(least(a, greatest(0, 2000 - coalesce(sum(a) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS used FROM tx)
SELECT query_id AS request_id, CAST(rank AS INTEGER) AS position, version AS doc_id, score, channels, used, used < chars AS truncated, degraded, NULL AS error FROM ux WHERE used > 0
UNION ALL SELECT query_id, -1, -1, -1, NULL, -1, false, false, error FROM ex WHERE error IS NOT NULL""")
def retrieve(s, d):
    """Every benchmark question as a request, from its check to its evidence; some searches fail."""
    k = F.col("item_id")
    asked = table(s, d, "benchmark").join(table(s, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding"), "item_id", "left")
    mode = F.get(F.array(F.lit("HYBRID"), F.lit("KEYWORD"), F.lit("SEMANTIC")), (k % 3).cast("int"))
    requests = asked.select(k.alias("request_id"), F.when(k % 11 == 4, " ").otherwise(F.col("text")).alias("query"), mode.alias("mode"), F.lit(5).alias("top_k"), "embedding", (k % 7 != 0).alias("keyword_ok"), (k % 5 != 0).alias("semantic_ok"))
    vectors = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    found = E.retrieve(requests, table(s, d, "documents").select("doc_id", "text"), vectors, (("text", T.tokens, 1.0),), 600, 2_000)
    return found.fillna(-1, ["position", "doc_id", "score", "used"]).fillna(False, ["truncated"])


QUERIES, SQL = Q, S
