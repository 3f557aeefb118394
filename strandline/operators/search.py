"""Retrieval: BM25 over an inverted index, highlighting, exact vector search, rank fusion, evidence."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.adapters import shared_dir, stored
from strandline.functions.text import bigram_tokens, standard_tokens, tokens
from strandline.operators import keyword_index

K1, B, RRF_K = 1.2, 0.75, 60
#: Fields of the keyword search, each with its analyzer and boost.
FIELDS = (
    ("text", bigram_tokens, 4.0),
    ("text", standard_tokens, 3.0),
    ("heading", bigram_tokens, 2.0),
    ("heading", standard_tokens, 1.5),
    ("title", bigram_tokens, 1.2),
    ("title", standard_tokens, 1.0),
)
#: Scores are rounded to six decimals; bounds leave room for that.
SLACK = 1e-4


def postings(docs: DataFrame, terms: DataFrame, analyzer=tokens, text_col: str = "text", k1: float = K1, b: float = B) -> tuple[DataFrame, int]:
    """``term, doc_id, w``: the weight of each of the queries' terms in each document; and the number of documents.

    Texts are analyzed once and never leave the scan: only the terms of queries do,
    and one row for each document (its term is empty) that holds its length.
    """
    split = docs.select("doc_id", analyzer(F.col(text_col)).alias("t"))
    wanted = terms.select("term").distinct().union(terms.sparkSession.sql("SELECT '' AS term"))
    rows = split.select("doc_id", F.size("t").alias("len"), F.explode(F.concat("t", F.array(F.lit("")))).alias("term"))
    post = stored(rows.join(wanted, "term", "left_semi").groupBy("term", "doc_id", "len").agg(F.count(F.lit(1)).alias("tf")), "postings")
    stats = post.where("term = ''").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean")).first()
    n, mean = stats["n"], stats["mean"] or 1.0
    df = post.where("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / mean))
    return post.join(df, "term").select("term", "doc_id", weight.alias("w")), n


def query_terms(queries: DataFrame, analyzer=tokens) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(analyzer(F.col("text")))).alias("term"))


def bm25(docs: DataFrame, queries: DataFrame, text_col: str = "text", analyzer=tokens) -> DataFrame:
    """``doc_id, text`` and ``query_id, text`` → ``query_id, doc_id, score`` of every match, scores rounded to 6 decimals."""
    terms = query_terms(queries, analyzer)
    scored = postings(docs, terms, analyzer, text_col)[0].join(terms, "term")
    return scored.groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), 6).alias("score"))


def bm25_top(docs: DataFrame, queries: DataFrame, k: int, text_col: str = "text", analyzer=tokens) -> DataFrame:
    """The ``k`` best matches of each query (``query_id, doc_id, score, rank``), through an index of one field."""
    return best_fields(docs, queries, k, ((text_col, analyzer, 1.0),))


def top_k(scored: DataFrame, k: int, item: str = "doc_id") -> DataFrame:
    """Rank within each query by score, ties by id; the window keeps ``k`` rows a query before and after its shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), item)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_fields(docs: DataFrame, queries: DataFrame, k: int, fields=FIELDS) -> DataFrame:
    """The ``k`` best by the greatest of the fields' boosted scores, through an index made for this call (see ``keyword_index`` to keep one)."""
    path = f"{shared_dir(docs.sparkSession)}/strandline/keyword-index-{uuid.uuid4().hex}"
    keyword_index.build(docs, fields, path)
    return keyword_index.search(docs.sparkSession, path, queries, fields, k)


def highlight(hits: DataFrame, queries: DataFrame, size: int = 160, most: int = 3, mark: str = "\ue000", unmark: str = "\ue001") -> DataFrame:
    """``query_id, doc_id, text`` of hits → ``query_id, doc_id, fragments``: at most ``most`` pieces of about ``size`` characters with the query's words marked.

    A text is cut into fragments at the spaces after ``size`` characters; those with the most
    different words of the query come first, then those with more of them, then the
    earlier ones.  The analyzer is that of the text's main field.
    """
    words = queries.select("query_id", bigram_tokens(F.col("text")).alias("terms"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = [fragments(t, set(w or ()), size, most, mark, unmark) for t, w in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.string()))], names=["query_id", "doc_id", "fragments"])

    return hits.select("query_id", "doc_id", "text").join(words, "query_id").mapInArrow(run, "query_id long, doc_id long, fragments array<string>")


def fragments(text: str | None, terms: set[str], size: int, most: int, mark: str, unmark: str) -> list[str]:
    """The best marked fragments of one text, in text order."""
    import re

    wide = r"\u2e80-\u2fdf\u3005-\u3007\u3021-\u3029\u3038-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff"
    text = text or ""
    spans = []
    for m in re.finditer(rf"[{wide}]+|(?:[^\W{wide}]|(?<=[^\W\d_])[.'’](?=[^\W\d_])|(?<=\d)[.,](?=\d))+", text):
        if re.match(f"[{wide}]", m[0]):
            hit = [m[0][i : i + 2] in terms for i in range(max(1, len(m[0]) - 1))]
            for i, found in enumerate(hit):
                if found:
                    spans.append((m.start() + i, m.start() + min(i + 2, len(m[0])), m[0][i : i + 2]))
        elif m[0].lower() in terms:
            spans.append((*m.span(), m[0].lower()))
    cuts = [0]
    while cuts[-1] < len(text):
        end = min(len(text), cuts[-1] + size)
        space = text.find(" ", end)
        # at a space soon after, else (in scripts without spaces, say) right there
        end = space if 0 <= space <= end + size // 4 else end
        # never inside a match
        end = next((b for a, b, _ in spans if a < end < b), end)
        cuts.append(end)
    found = []
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        own = [s for s in spans if a <= s[0] and s[1] <= b]
        if own:
            found.append((-len({s[2] for s in own}), -len(own), k, a, b, own))
    out = []
    for _, _, _, a, b, own in sorted(sorted(found)[:most], key=lambda x: x[2]):
        merged: list[list[int]] = []
        for s, e, _ in own:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        piece, at = "", a
        for s, e in merged:
            piece += text[at:s] + mark + text[s:e] + unmark
            at = e
        out.append((piece + text[at:b]).strip())
    return out


VECTOR_BLOCK, QUERY_BLOCK = 8192, 512


def knn(vectors: DataFrame, queries: DataFrame, k: int, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``vec_id, scope, embedding`` and ``query_id, scope, embedding`` → the ``k`` nearest by cosine within the query's scope.

    Exact: blocks of vectors meet blocks of queries of the same scope, one matrix product
    a meeting, which returns ``k`` rows for each query.  A scope of any size is many
    blocks, each with a key of its own.  Vectors without a length come last.
    """
    sized = vectors.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / vector_block).cast("int").alias("blocks"))
    asked = queries.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("parts"))
    facts = stored(sized.join(asked, "scope"), "knn-scopes")
    of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = vectors.join(facts, "scope").groupBy("scope", of("vec_id", "blocks").alias("block")).agg(F.collect_list(F.struct("vec_id", "embedding")).alias("v"), F.first("parts").alias("parts"))
    left = left.select("scope", "block", "v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = queries.join(facts, "scope").groupBy("scope", of("query_id", "parts").alias("part")).agg(F.collect_list(F.struct("query_id", "embedding")).alias("q"))
    return top_k(left.join(right, ["scope", "part"]).select("v", "q").mapInArrow(_nearest(k), "query_id long, vec_id long, score double"), k, "vec_id")


def _nearest(k: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def side(column, i, name):
            one = column.slice(i, 1).flatten()
            ids, vectors = one.field(name), one.field("embedding")
            m = np.array(vectors.to_pylist(), np.float64)
            return ids.to_numpy(zero_copy_only=False), m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

        for b in batches:
            for i in range(b.num_rows):
                ids, m = side(b.column(0), i, "vec_id")
                asked, q = side(b.column(1), i, "query_id")
                order = np.argsort(ids, kind="stable")
                ids, m = ids[order], m[order]
                s = np.round(q @ m.T, 6)
                # ids ascend, so a stable sort leaves ties in their order
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                n = best.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, n)), pa.array(ids[best].ravel()), pa.array(np.take_along_axis(s, best, 1).ravel())], names=["query_id", "vec_id", "score"])

    return run


def compact_rank(hits: DataFrame, *group: str) -> DataFrame:
    """Groups of hits numbered by their first appearance within the query."""
    first = hits.groupBy("query_id", *group).agg(F.min("rank").alias("first"))
    return first.withColumn("compact", F.row_number().over(Window.partitionBy("query_id").orderBy("first", *group)))


def fuse(keyword: DataFrame, semantic: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of two channels of sections.

    Both have ``query_id, version, heading, rank``; semantic hits also ``is_profile``.
    A profile group of a version takes a rank of its own and lends it to the best
    ranked section of that version; without one it stands for the root (heading -1).
    """
    kw = compact_rank(keyword, "version", "heading").select("query_id", "version", "heading", F.col("compact").alias("kw"))
    marked = semantic.withColumn("heading", F.when(F.col("is_profile"), F.lit(-1)).otherwise(F.col("heading")))
    sem = compact_rank(marked, "version", "heading")
    sections = sem.where("heading >= 0").select("query_id", "version", "heading", F.col("compact").alias("sem"))
    profiles = sem.where("heading < 0").select("query_id", "version", F.col("compact").alias("profile"))
    both = kw.join(sections, ["query_id", "version", "heading"], "full_outer")
    best = F.least(F.coalesce("kw", F.lit(1 << 30)), F.coalesce("sem", F.lit(1 << 30)))
    ranked = both.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "version").orderBy(best, "heading")))
    joined = ranked.join(profiles, ["query_id", "version"], "full_outer")
    rows = joined.select("query_id", "version", F.coalesce("heading", F.lit(-1)).alias("heading"), "kw", "sem", F.when(F.coalesce("r", F.lit(1)) == 1, F.col("profile")).alias("profile"))
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    scored = rows.withColumn("semantic", F.least("sem", "profile")).withColumn("score", F.round(part("kw") + part("semantic"), 9)).withColumn("best", F.least("kw", "semantic"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "best", "version", "heading")
    channels = F.concat_ws("+", F.when(F.col("kw").isNotNull(), "KEYWORD"), F.when(F.col("semantic").isNotNull(), "SEMANTIC"))
    return scored.select("query_id", "version", "heading", "score", channels.alias("channels"), F.row_number().over(order).alias("rank"))


class OutsideSnapshot(ValueError):
    """A search returned something that its caller must not see."""


def within_snapshot(hits: DataFrame, snapshot: DataFrame, key: str = "version") -> DataFrame:
    """The hits, if all of them are in the snapshot; a single one that is not fails the whole search."""
    if stray := hits.join(snapshot.select(key).distinct(), key, "left_anti").select(key).first():
        raise OutsideSnapshot(f"{key} {stray[key]}")
    return hits


def execute_mode(queries: DataFrame) -> DataFrame:
    """``mode, keyword_ok, semantic_ok`` (and ``snapshot_size``) → what runs, whether degraded, and the error; over an empty snapshot nothing runs."""
    m, k, s = F.col("mode"), F.col("keyword_ok"), F.col("semantic_ok")
    if "snapshot_size" in queries.columns:
        some = queries.where("snapshot_size > 0").drop("snapshot_size")
        none = queries.where("snapshot_size = 0").drop("snapshot_size").select("*", F.lit("NONE").alias("executed_mode"), F.lit(False).alias("degraded"), F.lit(None).cast("string").alias("error"))
        return execute_mode(some).unionByName(none)
    error = F.when((m != "SEMANTIC") & ~k, "KEYWORD_FAILED").when((m == "SEMANTIC") & ~s, "SEMANTIC_FAILED")
    degraded = (m == "HYBRID") & k & ~s
    return queries.select("*", F.when(error.isNotNull(), F.lit(None)).when(degraded, "KEYWORD").otherwise(m).alias("executed_mode"), degraded.alias("degraded"), error.alias("error"))


def normalize_request(requests: DataFrame, max_chars: int = 2000, top: int = 20, default_top: int = 5) -> DataFrame:
    """Stripped query, mode (HYBRID by default, any case), result count, and why a request is invalid."""
    from strandline.functions.text import strip

    q = strip(F.coalesce("query", F.lit("")))
    mode = F.upper(F.coalesce("mode", F.lit("HYBRID")))
    k = F.coalesce("top_k", F.lit(default_top))
    error = F.when(F.length(q) == 0, "EMPTY_QUERY").when(F.length(q) > max_chars, "QUERY_TOO_LONG").when(~mode.isin("KEYWORD", "SEMANTIC", "HYBRID"), "UNKNOWN_MODE").when(~k.between(1, top), "BAD_TOP_K")
    return requests.select("request_id", F.length(q).cast("long").alias("n_chars"), mode.alias("mode"), k.cast("long").alias("top_k"), error.alias("error"))


def round_robin(ranked: DataFrame, family: str, k: int) -> DataFrame:
    """``k`` results a query, one of each family in a round; families in order of first appearance."""
    in_family = Window.partitionBy("query_id", family).orderBy("rank")
    rows = ranked.select("*", F.row_number().over(in_family).alias("__round"), F.min("rank").over(Window.partitionBy("query_id", family)).alias("__first"))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("__round", "__first"))).where(F.col("position") <= k).drop("__round", "__first")


def select_blocks(blocks: DataFrame, hits: DataFrame, most: int = 3) -> DataFrame:
    """Blocks of a section for a result: hit ones by rank first, then the nearest to a hit, headings last at equal distance."""
    near = blocks.join(hits.select("query_id", "section", F.col("ordinal").alias("hit"), "rank"), "section")
    own = near.groupBy("query_id", "section", "block_id", "ordinal", "structural").agg(F.min(F.when(F.col("ordinal") == F.col("hit"), F.col("rank"))).alias("kw"), F.min(F.abs(F.col("ordinal") - F.col("hit"))).alias("distance"))
    order = Window.partitionBy("query_id", "section").orderBy(F.col("kw").asc_nulls_last(), "distance", "structural", "ordinal")
    return own.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)


def select_without_keywords(blocks: DataFrame, ranges: DataFrame, most: int = 3) -> DataFrame:
    """Blocks for results that no keyword hit: of the card's range (``query_id, section, start, end``) those that are text first, then in order."""
    own = blocks.join(ranges, "section").where((F.col("ordinal") >= F.col("start")) & (F.col("ordinal") < F.col("end")))
    order = Window.partitionBy("query_id", "section").orderBy("structural", "ordinal")
    return own.select("query_id", "section", "block_id", F.row_number().over(order).alias("n")).where(F.col("n") <= most)


def top_results(used: DataFrame, top: int) -> DataFrame:
    """Of budgeted blocks those of each query's first ``top`` results that still have some, numbered anew."""
    order = Window.partitionBy("query_id").orderBy("rank")
    return used.withColumn("position", F.dense_rank().over(order)).where(F.col("position") <= top)


def apply_budgets(rows: DataFrame, per_result: int, total: int, most: int = 3) -> DataFrame:
    """``query_id, rank, n, chars`` → ``used`` characters of each block under a budget a result and one a query; blocks that get none go."""
    within = Window.partitionBy("query_id", "rank").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.where(F.col("n") <= most).withColumn("a", F.least("chars", F.greatest(F.lit(0), per_result - F.coalesce(F.sum("chars").over(within), F.lit(0)))))
    across = Window.partitionBy("query_id").orderBy("rank", "n").rowsBetween(Window.unboundedPreceding, -1)
    second = first.withColumn("used", F.least("a", F.greatest(F.lit(0), total - F.coalesce(F.sum("a").over(across), F.lit(0)))).cast("long"))
    return second.where(F.col("used") > 0).select("query_id", "rank", "n", "chars", "used", (F.col("used") < F.col("chars")).alias("truncated"))


def rerank(ranked: DataFrame, scores: DataFrame) -> DataFrame:
    """New order by score, if each candidate of a query has exactly one finite score and there are two or more; else the old one."""
    ok = F.col("s").isNotNull() & ~F.isnan("s") & (F.abs("s") != float("inf"))
    per = scores.groupBy("query_id", "item").agg(F.max("score").alias("s"), F.count(F.lit(1)).alias("c"))
    q = Window.partitionBy("query_id")
    rows = ranked.join(per, ["query_id", "item"], "left").withColumn("usable", (F.count(F.lit(1)).over(q) >= 2) & (F.sum(F.when(ok & (F.col("c") == 1), 0).otherwise(1)).over(q) == 0))
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("usable"), -F.col("s")), "rank")
    return rows.select("query_id", "item", F.row_number().over(order).alias("rank"), F.col("usable").alias("reranked"))


def resolve_hits(hits: DataFrame, blocks: DataFrame) -> DataFrame:
    """Keyword hits with their canonical block, and ``error`` where there is none or the hit's address is another one.

    Both have ``version, block_id, heading, ordinal, start, end``; a hit that does not
    match makes its evidence unavailable, it is never used in part.
    """
    address = ["heading", "ordinal", "start", "end"]
    there = blocks.select("version", "block_id", *[F.col(c).alias(f"b_{c}") for c in address])
    same = F.lit(True)
    for c in address:
        same = same & (F.col(c) == F.col(f"b_{c}"))
    rows = hits.join(there, ["version", "block_id"], "left")
    return rows.select(*hits.columns, F.when(~F.coalesce(same, F.lit(False)), "EVIDENCE_UNAVAILABLE").alias("error"))


def semantic_addresses(hits: DataFrame, headings: DataFrame, blocks: DataFrame) -> DataFrame:
    """``query_id, version, heading, card_type, start, end, error``: the address by which a section is read.

    The best part card of the section if there is one, else its best card.  A full
    card must have the heading's range, a part must lie in it and hold something, and
    the characters it states must be those of its first and last block.
    """
    order = Window.partitionBy("query_id", "version", "heading").orderBy(F.col("card_type") != "HEADING_SUBPARTITION", "rank")
    best = hits.where("card_type <> 'DOCUMENT_PROFILE'").withColumn("n", F.row_number().over(order)).where("n = 1")
    rows = best.join(headings.select("version", "heading", F.col("start").alias("h_start"), F.col("end").alias("h_end")), ["version", "heading"], "left")
    at = lambda name, c: blocks.select("version", F.col("ordinal").alias(f"{name}_o"), F.col(c).alias(name))
    rows = rows.join(at("first", "char_start").withColumnRenamed("first_o", "start"), ["version", "start"], "left")
    rows = rows.withColumn("last_o", F.col("end") - 1).join(at("last", "char_end"), ["version", "last_o"], "left")
    full, part = F.col("card_type") == "HEADING_NODE", F.col("card_type") == "HEADING_SUBPARTITION"
    ranged = F.when(full, (F.col("start") == F.col("h_start")) & (F.col("end") == F.col("h_end"))).when(part, (F.col("start") >= F.col("h_start")) & (F.col("end") <= F.col("h_end")) & (F.col("start") < F.col("end")))
    chars = F.coalesce(F.col("canonical_start") == F.col("first"), F.lit(True)) & F.coalesce(F.col("canonical_end") == F.col("last"), F.lit(True))
    return rows.select("query_id", "version", "heading", "card_type", "start", "end", F.when(~F.coalesce(ranged & chars, F.lit(False)), "EVIDENCE_UNAVAILABLE").alias("error"))


#: What a loaded document must have in common with its manifest.
LOADED = ("tenant_id", "bucket", "size_bytes", "object_sha256", "block_count", "heading_count", "warning_count", "text_length", "text_sha256")


def load_errors(wanted: DataFrame, manifests: DataFrame, loaded: DataFrame) -> DataFrame:
    """``version, error, mismatches``: closed on any doubt. A version without a manifest or an object, or with one fact that differs, is unavailable."""
    m = manifests.select("version", F.lit(True).alias("m"), *[F.col(c).alias(f"m_{c}") for c in LOADED])
    rows = wanted.select("version").join(m, "version", "left").join(loaded.select("version", F.lit(True).alias("l"), *LOADED), "version", "left")
    differs = F.array(*[F.when(~F.coalesce(F.col(c) == F.col(f"m_{c}"), F.lit(False)), c) for c in LOADED])
    bad = F.when(F.col("m").isNull(), F.array(F.lit("manifest"))).when(F.col("l").isNull(), F.array(F.lit("object"))).otherwise(F.filter(differs, lambda x: x.isNotNull()))
    return rows.select("version", F.when(F.size(bad) > 0, "EVIDENCE_UNAVAILABLE").alias("error"), F.array_join(bad, ",").alias("mismatches"))


def coverage(results: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """What a result page covers: ``query_id, results, documents, families, pages, concentrated``.

    ``results``: ``query_id, version, family``; ``evidence``: ``query_id, version, page``.  Families and pages
    are counted within their versions.  Three results or more are concentrated in one family or on one or two pages.
    """
    per = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("results"), F.countDistinct("version").alias("documents"), F.countDistinct("version", F.coalesce(F.col("family").cast("string"), F.lit(""))).alias("families"))
    if evidence is None:
        per = per.withColumn("pages", F.lit(0).cast("long"))
    else:
        n = evidence.where("page IS NOT NULL").groupBy("query_id").agg(F.countDistinct("version", "page").alias("pages"))
        per = per.join(n, "query_id", "left").withColumn("pages", F.coalesce("pages", F.lit(0)))
    return per.withColumn("concentrated", (F.col("results") >= 3) & ((F.col("families") <= 1) | F.col("pages").between(1, 2)))


def search_page(ranked: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page of a search tool's frozen ranking (``query_id, version, heading, rank``) with its coverage and where it goes on.

    ``documents, families, largest``: what the page covers; ``next_offset`` is null on the last page.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    page = ranked.withColumn("n", n).where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))
    per = page.groupBy("query_id").agg(F.countDistinct("version").alias("documents"), F.countDistinct("heading").alias("families"))
    most = page.groupBy("query_id", "version").agg(F.count(F.lit(1)).alias("c")).groupBy("query_id").agg(F.max("c").alias("largest"))
    rows = page.join(per, "query_id").join(most, "query_id")
    return rows.select("query_id", "version", "heading", "rank", "documents", "families", "largest", F.when(F.col("n") > offset + limit, F.lit(offset + limit)).alias("next_offset"))
