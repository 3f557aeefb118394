"""One retrieve call for many requests: checks, the searches that a mode asks for, degradation, fusion, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.adapters import stored
from strandline.operators.search import FIELDS, apply_budgets, best_fields, execute_mode, fuse, knn, normalize_request

KEYWORD_HITS, SEMANTIC_HITS = 50, 20
RESULT_CHARS, TOTAL_CHARS = 4_000, 20_000


def retrieve(requests: DataFrame, docs: DataFrame, vectors: DataFrame, fields=FIELDS, per_result: int = RESULT_CHARS, total: int = TOTAL_CHARS) -> DataFrame:
    """``request_id, position, doc_id, score, channels, used, truncated, degraded, error``.

    ``requests``: ``request_id, query, mode, top_k, embedding, keyword_ok, semantic_ok`` (whether either search answers);
    ``docs``: ``doc_id, text`` and the fields' columns; ``vectors``: ``doc_id, embedding``.  A request that is invalid, or whose
    search fails, is one row with its error.  A hybrid one without its semantic half is answered by keywords, and says so.
    Only the searches that some request needs run, each once for all of them.  Results of both are fused by
    rank, cut to ``top_k``, and get their texts' characters under a budget for each and one for all.
    """
    checked = normalize_request(requests).select("request_id", F.col("mode").alias("wanted"), F.col("top_k").alias("most"), F.col("error").alias("invalid"))
    planned = requests.drop("mode", "top_k").join(checked, "request_id")
    bad = planned.where("invalid IS NOT NULL").select("request_id", F.lit(False).alias("degraded"), F.col("invalid").alias("error"))
    run = execute_mode(planned.where("invalid IS NULL").withColumnRenamed("wanted", "mode"))
    run = stored(run.select("request_id", "query", "embedding", "most", "executed_mode", "degraded", "error"), "retrieve-plan")
    failed = bad.unionByName(run.where("error IS NOT NULL").select("request_id", "degraded", "error"))

    asks = lambda *modes: run.where(F.col("executed_mode").isin(*modes))
    words = asks("KEYWORD", "HYBRID").select(F.col("request_id").alias("query_id"), F.col("query").alias("text"))
    meant = asks("SEMANTIC", "HYBRID").where("embedding IS NOT NULL").select(F.col("request_id").alias("query_id"), F.lit(0).alias("scope"), "embedding")
    hits = lambda rows, key: rows.select("query_id", F.col(key).alias("version"), F.lit(0).alias("heading"), "rank")
    keyword = hits(best_fields(docs, words, KEYWORD_HITS, fields), "doc_id")
    known = vectors.select(F.col("doc_id").alias("vec_id"), F.lit(0).alias("scope"), "embedding").join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    semantic = hits(knn(known, meant, SEMANTIC_HITS), "vec_id").withColumn("is_profile", F.lit(False))

    ranked = fuse(keyword, semantic).join(run.select(F.col("request_id").alias("query_id"), "most", "degraded"), "query_id").where(F.col("rank") <= F.col("most"))
    ranked = stored(ranked, "retrieve-ranked")
    texts = ranked.select("query_id", "rank", F.col("version").alias("doc_id")).join(docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("chars")), "doc_id")
    used = apply_budgets(texts.select("query_id", "rank", F.lit(1).alias("n"), "chars"), per_result, total).select("query_id", "rank", "used", "truncated")
    found = ranked.join(used, ["query_id", "rank"]).select(F.col("query_id").alias("request_id"), F.col("rank").alias("position"), F.col("version").alias("doc_id"), "score", "channels", "used", "truncated", "degraded", F.lit(None).cast("string").alias("error"))
    return found.unionByName(failed, allowMissingColumns=True)
