"""Query op13: leaf, roots, proof and tamper check of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import table
from strandline.llm.manifest import fold, leaf, manifest

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digest = lambda text: leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = F.when(changed, digest(F.translate("text", UPPER, LOWER))).otherwise(digest(F.col("text")))
    leaves = docs.select("doc_id", "lang", digest(F.col("text")).alias("leaf"), tampered.alias("tampered"))
    proved = manifest(leaves, "lang", "doc_id", "leaf", carry=["tampered"])
    folded = proved.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), fold(F.col("tampered"), F.col("proof"), F.col("at"), F.col("size")).alias("folded_root"))
    return folded.select("*", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "coalesce(CAST(octet_length(encode({0})) AS VARCHAR) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(x) for x in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", "{text}")) + ")"
#: A tree over (g, i, n, node): a recursion of levels, in which a level's nodes are digests of runs of eight.
_TREE = """SELECT 0 AS lvl, g, i, n, node FROM {base}
  UNION ALL
  SELECT lvl + 1, g, i // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY lvl, g, i // 8, n"""
#: Where documents stand: their places in a tree's levels, with their runs.
_RUN = "t.lvl = p.lvl AND t.g = p.g AND t.i // 8 = p.i // 8"

QUERIES = {"op13_manifest": op13_manifest}
SQL = {
    "op13_manifest": rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS g, {_LEAF.format(text="text")} AS leaf,
         {_LEAF.format(text=f"translate(text, '{UPPER}', '{LOWER}')")} AS lowered,
         list_reduce([4294967295] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
           lambda c: list_transform(range(0, 8), lambda k: (ascii(c) >> k) & 1))),
           lambda a, b: xor(a >> 1, CASE WHEN (a & 1) <> b THEN 3988292384 ELSE 0 END)) AS crc
  FROM documents),
f AS MATERIALIZED (
  SELECT r, doc_id, g, leaf, CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN lowered ELSE leaf END AS tampered,
         row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
base AS (SELECT g, i, n, leaf AS node FROM f),
tree AS ({_TREE.format(base="base", name="tree")}),
subs AS MATERIALIZED (SELECT g AS lang, node, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
heads AS (SELECT '' AS g, i, n, node FROM subs),
crown AS ({_TREE.format(base="heads", name="crown")}),
nodes AS MATERIALIZED (
  SELECT lvl, g, i, node FROM tree WHERE n > 1
  UNION ALL SELECT 100 + lvl, g, i, node FROM crown WHERE n > 1),
spots AS (SELECT f.r, l.lvl, f.g, f.i >> (3 * l.lvl) AS i FROM f JOIN (SELECT DISTINCT lvl, g FROM tree WHERE n > 1) l USING (g)
       UNION ALL
       SELECT f.r, 100 + l.lvl, '', s.i >> (3 * l.lvl) FROM f JOIN subs s ON s.lang = f.g CROSS JOIN (SELECT DISTINCT lvl FROM crown WHERE n > 1) l),
steps AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY r ORDER BY lvl) AS step FROM spots),
runs AS MATERIALIZED (
  SELECT p.r, p.step, p.lvl, string_agg(CASE WHEN t.i <> p.i THEN t.node END, '' ORDER BY t.i) AS siblings,
         coalesce(string_agg(CASE WHEN t.i < p.i THEN t.node END, '' ORDER BY t.i), '') AS below,
         coalesce(string_agg(CASE WHEN t.i > p.i THEN t.node END, '' ORDER BY t.i), '') AS above
  FROM steps p JOIN nodes t ON {_RUN} GROUP BY p.r, p.step, p.lvl),
proofs AS (SELECT r, sha256(coalesce(string_agg(siblings, '' ORDER BY step), '')) AS proof_sha256 FROM runs GROUP BY r),
folds AS (
  SELECT r, CAST(1 AS BIGINT) AS step, tampered AS node FROM f
  UNION ALL
  SELECT x.r, x.step + 1, sha256(u.below || x.node || u.above) FROM folds x JOIN runs u ON u.r = x.r AND u.step = x.step),
ends AS (SELECT r, arg_max(node, step) AS folded_root FROM folds GROUP BY r)
SELECT f.doc_id, f.leaf, s.node AS subroot, t.node AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = t.node AS verified
FROM f JOIN subs s ON s.lang = f.g JOIN ends e ON e.r = f.r LEFT JOIN proofs p ON p.r = f.r CROSS JOIN (SELECT node FROM crown WHERE n = 1) t"""
}
