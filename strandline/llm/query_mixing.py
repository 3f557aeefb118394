"""Query op7: how many words of each document the mix takes, and the shards that its draws go to.

The SQL draws the same tree: one step of its recursion takes the next source of every node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import table
from strandline.llm.mixing import MOST, SHARD_BLOCKS, mix

SHARDS, SEED = 16, 7


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mix(table(spark, sf_dir, "documents"), shards=SHARDS, seed=SEED)
    shards = F.array_join(F.transform("draws", lambda x: x["shard"].cast("string")), ",")
    places = F.md5(F.array_join(F.transform("draws", lambda x: F.concat_ws("/", x["pass"].cast("string"), x["shard"].cast("string"), x["position"])), ",").cast("binary"))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, x: a + F.col("size")).alias("taken")
    return drawn.select("doc_id", "size", "source_size", "target", taken, shards.alias("shards"), places.alias("places"))


#: Ways to choose, as a logarithm.
_WAYS = "(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"
_WEIGHT = f"{_WAYS.format(n='good', k='k')} + {_WAYS.format(n='bad', k='(draws - k)')}"

QUERIES = {"op7_mixing": op7_mixing}
SQL = {
    "op7_mixing": rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS words, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
w AS (SELECT *, 1 + (n - 1) % 3 AS w FROM s),
f AS (
  SELECT *, coalesce(sum({MOST} * words) OVER (ORDER BY {MOST} * words / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (ORDER BY {MOST} * words / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(words) OVER () AS total
  FROM w),
l AS (SELECT *, CAST(total - before AS DOUBLE) / CAST(rest AS DOUBLE) AS level FROM f),
t AS (
  SELECT source, n, words, CASE WHEN level * w >= {MOST} * words THEN CAST({MOST} * words AS DOUBLE)
         ELSE w * max(level) FILTER (WHERE level * w < {MOST} * words) OVER () END AS target
  FROM l),
p AS MATERIALIZED (
  SELECT *, CAST(ceil(target / block) AS BIGINT) AS quota
  FROM (SELECT *, greatest(1, CAST(ceil(sum(target) OVER () / {SHARDS * SHARD_BLOCKS}) AS BIGINT)) AS block FROM t)),
tree AS (
  SELECT 0 AS level, 0 AS node, 0 AS i, CAST(sum(quota) - sum(quota) // 2 AS BIGINT) AS draws, CAST(sum(quota) AS BIGINT) AS rest,
         list(CAST(quota AS BIGINT) ORDER BY n) AS q, CAST([] AS BIGINT[]) AS lft
  FROM p
  UNION ALL
  SELECT CASE WHEN step THEN level ELSE level + 1 END, CASE WHEN step THEN node ELSE 2 * node + side END, CASE WHEN step THEN i + 1 ELSE 0 END,
         CASE WHEN step THEN draws - x ELSE list_sum(child) - list_sum(child) // 2 END, CASE WHEN step THEN rest - good ELSE list_sum(child) END,
         CASE WHEN step THEN q ELSE child END, CASE WHEN step THEN list_append(lft, x) ELSE CAST([] AS BIGINT[]) END
  FROM (
    SELECT *, CAST(CASE WHEN good <= 0 OR draws <= 0 THEN 0 WHEN bad <= 0 THEN draws WHEN low = high THEN low
                   ELSE low + len(list_filter(range(1, len(ws) + 1), lambda j: list_sum(ws[1:j]) < u * list_sum(ws))) END AS BIGINT) AS x
    FROM (
      SELECT *, list_transform(range(low, high + 1), lambda k: exp({_WEIGHT} - top)) AS ws
      FROM (
        SELECT *, {_WEIGHT.replace('k', 'mode')} AS top
        FROM (
          SELECT *, greatest(0, draws - bad) AS low, least(good, draws) AS high,
                 least(least(good, draws), greatest(greatest(0, draws - bad), CAST(floor((draws + 1.0::DOUBLE) * (good + 1.0::DOUBLE) / (good + bad + 2.0::DOUBLE)) AS BIGINT))) AS mode
          FROM (
            SELECT *, i < len(q) AS step, CASE WHEN i < len(q) THEN q[i + 1] ELSE 0 END AS good, rest - CASE WHEN i < len(q) THEN q[i + 1] ELSE 0 END AS bad,
                   (CAST('0x' || substr(md5('{SEED}/' || level || '/' || node || '/' || i), 1, 12) AS BIGINT) + 0.5::DOUBLE) / {1 << 48} AS u,
                   CASE WHEN i < len(q) THEN q WHEN side = 0 THEN lft ELSE list_transform(q, lambda v, j: v - lft[j]) END AS child
            FROM tree, (VALUES (0), (1)) AS sides(side)
            WHERE (i < len(q) AND side = 0) OR (i = len(q) AND level < {SHARDS.bit_length() - 1}))))))),
leaves AS (SELECT node, unnest(q) AS q, generate_subscripts(q, 1) AS n FROM tree WHERE level = {SHARDS.bit_length() - 1} AND i = 0),
cuts AS (SELECT n, list(upto ORDER BY node) AS cut FROM (SELECT n, node, sum(q) OVER (PARTITION BY n ORDER BY node) AS upto FROM leaves) GROUP BY n),
k AS (
  SELECT d.source, d.key, CAST(sum(d.size) AS BIGINT) AS n, CAST(sum(sum(d.size)) OVER (PARTITION BY d.source ORDER BY d.key) - sum(d.size) AS BIGINT) AS first
  FROM d GROUP BY d.source, d.key),
r AS (
  SELECT d.doc_id, d.size, p.words, p.target, d.key, p.block, cuts.cut, k.first, list_filter(range(0, {MOST}), lambda x: 2 * (x * p.words + k.first) + k.n < 2 * p.target) AS passes
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN k ON k.source IS NOT DISTINCT FROM d.source AND k.key = d.key LEFT JOIN cuts ON cuts.n = p.n),
z AS (SELECT *, list_transform(passes, lambda x: len(list_filter(cut, lambda c: c * block <= x * words + first))) AS shards FROM r)
SELECT doc_id, size, words AS source_size, target, CAST(size * len(passes) AS BIGINT) AS taken,
       array_to_string(shards, ',') AS shards,
       md5(array_to_string(list_transform(passes, lambda x, j: x || '/' || shards[j] || '/' || md5('{SEED}/' || x || '/' || key)), ',')) AS places
FROM z"""
}
