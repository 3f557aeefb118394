"""Connected components of an edge table, by alternating large and small stars.

Each round replaces a node's links by links to the smallest node it knows.  Both
stars are a minimum by node (with map-side partials) joined back to the links; no
node's neighbours are ever brought into one row, so a hub with millions of links is
as good as any other (the join is one that Spark can split where it is skewed).
Every round is a table in the shared folder, so a lost executor costs one round.
Rounds grow with the logarithm of the longest chain of links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``u, v`` (of one type; direction and repeats do not matter) → ``node, root``.

    ``root`` is the component's smallest node; only nodes with a link to another one
    occur.  Null ends are left out; a chain too long for ``rounds`` is an error.
    """
    links = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(edges["u"].isNotNull() & edges["v"].isNotNull() & (edges["u"] != edges["v"])).distinct()
    links = stored(links, "links")
    state = _state(links)
    for _ in range(rounds):
        if not state[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        # large star: neighbours above a node move to the smallest one known to it
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        # stored, so that the join has a plain scan on either side and Spark can split a hub
        least = stored(least, "least")
        large = both.join(least, both["u"] == least["n"]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large, "large")
        # small star: a node and its lower neighbours move to the lowest of them
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m"), "lowest")
        small = large.join(low, large["u"] == low["n"]).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stored(small.union(low.select(F.col("n").alias("u"), F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct(), "links")
        now = _state(links)
        if now == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
    raise RuntimeError(f"components are not done after {rounds} rounds")


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]
