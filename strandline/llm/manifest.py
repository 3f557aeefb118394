"""Merkle manifest of a table: superblocks collapse several levels of a tree at a time.

Rows become leaves (a digest of named fields).  Each group (here a language) has a tree
over its leaves in order, and the groups' roots have one above them.  A node is the
digest of its ``fanout`` children's digests; the last of a level may have fewer.

Leaves are numbered without bringing a group together: they are spread by ranges of group,
order, leaf and a running number (which parts rows that are equal), sorted within each
range and stored; a small table of (group, range) counts then turns places within a range
into places within the group.  Places divided by ``fanout ** depth`` are superblocks of
a bounded size.  ``applyInPandas`` collapses ``depth`` levels of each into one node; these nodes
are the places of the next round, until each group has one.  The same rounds make the
root of the groups' roots.  On the way down every superblock meets the one proof of its own node, and
each of its members gets its siblings below, followed by that proof.

Defined results: null fields count as such; a null group is one, the first; null order
values come first; rows that are equal in group and order are ordered by leaf, and
equal rows give as many leaves; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import stored

FANOUT = 8
DEPTH = 3
DIGEST = 64
POSITION_BITS = 33


def leaf(*fields: Column) -> Column:
    """Digest of the fields: each ``-`` if null, else its bytes, a colon and the value."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[one(c.cast("string")) for c in fields]), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` (stored) with ``idx``, the place within its group from 0, and ``n``, the group's rows."""
    keys = [F.col(group), *[F.col(c).asc_nulls_first() for c in order], F.col("__salt")]
    spread = rows.select("*", F.monotonically_increasing_id().alias("__salt")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    # the id has the range above its lowest bits and the place within it in them
    placed = stored(spread.drop("__salt").select("*", F.monotonically_increasing_id().alias("__at")), "manifest-placed")
    placed = placed.select("*", F.shiftright("__at", POSITION_BITS).alias("__range"))
    runs = placed.groupBy(group, "__range").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    whole = Window.partitionBy(group)
    before = F.sum("__n").over(whole.orderBy("__range")) - F.col("__n")
    runs = stored(runs.select(group, "__range", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(whole).alias("n")), "manifest-runs")
    return placed.join(runs, [group, "__range"]).select("*", (F.col("__at") + F.col("__shift")).alias("idx")).drop("__at", "__range", "__shift")


def _join_digests(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def _levels(nodes: list[str], n: int, fanout: int, depth: int) -> list[list[str]]:
    """The nodes of a superblock and the levels above them; ``n``: nodes of the whole group at the lowest."""
    out = [nodes]
    while n > 1 and len(out) <= depth:
        out.append([_join_digests(out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
        n = -(-n // fanout)
    return out


def _collapse(nodes: DataFrame, fanout: int, depth: int) -> DataFrame:
    """``grp, idx, n, node`` → the same, ``depth`` levels above."""
    width = fanout**depth

    def run(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("idx")
        n = int(pdf["n"].iloc[0])
        return pd.DataFrame({"grp": [key[0]], "idx": [key[1]], "n": [-(-n // width)], "node": [_levels(pdf["node"].tolist(), n, fanout, depth)[-1][0]]})

    return nodes.select("grp", "idx", "n", "node").groupBy("grp", F.floor(F.col("idx") / width).alias("bucket")).applyInPandas(run, "grp string, idx long, n long, node string")


def _extend(nodes: DataFrame, upper: DataFrame, carry: list[str], fanout: int, depth: int) -> DataFrame:
    """``nodes`` with ``proof, at, size``: the siblings below their superblock's node, then that node's own proof in ``upper``."""
    width = fanout**depth

    def run(below, above):
        import pandas as pd

        below = below.sort_values("idx")
        levels = _levels(below["node"].tolist(), int(below["n"].iloc[0]), fanout, depth)
        top = above.iloc[0]
        found = [(top["proof"], list(top["at"]), list(top["size"]))]
        for level in reversed(levels[:-1]):
            higher, found = found, []
            for j in range(len(level)):
                at = j % fanout
                run_of = level[j - at : j - at + fanout]
                proof, ats, sizes = higher[j // fanout]
                found.append(("".join(run_of[:at] + run_of[at + 1 :]) + proof, [at, *ats], [len(run_of), *sizes]))
        proof, ats, sizes = zip(*found, strict=True)
        return below[["grp", "idx", "node", *carry]].assign(root=top["root"], subroot=top["subroot"], proof=proof, at=ats, size=sizes)

    own = nodes.select("grp", "idx", "n", "node", *carry).groupBy("grp", F.floor(F.col("idx") / width).alias("bucket"))
    schema = "grp string, idx long, node string, " + "".join(f"{c} string, " for c in carry) + "root string, subroot string, proof string, at array<int>, size array<int>"
    return own.cogroup(upper.select("grp", "idx", "root", "subroot", "proof", "at", "size").groupBy("grp", "idx")).applyInPandas(run, schema)


def _rounds(nodes: DataFrame, fanout: int, depth: int) -> list[DataFrame]:
    """``nodes`` and what each round makes of them, until every group has one node."""
    out = [nodes]
    most = nodes.agg(F.max("n").alias("n")).first()["n"] or 0
    while most > 1:
        out.append(stored(_collapse(out[-1], fanout, depth), "manifest-nodes"))
        most = -(-most // fanout**depth)
    return out


def _prove(rounds: list[DataFrame], upper: DataFrame, carry: list[str], fanout: int, depth: int) -> DataFrame:
    for k in range(len(rounds) - 2, -1, -1):
        upper = _extend(rounds[k], upper, carry if k == 0 else [], fanout, depth)
        upper = stored(upper, "manifest-proofs") if k else upper
    return upper


def manifest(leaves: DataFrame, group_col: str, order_col: str, leaf_col: str, carry: list[str] | None = None, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """``order_col``, ``leaf, subroot, root, proof, at, size`` of every row, and the (string) columns of ``carry``.

    ``proof``: the digests of all siblings, from the leaf's to those of the root's children, left to
    right; ``at`` and ``size``: the node's place in its run on each level, and the nodes of that run.
    """
    carry = carry or []
    kind = leaves.schema[order_col].dataType.simpleString()
    # a name that sorts nulls first and is never null
    named = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("grp")
    rows = stored(leaves.select(named, F.col(order_col).alias("__order"), F.col(leaf_col).alias("node"), *[F.col(c).alias(f"__carry{k}") for k, c in enumerate(carry)]), "manifest-leaves")
    extra = [f"__carry{k}" for k in range(len(carry))]
    placed = stored(numbered(rows, "grp", ["__order", "node"]), "manifest-numbered")

    trees = _rounds(placed.withColumn("__order", F.col("__order").cast("string")), fanout, depth)
    subroots = trees[-1].select(F.lit("").alias("grp"), F.col("grp").alias("__group"), "node")
    tops = stored(numbered(stored(subroots, "manifest-subroots"), "grp", ["__group"]), "manifest-tops")
    above = _rounds(tops, fanout, depth)
    none = F.array().cast("array<int>")
    start = above[-1].select("grp", "idx", F.col("node").alias("root"), F.lit("").alias("subroot"), F.lit("").alias("proof"), none.alias("at"), none.alias("size"))
    # a single group: its node is the root, and nothing stands above it
    proved = _prove(above, start, ["__group"], fanout, depth) if len(above) > 1 else start.join(tops.select("grp", "__group", "node"), "grp")
    upper = stored(proved.select(F.col("__group").alias("grp"), F.lit(0).cast("long").alias("idx"), "root", F.col("node").alias("subroot"), "proof", "at", "size"), "manifest-proofs")
    if len(trees) > 1:
        proved = _prove(trees, upper, ["__order", *extra], fanout, depth)
    else:  # no group has a second leaf
        proved = trees[0].drop("idx", "n").join(upper, "grp")
    return proved.select(F.col("__order").cast(kind).alias(order_col), F.col("node").alias("leaf"), "subroot", "root", "proof", "at", "size", *[F.col(x).alias(c) for x, c in zip(extra, carry, strict=True)])


def fold(node: Column, proof: Column, at: Column, size: Column) -> Column:
    """The root that ``node`` leads to with the siblings of ``proof``."""

    def step(s, x):
        left = F.substr(proof, s["cut"], x["at"] * DIGEST)
        right = F.substr(proof, s["cut"] + x["at"] * DIGEST, (x["size"] - 1 - x["at"]) * DIGEST)
        return F.struct(F.sha2(F.concat(left, s["node"], right), 256).alias("node"), (s["cut"] + (x["size"] - 1) * DIGEST).alias("cut"))

    steps = F.arrays_zip(at.alias("at"), size.alias("size"))
    return F.aggregate(steps, F.struct(node.alias("node"), F.lit(1).alias("cut")), step)["node"]
