"""A stored index for approximate cosine search within scopes: coarse cells, residual codes, exact scores at the end.

Cells are trained by k-means on a bounded sample of unit vectors (``SAMPLE`` rows, by a hash
of the id); every row is indexed.  A row of the index is a block of up to about ``LIST_ROWS`` vectors of one scope
and cell: their ids, their residuals to the cell's centre as bytes with one scale, and the vectors themselves.
Blocks lie in folders by cell, so a search opens the folders of the cells it probes only, and reads the
vectors of blocks that hold candidates only.

The filter comes first: a query is led to the nearest of those cells that hold something of its scope, so
a rare scope is not lost behind cells of others.  Its codes give approximate scores, the best ``candidates`` are
scored exactly.  How many cells to probe is calibrated at the build: the smallest number that reaches the wanted recall
for a bounded sample of queries, told from the exact neighbours' cells.

A query's vector goes once to each slice of about ``SLICE_ROWS`` vectors of its scope, not to each cell it probes, and of
a slice only its best candidates come back; a part of ``QUERY_PART`` queries meets a slice in one group.

Bounds: the centres (at most ``MOST_CELLS`` times the dimensions) are the only data that go
to every task; joins with vectors are never broadcast, whatever their files' size says.  Null vectors are not indexed; vectors without a length score 0.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.adapters import stored
from strandline.operators.search import knn, top_k

SAMPLE = 65_536
MOST_CELLS = 4096
LIST_ROWS = 4096
CANDIDATES = 100
QUERY_PART = 512
SLICE_ROWS = 16_384
RECALL_QUERIES = 64


def _unit(rows):
    """Vectors of length one as float64; those without a length stay zero."""
    import numpy as np

    m = np.array(rows, np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _centres(vectors: DataFrame, n: int, cells: int, sample: int, seed: int):
    """Centres of the cells, of length one."""
    import numpy as np
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    part = min(1.0, sample / max(1, n))
    drawn = vectors.where(F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 20)) < F.lit(int(part * (1 << 20))))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    unit = drawn.select(F.transform("embedding", lambda x: (x / F.greatest(norm, F.lit(1e-300))).cast("double")).alias("e"))
    # every pass reads the sample, in as many tasks as there are cores; solved row by row, each would also send the distances between all centres to the driver
    few = unit.select(array_to_vector("e").alias("v")).coalesce(vectors.sparkSession.sparkContext.defaultParallelism)
    model = KMeans(k=cells, seed=seed, maxIter=12, featuresCol="v", solver="block").fit(few)
    return _unit(np.array(model.clusterCenters()))


def _assigned(centres):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            near = (_unit(b.column(2).to_pylist()) @ centres.T).argmax(1) if b.num_rows else np.array([], np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int32())], names=["vec_id", "scope", "embedding", "cell"])

    return run


def _packed(centres):
    """The vectors of one block → its row."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("vec_id")
        raw = np.array(table.column("embedding").to_pylist(), np.float64)
        residual = _unit(raw) - centres[table.column("cell")[0].as_py()]
        scale = max(float(np.abs(residual).max()), 1e-12) / 127
        codes = np.rint(residual / scale).astype(np.int8)
        first = lambda c: [table.column(c)[0].as_py()]
        ids = pa.array([table.column("vec_id").to_pylist()], pa.list_(pa.int64()))
        return pa.table({"scope": pa.array(first("scope"), table.schema.field("scope").type), "block": pa.array(first("block"), pa.int32()), "ids": ids, "codes": pa.array([codes.tobytes()]), "scale": [scale], "vectors": pa.array([raw.tobytes()]), "cell": pa.array(first("cell"), pa.int32())})

    return run


def build(vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE, list_rows: int = LIST_ROWS, recall: float = 0.95, k: int = 20, seed: int = 5) -> None:
    """Write the index of ``vec_id, scope, embedding`` to ``path``; ``recall`` and ``k`` are what the number of probes is calibrated for."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "scope", F.col("embedding").cast("array<double>").alias("embedding"))
    kind = rows.schema["scope"].dataType.simpleString()
    n = rows.count()
    cells = cells or max(1, min(MOST_CELLS, round(math.sqrt(n))))
    centres = _centres(rows, n, cells, sample, seed) if n else _unit([[0.0]])
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    placed = stored(rows.mapInArrow(_assigned(centres), f"vec_id long, scope {kind}, embedding array<double>, cell int"), "vectors-placed")
    facts = placed.groupBy("scope", "cell").agg(F.count(F.lit(1)).alias("n"))
    facts.write.parquet(f"{path}/facts")
    facts = spark.read.parquet(f"{path}/facts")
    blocks = F.ceil(F.col("n") / list_rows)
    sized = placed.join(facts, ["scope", "cell"]).select("vec_id", "scope", "embedding", "cell", F.pmod(F.xxhash64("vec_id"), blocks).cast("int").alias("block"))
    packed = sized.groupBy("scope", "cell", "block").applyInArrow(_packed(centres), f"scope {kind}, block int, ids array<long>, codes binary, scale double, vectors binary, cell int")
    packed.repartition("cell").sortWithinPartitions("cell", "scope").write.partitionBy("cell").parquet(f"{path}/lists")
    probes = _calibrated(spark, path, placed, recall, k, seed)
    spark.createDataFrame([(probes, n)], "probes int, n long").coalesce(1).write.parquet(f"{path}/meta")


def _calibrated(spark: SparkSession, path: str, placed: DataFrame, recall: float, k: int, seed: int) -> int:
    """The least number of probes whose cells hold ``recall`` of the exact neighbours of ``RECALL_QUERIES`` rows."""
    some = placed.select("vec_id", "scope", "embedding").orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(RECALL_QUERIES)
    asked = stored(some.withColumnRenamed("vec_id", "query_id"), "vectors-asked")
    exact = knn(placed.select("vec_id", "scope", "embedding"), asked, k)
    order = probed(spark, path, asked, MOST_CELLS).select("query_id", "cell", F.col("rank").alias("need"))
    needs = exact.join(placed.select("vec_id", "cell"), "vec_id").join(order, ["query_id", "cell"])
    # one number for each number of probes, at most as many as cells
    counts = sorted((r["need"], r["count"]) for r in needs.groupBy("need").count().collect())
    total, seen = sum(c for _, c in counts), 0
    for need, c in counts:
        seen += c
        if seen >= recall * total:
            return need
    return 1


def _nearest_cells(centres, probes: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            q = _unit(b.column(2).to_pylist())
            near = []
            for i, there in enumerate(b.column(3).to_pylist()):
                there = np.array(sorted(there))
                s = centres[there] @ q[i]
                best = np.argsort(-s, kind="stable")[:probes]
                near.append([{"cell": c, "base": x} for c, x in zip(there[best].tolist(), s[best].tolist(), strict=True)])
            kind = pa.list_(pa.struct([("cell", pa.int32()), ("base", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(q.tolist(), pa.list_(pa.float64())), pa.array(near, kind)], names=["query_id", "scope", "unit", "near"])

    return run


def led(spark: SparkSession, path: str, queries: DataFrame, probes: int) -> DataFrame:
    """``query_id, scope, unit, near``: each query once, with the nearest ``probes`` cells that hold something of its scope, nearest first."""
    centres = _loaded_centres(spark, path)
    # a scope is in as many cells as there are at most
    there = spark.read.parquet(f"{path}/facts").groupBy("scope").agg(F.collect_list("cell").alias("cells"))
    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", "scope", F.col("embedding").cast("array<double>").alias("embedding")).join(there, "scope").select("query_id", "scope", "embedding", "cells")
    kinds = {c: asked.schema[c].dataType.simpleString() for c in ("query_id", "scope")}
    return asked.mapInArrow(_nearest_cells(centres, probes), f"query_id {kinds['query_id']}, scope {kinds['scope']}, unit array<double>, near array<struct<cell:int,base:double>>")


def probed(spark: SparkSession, path: str, queries: DataFrame, probes: int) -> DataFrame:
    """``query_id, scope, unit, cell, rank, base``: the same, a row for each cell."""
    rows = led(spark, path, queries, probes).select("query_id", "scope", "unit", F.posexplode("near").alias("at", "cell"))
    return rows.select("query_id", "scope", "unit", "cell.cell", (F.col("at") + 1).alias("rank"), "cell.base")


def _loaded_centres(spark: SparkSession, path: str):
    import numpy as np

    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    return np.array([r["centre"] for r in rows])


def _approximate(most: int):
    """The blocks of a slice and a part of the queries of its scope → each query's ``most`` best candidates there."""

    def run(lists, asked):
        import numpy as np
        import pyarrow as pa

        q = np.array(asked.column("unit").to_pylist())
        near = asked.column("near").combine_chunks()
        who = np.repeat(np.arange(len(q)), near.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        flat = near.flatten()
        cell, base = flat.field("cell").to_numpy(), flat.field("base").to_numpy()
        order = np.argsort(cell, kind="stable")
        who, cell, base = who[order], cell[order], base[order]
        lists = lists.sort_by([("cell", "ascending"), ("block", "ascending")])
        cells, codes, scales = lists.column("cell").to_numpy(), lists.column("codes"), lists.column("scale").to_numpy()
        # a query's score that ``most`` candidates so far reach; what lies below need not be kept
        floor = np.full(len(q), -np.inf)
        kept, held = [[np.array([], np.int64)] * 3 + [np.array([])]], 0

        def best():
            w, row, at, s = (np.concatenate(x) for x in zip(*kept, strict=True))
            order = np.lexsort((at, row, -s, w))
            w, row, at, s = w[order], row[order], at[order], s[order]
            place = np.arange(len(w)) - np.searchsorted(w, w)
            last = place == most - 1
            floor[w[last]] = s[last]
            top = place < most
            return [w[top], row[top], at[top], s[top]]

        for i in range(lists.num_rows):
            some = slice(*np.searchsorted(cell, [cells[i], cells[i] + 1]))
            if some.start == some.stop:
                continue
            c = np.frombuffer(codes[i].as_py(), np.int8).reshape(-1, q.shape[1])
            s = base[some, None] + (q[who[some]] @ c.T.astype(np.float64)) * scales[i]
            w, at = np.nonzero(s >= floor[who[some], None])
            kept.append([who[some][w], np.full(len(w), i), at, s[w, at]])
            held += len(w)
            if held > 4 * most * len(q):
                kept = [best()]
                held = len(kept[0][0])
        w, row, at, s = best()
        names = ["query_id", "scope", "cell", "block", "at", "score"]
        return pa.table([asked.column("query_id").take(pa.array(w)), asked.column("scope").take(pa.array(w)), lists.column("cell").take(pa.array(row)), lists.column("block").take(pa.array(row)), pa.array(at, pa.int32()), pa.array(s)], names=names)

    return run


def _exact(batches):
    """Blocks of vectors with (query, place) candidates → exact scores."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        cols = {name: b.column(i) for i, name in enumerate(b.schema.names)}
        for i in range(b.num_rows):
            ids = cols["ids"].slice(i, 1).flatten().to_numpy()
            vectors = _unit(np.frombuffer(cols["vectors"][i].as_py(), np.float64).reshape(len(ids), -1))
            asked = cols["asked"].slice(i, 1).flatten()
            at = asked.field("at").to_numpy()
            s = np.round((np.array(asked.field("unit").to_pylist()) * vectors[at]).sum(1), 6)
            yield pa.RecordBatch.from_arrays([asked.field("query_id"), pa.array(ids[at]), pa.array(s)], names=["query_id", "vec_id", "score"])


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None = None, candidates: int = CANDIDATES) -> DataFrame:
    """``query_id, vec_id, score, rank``: about the ``k`` nearest by cosine within the query's scope; scores are exact.

    Without ``probes`` the calibrated number is used.  A query whose scope has no vector gives no rows.
    """
    probes = probes or spark.read.parquet(f"{path}/meta").first()["probes"]
    most = max(candidates, k)
    asked = stored(led(spark, path, queries, probes), "vectors-probes")
    kinds = {c: asked.schema[c].dataType.simpleString() for c in ("query_id", "scope")}
    lists = spark.read.parquet(f"{path}/lists")
    # at most as many as cells: so only their folders are opened
    cells = [r["cell"] for r in asked.select(F.explode("near.cell").alias("cell")).distinct().collect()]
    lists = lists.where(F.col("cell").isin(cells))
    count = lambda n, most: F.ceil(n / most).cast("int")
    sized = spark.read.parquet(f"{path}/facts").groupBy("scope").agg(count(F.sum("n"), SLICE_ROWS).alias("slices"))
    sizes = stored(sized.join(asked.groupBy("scope").agg(count(F.count(F.lit(1)), QUERY_PART).alias("parts")), "scope"), "vectors-sizes")
    of = lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = lists.join(sizes, "scope").select("scope", "cell", "block", "codes", "scale", of("slices", "cell", "block").alias("slice"), each("parts").alias("part"))
    right = asked.join(sizes, "scope").select("query_id", "scope", "unit", "near", of("parts", "query_id").alias("part"), each("slices").alias("slice"))
    near = left.groupBy("scope", "slice", "part").cogroup(right.groupBy("scope", "slice", "part")).applyInArrow(_approximate(most), f"query_id {kinds['query_id']}, scope {kinds['scope']}, cell int, block int, at int, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "cell", "block", "at")
    few = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("query_id", "scope", "cell", "block", "at")
    wanted = few.join(asked.select("query_id", "unit").hint("merge"), "query_id").join(sizes.select("scope", "parts"), "scope")
    wanted = wanted.groupBy("scope", "cell", "block", of("parts", "query_id").alias("part")).agg(F.collect_list(F.struct("query_id", "unit", "at")).alias("asked"))
    final = lists.select("scope", "cell", "block", "ids", "vectors").join(stored(wanted, "vectors-candidates").hint("merge"), ["scope", "cell", "block"]).select("ids", "vectors", "asked")
    return top_k(final.mapInArrow(_exact, f"query_id {kinds['query_id']}, vec_id long, score double"), k, "vec_id")
