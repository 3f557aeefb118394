"""A stored inverted index for keyword search, with postings in blocks and the greatest weight of each.

Documents are dealt to blocks of about ``BLOCK_DOCS`` by a hash of their id; only their texts are shuffled to them, and a block's
postings are made and written where it is.  For each field (a column under an
analyzer), term and block there is one row: the documents, how often they have the term, their lengths, and for each frequency
the least length, one of which gives the block's greatest BM25 weight.  Rows lie
in folders by a hash of their term, sorted by field and term, so a search reads the folders
and row groups of its own terms only.

A search counts the documents of its own terms and reads the greatest weights alone.  Their sums bound what a document of a block can
reach for a query.  The most promising blocks of each query are scored first; the k-th score there is a floor, and of the
other blocks only those whose bound reaches it are read at all.  A block is scored for all its queries in one task
by NumPy, which returns k rows a query, so nothing grows with documents times queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.adapters import stored

K1, B = 1.2, 0.75
BLOCK_DOCS = 1024
FOLDERS = 16
QUERY_PART = 256
FIRST_BLOCKS = 2
#: Scores are rounded to six decimals; bounds leave room for that.
SLACK = 1e-4
#: Documents of a block that are Python lists of words at a time.
DOCS_AT_ONCE = 64
#: Blocks that one task makes, where there are enough for all cores.
BLOCKS_A_TASK = 16


def _postings(fields: int):
    """A block's documents as token arrays by field → its rows; the empty term has the lengths of all its documents."""

    def run(table):
        from array import array
        from collections import Counter

        import numpy as np
        import pyarrow as pa

        found: dict[tuple[int, str], array] = {}
        for at in range(0, table.num_rows, DOCS_AT_ONCE):
            some = table.slice(at, DOCS_AT_ONCE)
            docs = some.column("doc_id").to_pylist()
            for field in range(fields):
                for d, tokens in zip(docs, some.column(f"f{field}").to_pylist(), strict=True):
                    own = Counter(tokens or ())
                    n = sum(own.values())
                    own[""] = 1
                    for term, tf in own.items():
                        there = found.get((field, term))
                        if there is None:
                            there = found[field, term] = array("q")
                        there.extend((d, tf, n))
        entries = np.frombuffer(b"".join(found.values()), np.int64).reshape(-1, 3)
        sizes = np.array([len(x) // 3 for x in found.values()], np.int64)
        listed = lambda sizes, values, kind: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))
        # the weight grows with tf and falls with len, so the shortest document of each tf is enough for the greatest
        row = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((entries[:, 2], entries[:, 1], row))
        row, tf, size = row[order], entries[order, 1], entries[order, 2]
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (tf[1:] != tf[:-1])
        peaks = np.bincount(row[first], minlength=len(sizes))
        columns = {
            "field": pa.array([f for f, _ in found], pa.int32()), "term": pa.array([t for _, t in found], pa.string()), "block": pa.array(np.full(len(sizes), table.column("block")[0].as_py()), pa.int32()), "n": pa.array(sizes, pa.int32()),
            "peak_tfs": listed(peaks, tf[first], pa.int32()), "peak_lens": listed(peaks, size[first], pa.int32()), "docs": listed(sizes, entries[:, 0], pa.int64()), "tfs": listed(sizes, entries[:, 1], pa.int32()), "lens": listed(sizes, entries[:, 2], pa.int32()),
        }
        return pa.table(columns)

    return run


ROWS = "field int, term string, block int, n int, peak_tfs array<int>, peak_lens array<int>, docs array<long>, tfs array<int>, lens array<int>"
INDEX = ROWS + ", folder int"
FACTS = "field int, boost double, k1 double, b double, docs long, mean double"


def build(docs: DataFrame, fields, path: str, block_docs: int = BLOCK_DOCS, k1: float = K1, b: float = B) -> None:
    """Write the index of ``docs`` (``doc_id`` and the fields' columns) to ``path``.

    ``fields``: (column, analyzer, boost) each.  Every column is read and analyzed once by each of its
    analyzers.  A null text has no terms; ids that occur twice share their postings.
    """
    spark = docs.sparkSession
    columns = list(dict.fromkeys(c for c, _, _ in fields))
    blocks = max(1, -(-docs.count() // block_docs))
    tasks = max(min(blocks, spark.sparkContext.defaultParallelism), -(-blocks // BLOCKS_A_TASK))
    block = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(blocks)).cast("int")
    texts = docs.where(F.col("doc_id").isNotNull()).select(block.alias("block"), F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    # dealt and sorted as texts, which are smaller than their words
    dealt = texts.repartition(tasks, "block").sortWithinPartitions("block")
    tokens = dealt.select("block", "doc_id", *[analyzer(F.col(f"c{columns.index(c)}")).alias(f"f{i}") for i, (c, analyzer, _) in enumerate(fields)])
    rows = tokens.groupBy("block").applyInArrow(_postings(len(fields)), ROWS).withColumn("folder", F.pmod(F.xxhash64("term"), F.lit(FOLDERS)).cast("int"))
    rows.sortWithinPartitions("folder", "field", "term", "block").write.partitionBy("folder").parquet(f"{path}/postings")
    # a field's length of each document stands under the empty term
    written = spark.read.schema(INDEX).parquet(f"{path}/postings").where((F.col("term") == "") & (F.col("folder") == F.pmod(F.xxhash64(F.lit("")), F.lit(FOLDERS)).cast("int")))
    length = F.aggregate("lens", F.lit(0).cast("long"), lambda n, x: n + x)
    found = written.groupBy("field").agg(F.sum("n").alias("docs"), (F.sum(length) / F.sum("n")).alias("mean"))
    boosts = spark.createDataFrame([(i, float(boost), float(k1), float(b)) for i, (_, _, boost) in enumerate(fields)], "field int, boost double, k1 double, b double")
    mean = F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0)
    boosts.join(found, "field", "left").select("field", "boost", "k1", "b", F.coalesce("docs", F.lit(0)).alias("docs"), mean.alias("mean")).coalesce(1).write.parquet(f"{path}/fields")


def query_terms(queries: DataFrame, fields) -> DataFrame:
    """``query_id, field, term``: the different terms of each query under each field's analyzer."""
    arrays = F.array(*[F.struct(F.lit(i).alias("field"), F.array_distinct(analyzer(F.col("text"))).alias("terms")) for i, (_, analyzer, _) in enumerate(fields)])
    each = queries.select("query_id", F.explode(arrays).alias("x"))
    return each.select("query_id", "x.field", F.explode("x.terms").alias("term"))


def _scored(k: int, boosts: dict[int, float], k1: float, b: float):
    """Posting rows of one block, and the queries that want the block → the ``k`` best documents of each query."""

    def run(table, wanting):
        import numpy as np
        import pyarrow as pa

        if not table.num_rows or not wanting.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        lists = table.column("docs").combine_chunks()
        counts = lists.value_lengths().to_numpy()
        ids, at = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        numbers = lambda c: table.column(c).combine_chunks().flatten().to_numpy().astype(np.float64)
        tf, idf, mean = numbers("tfs"), np.repeat(table.column("idf").to_numpy(), counts), np.repeat(table.column("mean").to_numpy(), counts)
        w = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * numbers("lens") / mean))
        ends = np.cumsum(counts)
        wanted = table.column("queries").combine_chunks()
        asked = np.unique(wanting.column("query_id").to_numpy())
        of, posting = wanted.flatten().to_numpy(), np.repeat(np.arange(table.num_rows), wanted.value_lengths().to_numpy())
        there = np.isin(of, asked)
        row_of, query_ends = np.searchsorted(asked, of[there]), np.cumsum(np.bincount(posting[there], minlength=table.num_rows))
        best = np.full((len(asked), len(ids)), -1.0)
        field_of = table.column("field").to_numpy()
        for field in np.unique(field_of).tolist():
            sums = np.zeros_like(best)
            for i in np.flatnonzero(field_of == field).tolist():
                places = slice(ends[i - 1] if i else 0, ends[i])
                # ids may occur twice; a term's queries do not
                sums[row_of[query_ends[i - 1] if i else 0 : query_ends[i]]] += np.bincount(at[places], w[places], len(ids))
            # in millionths, halves upwards
            best = np.where(sums > 0, np.maximum(best, np.floor(np.floor(sums * 1e6 + 0.5) * boosts[field] + 0.5)), best)
        order = np.argsort(-best, axis=1, kind="stable")[:, :k]
        score = np.take_along_axis(best, order, 1)
        there = score >= 0
        n = order.shape[1]
        return pa.table({"query_id": np.repeat(asked, n)[there.ravel()], "doc_id": ids[order].ravel()[there.ravel()], "score": score.ravel()[there.ravel()] / 1e6})

    return run


def search(spark: SparkSession, path: str, queries: DataFrame, fields, k: int, first_blocks: int = FIRST_BLOCKS) -> DataFrame:
    """``query_id, doc_id, score, rank``: the ``k`` best of each query by the greatest of its fields' boosted scores, ties by id.

    ``fields``: as the index was built with.  ``spark`` may be another session than the one that built it.
    """
    from strandline.operators.search import top_k

    boosts = {i: float(boost) for i, (_, _, boost) in enumerate(fields)}
    terms = query_terms(queries, fields).select("*", F.pmod(F.xxhash64("term"), F.lit(FOLDERS)).cast("int").alias("folder"), F.pmod(F.xxhash64("query_id"), F.lit(1 << 20)).alias("h"))
    parts = max(1, -(-queries.count() // QUERY_PART))
    terms = stored(terms.where("term <> ''").select("query_id", "field", "term", "folder", F.pmod("h", F.lit(parts)).cast("int").alias("part")), "index-terms")
    index = spark.read.schema(INDEX).parquet(f"{path}/postings")
    fields_of = spark.read.schema(FACTS).parquet(f"{path}/fields")
    k1, b = fields_of.select("k1", "b").first()
    keys = ["folder", "field", "term"]
    # what is known of the queries' terms; so the postings stay where they are until they are scored
    df = index.select(*keys, "n").join(terms.select(*keys).distinct(), keys).groupBy(*keys).agg(F.sum("n").alias("df")).join(fields_of.select("field", "docs", "mean"), "field")
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    facts = stored(df.select(*keys, idf.alias("idf"), "mean"), "index-facts")
    asked = stored(terms.join(facts, keys).groupBy(*keys, "idf", "mean", "part").agg(F.collect_list("query_id").alias("queries")), "index-asked")
    weight = lambda tf, size: F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / F.col("mean")))
    boost = F.element_at(F.create_map(*[x for i, v in boosts.items() for x in (F.lit(i), F.lit(v))]), F.col("field"))
    most = index.select(*keys, "block", "peak_tfs", "peak_lens").join(asked, keys).select("block", "field", "part", F.array_max(F.zip_with("peak_tfs", "peak_lens", weight)).alias("most"), F.explode("queries").alias("query_id"))
    reach = most.groupBy("query_id", "part", "block", "field").agg((F.sum("most") * F.first(boost)).alias("reach"))
    bounds = stored(reach.groupBy("query_id", "part", "block").agg(F.max("reach").alias("reach")), "index-bounds")

    def scored(of: DataFrame) -> DataFrame:
        """The ``k`` best of each query in the blocks of ``of``."""
        places = stored(of.select("block", "part").distinct(), "index-places")
        found = index.select(*keys, "block", "docs", "tfs", "lens").join(asked, keys).join(places, ["block", "part"], "left_semi")
        found = found.select("block", "part", "field", "docs", "tfs", "lens", "idf", "mean", "queries").groupBy("block", "part")
        return found.cogroup(of.select("block", "part", F.col("query_id").cast("long").alias("query_id")).groupBy("block", "part")).applyInArrow(_scored(k, boosts, k1, b), "query_id long, doc_id long, score double")

    first = stored(top_k(bounds.select("query_id", "part", "block", F.col("reach").alias("score")), first_blocks, "block"), "index-first")
    head = stored(scored(first), "index-head")
    rest = stored(surviving(bounds, first, head, k), "index-rest")
    return top_k(head.unionByName(scored(rest)), k)


def surviving(bounds: DataFrame, first: DataFrame, head: DataFrame, k: int) -> DataFrame:
    """Blocks whose bound reaches the k-th score of those scored first; all, for queries with fewer scores."""
    from strandline.operators.search import top_k

    floor = top_k(head, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    rest = bounds.join(first.select("query_id", "block"), ["query_id", "block"], "left_anti").join(floor, "query_id", "left")
    return rest.where(F.col("floor").isNull() | (F.col("reach") >= F.col("floor") - SLACK)).select("query_id", "part", "block", "reach", "floor")
