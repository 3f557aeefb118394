"""Token counts through a digest cache.

The cache is a table of (content digest, tokenizer digest, count) in a shared
folder, partitioned by tokenizer digest.  A run joins the digests of its texts to
it, encodes only distinct texts that it lacks, appends their counts, and joins
again.  Normalisation makes null texts empty and changes nothing else, since any
other change could change a count.  The tokenizer digest covers the file and the
name and version of the library.

The digests of a run's texts are compared with the cache first, without the texts.
While the missing ones are few (``SENT_ROWS``, 64 bytes each) they are sent to the
tasks, and only texts that are missed leave a task at all; beyond that, texts are
reduced to one of each digest with map-side partials before they meet the missing
digests.  Either way a text that fills a third of the table crosses the network once
for each map task at most.  Encoding is one pass of Arrow batches with one
process-wide tokenizer; memory is a batch of ``batch_rows`` texts.

Two runs may share a cache: each appends files of its own, what both encode is there
twice with the same count, and a run joins what it finds after its own append.

Defined results: a null text counts as the empty one; repeated rows give repeated
results; an empty table gives none; extra columns are ignored.  A run that dies
between append and join leaves complete cache files only (Parquet commit), and a
digest appended twice is counted once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import exists, shared_dir, stored

SENT_ROWS = 100_000
CACHE_SCHEMA = "content string, n_tokens long, tokenizer string"


def tokenizer_digest(path: str) -> str:
    import hashlib

    from importlib.metadata import version

    library = "tokenizers" if path.endswith(".json") else "sentencepiece"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"\n{library} {version(library)}".encode()).hexdigest()


def counter(path: str):
    """texts → counts, as the file's library gives them without begin, end or added special tokens."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        return lambda texts: [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1, add_bos=False, add_eos=False)]


def _encode(path_of, batch_rows: int):
    def run(batches):
        import pyarrow as pa

        count = counter(path_of())
        for b in batches:
            for k in range(0, b.num_rows, batch_rows):
                part = b.slice(k, batch_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count(part.column(1).to_pylist()), pa.int64())], names=["content", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path_of, cache_dir: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, batch_rows: int = 256, sent_rows: int = SENT_ROWS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row.

    ``path_of``: a function without arguments that gives the tokenizer file's path
    on whichever machine it runs.  ``cache_dir``: a shared folder that keeps counts
    between runs; without it the run has a cache of its own under the shared folder.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(path_of())
    cache_dir = cache_dir or f"{shared_dir(spark)}/strandline/token-cache-{uuid.uuid4().hex}"
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    digest = F.sha2("__text", 256).alias("content")
    rows = stored(texts.select("__id", F.octet_length("__text").cast("long").alias("n_bytes"), digest), "token-digests")
    wanted = rows.select("content").distinct()

    if not exists(spark, cache_dir):
        spark.createDataFrame([], CACHE_SCHEMA).write.partitionBy("tokenizer").mode("append").parquet(cache_dir)
    cached = lambda: spark.read.schema(CACHE_SCHEMA).parquet(cache_dir).where(F.col("tokenizer") == version).select("content", "n_tokens")
    missing = stored(wanted.join(cached().select("content"), "content", "left_anti"), "token-missing")
    if n := missing.count():
        named = texts.select(digest, "__text")
        if n <= sent_rows:
            named = named.join(F.broadcast(missing), "content", "left_semi")
        distinct = named.groupBy("content").agg(F.first("__text").alias("__text"))
        # an inner join, which stays above the aggregation
        misses = distinct if n <= sent_rows else distinct.join(missing, "content").select("content", "__text")
        counted = misses.mapInArrow(_encode(path_of, batch_rows), "content string, n_tokens long").select("content", "n_tokens", F.lit(version).alias("tokenizer"))
        counted.write.partitionBy("tokenizer").mode("append").parquet(cache_dir)
    # a table of its own, so that the last join has a plain scan on either side and a text that fills a third of the rows can be split
    known = stored(cached().join(wanted, "content", "left_semi").groupBy("content").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    joined = rows.join(known, "content", "left")
    return joined.select(F.col("__id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
