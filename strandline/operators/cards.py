"""Cards and packing: greedy batches, partition bounds and plans, card ids, validation, index rows, JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.adapters import stream_fold
from strandline.functions.text import strip, utf16_len


def greedy_batches(rows: DataFrame, by: str, order: str, size: str, most_items: int, most_size: int) -> DataFrame:
    """``by, order, batch``: items in order, a new batch where the next one would exceed a limit (a larger item has its own)."""

    def step(state, r):
        batch, n, total = state
        if n and (n >= most_items or total + r[size] > most_size):
            batch, n, total = batch + 1, 0, 0
        return (batch, n + 1, total + int(r[size])), (r[order], batch)

    kind = rows.schema[order].dataType.simpleString()
    return stream_fold(rows.select(by, order, F.col(size).cast("long").alias(size)), [by], [order, size], lambda: (0, 0, 0), step, f"{order} {kind}, batch long")


def partition_bounds(tokens: Column, threshold: int, most: int) -> list[Column]:
    """Fewest and most parts of an oversize section, and whether it cannot be split."""
    low = F.greatest(F.lit(2), F.ceil(tokens / threshold)).cast("long")
    return [low.alias("min_parts"), F.least(F.lit(most), low + 1).cast("long").alias("max_parts"), (low > most).alias("too_large")]


def best_partition(tokens: list[int], candidates: list[tuple[int, int]], least: int, most: int, fewest: int, largest: int):
    """Starts of parts of a section, or None.

    ``tokens``: of each block; ``candidates``: (start, strength), the first at 0.  For
    the smallest number of parts that is feasible, each of ``least`` to ``most``
    tokens: the greatest total strength, then the least deviation from equal parts,
    then the earliest starts.  Dynamic programming over candidates.
    """
    total = sum(tokens)
    prefix = [0]
    for t in tokens:
        prefix.append(prefix[-1] + t)
    starts = sorted({0: 0, **dict(candidates)}.items())
    for n in range(fewest, largest + 1):
        target = total / n
        # state: (candidate index, parts so far) → best (strength, -deviation, earlier starts)
        best = {(0, 0): (0, 0.0, ())}
        for parts in range(n):
            for i, (a, strength) in enumerate(starts):
                state = best.get((i, parts))
                if state is None:
                    continue
                ends = [(j, b) for j, (b, _) in enumerate(starts) if b > a] if parts < n - 1 else [(-1, len(tokens))]
                for j, b in ends:
                    size = prefix[b] - prefix[a]
                    if least <= size <= most:
                        new = (state[0] + (strength if a else 0), state[1] - abs(size - target), (*state[2], -a))
                        if (j, parts + 1) not in best or new > best[j, parts + 1]:
                            best[j, parts + 1] = new
        if (-1, n) in best:
            return [-a for a in best[-1, n][2]]
    return None


def plan_partitions(sections: DataFrame, threshold: int, least: int, most_parts: int = 6) -> DataFrame:
    """``section, blocks array<struct<o, tokens, strength>>`` → ``section, starts``; strength null: no candidate."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for blocks in b.column(1).to_pylist():
                tokens = [x["tokens"] for x in blocks]
                low = max(2, -(-sum(tokens) // threshold))
                cands = [(i, x["strength"]) for i, x in enumerate(blocks) if x["strength"] is not None]
                out.append(best_partition(tokens, cands, least, threshold, low, min(most_parts, low + 1)) if low <= most_parts else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], names=["section", "starts"])

    return sections.select("section", "blocks").mapInArrow(run, "section long, starts array<long>")


def candidate_errors(candidates: DataFrame) -> DataFrame:
    """Why a section's boundary candidates are unusable: not rising, not from the start, title or strength out of range."""
    order = Window.partitionBy("section").orderBy("n")
    rows = candidates.withColumn("last", F.lag("start").over(order)).withColumn("first", F.row_number().over(order) == 1)
    rules = F.array(
        F.when(F.col("start") <= F.col("last"), "NOT_INCREASING"), F.when(F.col("first") & (F.col("start") != 0), "NOT_FROM_START"),
        F.when((F.length("title") > 120) | (F.length("title") == 0), "BAD_TITLE"), F.when(~F.col("strength").between(1, 5), "BAD_STRENGTH"),
        *([F.when(~F.coalesce(F.size("topics").between(1, 8) & F.forall("topics", lambda t: F.length(F.trim(t)).between(1, 80)), F.lit(False)), "BAD_TOPICS")] if "topics" in candidates.columns else []),
    )
    return rows.select("section", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("error")).groupBy("section", "error").agg(F.count(F.lit(1)).alias("n"))


def card_ids(version: Column, node: Column, part: Column) -> Column:
    """Id of a heading card, of a card of a part of it, or (node null) of the document's profile."""
    v = version.cast("string")
    return F.when(node.isNull(), F.concat(v, F.lit(":rp:document"))).when(part.isNull(), F.concat(v, F.format_string(":rn:%06d", node))).otherwise(F.concat(v, F.format_string(":rsp:%06d:%02d", node, part)))


def semantic_errors(cards: DataFrame) -> DataFrame:
    """Fields of a card that are out of range, joined by commas; empty if the card is valid."""
    short = lambda c, n: F.forall(c, lambda x: F.length(x).between(1, n))
    bad = F.array(
        F.when(~F.size("topics").between(1, 12) | ~short("topics", 80), "topics"), F.when((F.size("aliases") > 12) | ~short("aliases", 80), "aliases"),
        F.when((F.size("questions") > 8) | ~short("questions", 200), "questions"), F.when(~F.length("summary").between(1, 600), "summary"),
    )
    return cards.select("card_id", F.array_join(F.filter(bad, lambda x: x.isNotNull()), ",").alias("errors"))


def semantic_violations(cards: DataFrame) -> DataFrame:
    """``card_id, errors``: what a model's answer for a card has out of range, joined by commas.

    ``profile``: whether it is a document's; that has a ``text`` (its purpose) of at most 400 UTF-16 units and one question or more, another
    card one (its summary) of at most 600 and may have none.  1 to 12 topics and up to 12 aliases of 80, up to 8 questions of 200.
    Null lists and items, blank texts, and items that are equal but for white space around them are errors.
    """
    text = lambda c, n: F.coalesce((F.length(strip(c)) > 0) & (utf16_len(c) <= n), F.lit(False))

    def items(c, least, most, n):
        x = F.col(c)
        unique = F.size(F.array_distinct(F.transform(x, strip))) == F.size(x)
        return F.coalesce(F.size(x).between(least, most) & F.forall(x, lambda v: text(v, n)) & unique, F.lit(False))

    whole = F.col("profile")
    bad = F.array(
        F.when(~text(F.col("text"), F.when(whole, 400).otherwise(600)), F.when(whole, "purpose").otherwise("summary")), F.when(~items("topics", 1, 12, 80), "topics"),
        F.when(~items("aliases", 0, 12, 80), "aliases"), F.when(~items("questions", F.when(whole, 1).otherwise(0), 8, 200), "questions"),
    )
    return cards.select("card_id", F.array_join(F.filter(bad, lambda x: x.isNotNull()), ",").alias("errors"))


def json_lines(docs: DataFrame, blocks: DataFrame, headings: DataFrame | None = None, warnings: DataFrame | None = None) -> DataFrame:
    """Header, a line for each block, heading and warning, footer with their counts: ``doc_id, section, ordinal, line``. A writer orders by these."""
    none = docs.select("doc_id", F.lit(0).alias("pos"), F.lit("").alias("title")).limit(0)
    headings = none if headings is None else headings
    warnings = docs.select("doc_id", F.lit("").alias("code"), F.lit(0).alias("pos")).limit(0) if warnings is None else warnings
    record = lambda kind, *fields: F.to_json(F.struct(F.lit(kind).alias("recordType"), *fields)).alias("line")
    row = lambda df, section, order, line: df.select("doc_id", F.lit(section).alias("section"), order.cast("long").alias("ordinal"), line)
    header = row(docs, 0, F.lit(0), record("header", F.lit(1).alias("schemaVersion"), "doc_id"))
    body = row(blocks, 1, F.col("ordinal"), record("block", "ordinal", "text"))
    heads = row(headings, 2, F.col("pos"), record("heading", F.col("pos").alias("ordinal"), F.col("title").alias("text")))
    warned = row(warnings, 3, F.coalesce("pos", F.lit(-1)), record("warning", F.col("pos").alias("ordinal"), F.col("code").alias("text")))
    count = lambda df, name: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    counts = docs.select("doc_id").join(count(blocks, "b"), "doc_id", "left").join(count(headings, "h"), "doc_id", "left").join(count(warnings, "w"), "doc_id", "left")
    footer = row(counts, 4, F.lit(0), record("footer", F.coalesce("b", F.lit(0)).alias("blockCount"), F.coalesce("h", F.lit(0)).alias("headingCount"), F.coalesce("w", F.lit(0)).alias("warningCount")))
    return header.unionByName(body).unionByName(heads).unionByName(warned).unionByName(footer)


def object_facts(lines: DataFrame, most_bytes: int) -> DataFrame:
    """``doc_id, size_bytes, sha256, error`` of the object that a document's lines make, each ended by a newline; one over the limit is an error."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "ordinal", "line"))), lambda x: F.concat(x["line"], F.lit("\n"))), "")
    rows = lines.groupBy("doc_id").agg(text.alias("t")).select("doc_id", F.octet_length("t").cast("long").alias("size_bytes"), F.sha2("t", 256).alias("sha256"))
    large = F.col("size_bytes") > most_bytes
    return rows.select("doc_id", "size_bytes", F.when(~large, F.col("sha256")).alias("sha256"), F.when(large, "OBJECT_TOO_LARGE").alias("error"))


def evidence_rows(blocks: DataFrame, tree: DataFrame, documents: DataFrame, manifests: DataFrame) -> DataFrame:
    """Rows of the evidence index: a block with its title path, range, position and lineage.

    ``documents``: ``doc_id, tenant_id, kb_id, title``; ``manifests``: ``doc_id, artifact_sha256, fingerprint``.  Positions
    (``page, start_line, end_line, row, col``) pass through where blocks have them.
    """
    paths = tree.select("doc_id", F.col("pos").alias("heading"), "path")
    position = [c if c in blocks.columns else F.lit(None).cast("long").alias(c) for c in ("page", "start_line", "end_line", "row", "col")]
    rows = blocks.join(documents, "doc_id").join(manifests, "doc_id").join(paths, ["doc_id", "heading"], "left")
    continuation = "continuation" if "continuation" in blocks.columns else F.lit(None).cast("string").alias("continuation")
    return rows.select("tenant_id", "kb_id", "doc_id", "title", "block_id", "ordinal", "kind", "heading", F.coalesce("path", F.lit("")).alias("heading_path"), "text", "start", "end", continuation, *position, "artifact_sha256", "fingerprint")


def read_json_lines(lines: DataFrame) -> DataFrame:
    """Back to blocks with a check for each document: one header, one footer, as many blocks, headings and warnings as it says, no other record."""
    kind = "recordType string, doc_id long, ordinal long, text string, blockCount long, headingCount long, warningCount long"
    rows = lines.select("doc_id", F.from_json("line", kind).alias("r")).select(F.col("doc_id").alias("doc"), "r.*")
    is_ = lambda x: F.col("recordType") == x
    as_said = lambda name: F.count_if(is_(name)) == F.coalesce(F.max(f"{name}Count"), F.lit(0))
    known = F.coalesce(F.col("recordType").isin("header", "block", "heading", "warning", "footer"), F.lit(False))
    ok = (F.count_if(is_("header")) == 1) & (F.count_if(is_("footer")) == 1) & as_said("block") & as_said("heading") & as_said("warning") & (F.count_if(~known) == 0)
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(is_("block"), F.struct("ordinal", "text")))), lambda x: x["text"]), "\n\n"), 256)
    return rows.groupBy("doc").agg(F.coalesce(ok, F.lit(False)).alias("valid"), F.count_if(is_("block")).alias("n_blocks"), digest.alias("text_sha256")).withColumnRenamed("doc", "doc_id")


def partition_trigger(sections: DataFrame, threshold: int = 64_000, enabled: bool = False) -> DataFrame:
    """Sections (``tokens, children``) that are cut into parts: leaves over the threshold, and none while this is off."""
    return sections.where(F.lit(enabled) & (F.col("children") == 0) & (F.col("tokens") > threshold))


def provider_cards(answer: Column) -> Column:
    """What a provider's JSON says of its cards: struct (items, error).

    The object's ``items`` are read; fields that are not known are ignored, missing
    lists are empty; an item that is no object (an array around it, say), or has no id, is an error.
    """
    raw = F.from_json(F.get_json_object(answer, "$.items"), "array<string>")
    item = "request_id string, summary string, topics array<string>, aliases array<string>, questions array<string>"
    empty = F.array().cast("array<string>")
    read = lambda x: F.from_json(x, item)
    full = lambda r: F.struct(r["request_id"].alias("request_id"), r["summary"].alias("summary"), *[F.coalesce(r[c], empty).alias(c) for c in ("topics", "aliases", "questions")])
    bad = F.exists(raw, lambda x: F.json_object_keys(x).isNull() | (F.length(F.trim(F.coalesce(F.get_json_object(x, "$.request_id"), F.lit("")))) == 0))
    error = F.when(F.json_object_keys(answer).isNull(), "NOT_AN_OBJECT").when(raw.isNull(), "NO_ITEMS").when(bad, "BAD_ITEM")
    return F.struct(F.when(error.isNull(), F.transform(raw, lambda x: full(read(x)))).alias("items"), error.alias("error"))
