"""Navigation cards of a document: generation from the leaves up, limits, checks, index rows, JSON lines.

Models are ports: a function from a source text's column to a struct ``summary,
topics, aliases, questions``; ``extract`` stands in for one offline.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.adapters import stored
from strandline.functions.text import bounded, embedding_text, estimate_tokens, utf16_len
from strandline.operators.cards import card_ids

#: Limits of one document.
MOST_CHARS, MOST_CARDS, MOST_CALLS, MOST_ROUNDS = 4_000_000, 2_000, 128, 8
DEEPEST = 6
SEMANTIC = "struct<summary:string,topics:array<string>,aliases:array<string>,questions:array<string>>"


def extract(source: Column, title: Column) -> Column:
    """A stand-in for a model: the source's beginning, its first long words, and a question after the title."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(source), F.lit(r"\p{L}{5,}"), 0))
    return F.struct(
        F.coalesce(F.nullif(bounded(source, 160), F.lit("")), title).alias("summary"), F.slice(F.concat(words, F.array(F.lower(title))), 1, 3).alias("topics"),
        F.array().cast("array<string>").alias("aliases"), F.array(F.concat(F.lit("What does "), title, F.lit(" say?"))).alias("questions"),
    )


def temporary_card(title: Column, card: Column) -> Column:
    """A card as its parent's source holds it."""
    joined = lambda c: F.array_join(c, " | ")
    return F.concat(F.lit("Section: "), title, F.lit("\nSummary: "), card["summary"], F.lit("\nTopics: "), joined(card["topics"]), F.lit("\nQuestions: "), joined(card["questions"]))


def rerank_document(title_path: Column, text: Column) -> Column:
    """What a reranker reads of a candidate."""
    return F.concat_ws("\n", F.when(F.length(title_path) > 0, title_path), text)


def section_cards(blocks: DataFrame, tree: DataFrame, model: Callable[[Column, Column], Column] = extract) -> DataFrame:
    """``doc_id, pos, depth, title, path, source, card``: a card for each heading, the deepest first.

    A section's source is its own text, without headings, and then its children's
    cards in order; an empty one has its title.  One step for each depth that occurs, of which
    there are ``DEEPEST`` at most; each reads the stored cards of the one below.
    """
    body = blocks.where(F.col("level").isNull() & (F.col("heading") >= 0))
    ordered = lambda c, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, c))), lambda x: x[c]), "\n\n")
    own = stored(body.groupBy("doc_id", F.col("heading").alias("pos")).agg(ordered("text", "ordinal").alias("own")), "card-texts")
    heads = stored(tree.select("doc_id", "pos", "depth", "title", "path", "parent").join(own, ["doc_id", "pos"], "left"), "card-sections")
    below, done = None, []
    deepest = heads.agg(F.max("depth").alias("d")).first()["d"] or 1
    for depth in range(min(DEEPEST, deepest), 0, -1):
        level = heads.where(F.col("depth") == depth)
        if below is None:
            level = level.withColumn("children", F.lit(None).cast("string"))
        else:
            rendered = below.select("doc_id", F.col("parent").alias("pos"), F.col("pos").alias("child"), temporary_card(F.col("title"), F.col("card")).alias("text"))
            level = level.join(rendered.groupBy("doc_id", "pos").agg(ordered("text", "child").alias("children")), ["doc_id", "pos"], "left")
        source = F.concat_ws("\n\n", *[F.when(F.length(F.trim(c)) > 0, F.col(c)) for c in ("own", "children")])
        source = F.when(F.length(source) > 0, source).otherwise(F.concat(F.lit("Section title: "), F.col("title")))
        level = level.select("doc_id", "pos", "depth", "title", "path", "parent", source.alias("source"))
        below = stored(level.select("*", model(F.col("source"), F.col("title")).cast(SEMANTIC).alias("card")), f"cards-{depth}")
        done.append(below)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("parent")


def card_limits(blocks: DataFrame, tree: DataFrame, batch: int = 4) -> DataFrame:
    """``doc_id, chars, headings, calls, error``: what a document's cards would cost, and whether that is too much."""
    chars = blocks.groupBy("doc_id").agg(F.sum(utf16_len(F.col("text"))).alias("chars"))
    per = tree.groupBy("doc_id", "depth").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("headings"), (F.sum(F.ceil(F.col("n") / batch)) + 1).alias("calls"))
    rows = chars.join(per, "doc_id", "left").select("doc_id", "chars", F.coalesce("headings", F.lit(0)).alias("headings"), F.coalesce("calls", F.lit(1)).alias("calls"))
    too_much = (F.col("chars") > MOST_CHARS) | (F.col("headings") + 1 > MOST_CARDS) | (F.col("calls") > MOST_CALLS)
    return rows.select("*", F.when(too_much, "RETRIEVAL_GENERATION_LIMIT_EXCEEDED").alias("error"))


def reduced(text: str, limit: int, split: Callable, summarise: Callable, estimate: Callable, most_rounds: int = MOST_ROUNDS) -> str:
    """A text that a model can read at once: pieces of it are summarised until it fits; each round must shrink it."""
    for _ in range(most_rounds + 1):
        if estimate(text) <= limit:
            return text
        shorter = "\n\n".join(s for s in map(summarise, split(text, limit)) if s.strip())
        if len(shorter) >= len(text):
            break
        text = shorter
    raise ValueError("RETRIEVAL_GENERATION_LIMIT_EXCEEDED")


def _pieces(limit: int):
    def run(batches):
        import pyarrow as pa

        from strandline.functions.text import split_tokens

        for b in batches:
            for key, text in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                parts = split_tokens(text, limit)
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(parts), b.schema.field(0).type), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], names=["id", "n", "piece"])

    return run


def reduce_texts(texts: DataFrame, limit: int, summarise: Callable[[Column], Column], most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """``id, text`` → ``id, text, rounds, error``: every text as one that a model can read at once.

    A round takes the texts whose estimated tokens are over ``limit``, and no others: it cuts them into pieces
    within the limit, deals the pieces to all tasks (a long text's too), summarises each, and joins
    the summaries that are not blank in order.  A text that a round does not shorten, or that ``most_rounds`` do not bring within the
    limit, is an error and keeps its last state.  Each round is stored.  A null text is empty; ids are unique and not null.
    """
    kind = texts.schema["id"].dataType.simpleString()
    now = stored(texts.select("id", F.coalesce("text", F.lit("")).alias("text"), F.lit(0).alias("rounds"), F.lit(None).cast("string").alias("error")), "reduce-0")
    for k in range(1, most_rounds + 2):
        over = F.col("error").isNull() & (estimate_tokens(F.col("text")) > limit)
        long = now.where(over)
        if not long.take(1):
            return now
        failed = F.lit("RETRIEVAL_GENERATION_LIMIT_EXCEEDED")
        if k > most_rounds:
            return now.select("id", "text", "rounds", F.when(over, failed).otherwise(F.col("error")).alias("error"))
        pieces = long.select("id", "text").mapInArrow(_pieces(limit), f"id {kind}, n int, piece string").repartition("id", "n")
        said = pieces.select("id", "n", summarise(F.col("piece")).alias("s")).where(F.rlike("s", F.lit(r"(?U)\S")))
        joined = said.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda x: x["s"]), "\n\n").alias("shorter"))
        met = now.join(joined, "id", "left").withColumn("shorter", F.when(over, F.coalesce("shorter", F.lit(""))))
        shrunk = F.length("shorter") < F.length("text")
        now = stored(
            met.select(
                "id", F.when(over & shrunk, F.col("shorter")).otherwise(F.col("text")).alias("text"), (F.col("rounds") + F.when(over & shrunk, 1).otherwise(0)).alias("rounds"),
                F.when(over & ~shrunk, failed).otherwise(F.col("error")).alias("error"),
            ), f"reduce-{k}",
        )
    return now


def accepted_outputs(requests: DataFrame, outputs: DataFrame) -> DataFrame:
    """``batch, request_id, n`` and ``batch, attempt, request_id, valid`` → ``batch, request_id, n, attempt, error``.

    A batch's answer counts if it has every request once, nothing else, and all of it
    is valid.  The first that counts of two attempts is taken, in the order of the requests.
    """
    asked = requests.groupBy("batch").agg(F.count(F.lit(1)).alias("asked"))
    known = outputs.join(requests.select("batch", "request_id", F.lit(1).alias("known")), ["batch", "request_id"], "left")
    per = known.groupBy("batch", "attempt").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("request_id").alias("ids"), F.min(F.coalesce("known", F.lit(0))).alias("known"), F.min(F.coalesce(F.col("valid"), F.lit(False)).cast("int")).alias("ok"))
    good = per.join(asked, "batch").where((F.col("n") == F.col("asked")) & (F.col("ids") == F.col("asked")) & (F.col("known") == 1) & (F.col("ok") == 1) & F.col("attempt").isin(1, 2))
    chosen = good.groupBy("batch").agg(F.min("attempt").alias("attempt"))
    return requests.join(chosen, "batch", "left").select("batch", "request_id", "n", "attempt", F.when(F.col("attempt").isNull(), "RETRIEVAL_MODEL_OUTPUT_INVALID").alias("error"))


def artifact_violations(cards: DataFrame) -> DataFrame:
    """``version, rule, n`` of a document's cards, which are in the order ``n``.

    ``cards``: ``version, n, card_id, card_type, node, parent, depth, sibling, part, title, path,
    start, end, canonical_start, canonical_end, embedding_text, wanted_text``.
    """
    full, part = F.col("card_type") == "HEADING_NODE", F.col("card_type") == "HEADING_SUBPARTITION"
    prefix = lambda kind: F.startswith(F.col("card_id"), F.concat(F.col("version").cast("string"), F.lit(f":{kind}:")))
    shape = (
        ~(full | part) | (full & (~prefix("rn") | F.col("part").isNotNull())) | (part & (~prefix("rsp") | F.col("part").isNull() | (F.col("part") < 0))) | F.col("node").isNull() | F.col("parent").isNull()
        | (F.col("depth") < 1) | (F.col("sibling") < 0) | (F.length(F.trim(F.coalesce("title", F.lit("")))) == 0) | (F.length(F.trim(F.coalesce("path", F.lit("")))) == 0)
        | (F.col("start") >= F.col("end")) | (F.col("canonical_start") > F.col("canonical_end"))
    )
    # what a card tells by itself is told before it is dealt and sorted: texts do not go on
    told = cards.select(
        "version", "n", "card_id", "card_type", "node", "parent", "depth", "part", "start", "end",
        F.coalesce(shape, F.lit(True)).alias("odd"), (~F.col("embedding_text").eqNullSafe(F.col("wanted_text"))).alias("other_text"),
    )
    sums = {"full": F.count_if(full), "part": F.count_if(part), "odd": F.count_if("odd"), "other": F.count_if("other_text"), "cards": F.count(F.lit(1)), "first": F.min("n")}
    nodes = told.groupBy("version", "node").agg(*[c.alias(k) for k, c in sums.items()], F.min_by(F.struct("parent", "depth"), "n").alias("own"), F.min(F.when(F.col("depth") == 1, F.struct("n", "parent"))).alias("root"))
    nodes = nodes.select("*", "own.parent", "own.depth", F.min("root").over(Window.partitionBy("version"))["parent"].alias("rooted")).drop("own", "root")
    heads = told.groupBy("version", F.col("node").alias("parent")).agg(F.min("n").alias("parent_at"))
    mixed = (F.col("full") > 1) | ((F.col("full") > 0) & (F.col("part") > 0))
    late = (F.col("depth") > 1) & ~F.coalesce(F.col("parent_at") < F.col("first"), F.lit(False))
    of_nodes = nodes.join(heads, ["version", "parent"], "left").groupBy("version").agg(
        F.sum("odd").alias("BAD_SHAPE"), F.sum(F.when(mixed, F.col("cards")).otherwise(0)).alias("MIXED_CARDS"), F.count_if((F.col("depth") == 1) & (F.col("parent") != F.col("rooted"))).alias("SEVERAL_ROOTS"),
        F.count_if(late).alias("PARENT_AFTER_CHILD"), F.sum("other").alias("TEXT_NOT_OF_TEMPLATE"), F.when(F.sum("cards") + 1 > MOST_CARDS, F.sum("cards")).otherwise(0).alias("TOO_MANY_CARDS"),
    )
    each = [F.struct(F.lit(c).alias("rule"), F.col(c).cast("long").alias("n")) for c in of_nodes.columns[1:]]
    found = of_nodes.select("version", F.explode(F.array(*each)).alias("x")).select("version", "x.rule", "x.n")
    # of cards themselves only the parts of a heading are sorted
    pieces = Window.partitionBy("version", "node").orderBy("n")
    apart = (F.col("part") != F.row_number().over(pieces) - 1) | (F.lag("end").over(pieces) != F.col("start"))
    gaps = told.where(part).select("version", "node", "n", "part", "start", "end").select("version", apart.alias("apart")).groupBy("version").agg(F.count_if("apart").alias("n"))
    ids = told.groupBy("version", "card_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy("version").agg(F.sum("n").alias("n"))
    named = lambda df, rule: df.select("version", F.lit(rule).alias("rule"), "n")
    return found.unionByName(named(gaps, "PARTS_NOT_CONTIGUOUS")).unionByName(named(ids, "CARD_ID_REPEATED")).where("n > 0")


def navigation_rows(cards: DataFrame, profiles: DataFrame) -> DataFrame:
    """Rows of the navigation index: a profile for each version and a row for each card, with title, template text and vector.

    ``cards``: ``version, node, part, depth, title, path, start, end, card, embedding``; ``profiles``: ``version, title, card, embedding``.
    """
    text = lambda path: embedding_text(F.col("document_title"), path, F.col("card.summary"), F.col("card.topics"), F.col("card.aliases"), F.col("card.questions"))
    none = lambda kind: F.lit(None).cast(kind)
    top = profiles.select("version", card_ids(F.col("version"), none("int"), none("int")).alias("card_id"), F.lit("DOCUMENT_PROFILE").alias("card_type"), none("int").alias("node"), none("int").alias("depth"), F.col("title").alias("document_title"), none("string").alias("path"), none("int").alias("start"), none("int").alias("end"), "card", "embedding")
    kind = F.when(F.col("part").isNull(), "HEADING_NODE").otherwise("HEADING_SUBPARTITION")
    titles = profiles.select("version", F.col("title").alias("document_title"))
    rest = cards.join(titles, "version").select("version", card_ids(F.col("version"), F.col("node"), F.col("part")).alias("card_id"), kind.alias("card_type"), F.col("node").cast("int").alias("node"), F.col("depth").cast("int").alias("depth"), "document_title", "path", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "card", "embedding")
    both = top.unionByName(rest)
    return both.select("version", "card_id", "card_type", "node", "depth", "document_title", "path", "start", "end", text(F.col("path")).alias("embedding_text"), "embedding")


NODE = "recordType string, schemaVersion int, version long, fingerprint string, cardId string, cardType string, n int, text string, profileCount int, nodeCount int, vectorCount int, semanticSha256 string, complete boolean"


def retrieval_lines(rows: DataFrame, headers: DataFrame, schema_version: int = 2) -> DataFrame:
    """Index rows (``version, n, card_id, card_type, text``; the profile has n = 0) → ``version, section, n, line``: header, profile, nodes, footer."""
    head = headers.select("version", F.lit(0).alias("section"), F.lit(0).alias("n"), F.to_json(F.struct(F.lit("header").alias("recordType"), F.lit(schema_version).alias("schemaVersion"), "version", "fingerprint")).alias("line"))
    profile = F.col("card_type") == "DOCUMENT_PROFILE"
    body = rows.select("version", F.when(profile, 1).otherwise(2).alias("section"), "n", F.to_json(F.struct(F.when(profile, "profile").otherwise("node").alias("recordType"), F.col("card_id").alias("cardId"), F.col("card_type").alias("cardType"), "n", "text")).alias("line"))
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n"), 256)
    counts = rows.groupBy("version").agg(F.count_if(profile).alias("profileCount"), F.count_if(~profile).alias("nodeCount"), F.count(F.lit(1)).alias("vectorCount"), digest.alias("semanticSha256"))
    foot = counts.select("version", F.lit(3).alias("section"), F.lit(0).alias("n"), F.to_json(F.struct(F.lit("footer").alias("recordType"), "profileCount", "nodeCount", "vectorCount", "semanticSha256", F.lit(True).alias("complete"))).alias("line"))
    return head.unionByName(body).unionByName(foot)


def read_retrieval_lines(lines: DataFrame, known_version: int = 2) -> DataFrame:
    """``version, error, nodes``: what is wrong with each version's lines (in the order ``at``), or null.

    Header first, footer last and complete, one profile, counts and digest as stated, no
    blank line, no other record; a schema up to ``known_version`` is read, and in
    version 1 a node without a card type is a heading's.
    """
    r = lines.select(F.col("version").alias("v"), "at", F.length(F.trim("line")).alias("size"), F.from_json("line", NODE).alias("r")).select("v", "at", "size", "r.*")
    is_ = lambda x: F.col("recordType").eqNullSafe(F.lit(x))
    v = Window.partitionBy("v")
    edged = r.select("*", F.min("at").over(v).alias("first"), F.max("at").over(v).alias("last"))
    node = is_("node") & (F.coalesce("cardType", F.lit("HEADING_NODE")).isin("HEADING_NODE", "HEADING_SUBPARTITION"))
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(is_("profile") | is_("node"), F.struct("n", "text")))), lambda x: x["text"]), "\n"), 256)
    per = edged.groupBy("v").agg(
        F.count_if(F.coalesce(F.col("size"), F.lit(0)) == 0).alias("blank"), F.count_if(is_("header") & (F.col("at") == F.col("first"))).alias("header"), F.count_if(is_("header")).alias("headers"), F.count_if(is_("footer") & (F.col("at") == F.col("last")) & F.col("complete")).alias("footer"), F.count_if(is_("footer")).alias("footers"),
        F.count_if(is_("profile")).alias("profiles"), F.count_if(is_("node")).alias("nodes"), F.count_if(is_("node") & ~node).alias("bad"), F.count_if(~F.coalesce(F.col("recordType").isin("header", "profile", "node", "footer"), F.lit(False))).alias("unknown"),
        F.max("schemaVersion").alias("schema"), F.max("profileCount").alias("p"), F.max("nodeCount").alias("c"), F.max("vectorCount").alias("w"), F.max("semanticSha256").alias("sha"), digest.alias("digest"),
    )
    error = (
        F.when(F.col("blank") > 0, "BLANK_LINE").when((F.col("header") != 1) | (F.col("headers") != 1), "NO_HEADER").when((F.col("footer") != 1) | (F.col("footers") != 1), "NO_FOOTER").when((F.col("unknown") > 0) | (F.col("bad") > 0), "UNKNOWN_RECORD")
        .when(~F.coalesce(F.col("schema").between(1, known_version), F.lit(False)), "UNKNOWN_SCHEMA").when((F.col("profiles") != 1) | (F.col("p") != 1) | (F.col("c") != F.col("nodes")) | (F.col("w") != F.col("nodes") + 1), "COUNT_MISMATCH").when(F.col("sha") != F.col("digest"), "DIGEST_MISMATCH")
    )
    return per.select(F.col("v").alias("version"), error.alias("error"), "nodes")
