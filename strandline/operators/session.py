"""Answer sessions: evidence ids, windows, budgets, the final answer's contract, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.adapters import stored, stream_fold


def evidence_numbers(registrations: DataFrame) -> DataFrame:
    """``session, key, at`` → E1, E2, ... by first registration of each key."""
    first = registrations.groupBy("session", "key").agg(F.min("at").alias("at"))
    return first.select("session", "key", F.concat(F.lit("E"), F.row_number().over(Window.partitionBy("session").orderBy("at", "key")).cast("string")).alias("evidence_id"))


def adjacent_windows(blocks: DataFrame, size: int = 7) -> DataFrame:
    """Windows of ``size`` blocks with the ones before and after."""
    windows = blocks.groupBy("doc_id", F.floor(F.col("ordinal") / size).alias("w")).agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))
    order = Window.partitionBy("doc_id").orderBy("w")
    return windows.select("doc_id", "w", "first", "last", F.lag("w").over(order).alias("previous"), F.lead("w").over(order).alias("next"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """Pages of a document by the first block on them."""
    first = blocks.groupBy("doc", "page").agg(F.min("ordinal").alias("first"))
    return first.select("doc", "page", F.row_number().over(Window.partitionBy("doc").orderBy("first")).alias("position"))


def accept_budget(items: DataFrame, budget: int) -> DataFrame:
    """``session, n, cost`` in order: an item that does not fit is skipped and later ones may still fit."""

    def step(used, r):
        fits = used + int(r["cost"]) <= budget
        return used + (int(r["cost"]) if fits else 0), (int(r["n"]), fits)

    return stream_fold(items.select("session", F.col("n").cast("long").alias("n"), F.col("cost").cast("long").alias("cost")), ["session"], ["n", "cost"], lambda: 0, step, "n long, accepted boolean")


def fair_share(lengths: Column, budget: int) -> Column:
    """Characters that each item in order may use: at most an equal share of what is left, at least one."""
    n = F.size(lengths)

    def step(a, x):
        allowed = F.greatest(F.lit(1), F.floor((budget - a["used"]) / (n - F.size(a["out"])))).cast("long")
        got = F.least(x.cast("long"), allowed)
        return F.struct((a["used"] + got).alias("used"), F.concat(a["out"], F.array(got)).alias("out"))

    return F.aggregate(lengths, F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("out")), step)["out"]


def accepted_citations(submitted: Column, allowed: Column, registered: Column) -> Column:
    """Submitted ids that are allowed and registered, in order, once each."""
    return F.array_intersect(F.array_intersect(submitted, allowed), registered)


def final_answer_error(answer: Column) -> Column:
    """Why a final answer (JSON) breaks its contract, or null: exactly status, answer and evidenceIds, with fitting types."""
    keys = F.array_sort(F.json_object_keys(answer))
    status, ids = F.get_json_object(answer, "$.status"), F.from_json(F.get_json_object(answer, "$.evidenceIds"), "array<string>")
    text = F.get_json_object(answer, "$.answer")
    return (
        F.when(keys.isNull(), "NOT_AN_OBJECT").when(keys != F.array(F.lit("answer"), F.lit("evidenceIds"), F.lit("status")), "WRONG_KEYS")
        .when(~status.isin("ANSWERED", "INSUFFICIENT_EVIDENCE"), "BAD_STATUS").when(ids.isNull(), "BAD_EVIDENCE")
        .when((status == "ANSWERED") & (F.length(F.trim(F.coalesce(text, F.lit("")))) == 0), "EMPTY_ANSWER").when((status == "ANSWERED") & (F.size(ids) == 0), "NO_CITATION")
        .when((status != "ANSWERED") & (F.size(ids) > 0), "CITED_REFUSAL")
    )


def outline(tree: DataFrame, budget: int = 200) -> DataFrame:
    """The first ``budget`` headings of each document in reading order, and whether some are left out."""
    order = Window.partitionBy("doc_id").orderBy("pos", "depth")
    return tree.select("doc_id", "pos", "depth", "title", F.row_number().over(order).alias("n"), (F.count(F.lit(1)).over(Window.partitionBy("doc_id")) > budget).alias("truncated")).where(F.col("n") <= budget)


def section_read(blocks: DataFrame, tree: DataFrame, budget: int) -> DataFrame:
    """For each section: blocks and characters to read (its own if it has children, else all), children, and whether it must be narrowed."""
    children = tree.where("parent >= 0").groupBy("doc_id", F.col("parent").alias("pos")).agg(F.count(F.lit(1)).alias("children"))
    sections = tree.select("doc_id", "pos", "section_end").join(children, ["doc_id", "pos"], "left")
    own = blocks.groupBy("doc_id", F.col("heading").alias("pos")).agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.col("end") - F.col("start")).alias("chars"))
    read = sections.join(own, ["doc_id", "pos"], "left")
    return read.select("doc_id", "pos", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("chars", F.lit(0)).alias("chars"), (F.coalesce("chars", F.lit(0)) > budget).alias("narrow"))


def opened_sections(blocks: DataFrame, tree: DataFrame, opened: DataFrame) -> DataFrame:
    """``doc_id, pos, remaining`` (sections and the tokens that a session has left) → what opening them gives: ``doc_id, pos, kind, ref, title, has_children, tokens, narrow``.

    A SECTION row each; a CHILD row for every direct child, by which reading can go on below; and, unless the estimated
    tokens are more than what remains (``narrow``), a BLOCK row for each block that stands right under the heading (of a
    section without children that is all of it).  Blank blocks are left out.
    """
    from strandline.functions.text import estimate_tokens, strip

    body = blocks.where(F.length(strip(F.col("text"))) > 0).select("doc_id", F.col("heading").alias("pos"), "ordinal", estimate_tokens(F.col("text")).alias("t"))
    parents = tree.select("doc_id", F.col("parent").alias("pos")).where("pos >= 0").distinct().withColumn("has_children", F.lit(True))
    heads = tree.select("doc_id", "pos", "title", "parent").join(parents, ["doc_id", "pos"], "left").select("doc_id", "pos", "title", "parent", F.coalesce("has_children", F.lit(False)).alias("has_children"))
    asked = opened.join(heads.drop("parent"), ["doc_id", "pos"]).join(body.groupBy("doc_id", "pos").agg(F.sum("t").alias("tokens")), ["doc_id", "pos"], "left")
    asked = asked.withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("narrow", F.col("tokens") > F.col("remaining"))
    row = lambda df, kind, ref, title, more: df.select("doc_id", "pos", F.lit(kind).alias("kind"), ref.cast("long").alias("ref"), title.alias("title"), more.alias("has_children"), "tokens", "narrow")
    below = asked.select("doc_id", "pos", "tokens", "narrow").join(heads.select("doc_id", F.col("parent").alias("pos"), F.col("pos").alias("child"), "title", "has_children"), ["doc_id", "pos"])
    read = asked.where("NOT narrow").select("doc_id", "pos", "tokens", "narrow").join(body.select("doc_id", "pos", "ordinal"), ["doc_id", "pos"])
    return row(asked, "SECTION", F.col("pos"), F.col("title"), F.col("has_children")).unionByName(row(below, "CHILD", F.col("child"), F.col("title"), F.col("has_children"))).unionByName(row(read, "BLOCK", F.col("ordinal"), F.lit(""), F.lit(False)))


def safe_highlights(fragments: Column, text: Column, truncated: Column) -> Column:
    """Fragments that stand in the text word for word; none if the text was cut."""
    return F.when(truncated, F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(fragments, lambda f: F.contains(text, f))))


def merged_position(blocks: DataFrame) -> DataFrame:
    """Position of a group of blocks: first and last line, the page only if it is one."""
    return blocks.groupBy("group").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.when(F.countDistinct("page") == 1, F.min("page")).alias("page"))


def cursor_errors(requests: DataFrame, cursors: DataFrame) -> DataFrame:
    """``session, cursor, query, scope`` → why a search cannot go on with its cursor, or null.

    ``cursors``: ``session, cursor, query, scope`` as registered.  Queries are compared without
    regard to case and white space; the scope, which may be null, must be the same.
    """
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    known = cursors.select("session", "cursor", F.lit(True).alias("known"), F.col("query").alias("c_query"), F.col("scope").alias("c_scope"))
    rows = requests.join(known, ["session", "cursor"], "left")
    same = (plain(F.col("query")) == plain(F.col("c_query"))) & F.col("scope").eqNullSafe(F.col("c_scope"))
    error = F.when(F.col("known").isNull(), "UNKNOWN_CURSOR").when(~F.coalesce(same, F.lit(False)), "CURSOR_QUERY_OR_SCOPE_MISMATCH")
    return rows.select(*requests.columns, error.alias("error"))


def cursor_page(ranked: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page of a frozen ranking, with the offset of the next page or null."""
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    rows = ranked.withColumn("n", n).where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))
    return rows.select("query_id", "item", "rank", F.when(F.col("n") > offset + limit, F.lit(offset + limit)).alias("next_offset"))


#: Limits of one answer.
MOST_ROUNDS, MOST_TOOL_CALLS, MOST_MODEL_CALLS, SECONDS = 12, 200, 120, 300
FINAL_TOKENS, RADIUS = 32_000, 3


def loop_limits(calls: DataFrame, rounds: int = MOST_ROUNDS, tools: int = MOST_TOOL_CALLS, models: int = MOST_MODEL_CALLS, seconds: int = SECONDS) -> DataFrame:
    """``session, seq, round, kind, at`` of the calls that a scripted agent wants to make → which run, and why a session stops.

    ``kind``: MODEL or TOOL; ``at``: seconds from the session's start.  A call over a
    limit and all after it do not run; the first limit in the order below is the reason.
    """
    before = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    n = lambda kind: F.count_if(F.col("kind") == kind).over(before)
    rows = calls.select("*", n("TOOL").alias("t"), n("MODEL").alias("m"))
    why = F.when(F.col("at") >= seconds, "EXECUTION_TIMEOUT").when((F.col("round") > rounds) | (F.col("t") > tools) | (F.col("m") > models), "EXECUTION_LIMIT_EXCEEDED")
    marked = rows.withColumn("why", why)
    stopped = F.first("why", ignorenulls=True).over(before)
    return marked.select("session", "seq", stopped.isNull().alias("runs"), stopped.alias("stop"))


def cached_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Every call with the result of the session's first call of its signature; only that one runs (``ran``)."""
    order = Window.partitionBy("session", "signature").orderBy("seq")
    first = calls.withColumn("n", F.row_number().over(order)).withColumn("source", F.first("seq").over(order))
    return first.join(results.select("session", F.col("seq").alias("source"), "result"), ["session", "source"], "left").select("session", "seq", "result", (F.col("n") == 1).alias("ran"))


def opened_evidence(blocks: DataFrame, anchors: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``session, evidence, doc_id, ordinal, view`` → the blocks that opening it shows: ``scope, shown``.

    ``blocks``: ``doc_id, ordinal, heading, page, table_id, row, header``.  ``view`` COLUMN: cells of the
    anchor's table under its header; TABLE: all of the table; else the anchor's page, and
    without pages its neighbours within ``radius`` under its heading.
    """
    own = anchors.join(blocks, ["doc_id", "ordinal"])
    scope = (
        F.when((F.col("view") == "COLUMN") & F.col("table_id").isNotNull() & F.col("header").isNotNull(), "EVIDENCE_COLUMN").when(F.col("view").isin("TABLE", "COLUMN") & F.col("table_id").isNotNull(), "EVIDENCE_TABLE")
        .when(F.col("page").isNotNull(), "EVIDENCE_PAGE").otherwise("EVIDENCE_NEIGHBORHOOD")
    )
    a = own.select("session", "evidence", "doc_id", scope.alias("scope"), F.col("ordinal").alias("at"), "heading", "page", "table_id", "header")
    take = lambda name, *keys: blocks.select("doc_id", "ordinal", *keys).join(a.where(F.col("scope") == name), ["doc_id", *keys]).select("session", "evidence", "scope", F.col("ordinal").alias("shown"))
    near = a.where("scope = 'EVIDENCE_NEIGHBORHOOD'").withColumn("ordinal", F.explode(F.sequence(F.col("at") - radius, F.col("at") + radius)))
    around = blocks.select("doc_id", "heading", "ordinal").join(near, ["doc_id", "heading", "ordinal"]).select("session", "evidence", "scope", F.col("ordinal").alias("shown"))
    return take("EVIDENCE_COLUMN", "table_id", "header").unionByName(take("EVIDENCE_TABLE", "table_id")).unionByName(take("EVIDENCE_PAGE", "page")).unionByName(around)


def final_packages(evidence: DataFrame, blocks: DataFrame, budget: int = FINAL_TOKENS, radius: int = RADIUS) -> DataFrame:
    """``session, n, evidence, doc_id, ordinal`` → ``session, package, scope, doc_id, anchors, blocks, tokens``: what goes to the last model call.

    Evidence in order: the page it stands on, or without pages the blocks within
    ``radius`` of it, is a package; evidence that an earlier package of its document
    holds joins that one.  Packages are taken in order while the budget lasts; one that does not fit shrinks to the
    neighbourhoods of its anchors, and if that does not fit either it is left out.
    Two folds over each session's rows as a stream: which package evidence belongs to, for which a session's packages are
    kept as numbers, and what the budget takes.  Blocks are joined and counted by package; none is in a session's row.
    Stored columns of small numbers pack so well that their files say little of their size: joins are told to merge.
    """
    own = evidence.join(blocks.select("doc_id", "ordinal", "heading", "page").hint("merge"), ["doc_id", "ordinal"]).withColumnRenamed("ordinal", "at")
    whole = blocks.where(F.col("page").isNotNull()).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("ordinal", "tokens"))).alias("whole"))
    wanted = own.select("*", F.explode(F.sequence(F.col("at") - radius, F.col("at") + radius)).alias("ordinal"))
    near = blocks.select("doc_id", "heading", "ordinal", "tokens").hint("merge").join(wanted, ["doc_id", "heading", "ordinal"]).groupBy("session", "n", "evidence", "doc_id", "page", "at").agg(F.array_sort(F.collect_list(F.struct("ordinal", "tokens"))).alias("near"))
    near = stored(near, "packages-near")
    ends = blocks.where(F.col("page").isNotNull()).groupBy("doc_id", "page").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))
    spans = near.select("session", "n", "doc_id", "page", "at", F.array_min("near.ordinal").alias("low"), F.array_max("near.ordinal").alias("high")).join(ends.hint("merge"), ["doc_id", "page"], "left")
    spans = spans.select("session", "n", "doc_id", "page", "at", F.coalesce("first", "low").alias("low"), F.coalesce("last", "high").alias("high"))
    kind = evidence.schema["n"].dataType.simpleString()
    numbers = stream_fold(spans, ["session"], ["n"], lambda: (0, {}, {}, {}), _numbered, f"n {kind}, package int")

    opener = F.min_by(F.struct("doc_id", "page", "near"), "n").alias("opener")
    anchors = F.transform(F.array_sort(F.collect_list(F.struct("n", "evidence"))), lambda x: x["evidence"]).alias("anchors")
    around = F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("around")
    made = near.hint("merge").join(numbers, ["session", "n"]).groupBy("session", "package").agg(opener, anchors, around).select("session", "package", "opener.*", "anchors", "around")
    made = made.join(whole.hint("merge"), ["doc_id", "page"], "left").withColumn("all", F.coalesce("whole", "near"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + x["tokens"])
    made = stored(made.select("session", "package", "doc_id", "page", "anchors", "all", "around", total("all").alias("tokens"), total("around").alias("fewer"), (F.col("all") != F.col("around")).alias("shrinks")), "packages-made")
    taken = stream_fold(made.select("session", "package", "tokens", "fewer", "shrinks"), ["session"], ["package"], lambda: (0, 0), _taken(budget), "package int, place int, shrunk boolean")
    shown = made.hint("merge").join(taken.where("place > 0"), ["session", "package"])
    least = F.col("shrunk")
    scope = F.when(least, "ANCHOR_NEIGHBORHOOD").when(F.col("page").isNull(), "CANONICAL_WINDOW").otherwise("PAGE")
    held = F.transform(F.when(least, F.col("around")).otherwise(F.col("all")), lambda x: x["ordinal"].cast("int"))
    return shown.select("session", F.col("place").alias("package"), scope.alias("scope"), "doc_id", "anchors", held.alias("blocks"), F.when(least, F.col("fewer")).otherwise(F.col("tokens")).alias("tokens"))


def _numbered(state, r):
    """The package of a piece of evidence: the first that holds it, else a new one.

    State: how many packages there are, those of pages, those that hold an ordinal by being around it, and by document the pages' ordinals.
    """
    count, pages, windows, spans = state
    doc, page, at = r["doc_id"], r["page"], r["at"]
    held = [windows.get((doc, at))]
    held += [pages.get((doc, page))] if page is not None else [next((n for low, high, n in spans.get(doc, ()) if low <= at <= high), None)]
    found = min((n for n in held if n is not None), default=None)
    if found is None:
        found = count = count + 1
        if page is not None:
            pages[doc, page] = found
            spans.setdefault(doc, []).append((r["low"], r["high"], found))
        else:
            for o in range(int(r["low"]), int(r["high"]) + 1):
                windows.setdefault((doc, o), found)
    return (count, pages, windows, spans), (r["n"], found)


def _taken(budget: int):
    """A package's place among those that the budget takes (0: none), and whether it shrinks to what is around its anchors."""

    def step(state, r):
        used, count = state
        shrunk = r["tokens"] > budget - used and r["shrinks"]
        tokens = r["fewer"] if shrunk else r["tokens"]
        if tokens > budget - used:
            return state, (r["package"], 0, False)
        return (used + tokens, count + 1), (r["package"], count + 1, shrunk)

    return step


def pack(rows: list[dict], budget: int):
    """Packages of one session, all its rows at hand: (number, scope, document, evidence, blocks, tokens); the plain version of ``final_packages``."""
    packages: list[dict] = []
    for r in rows:
        whole = r["whole"] if r["whole"] is not None and len(r["whole"]) else None
        blocks = {int(x["ordinal"]): int(x["tokens"]) for x in (whole if whole is not None else r["near"])}
        near = {int(x["ordinal"]): int(x["tokens"]) for x in r["near"]}
        page = r["page"] if whole is not None else None

        def holds(p, r=r, page=page):
            if p["doc"] != r["doc_id"]:
                return False
            if p["page"] is not None and page is not None:
                return p["page"] == page
            return min(p["blocks"]) <= r["ordinal"] <= max(p["blocks"])

        found = next((p for p in packages if holds(p)), None)
        if found is None:
            found = {"doc": r["doc_id"], "page": page, "blocks": blocks, "scope": "CANONICAL_WINDOW" if page is None else "PAGE", "anchors": [], "near": {}}
            packages.append(found)
        found["anchors"].append(r["evidence"])
        found["near"] |= near
    used = n = 0
    for p in packages:
        blocks, scope = p["blocks"], p["scope"]
        if sum(blocks.values()) > budget - used and p["near"] != blocks:
            blocks, scope = p["near"], "ANCHOR_NEIGHBORHOOD"
        tokens = sum(blocks.values())
        if tokens > budget - used:
            continue
        used += tokens
        n += 1
        yield n, scope, p["doc"], p["anchors"], sorted(blocks), tokens


def cited_answer(answer: Column, cited: Column) -> Column:
    """The answer with the list of its references after it; without any it stays as it is."""
    marks = F.array_join(F.transform(F.sequence(F.lit(1), F.size(cited)), lambda k: F.concat(F.lit("["), k.cast("string"), F.lit("]"))), "")
    return F.when(F.size(cited) > 0, F.concat(answer, F.lit("\n\n参考依据："), marks)).otherwise(answer)
