"""Chat formatting by schema fingerprints (native DataFrame operators only).

A layout is a declarative mapping: the nested field paths that a record must
have, and where turns are to be found in it.  A *fingerprint* is a hash of those of
the nested field paths that any mapping names; equal fingerprints select a mapping by
a lookup in a literal map, so no shuffle is needed to learn which layouts occur.  A
JSON record has one fingerprint for its fields and one for each of its messages, since
the messages of a record need not be alike; a table has one, of its schema, taken
while planning.  What no mapping knows is refused with a reason (records:
``refused_records``; tables: an error), never read in part.

The template writes every turn as ``<|turn|>role<|text|>text<|end|>``.  Control
strings inside texts and roles are broken up by a backslash that ``unescape``
takes out again, so formatting loses nothing and no text can forge a turn.

Defined results: a null text or role is empty, and so is one whose key a message
lacks; a text that is JSON but no string stays JSON; fields and keys that no mapping
names are ignored; an empty conversation table gives no rows; equal (conversation,
turn) numbers are ordered by role, then text, and repeated rows count as turns of
their own; turns with a null number come first; rows with a null conversation id
belong to no conversation and give one each, with a null id; further columns of a table
are ignored, also those of another row layout.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import let

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"

#: Control strings of common chat templates, each with where a backslash breaks it up.
CONTROL_STRINGS = [
    ("<|", "<\\|"),
    ("<s>", "<\\s>"),
    ("</s>", "<\\/s>"),
    ("[INST]", "[\\INST]"),
    ("[/INST]", "[\\/INST]"),
    ("<<SYS>>", "<\\<SYS>>"),
    ("<</SYS>>", "<\\</SYS>>"),
]

#: Role names of common layouts and the role they stand for.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}

TURNS_TYPE = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


@dataclass(frozen=True)
class Layout:
    """``paths``: what a record must have; ``optional``: what it may have besides.

    ``messages``: the path of a list, each message of which selects a mapping of its
    own (a ``system`` field beside it is the first turn); ``fields``: else pairs (role, paths), each of which gives one turn.
    """

    name: str
    paths: tuple[str, ...]
    messages: str | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()


#: Names of common layouts' fields.
LISTS = ("messages", "conversations", "conversation", "dialogue", "turns", "data.messages", "data.conversations")
LAYOUTS = (
    *(Layout(p, (p,), messages=p, optional=("system", "tools")) for p in LISTS),
    Layout("prompt", ("prompt", "response"), fields=(("system", ("system",)), ("user", ("prompt", "context")), ("assistant", ("response",))), optional=("context", "system")),
    Layout("completion", ("prompt", "completion"), fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system",)),
    Layout("instruction", ("instruction", "output"), fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("input", "system")),
    Layout("instruction response", ("instruction", "response"), fields=(("system", ("system",)), ("user", ("instruction", "input", "context")), ("assistant", ("response",))), optional=("context", "input", "system")),
    Layout("question", ("question", "answer"), fields=(("system", ("system",)), ("user", ("question", "context")), ("assistant", ("answer",))), optional=("context", "system")),
    Layout("system question", ("question", "response"), fields=(("system", ("system_prompt",)), ("user", ("question",)), ("assistant", ("response",))), optional=("system_prompt",)),
    Layout("query", ("query", "response"), fields=(("system", ("system",)), ("user", ("query",)), ("assistant", ("response",))), optional=("system",)),
    Layout("problem", ("problem", "solution"), fields=(("user", ("problem",)), ("assistant", ("solution",)))),
)

#: Fixed values: (key of the role, key of the text) of a message; one of the two may be missing and is empty then.
MESSAGES = (("role", "content"), ("from", "value"), ("role", "text"), ("speaker", "text"), ("author", "content"), ("role", "value"))

#: A table with one row for each turn: the columns (conversation, turn, role, text), and columns that are then not looked at.
ROW_LAYOUTS = (
    (("conv_id", "turn", "role", "text"), ("content", "conversation_id")),
    (("conversation_id", "turn", "role", "content"), ("conv_id", "text")),
)


def _combinations(paths, optional=()):
    """Every set of paths that selects a mapping: the required ones with any of the optional ones."""
    for bits in range(1 << len(optional)):
        yield [*paths, *(p for k, p in enumerate(optional) if bits >> k & 1)]


def _vocabulary(layouts) -> list[str]:
    return sorted({p for x in layouts for p in (*x.paths, *x.optional)})


def _digest(paths) -> str:
    import hashlib

    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def fingerprint(paths: Column) -> Column:
    """Hash of a set of field paths; ``_digest`` is the same while planning."""
    return F.sha2(F.array_join(F.array_sort(paths), "\n"), 256)


def _record_table(layouts) -> dict[str, str]:
    return {_digest(c): x.name for x in layouts for c in _combinations(x.paths, x.optional)}


def _message_table() -> dict[str, tuple]:
    """Fingerprint of a message's known keys → (key of the role, key of the text); the first mapping wins."""
    found: dict[str, tuple] = {}
    for role, text in MESSAGES:
        for keys in ((role, text), (role,), (text,)):
            found.setdefault(_digest(keys), (role if role in keys else None, text if text in keys else None))
    return found


def _literal_map(table: dict) -> Column:
    return F.create_map(*[F.lit(v) for pair in table.items() for v in pair])


def _among(known, found: Column) -> Column:
    return F.array_intersect(F.array(*[F.lit(p) for p in known]), F.coalesce(found, F.array().cast("array<string>")))


def _prefixed(start: str):
    return lambda k: F.concat(F.lit(start), k)


def record_paths(record: Column, layouts=LAYOUTS) -> Column:
    """Those nested field paths of a JSON record that some mapping names, in order."""
    known = _vocabulary(layouts)
    found = _among([p for p in known if "." not in p], F.json_object_keys(record))
    for top in sorted({p.split(".")[0] for p in known if "." in p}):
        inner = F.transform(F.json_object_keys(F.get_json_object(record, f"$.{top}")), _prefixed(top + "."))
        found = F.concat(found, _among([p for p in known if p.startswith(top + ".")], inner))
    return F.array_sort(found)


def message_keys(message: Column) -> Column:
    """Those keys of a JSON message that some mapping names, in order."""
    return F.array_sort(_among(sorted({k for pair in MESSAGES for k in pair}), F.json_object_keys(message)))


def layout_of(record: Column, layouts=LAYOUTS) -> Column:
    """Name of the mapping that the record's fingerprint selects, or null."""
    return F.try_element_at(_literal_map(_record_table(layouts)), fingerprint(record_paths(record, layouts)))


def _role(role: Column) -> Column:
    lowered = F.lower(F.coalesce(role, F.lit("")))
    return F.coalesce(F.try_element_at(_literal_map(ROLE_NAMES), lowered), F.coalesce(role, F.lit("")))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(_role(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _message(m: Column) -> Column:
    """A JSON message → struct (role, text) by the mapping that its fingerprint selects, or null."""
    table = _message_table()
    kind = F.try_element_at(_literal_map({k: f"{r or ''} {t or ''}" for k, (r, t) in table.items()}), fingerprint(message_keys(m)))
    value = lambda key: F.get_json_object(m, f"$.{key}") if key else F.lit(None).cast("string")

    def of(kind):
        out = F.lit(None).cast(TURNS_TYPE.elementType)
        for role, text in dict.fromkeys(table.values()):
            out = F.when(kind == f"{role or ''} {text or ''}", _turn(value(role), value(text))).otherwise(out)
        return out

    return let(kind, of)


def _of_fields(layout: Layout, value) -> Column:
    parts = []
    for role, paths in layout.fields:
        values = [value(p) for p in paths]
        text = F.array_join(F.filter(F.array(*values), lambda v: F.length(v) > 0), "\n\n")
        there = values[0].isNotNull() if role == "system" else F.lit(True)
        parts.append(F.when(there, F.struct(F.lit(role).alias("role"), text.alias("text"))))
    return F.filter(F.array(*parts), lambda v: v.isNotNull()).cast(TURNS_TYPE)


def judged_records(records: DataFrame, id_col: str, record_col: str, layouts=LAYOUTS) -> DataFrame:
    """JSON records → ``__conv, __layout, __turns, __reason``: the turns, or why there are none."""
    found = records.select(F.col(id_col).alias("__conv"), F.col(record_col).alias("__record"), record_paths(F.col(record_col), layouts).alias("__paths"))
    found = found.select("*", F.try_element_at(_literal_map(_record_table(layouts)), fingerprint(F.col("__paths"))).alias("__layout"))
    record, out = F.col("__record"), F.lit(None).cast(TURNS_TYPE)
    for x in layouts:
        if x.messages:
            turns = F.transform(F.from_json(F.get_json_object(record, f"$.{x.messages}"), "array<string>"), _message)
        else:
            turns = _of_fields(x, lambda p: F.get_json_object(record, f"$.{p}"))
        out = F.when(F.col("__layout") == x.name, turns.cast(TURNS_TYPE)).otherwise(out)
    turned = found.select("*", out.alias("__found"))
    bad = F.array_position(F.transform("__found", lambda m: m.isNull()), True)
    reason = (
        F.when(F.json_object_keys(record).isNull(), F.lit("no JSON object"))
        .when(F.col("__layout").isNull(), F.concat(F.lit("no layout has the fields: "), F.array_join("__paths", ", ")))
        .when(F.col("__found").isNull(), F.lit("no list of messages"))
        .when(bad > 0, F.concat(F.lit("no mapping for message "), bad.cast("string")))
    )
    lists = F.col("__layout").isin(*[x.name for x in layouts if x.messages])
    whole = F.concat(_system_turn(F.when(lists, F.get_json_object(record, "$.system"))), "__found")
    return turned.select("__conv", "__layout", F.when(reason.isNull(), whole).alias("__turns"), reason.alias("__reason"))


def _system_turn(text: Column) -> Column:
    """One turn, or none for a null."""
    return F.when(text.isNull(), F.array().cast(TURNS_TYPE)).otherwise(F.array(F.struct(F.lit("system").alias("role"), text.alias("text"))).cast(TURNS_TYPE))


def _exploded(turns: DataFrame) -> DataFrame:
    return turns.select("__conv", "__layout", F.posexplode("__turns").alias("__turn", "__m")).select("__conv", F.col("__turn").cast("long").alias("__turn"), F.col("__m.role").alias("__role"), F.col("__m.text").alias("__text"), "__layout")


def canonical_turns(records: DataFrame, id_col: str, record_col: str, layouts=LAYOUTS) -> DataFrame:
    """JSON records of any known layout → ``__conv, __turn, __role, __text, __layout``, a row for each turn."""
    return _exploded(judged_records(records, id_col, record_col, layouts))


def refused_records(records: DataFrame, id_col: str, record_col: str, layouts=LAYOUTS) -> DataFrame:
    """``__conv, __reason`` of the records without turns, so that no text is lost without a trace."""
    return judged_records(records, id_col, record_col, layouts).where(F.col("__reason").isNotNull()).select("__conv", "__reason")


def schema_paths(schema: T.StructType, known) -> list[str]:
    """Those nested field paths of a table's schema that are known; ``[]`` stands for an array's elements."""
    found = []

    def walk(kind, path):
        found.append(path)
        if isinstance(kind, T.ArrayType):
            walk(kind.elementType, path + "[]")
        elif isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f"{path}.{f.name}")

    for f in schema.fields:
        walk(f.dataType, f.name)
    return sorted({p for p in found if p in known})


def canonical_rows(turns: DataFrame) -> DataFrame:
    """A table with one row for each turn, whose schema's fingerprint selects the columns; roles stay as they are."""
    table: dict[str, tuple] = {}
    for columns, others in ROW_LAYOUTS:
        for c in _combinations(columns, others):
            # what both layouts fit goes to the one that is listed first
            table.setdefault(_digest(c), columns)
    paths = schema_paths(turns.schema, {p for columns, others in ROW_LAYOUTS for p in (*columns, *others)})
    if _digest(paths) not in table:
        raise ValueError(f"no row layout has the columns {paths} of {sorted(turns.columns)}")
    conv, turn, role, text = table[_digest(paths)]
    return turns.select(F.col(conv).alias("__conv"), F.col(turn).cast("long").alias("__turn"), F.coalesce(F.col(role), F.lit("")).alias("__role"), F.coalesce(F.col(text), F.lit("")).alias("__text"), F.lit("rows").alias("__layout"))


def canonical_nested(table: DataFrame, id_col: str, layouts=LAYOUTS) -> DataFrame:
    """A table with one row for each conversation and (nested) columns of a known layout → turns, as ``canonical_turns`` gives them.

    The fingerprint of the schema selects the mapping; one that no mapping knows is an error.
    """
    known = {p for x in layouts for p in (*x.paths, *x.optional)}
    paths = schema_paths(table.schema, known)
    name = _record_table(layouts).get(_digest(paths))
    if name is None:
        raise ValueError(f"no layout has the columns {paths} of {sorted(table.columns)}")
    layout = next(x for x in layouts if x.name == name)
    if layout.messages:
        keys = schema_paths(table.schema, {f"{layout.messages}[].{k}" for pair in MESSAGES for k in pair})
        mapping = _message_table().get(_digest([k.split("[].")[1] for k in keys]))
        if mapping is None:
            raise ValueError(f"no mapping for messages with {keys}")
        role, text = mapping
        part = lambda m, key: m[key].cast("string") if key else F.lit(None).cast("string")
        turns = F.transform(F.filter(F.col(layout.messages), lambda m: m.isNotNull()), lambda m: _turn(part(m, role), part(m, text)))
        if "system" in paths:
            turns = F.concat(_system_turn(F.col("system").cast("string")), turns.cast(TURNS_TYPE))
    else:
        there = set(paths)
        turns = _of_fields(layout, lambda p: F.col(p).cast("string") if p in there else F.lit(None).cast("string"))
    return _exploded(table.select(F.col(id_col).alias("__conv"), F.lit(layout.name).alias("__layout"), turns.cast(TURNS_TYPE).alias("__turns")))


def escape(text: Column) -> Column:
    """Reversible: doubles backslashes, then breaks up control strings by one."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, broken in CONTROL_STRINGS:
        out = F.replace(out, F.lit(plain), F.lit(broken))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Canonical turns → one row for each conversation: ``conv_id, n_turns, formatted, loss_spans``.

    ``loss_spans``: (start, length) in code points of ``formatted``, the escaped text
    of each turn of ``loss_role``.  One shuffle, by conversation: the running
    offsets and the final grouping share it.  A conversation becomes one row, as
    one training example; nothing larger is ever brought together.
    """
    role, text = escape(F.col("__role")), escape(F.col("__text"))
    # rows without a conversation are told apart by a number of their own
    alone = F.when(F.col("__conv").isNull(), F.monotonically_increasing_id())
    order = Window.partitionBy("__conv", "__alone").orderBy("__turn", "__role", "__text")
    pieces = turns.select(
        "__conv", alone.alias("__alone"), "__turn", "__role", "__text",
        F.concat(F.lit(TURN), role, F.lit(TEXT), text, F.lit(END)).alias("__piece"),
        (F.length(role) + len(TURN) + len(TEXT)).cast("long").alias("__lead"), F.length(text).cast("long").alias("__len"),
    )
    placed = pieces.select(
        "__conv", "__alone", "__piece", "__lead", "__len", (F.col("__role") == loss_role).alias("__loss"),
        F.row_number().over(order).alias("__at"),
        (F.sum(F.length("__piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("__piece")).alias("__start"),
    )
    grouped = placed.groupBy("__conv", "__alone").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("__at", "__piece"))).alias("__pieces"),
        F.array_sort(F.collect_list(F.when(F.col("__loss"), F.struct((F.col("__start") + F.col("__lead")).alias("start"), F.col("__len").alias("length"))))).alias("loss_spans"),
    )
    return grouped.select(F.col("__conv").alias("conv_id"), "n_turns", F.array_join(F.col("__pieces.__piece"), "").alias("formatted"), "loss_spans")


def read_back(formatted: Column) -> Column:
    """``formatted`` → array of (role, text), unescaped."""
    parts = F.split(formatted, "<\\|turn\\|>")
    return F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: F.struct(unescape(F.substring_index(p, TEXT, 1)).alias("role"), unescape(F.substring_index(F.substring_index(p, END, 1), TEXT, -1)).alias("text")),
    )
