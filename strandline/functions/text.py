"""Scalar text functions as column expressions (and the few that need Arrow functions)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is stripped: ASCII separators and the Unicode space separators, but no no-break space.
STRIP = r"[\x09-\x0D\x1C-\x20\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]"
#: The same as a list of characters.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2008\u2009\u200a\u2028\u2029\u205f\u3000"


def strip(x: Column) -> Column:
    # a pattern would try every run of white space inside the text
    return F.trim(x, F.lit(_SPACES))


def strip_end(x: Column) -> Column:
    return F.regexp_replace(x, f"{STRIP}+$", "")


def clean_source(x: Column) -> Column:
    """CR LF and CR become LF, one leading byte-order mark goes."""
    return F.regexp_replace(F.regexp_replace(x, "^\\x{FEFF}", ""), "\r\n?", "\n")


def source_error(raw: Column) -> Column:
    """Why bytes are no source text, or null: malformed UTF-8, or a NUL."""
    return F.when(~F.is_valid_utf8(raw), F.lit("MALFORMED_UTF8")).when(F.contains(raw, F.lit("\x00")), F.lit("NUL_CHARACTER"))


def normalize_block(x: Column, kind: Column) -> Column:
    """CR LF to LF, no byte-order marks; code loses only newlines at its ends, anything else all white space."""
    plain = F.replace(F.replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit("\ufeff"), F.lit(""))
    return F.when(kind == "CODE_BLOCK", F.regexp_replace(plain, "^\n+|\n+$", "")).otherwise(strip(plain))


def utf16_len(x: Column) -> Column:
    """Length in UTF-16 code units, the unit of all offsets: non-BMP code points count twice."""
    # the others go in runs, not one by one; texts without any, told by their bytes, are not searched
    wide = F.length(F.regexp_replace(x, "[^\\x{10000}-\\x{10FFFF}]++", ""))
    return (F.length(x) + F.when(F.octet_length(x) == F.length(x), 0).otherwise(wide)).cast("long")


#: Code points outside the basic plane, and a noncharacter that stands for the second unit of one.
WIDE, SECOND = "[\\x{10000}-\\x{10FFFF}]", "\uffff"


def prefix(x: Column, n) -> Column:
    """The longest prefix of at most ``n`` UTF-16 units that splits no surrogate pair.

    Texts with code points outside the basic plane must not hold U+FFFF.
    """
    n = F.lit(n) if isinstance(n, int) else n
    units = F.left(F.regexp_replace(x, f"({WIDE})", f"$1{SECOND}"), n)
    return F.when(F.rlike(F.left(x, n), F.lit(WIDE)), F.replace(F.regexp_replace(units, f"{WIDE}$", ""), F.lit(SECOND), F.lit(""))).otherwise(F.left(x, n))


def bounded(x: Column, n: int) -> Column:
    """Stripped, cut to ``n``, and stripped again at the end."""
    return strip_end(prefix(strip(x), n))


def bounded_list(xs: Column, items: int, chars: int) -> Column:
    """Items bounded one by one, empty ones dropped, distinct in order, the first ``items``."""
    return F.slice(F.array_distinct(F.filter(F.transform(xs, lambda x: bounded(x, chars)), lambda x: F.length(x) > 0)), 1, items)


def estimate_tokens(x: Column) -> Column:
    """A quarter of the ASCII characters (rounded up) and every other one; at least 1."""
    ascii_ = F.length(F.regexp_replace(x, "[^\\x00-\\x7F]", ""))
    return F.greatest(F.lit(1), F.floor((ascii_ + 3) / 4) + F.length(x) - ascii_).cast("long")


def title_path(titles: Column) -> Column:
    return F.array_join(titles, " > ")


def split_path(x: Column) -> Column:
    return F.split(x, r"\s*>\s*")


def normalize_header(x: Column) -> Column:
    """White space collapsed, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def sanitize_answer(x: Column) -> Column:
    """Without ``[E1, E2]`` groups (in any case), spaces before punctuation and at line ends; stripped."""
    x = F.regexp_replace(x, r"(?i)\[\s*E[1-9][0-9]*(?:\s*[,，]\s*E[1-9][0-9]*)*\s*\]", "")
    x = F.regexp_replace(x, r"[ \t]+([,.;:!?，。；：！？])", "$1")
    return strip(F.regexp_replace(x, r"(?m)[ \t]+$", ""))


def evidence_ids(xs: Column) -> Column:
    """Upper-case, well-formed evidence ids, distinct in order."""
    return F.array_distinct(F.filter(F.transform(xs, lambda x: F.upper(F.trim(x))), lambda x: F.rlike(x, F.lit("^E[1-9][0-9]*$"))))


def compact(x: Column) -> Column:
    """For comparison of Latin text: no white space, lower case (``nfkc_fold`` does full Unicode)."""
    return F.lower(F.regexp_replace(x, r"\s+", ""))


def numbers(x: Column) -> Column:
    """Decimal tokens that do not continue a word or number."""
    return F.regexp_extract_all(F.concat(F.lit(" "), x), F.lit(r"(?:^|[^\w.])(-?\d+(?:\.\d+)?)"), 1)


def title_key(x: Column) -> Column:
    """Narrow forms in lower case, numbers with their decimal parts as ``#``, letters and digits only."""
    return F.regexp_replace(F.regexp_replace(F.lower(narrow(x)), r"\d+(?:\.\d+)*", "#"), r"[^\p{L}\p{N}#]", "")


#: Compatibility forms that titles use, and what they stand for.
ROMAN_NUMERALS = dict(zip("ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ", "I II III IV V VI VII VIII IX X XI XII".split(), strict=True))


def narrow(x: Column) -> Column:
    """Full-width ASCII, the ideographic space and roman numeral characters in their plain forms.

    These are the compatibility forms of titles; ``nfkc_fold`` knows all, in Python.
    """
    full = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000\u00a0"
    plain = "".join(chr(c) for c in range(0x21, 0x7F)) + "  "
    out = F.translate(x, full, plain)
    for sign, letters in ROMAN_NUMERALS.items():
        out = F.replace(out, F.lit(sign), F.lit(letters))
    return out


#: Titles whose numbering makes them a heading of level 1, and the number whose depth is the level.
NUMBERED_TITLE = r"^(\d+(?:\.\d+){0,5})[.、)）:](?:\s*\S.*)?$"
TOP_TITLES = (
    r"(?i)^[IVXLCDM]+[.、)）:](?:\s*\S.*)?$",
    r"^[一二三四五六七八九十百]+[、.．]\s*\S+",
    r"(?i)^(chapter|part|section|unit|appendix)\s*(\d+|[ivxlcdm]+|[a-z])\s*[:：.、\-—]\s*\S+",
    r"(?i)^semester\s*\d+\s*[:：]\s*quarter\s*\d+",
)


def heading_level(x: Column) -> Column:
    """Level that a title's numbering tells, else null.

    A number counts only with a delimiter after it: ``1. Title`` has level 1, in
    ``1.2 Title`` the point delimits the 1, and ``1 Title`` has none.
    """
    title = strip(narrow(x))
    number = F.regexp_extract(title, NUMBERED_TITLE, 1)
    top = F.lit(False)
    for pattern in TOP_TITLES:
        top = top | F.rlike(title, F.lit(pattern))
    return F.when(F.length(number) > 0, F.least(F.lit(6), F.size(F.split(number, r"\.")))).when(top, F.lit(1)).cast("long")


def mostly_upper(x: Column) -> Column:
    """At least 90 % of the letters are upper case."""
    letters = F.length(F.regexp_replace(x, r"[^\p{L}]", ""))
    return (letters > 0) & (F.length(F.regexp_replace(x, r"[^\p{Lu}]", "")) * 10 >= letters * 9)


#: Titles that are chapters whatever else they look like.
SECTIONS = (
    "abstract introduction background overview method methods methodology result results discussion conclusion conclusions reference references appendix "
    "摘要 引言 背景 概述 方法 结果 讨论 结论 参考文献 附录"
).split()


def chapter_title(x: Column, upper: bool = True) -> Column:
    """Whether a title of at most 100 characters is a known section's or, with ``upper``, has 4 ASCII letters or more, 90 % of them capitals."""
    title = strip(narrow(x))
    bare = F.lower(F.regexp_replace(title, r"[\s:：.。!！?？\-_—]+", ""))
    ascii_ = F.length(F.regexp_replace(title, "[^A-Za-z]", ""))
    capitals = F.length(F.regexp_replace(title, "[^A-Z]", ""))
    loud = (ascii_ >= 4) & (capitals * 10 >= ascii_ * 9) if upper else F.lit(False)
    return F.length(title).between(1, 100) & (bare.isin(*SECTIONS) | loud)


def ordered_number(x: Column) -> Column:
    """A numbered title with its number in front: after it goes ``1.2.`` that stands at its end or touches it, if the rest reads like a heading."""
    title = strip(narrow(x))
    lead, trail = r"^(\d+(?:\.\d+){1,5}\.)(\S.{0,118})$", r"^(.{2,120}?)(\d+(?:\.\d+){1,5}\.)$"
    part = lambda pattern, n: F.regexp_extract(title, pattern, n)
    after, before = F.trim(part(lead, 2)), F.trim(part(trail, 1))
    return F.when(F.rlike(title, F.lit(lead)) & plausible_heading(after), F.concat_ws(" ", part(lead, 1), after)).when(F.rlike(title, F.lit(trail)) & plausible_heading(before), F.concat_ws(" ", part(trail, 2), before)).otherwise(x)


def split_numbered(x: Column) -> Column:
    """Struct (heading, body) of a text that begins with a numbered sentence which reads like a heading; the heading is null otherwise."""
    pattern = r"(?s)^(\d+(?:\.\d+){1,5}\.)\s*(.{1,120}?[.!?])\s+(.+)$"
    text = strip(x)
    ok = F.rlike(text, F.lit(pattern)) & plausible_heading(F.regexp_extract(text, pattern, 2))
    head = F.concat_ws(" ", F.regexp_extract(text, pattern, 1), strip(F.regexp_extract(text, pattern, 2)))
    return F.struct(F.when(ok, head).alias("heading"), F.when(ok, strip(F.regexp_extract(text, pattern, 3))).otherwise(x).alias("body"))


def like_escaped(x: Column, escape: str = "!") -> Column:
    """A text to be found as it is by LIKE with this escape sign."""
    out = x
    for sign in (escape, "%", "_"):
        out = F.replace(out, F.lit(sign), F.lit(escape + sign))
    return out


#: Words that need no capital in a heading.
SMALL_WORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with")


def plausible_heading(x: Column) -> Column:
    """1 to 12 words, and at least 75 % of the significant ones start with a capital or digit."""
    words = F.filter(F.split(F.trim(x), r"\s+"), lambda w: F.length(w) > 0)
    big = F.filter(words, lambda w: ~F.lower(w).isin(*SMALL_WORDS))
    capital = F.filter(big, lambda w: F.rlike(w, F.lit(r"^[\p{Lu}\p{N}]")))
    return F.size(words).between(1, 12) & (F.size(big) > 0) & (F.size(capital) * 4 >= F.size(big) * 3)


def split_number(x: Column) -> Column:
    """Struct (number, title) of a numbered title; the number is empty if there is none."""
    pattern = r"^\s*((?:\d+(?:\.\d+)*\.?)?)\s*(.*?)\s*$"
    return F.struct(F.regexp_extract(x, pattern, 1).alias("number"), F.regexp_extract(x, pattern, 2).alias("title"))


def extension_format(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.endswith(".pdf"), "PDF").when(low.endswith(".docx"), "DOCX").when(low.endswith(".md") | low.endswith(".markdown"), "MARKDOWN").when(low.endswith(".txt"), "TXT")


def location_label(path: Column, page: Column, line: Column) -> Column:
    """Where a citation points: the heading path, then the page or else the line; the body if there is nothing."""
    place = F.when(page > 0, F.concat(F.lit("第 "), page.cast("string"), F.lit(" 页"))).when(line > 0, F.concat(F.lit("第 "), line.cast("string"), F.lit(" 行")))
    label = F.concat_ws(" / ", path, place)
    return F.when(F.length(label) > 0, label).otherwise("文档正文")


def embedding_text(document: Column, section: Column, summary: Column, topics: Column, aliases: Column, questions: Column) -> Column:
    """The text of a card that is embedded; empty parts have no line."""
    part = lambda label, v: F.when(F.length(v) > 0, F.concat(F.lit(label + ": "), v))
    joined = lambda v: F.array_join(v, " | ")
    return F.concat_ws("\n", part("Document", document), part("Section", section), part("Summary", summary), part("Topics", joined(topics)), part("Aliases", joined(aliases)), part("Questions", joined(questions)))


def highlight_segments(x: Column, mark: str = "\ue000", unmark: str = "\ue001", strict: bool = True) -> Column:
    """Marked text → array of (text, matched), without empty ones.

    Outside a match only ``mark`` counts, inside one only ``unmark``.  A match without
    an end is an error, or null unless ``strict``.
    """
    tokens = F.regexp_extract_all(x, F.lit(f"[^{mark}]+|{mark}[^{unmark}]*{unmark}"), 0)
    closed = F.length(F.array_join(tokens, "")) == F.length(x)
    inside = lambda t: F.startswith(t, F.lit(mark))
    parts = F.transform(tokens, lambda t: F.struct(F.when(inside(t), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t).alias("text"), inside(t).alias("matched")))
    found = F.when(closed, F.filter(parts, lambda p: F.length(p["text"]) > 0))
    return found.when(closed.isNotNull(), F.raise_error(F.lit("a match has no end")).cast("array<struct<text:string,matched:boolean>>")) if strict else found


def highlight_fragments(xs: Column, **marks) -> Column:
    """Marked fragments → their segments, each fragment once and in order; fragments without text are left out."""
    return F.filter(F.transform(F.array_distinct(xs), lambda x: highlight_segments(x, **marks)), lambda f: F.size(f) > 0)


def match_answer(answer: Column, gold: Column) -> Column:
    """Numeric membership, or either contains the other, after compacting."""
    a, g = compact(answer), compact(gold)
    number = F.element_at(numbers(gold), 1)
    numeric = F.rlike(F.trim(gold), F.lit(r"^-?\d+(\.\d+)?$"))
    return F.when(numeric, F.array_contains(F.transform(numbers(answer), lambda n: n.cast("decimal(38,18)")), number.cast("decimal(38,18)"))).otherwise((F.length(g) > 0) & (F.length(a) > 0) & (F.contains(a, g) | F.contains(g, a)))


def tokens(x: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}]+"), 0)


#: Words that the bigram analyzer leaves out.
STOP_WORDS = "a and are as at be but by for if in into is it no not of on or s such t that the their then there these they this to was will with www".split()

_CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
#: Words of other scripts; between letters ``.``, ``'`` and ``’`` join, between digits ``.`` and ``,`` do.
#: Runs of ASCII, which most are, come first: they need no look at scripts.
_PLAIN = r"(?:[a-z0-9_]++|(?:[^\P{L}" + _CJK + r"]|[\p{M}_])+|\p{N}+|(?<=[\p{L}])[.'’](?=[^\P{L}" + _CJK + r"])|(?<=\p{N})[.,](?=\p{N}))+"


def standard_tokens(x: Column) -> Column:
    """Lower-case words; Han and Hiragana letters are words of their own."""
    joined = _PLAIN + r"|[\p{IsHan}\p{IsHiragana}]|\p{IsKatakana}+|\p{IsHangul}+"
    return F.regexp_extract_all(F.lower(x), F.lit(joined), 0)


def bigram_tokens(x: Column) -> Column:
    """Words without stop words; of each run of Han, kana or Hangul its overlapping pairs, or its one letter."""
    runs = F.regexp_extract_all(F.lower(narrow(x)), F.lit(f"{_PLAIN}|[{_CJK}]+"), 0)
    # none of these scripts starts below U+1100
    wide = lambda t: (F.ascii(t) >= 0x1100) & F.rlike(t, F.lit(f"^[{_CJK}]"))
    pairs = lambda t: F.when(F.length(t) == 1, F.array(t)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2))))
    return F.filter(F.flatten(F.transform(runs, lambda t: F.when(wide(t), pairs(t)).otherwise(F.array(t)))), lambda t: ~t.isin(*STOP_WORDS))


def _sliced(f, kind: pa.DataType, returns: str, rows: int = 64):
    """Arrow function of one column that holds only a few rows of a batch as Python objects."""
    @F.arrow_udf(returns)
    def run(xs: pa.Array) -> pa.Array:
        done = [pa.array([f(x.as_py()) for x in xs.slice(k, rows)], kind) for k in range(0, len(xs), rows)]
        return pa.concat_arrays(done) if done else pa.array([], kind)

    return run


def safe_split(limit: int):
    """Text → pieces of at most ``limit`` UTF-16 units, at a sentence end in the last quarter if there is one: ``split_text`` as an expression.

    Only texts with code points outside the basic plane, whose units must be counted, go through Python.
    """
    least = max(1, limit - max(1, limit // 4))
    ended = rf"|.{{{least},{limit - 1}}}[\n。！？.!?]" if least < limit else ""
    pattern = rf"(?s)(.{{1,{limit}}}\z{ended}|.{{{limit}}}){STRIP}*+"
    counted = _sliced(lambda x: None if x is None else split_text(x, limit), pa.list_(pa.string()), "array<string>")

    def run(x) -> Column:
        x = F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))
        wide = (F.octet_length(x) != F.length(x)) & F.rlike(x, F.lit(WIDE))
        pieces = F.filter(F.transform(F.regexp_extract_all(x, F.lit(pattern), 1), strip), lambda p: F.length(p) > 0)
        return F.when(wide, counted(F.when(wide, x))).otherwise(pieces)

    return run


def split_text(text: str | None, limit: int) -> list[str]:
    """Pieces no longer than ``limit`` code units; a piece ends after the last of ``\\n 。！？.!?`` in its final quarter, else at the limit."""
    text = text or ""
    unit = lambda c: 2 if ord(c) > 0xFFFF else 1
    out, at = [], 0
    while at < len(text):
        end, size = at, 0
        while end < len(text) and size + unit(text[end]) <= limit:
            size += unit(text[end])
            end += 1
        if end < len(text):
            back = max(at + 1, end - max(1, limit // 4))
            for k in range(end - 1, back - 1, -1):
                if text[k] in "\n。！？.!?":
                    end = k + 1
                    break
        piece = text[at:end].strip(_SPACES)
        if piece:
            out.append(piece)
        at = max(end, at + 1)
        while at < len(text) and text[at] in _SPACES:
            at += 1
    return out


def split_tokens(text: str | None, limit: int) -> list[str]:
    """Greedy prefixes of at most ``limit`` estimated tokens each."""
    out, start, plain, wide = [], 0, 0, 0
    for i, c in enumerate(text or ""):
        p, w = (plain + 1, wide) if ord(c) < 128 else (plain, wide + 1)
        if i > start and (p + 3) // 4 + w > limit:
            out.append(text[start:i])
            start, p, w = i, int(ord(c) < 128), int(ord(c) >= 128)
        plain, wide = p, w
    return out + ([text[start:]] if text and start < len(text) else [])


def nfkc_fold():
    """HTML entities decoded, NFKC, no white space, case folded: ``fold_text`` as an expression; ASCII without entities stays out of Python."""
    folded = _sliced(fold_text, pa.string(), "string")

    def run(x) -> Column:
        # a name would be a literal as a value of when()
        x = F.col(x) if isinstance(x, str) else x
        plain = (F.octet_length(x) == F.length(x)) & ~F.contains(x, F.lit("&"))
        bare = x
        for c in _SPACES:
            bare = F.replace(bare, F.lit(c), F.lit("")) if c.isascii() else bare
        return F.when(plain, F.lower(bare)).otherwise(folded(F.when(~plain, x)))

    return run


def fold_text(x: str | None) -> str | None:
    import html
    import unicodedata

    return None if x is None else "".join(unicodedata.normalize("NFKC", html.unescape(x)).split()).casefold()


def same_letters():
    """Arrow function: whether two texts hold each character equally often; null if one is null."""
    @F.arrow_udf("boolean")
    def run(xs: pa.Array, ys: pa.Array) -> pa.Array:
        return pa.array([letters_equal(x.as_py(), y.as_py()) for x, y in zip(xs, ys, strict=True)], pa.bool_())

    return run


def letters_equal(x: str | None, y: str | None) -> bool | None:
    import numpy as np

    if x is None or y is None:
        return None
    if len(x) != len(y):
        return False
    count = lambda t: np.bincount(np.frombuffer(t.encode("utf-32-le"), np.uint32))
    return np.array_equal(count(x), count(y))
