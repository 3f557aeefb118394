"""Markdown to parsed blocks: headings, paragraphs, list items, quotes, code, raw HTML.

A container (a quote, a list item) is read by taking its lines without their marks and
reading these again, so containers nest.  Text in a list item is a LIST_ITEM, also
within a quote; other text in a quote is a QUOTE.  Inline marks go, their text stays.
"""

from __future__ import annotations

import html
import re

BLOCK = "kind string, level int, text string, start_line long, end_line long, warning string"
_FENCE = re.compile(r"^( {0,3})(`{3,}(?=[^`]*$)|~{3,})")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r"^ {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_ITEM = re.compile(r"^( {0,3})([-+*]|(\d{1,9})[.)])([ \t]+|$)(.*)$")
_QUOTE = re.compile(r"^ {0,3}> ?(.*)$")
_LABEL = re.compile(r"^ {0,3}\[([^\]]+)\]:[ \t]*\S+(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?[ \t]*$")
#: Where a block of HTML begins and after which line it ends; None: before a blank line.
_HTML = (
    (re.compile(r"(?i)^ {0,3}<(?:script|pre|style|textarea)(?:[\s>]|$)"), re.compile(r"(?i)</(?:script|pre|style|textarea)>")),
    (re.compile(r"^ {0,3}<!--"), re.compile("-->")),
    (re.compile(r"^ {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r"^ {0,3}<![A-Za-z]"), re.compile(">")),
    (re.compile(r"(?i)^ {0,3}</?(?:address|article|aside|blockquote|body|center|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|nav|ol|option|p|section|summary|table|tbody|td|tfoot|th|thead|title|tr|ul)(?:\s|/?>|$)"), None),
)
#: A tag alone on its line begins a block too, but does not end a paragraph.
_LONE_TAG = re.compile(r"^ {0,3}</?[A-Za-z][\w-]*(?:\s[^<>]*)?/?>[ \t]*$")


def parse(text: str | None) -> list[dict]:
    """Blocks in order, with 1-based lines. A soft break becomes a space, a hard one (two spaces or a backslash) stays."""
    lines = (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    labels = {_folded(m[1]) for line in lines if (m := _LABEL.match(line))}
    out: list[dict] = []
    _read(list(enumerate(lines, 1)), "PARAGRAPH", labels, out)
    return [b for b in out if b["text"].strip()]


def _folded(label: str) -> str:
    return " ".join(label.split()).casefold()


def _indent(line: str) -> int:
    wide = line.expandtabs(4)
    return len(wide) - len(wide.lstrip(" "))


def _begins(line: str, in_paragraph: bool) -> bool:
    """Whether a line begins a block other than a paragraph."""
    if _FENCE.match(line) or _ATX.match(line) or _RULE.match(line) or _QUOTE.match(line) or any(a.match(line) for a, _ in _HTML):
        return True
    if m := _ITEM.match(line):
        return not in_paragraph or (bool(m[5].strip()) and m[3] in (None, "1"))
    return False


def _read(lines: list[tuple[int, str]], kind: str, labels: set[str], out: list[dict]) -> None:
    """Append the blocks of a container's lines (number, text)."""
    para: list[tuple[int, str]] = []

    def add(block_kind, body, first, last, level=None, warning=None):
        out.append({"kind": block_kind, "level": level, "text": body, "start_line": first, "end_line": last, "warning": warning})

    def flush():
        if para:
            add(kind, inline(_joined([x for _, x in para]), labels), para[0][0], para[-1][0])
            para.clear()

    i = 0
    while i < len(lines):
        n, line = lines[i]
        if not line.strip():
            flush()
        elif para and (m := _SETEXT.match(line)):
            add("HEADING", inline(_joined([x for _, x in para]), labels), para[0][0], n, 1 if m[1][0] == "=" else 2)
            para.clear()
        elif not para and _indent(line) >= 4:
            j = i
            while j < len(lines) and (not lines[j][1].strip() or _indent(lines[j][1]) >= 4):
                j += 1
            while not lines[j - 1][1].strip():
                j -= 1
            add("CODE_BLOCK", "\n".join(x.expandtabs(4)[4:] for _, x in lines[i:j]), n, lines[j - 1][0])
            i = j - 1
        elif m := _FENCE.match(line):
            flush()
            close = re.compile(rf"^ {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$")
            j = i + 1
            while j < len(lines) and not close.match(lines[j][1]):
                j += 1
            strip = re.compile(rf"^ {{0,{len(m[1])}}}")
            add("CODE_BLOCK", "\n".join(strip.sub("", x) for _, x in lines[i + 1 : j]), n, lines[min(j, len(lines) - 1)][0])
            i = j
        elif m := _ATX.match(line):
            flush()
            add("HEADING", inline((m[2] or "").strip(), labels), n, n, len(m[1]))
        elif _RULE.match(line):
            flush()
        elif _QUOTE.match(line):
            flush()
            j, own = i, []
            while j < len(lines):
                if m := _QUOTE.match(lines[j][1]):
                    own.append((lines[j][0], m[1]))
                elif lines[j][1].strip() and own[-1][1].strip() and not _begins(lines[j][1], True) and not _begins(own[-1][1], False):
                    own.append(lines[j])
                else:
                    break
                j += 1
            _read(own, "LIST_ITEM" if kind == "LIST_ITEM" else "QUOTE", labels, out)
            i = j - 1
        elif (m := _ITEM.match(line)) and (not para or _begins(line, True)):
            flush()
            gap = len(m[4].expandtabs(4))
            offset = len(m[1]) + len(m[2]) + (gap if 1 <= gap <= 4 and m[5] else 1)
            first = m[5] if gap <= 4 else " " * (gap - 1) + m[5]
            j, own = i + 1, [(n, first)]
            while j < len(lines):
                later = lines[j][1]
                if not later.strip():
                    own.append((lines[j][0], ""))
                elif _indent(later) >= offset:
                    own.append((lines[j][0], later.expandtabs(4)[offset:]))
                elif own[-1][1].strip() and not _begins(later, True) and not _SETEXT.match(later):
                    own.append(lines[j])
                else:
                    break
                j += 1
            _read(own, "LIST_ITEM", labels, out)
            i = j - 1
        elif (found := next((end for begin, end in _HTML if begin.match(line)), "none")) != "none" or (not para and _LONE_TAG.match(line)):
            flush()
            end = None if found == "none" else found
            j = i
            while j < len(lines) and not (end is None and not lines[j][1].strip()):
                j += 1
                if end is not None and end.search(lines[j - 1][1]):
                    break
            add("RAW_TEXT", "\n".join(x for _, x in lines[i:j]), n, lines[j - 1][0], warning="STRUCTURE_FLATTENED")
            i = j - 1
        elif not para and _LABEL.match(line):
            pass
        else:
            para.append((n, line))
        i += 1
    flush()


def _joined(lines: list[str]) -> str:
    out = ""
    for k, line in enumerate(lines):
        last = k + 1 == len(lines)
        hard = not last and (line.endswith("  ") or line.endswith("\\"))
        out += (line[:-1] if hard and line.endswith("\\") else line).strip() + ("" if last else "\n" if hard else " ")
    return out


_SAFE = re.compile(r"(?P<ticks>`+)(?!`)(?P<code>.+?)(?<!`)(?P=ticks)(?!`)|\\(?P<escaped>[!-/:-@\[-`{-~])|<(?P<auto>[A-Za-z][\w+.-]{1,31}:[^\s<>]*|[\w.+-]+@[\w.-]+)>|(?P<tag></?[A-Za-z][^<>]*>|<!--.*?-->)|(?P<entity>&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|\w+);)", re.S)
_LINK = re.compile(r"!?\[([^\[\]]*)\]\(\s*(?:<[^<>]*>|[^()\s]*(?:\([^()\s]*\)[^()\s]*)*)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)")
_REFERENCE = re.compile(r"!?\[([^\[\]]+)\](?:\[([^\[\]]*)\])?")
_MARKS = [
    re.compile(r"\*\*(?=[^\s*])((?:(?!\*\*).)+?)(?<=[^\s])\*\*", re.S), re.compile(r"(?<!\w)__(?=\S)(.+?)(?<=\S)__(?!\w)", re.S),
    re.compile(r"\*(?=[^\s*])([^*]+?)(?<=[^\s])\*"), re.compile(r"(?<!\w)_(?=[^\s_])([^_]+?)(?<=[^\s])_(?!\w)"),
]


def inline(text: str, labels: set[str] = frozenset()) -> str:
    """The text without inline marks: emphasis, code ticks, links and images (their text stays), escapes, entities; raw tags stay."""
    kept: list[str] = []

    def protect(m):
        if m["code"] is not None:
            code = m["code"].replace("\n", " ")
            value = code[1:-1] if code.strip() and code[0] == code[-1] == " " and len(code) > 1 else code
        else:
            value = m["escaped"] or m["auto"] or m["tag"] or html.unescape(m["entity"])
        kept.append(value)
        return f"\x00{len(kept) - 1}\x01"

    out = _SAFE.sub(protect, text.replace("\x00", "").replace("\x01", ""))
    before = None
    while before != out:
        before, out = out, _LINK.sub(r"\1", out)
    out = _REFERENCE.sub(lambda m: m[1] if _folded(m[2] or m[1]) in labels else m[0], out)
    for mark in _MARKS:
        before = None
        while before != out:
            before, out = out, mark.sub(r"\1", out)
    return re.sub("\x00(\\d+)\x01", lambda m: kept[int(m[1])], out)
