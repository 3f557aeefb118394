"""DOCX to parsed blocks, with limits against packages that unpack to far more than they hold."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MOST_ENTRIES, MOST_BYTES, MOST_RATIO = 2000, 200 << 20, 200
BLOCK = "kind string, level int, text string, body_index int, row int, col int"


class DocumentError(ValueError):
    """No usable package."""


def _open(raw: bytes) -> zipfile.ZipFile:
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile as e:
        raise DocumentError("no package") from e
    infos = z.infolist()
    if len(infos) > MOST_ENTRIES or sum(i.file_size for i in infos) > MOST_BYTES or any(i.file_size > MOST_RATIO * max(1, i.compress_size) and i.file_size > 1 << 20 for i in infos):
        raise DocumentError("package too large")
    names = {i.filename for i in infos}
    if any(n.startswith("/") or ".." in n.split("/") for n in names) or not {"[Content_Types].xml", "word/document.xml"} <= names:
        raise DocumentError("package incomplete or unsafe")
    return z


def _styles(z: zipfile.ZipFile) -> dict:
    """Style id → (name, outline level, parent style)."""
    if "word/styles.xml" not in z.namelist():
        return {}
    out = {}
    for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{W}style"):
        get = lambda tag, s=s: (x.get(f"{W}val") if (x := s.find(tag)) is not None else None)
        out[s.get(f"{W}styleId")] = (get(f"{W}name"), get(f"{W}pPr/{W}outlineLvl"), get(f"{W}basedOn"))
    return out


def _level(props, styles: dict):
    """Heading level by outline level, then along the chain of styles (8 at most), then by style name."""
    def val(tag):
        x = props.find(f"{W}{tag}") if props is not None else None
        return x.get(f"{W}val") if x is not None else None

    if (own := val("outlineLvl")) is not None and int(own) < 9:
        return min(6, int(own) + 1)
    style = val("pStyle")
    for _ in range(8):
        if style is None:
            return None
        name, outline, parent = styles.get(style, (style, None, None))
        if outline is not None and int(outline) < 9:
            return min(6, int(outline) + 1)
        if m := re.fullmatch(r"(?i)heading\s*([1-9])", name or style):
            return min(6, int(m[1]))
        style = parent
    return None


def _text(p) -> str:
    return "".join({"t": x.text or "", "tab": "\t", "br": "\n"}.get(x.tag.removeprefix(W), "") for x in p.iter())


def parse(raw: bytes) -> list[dict]:
    """Blocks in body order; cells of tables paragraph by paragraph."""
    z = _open(raw)
    styles = _styles(z)
    try:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    except ElementTree.ParseError as e:
        raise DocumentError("document unreadable") from e
    out = []

    def add(kind, text, index, level=None, row=None, col=None):
        if text.strip():
            out.append({"kind": kind, "level": level, "text": text.strip(), "body_index": index, "row": row, "col": col})

    for index, e in enumerate(body if body is not None else []):
        if e.tag == f"{W}p":
            props = e.find(f"{W}pPr")
            style = props.find(f"{W}pStyle").get(f"{W}val") if props is not None and props.find(f"{W}pStyle") is not None else ""
            level = _level(props, styles)
            if re.fullmatch(r"(?i)title", styles.get(style, (style,))[0] or style or "-"):
                add("TITLE", _text(e), index)
            elif level:
                add("HEADING", _text(e), index, level)
            else:
                add("LIST_ITEM" if props is not None and props.find(f"{W}numPr") is not None else "PARAGRAPH", _text(e), index)
        elif e.tag == f"{W}tbl":
            for r, row in enumerate(e.findall(f"{W}tr")):
                for c, cell in enumerate(row.findall(f"{W}tc")):
                    for p in cell.iter(f"{W}p"):
                        add("TABLE_CELL", _text(p), index, None, r, c)
    return out
