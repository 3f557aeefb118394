"""Grid of HTML tables: cells with their place after row and column spans."""

from __future__ import annotations

from html.parser import HTMLParser

CELL = "table_no int, row int, col int, row_span int, col_span int, header boolean, text string"


class _Grid(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cells, self.open, self.count = [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append({"no": self.count, "row": -1, "taken": set(), "cell": None})
            self.count += 1
        elif not self.open:
            return
        elif tag == "tr":
            self._end_cell()
            self.open[-1]["row"] += 1
        elif tag in ("td", "th"):
            self._end_cell()
            t, a = self.open[-1], dict(attrs)
            t["row"] = max(t["row"], 0)
            span = lambda k: max(1, min(1000, int(a.get(k) or 1))) if (a.get(k) or "1").isdigit() else 1
            rows, cols, col = span("rowspan"), span("colspan"), 0
            while (t["row"], col) in t["taken"]:
                col += 1
            t["taken"] |= {(t["row"] + i, col + j) for i in range(rows) for j in range(cols)}
            t["cell"] = {"table_no": t["no"], "row": t["row"], "col": col, "row_span": rows, "col_span": cols, "header": tag == "th", "text": ""}

    def handle_endtag(self, tag):
        if self.open and tag in ("td", "th", "tr", "table"):
            self._end_cell()
            if tag == "table":
                self.open.pop()

    def handle_data(self, data):
        if self.open and self.open[-1]["cell"] is not None:
            self.open[-1]["cell"]["text"] += data

    def _end_cell(self):
        cell = self.open[-1]["cell"]
        if cell is not None:
            self.cells.append(cell | {"text": " ".join(cell["text"].split())})
            self.open[-1]["cell"] = None


def parse(html: str | None) -> list[dict]:
    """Cells of all tables; a nested table is one of its own."""
    grid = _Grid()
    grid.feed(html or "")
    grid.close()
    while grid.open:
        grid._end_cell()
        grid.open.pop()
    return sorted(grid.cells, key=lambda c: (c["table_no"], c["row"], c["col"]))
