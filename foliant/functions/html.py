"""Tables of a page, by the standard library's parser."""

from __future__ import annotations

from html.parser import HTMLParser


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.open: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "table":
            self.open.append([])
        elif self.open and tag == "tr":
            self.open[-1].append([])
        elif self.open and tag in ("td", "th"):
            if not self.open[-1]:
                self.open[-1].append([])
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self.cell is not None and self.open and self.open[-1]:
            self.open[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "table" and self.open:
            self.tables.append(self.open.pop())

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)


def markdown_tables(html: str) -> list[str]:
    """Tables of two rows or more, the first row being the header; rows without text are left out.

    >>> markdown_tables("<table><tr><td>a<td>b</td></tr><tr><td>1|2</td></tr></table>")[0].splitlines()[-1]
    '| 1\\\\|2 |  |'
    """
    parser = _Tables()
    parser.feed(html.replace("<td", "</td><td").replace("<th>", "</th><th>"))
    out = []
    for rows in parser.tables:
        if len(rows) < 2:
            continue
        head, *body = rows
        width = len(head)
        line = lambda cells: "| " + " | ".join(c.replace("|", "\\|") for c in (cells + [""] * width)[:width]) + " |"
        out.append("\n".join([line(head), "|" + " --- |" * width, *(line(r) for r in body if any(r))]))
    return out


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        self.hidden += tag in ("script", "style", "template")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "template") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def visible_text(html: str) -> str:
    """The text of a page, without scripts and styles.

    >>> visible_text("<p>a&amp;b</p><script>x()</script> <b>c</b>")
    'a&b c'
    """
    parser = _Text()
    parser.feed(html)
    return " ".join(" ".join(parser.parts).split())
