"""Elements of an HTML page as numbered nodes."""

from __future__ import annotations

from html.parser import HTMLParser

#: Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows: list[tuple[int, int | None, str]] = []
        self.open: list[tuple[int, str]] = []

    def handle_starttag(self, tag, attrs):
        me = len(self.rows)
        self.rows.append((me, self.open[-1][0] if self.open else None, tag))
        if tag not in VOID:
            self.open.append((me, tag))

    def handle_startendtag(self, tag, attrs):
        self.rows.append((len(self.rows), self.open[-1][0] if self.open else None, tag))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][1] == tag:
                del self.open[k:]
                break


def elements(html: str) -> list[tuple[int, int | None, str]]:
    tree = _Tree()
    tree.feed(html)
    return tree.rows
