"""Visible text of HTML by the standard library's parser, for Arrow functions."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa

#: Elements that are dropped with all they hold.
DROPPED = ("script", "style", "nav", "footer", "svg")


class Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.inside: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.inside.append(tag)

    def handle_endtag(self, tag):
        if tag in self.inside:
            while self.inside.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.inside:
            self.parts.append(data)


def visible_text(html: str | None) -> str | None:
    """The text outside of dropped elements, the pieces between tags on lines of their own; null stays null."""
    if html is None:
        return None
    parser = Visible()
    parser.feed(html)
    parser.close()
    return "\n".join(parser.parts).strip()


def visible_texts(pages: pa.Array) -> pa.Array:
    return pa.array([visible_text(x) for x in pages.to_pylist()], pa.string())
