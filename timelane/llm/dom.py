"""Block elements of an HTML page as arrays, for models on its tree."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

# Elements by their part in a page, as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var br wbr img".split()
)
UNSEEN = frozenset(
    "head title script style noscript template textarea select option button iframe object svg math "
    "canvas audio video map datalist".split()
)
CLOSES = {  # an opening element ends these open ones
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"},
    "tfoot": {"tbody", "tr", "td", "th"},
}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}}
RAW = frozenset({"script", "style"})
IN_HEAD = frozenset("html head base basefont bgsound link meta title script style noscript noframes template".split())
"""Anything else, and text, ends an open head: its end tag may be left out."""

_MARKED = re.compile(r"<!\[")
_NAME = re.compile(r"[a-z0-9]+")


@dataclass
class Node:
    tag: str
    parent: int
    names: list[str] = field(default_factory=list)
    marked: bool | None = None
    own: int = 0  # code points of text right inside
    linked: int = 0  # of these, inside links
    stops: int = 0
    unseen: bool = False


class Page(HTMLParser):
    """Nodes in page order, a parent before its children; and the texts of their blocks."""

    def __init__(self, html: str, mark: str | None = None):
        super().__init__(convert_charrefs=True)
        self.mark = mark
        self.nodes = [Node("#page", -1)]
        self.open = [0]
        self.blocks: list[tuple[int, str]] = []
        self._text: list[tuple[str, bool]] = []
        self._link = False
        self.feed(_MARKED.sub("<!-[", html))
        self.close()
        self._flush()

    def _end_head(self) -> None:
        if self.nodes[self.open[-1]].tag == "head":
            self._flush()
            self.open.pop()

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD:
            self._end_head()
        if tag in INLINE:
            if tag == "a":
                self._link = True
            elif tag in ("br", "wbr") and not self.nodes[self.open[-1]].unseen:
                self._text.append((" " if tag == "br" else "", False))
            return
        if tag in VOID:
            if tag == "hr":
                self._flush()
            return
        self._flush()
        if tag in ("ul", "ol", "p", "li", "nav"):
            self._link = False
        for name in CLOSES.get(tag, ()):
            self._end(name, SCOPE.get(tag, {"table"}))
        if tag not in UNSEEN:
            self._end("p", {"td", "th", "li", "button"} if tag in ("li", "td", "th") else {"button"})
        above = self.nodes[self.open[-1]]
        names, marked = [], above.marked
        for k, v in attrs:
            if k in ("class", "id", "role") and v:
                names += _NAME.findall(v.lower())
            elif self.mark is not None and k == self.mark:
                marked = True
        hidden = any(k == "hidden" or (k == "style" and v and re.search(r"display\s*:\s*none", v)) for k, v in attrs)
        self.nodes.append(Node(tag, self.open[-1], names, marked, unseen=above.unseen or hidden or tag in UNSEEN))
        self.open.append(len(self.nodes) - 1)

    def _end(self, tag: str, scope: set[str]) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            name = self.nodes[self.open[at]].tag
            if name == tag:
                del self.open[at:]
                return
            if name in scope:
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash at the end means nothing in HTML

    def handle_endtag(self, tag):
        if tag == "a":
            self._link = False
        if tag in INLINE or tag in VOID:
            return
        self._flush()
        for at in range(len(self.open) - 1, 0, -1):
            if self.nodes[self.open[at]].tag == tag:
                del self.open[at:]
                return

    def handle_data(self, data):
        if data.strip():
            self._end_head()
        if not self.nodes[self.open[-1]].unseen:
            self._text.append((data, self._link))

    def _flush(self) -> None:
        if not self._text:
            return
        text = " ".join("".join(t for t, _ in self._text).split())
        if text:
            node = self.nodes[self.open[-1]]
            node.own += len(text)
            node.linked += sum(len(t.strip()) for t, linked in self._text if linked)
            node.stops += text.count(". ") + text.count("? ") + text.count("! ") + text.count(", ") + (text[-1] in ".?!")
            self.blocks.append((self.open[-1], text))
        self._text = []
