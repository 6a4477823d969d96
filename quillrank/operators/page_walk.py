"""One page's cards and links, by its tag nesting: the per-row helper of ``cards``.

The module travels to the executors by value, so they need no installed package.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from html.parser import HTMLParser

from pyspark import cloudpickle

# Elements that never have content, and elements that make a card.
_VOID = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
_CARD_TAGS = ("article", "li", "div")
_HIDDEN_TAGS = ("script", "style", "template")


# The shapes of functions.times, to find where in a page they first occur.
_DATE = re.compile(r"(?<!\w)on\s+[A-Z][a-z]{2}\s+[0-9]{1,2},\s+[0-9]{4}")
_CLOCK = re.compile(r"(?<!\w)[0-9]{1,2}:[0-9]{2}(?!\w)")
_BLANK = re.compile(r"\s+")
#: Characters of a card's text that may become a summary.
HEAD = 500


class _PageWalk(HTMLParser):
    """Notes, per element of interest, which run of text pieces it spans."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.links: list[dict] = []
        self.marks = 0
        self._open: list[tuple[str, dict | None]] = []
        self._depth: dict[str, int] = {}
        self._cards: list[dict] = []
        self._buffer: list[str] = []

    def _flush(self) -> None:
        piece = "".join(self._buffer).strip()
        self._buffer.clear()
        if piece and not any(tag in _HIDDEN_TAGS for tag, _ in self._open[-1:]):
            self.pieces.append(piece)

    def handle_starttag(self, tag, attrs):
        self._flush()
        attrs = dict(attrs)
        node = None
        if tag == "a":
            # Links do not nest: the next one ends a link that was left open.
            if self.links:
                self.links[-1].setdefault("last", len(self.pieces))
            if attrs.get("href") is not None:
                node = {"href": attrs["href"], "first": len(self.pieces), "card": self._cards[-1] if self._cards else None}
                self.links.append(node)
        elif tag in _CARD_TAGS:
            node = {"first": len(self.pieces), "link": len(self.links), "mark": self.marks}
            self._cards.append(node)
        if "data-transcript" in attrs:
            # The mark counts for every card open here, this element included.
            self.marks += 1
        if tag not in _VOID:
            self._open.append((tag, node))
            self._depth[tag] = self._depth.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        if tag in _VOID or not self._depth.get(tag):
            return
        while self._close() != tag:
            pass

    def handle_data(self, data):
        self._buffer.append(data)

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def unknown_decl(self, data):
        self._flush()

    def parse_marked_section(self, i, report=1):
        """Sections with unknown keywords are comments up to the next ``>``."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            end = self.rawdata.find(">", i)
            if end < 0:
                return -1
            self.unknown_decl(self.rawdata[i + 3 : end])
            return end + 1

    def _close(self) -> str:
        tag, node = self._open.pop()
        self._depth[tag] -= 1
        if node is not None:
            node.setdefault("last", len(self.pieces))
            if tag in _CARD_TAGS:
                self._cards.pop()
                node["end_link"] = len(self.links)
                node["end_mark"] = self.marks
        return tag

    def finish(self) -> None:
        self.close()
        self._flush()
        while self._open:
            self._close()


class _Text:
    """The page's text, joined once, and slices of it by piece number."""

    def __init__(self, pieces: list[str]) -> None:
        self.text = " ".join(pieces)
        self.starts = [0]
        for piece in pieces:
            self.starts.append(self.starts[-1] + len(piece) + 1)

    def span(self, node) -> tuple[int, int]:
        start = self.starts[node["first"]]
        return start, max(start, self.starts[node["last"]] - 1)


def _first_inside(found: list[tuple[int, int]], text: str, start: int, end: int) -> str | None:
    """The first of the page's matches that lies within ``start`` and ``end``."""
    at = bisect_left(found, (start, 0))
    while at < len(found) and found[at][0] < end:
        if found[at][1] <= end:
            return text[found[at][0] : found[at][1]]
        at += 1
    return None


def walk_page(html: str, item_path: str, tracks: tuple[str, ...] = ()) -> dict:
    """Cards and item links of one page; a card is returned once, links point to it.

    Elements may lie within each other to any depth, so a card carries no copy of its
    text: only its beginning, the first date and duration in it, and which of the
    page's ``names`` are inside. What is returned grows with the page.
    """
    walk = _PageWalk()
    walk.feed(html)
    walk.finish()
    raw, plain = _Text(walk.pieces), _Text([_BLANK.sub(" ", p) for p in walk.pieces])
    dates = [m.span() for m in _DATE.finditer(raw.text)]
    clocks = [m.span() for m in _CLOCK.finditer(raw.text)]
    names, name_at, track_at = [], [], []
    for i, link in enumerate(walk.links):
        start, end = raw.span(link)
        if "/profile/" in link["href"] and end > start:
            names.append(raw.text[start:end])
            name_at.append(i)
        if tracks and raw.text[start:end] in tracks:
            track_at.append(i)
    cards: list[dict] = []
    numbers: dict[int, int] = {}
    links = []
    for pos, link in enumerate(walk.links):
        if item_path not in link["href"]:
            continue
        start, end = raw.span(link)
        title = raw.text[start:end]
        card, number, same = link["card"], None, False
        if card is not None:
            start, end = plain.span(card)
            same = end - start == len(title) and plain.text[start:end] == title
            number = numbers.get(id(card))
            if number is None:
                number = numbers[id(card)] = len(cards)
                span = raw.span(card)
                track = bisect_left(track_at, card["link"])
                inside = track < len(track_at) and track_at[track] < card["end_link"]
                cards.append(
                    {
                        "head": plain.text[start : min(end, start + HEAD)],
                        "date": _first_inside(dates, raw.text, *span),
                        "clock": _first_inside(clocks, raw.text, *span),
                        "first_name": bisect_left(name_at, card["link"]),
                        "end_name": bisect_left(name_at, card["end_link"]),
                        "track": raw.text[slice(*raw.span(walk.links[track_at[track]]))] if inside else None,
                        "transcript": card["mark"] < card["end_mark"],
                    }
                )
        links.append({"pos": pos, "href": link["href"], "title": title, "card": number, "same": same})
    return {"cards": cards, "links": links, "names": names, "error": None}


cloudpickle.register_pickle_by_value(sys.modules[__name__])
