"""Saved listing pages of candidate cards."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Class names of cards, status badges and names, how far up a card is looked for, labels and statuses.
_CARD = re.compile("card|candidate|row|item", re.I)
_BADGE = re.compile(r"badge|status|(^|\s)(chip|label|pill)(\s|$)", re.I)
_NAME = re.compile(r"(^|\s)(candidate-name|cand-name|name)(\s|$)")
_CLIMB = 6
_STATUSES = ("Accepted", "Rejected", "Withdrawn", "Contesting")
_HEADINGS = ("h1", "h2", "h3", "h4", "h5")
_BLOCK = frozenset("p div li tr td th h1 h2 h3 h4 h5 section article ul table".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Node:
    def __init__(self, tag: str, attrs: dict[str, str], up: _Node | None):
        self.tag, self.attrs, self.up, self.inside = tag, attrs, up, []

    def walk(self) -> Iterator[_Node]:
        for x in self.inside:
            if isinstance(x, _Node):
                yield x
                yield from x.walk()

    def text(self) -> str:
        out = "".join(x if isinstance(x, str) else x.text() for x in self.inside)
        return f"\n{out}\n" if self.tag in _BLOCK else "\n" if self.tag == "br" else out


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.inside.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.up and node.tag != tag:
            node = node.up
        if node.up:
            self.at = node.up

    def handle_data(self, data: str) -> None:
        self.at.inside.append(data)


def _labelled(label: str):
    """Rule: what follows a label on its line."""
    pattern = re.compile(rf"{label}\s*:?\s*([^\n]+)", re.I)
    return lambda card, text: (m := pattern.search(text)) and m[1]


def _element(fits):
    """Rule: the text of the first element of a kind."""
    return lambda card, text: next((t for n in card.walk() if fits(n) and (t := n.text().strip())), None)


def _attribute(name: str, pattern: str = "(.+)", within: str = ""):
    """Rule: what a pattern finds in the first attribute of a name that holds ``within`` and has it."""
    return lambda card, text: next((m[1] for n in card.walk() if within in n.attrs.get(name, "") and (m := re.search(pattern, n.attrs.get(name, "")))), None)


_PROFILE = "show-profile"
#: A field's rules; the first that finds anything gives it.
RULES = {
    "name": (_labelled("Name"), _element(lambda n: n.tag in _HEADINGS or _NAME.search(n.attrs.get("class", ""))), _element(lambda n: _PROFILE in n.attrs.get("href", ""))),
    "party": (_labelled("Party"),),
    "status": (_labelled("Status"), _element(lambda n: _BADGE.search(n.attrs.get("class", ""))), lambda card, text: (m := re.search(rf"\b({'|'.join(_STATUSES)})\b", text, re.I)) and m[1]),
    "state": (_labelled("State"),),
    "constituency": (_labelled("Constituency"),),
    "affidavit_id": (_attribute("data-affidavit-id"), _attribute("href", r"(\d{4,})", "download")),
}


def _card_of(link: _Node) -> _Node:
    """The nearest element around a link that looks like a row, within _CLIMB steps; else the last one reached."""
    card = link.up
    for _ in range(_CLIMB - 1):
        if card.tag in ("tr", "li") or _CARD.search(card.attrs.get("class", "")) or card.up is None or card.up.tag == "":
            break
        card = card.up
    return card


def cards(page: str) -> list[dict[str, str]]:
    """One row per card that holds a profile link, its fields by RULES."""
    tree = _Tree()
    tree.feed(page)
    links = {}
    for link in (n for n in tree.root.walk() if n.tag == "a" and _PROFILE in n.attrs.get("href", "")):
        card = _card_of(link)
        links.setdefault(id(card), (card, link))
    out = []
    for card, link in links.values():
        text = re.sub(r"[ \t]+", " ", re.sub(r"\s*\n\s*", "\n", card.text()))
        row = {field: next((found.strip() for rule in rules if (found := rule(card, text)) and found.strip()), "") for field, rules in RULES.items()}
        out.append(row | {"status": row["status"][:1].upper() + row["status"][1:].lower(), "profile_url": link.attrs["href"]})
    return out


_FIELDS = ("name", "party", "status", "state", "constituency", "profile_url", "affidavit_id")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(page, i, *(c[f] for f in _FIELDS)) for page, raw in zip(batch.column("page").to_pylist(), batch.column("html").to_pylist(), strict=True) for i, c in enumerate(cards(raw or ""))]
        kinds = [pa.int32(), pa.int32(), *[pa.string()] * len(_FIELDS)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True) if found else [[]] * len(kinds), kinds, strict=True)], ["page", "pos", *_FIELDS])


def listing_cards(pages: DataFrame) -> DataFrame:
    """pages (page, html) -> page, pos, the seven card fields."""
    return pages.select(F.col("page").cast("int").alias("page"), "html").mapInArrow(_rows, "page int, pos int, " + ", ".join(f"{f} string" for f in _FIELDS))
