"""Content blocks from the events of a page.

The reader of a page notes what happens to its visible content: elements that begin and end, text, pictures, links. `assemble`
sorts these events into blocks afterwards. A block is a list of nodes, text or links; a link is a node with nodes of its own, and
whether it becomes a mark in the block's text is known when it ends. Text is put together last, from the nodes.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

#: Elements that are a block each, elements that end loose text, and the punctuation after which a word is set apart.
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "blockquote", "td", "th", "dt", "dd", "figcaption", "pre"}
BREAKS = {
    "div", "section", "article", "main", "header", "footer", "nav", "aside", "form", "table", "tr", "ul", "ol", "dl", "figure", "br", "hr",
    "body", "button", "label", "select", "option", "iframe",
}
CLOSING = {".", "!", "?", "”", '"', ")", ":"}
#: Fixed value: repeated lines that are shorter than this and hold a digit stay.
DATED_CHARS = 60


def squash(text: str | None) -> str:
    return " ".join(re.split(r"\s+", html.unescape(text or ""))).strip()


def squash_lines(text: str) -> str:
    return "\n".join(filter(None, map(squash, text.split("\n"))))


@dataclass(frozen=True)
class Begin:
    tag: str
    chrome: bool


@dataclass(frozen=True)
class End:
    tag: str


@dataclass(frozen=True)
class Words:
    text: str
    chrome: bool


@dataclass(frozen=True)
class Picture:
    chrome: bool
    fields: dict


@dataclass(frozen=True)
class LinkBegin:
    """href is None for an anchor that leads nowhere."""

    href: str | None
    chrome: bool


@dataclass(frozen=True)
class LinkEnd:
    pass


@dataclass
class Link:
    href: str
    nodes: list = field(default_factory=list)
    whole: bool = False  # it ended in the block it began in

    def mark(self, last: str) -> str | None:
        """The link as a mark in text that ends with `last` so far, where it is one."""
        words = squash(joined(self.nodes, last))
        fits = self.whole and words and self.href.startswith(("http://", "https://", "mailto:", "tel:"))
        return f"[{words.replace(']', ')')}]({self.href})" if fits else None


def joined(nodes: list, last: str = "") -> str:
    """Text of nodes. Two elements that meet without a space after closing punctuation are set apart, and so are two marks side by side; `last` is the character before."""
    out, piece = "", ""
    for node in nodes:
        before = out[-1:] or last
        if isinstance(node, Link):
            apart = " " if piece.startswith("[") and piece.endswith(")") else ""
            mark = node.mark(apart or before)
            piece = joined(node.nodes, apart or before) if mark is None else mark
            out += apart + piece
        else:
            piece = node
            out += " " + node if before in CLOSING and node[:1].isalnum() else node
    return out


@dataclass
class Block:
    tag: str
    chrome: bool
    fields: dict = field(default_factory=dict)
    nodes: list = field(default_factory=list)
    links: list[Link] = field(default_factory=list)  # those open in it, the innermost last

    def put(self, node: str | Link) -> None:
        (self.links[-1].nodes if self.links else self.nodes).append(node)


class Assembly:
    """Blocks in document order, from events in document order. Text goes to the innermost open block, else to a loose paragraph."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.nest: list[Block] = []
        self.loose: Block | None = None
        self.anchors: list[tuple[Block, Link, int] | None] = []

    def new(self, tag: str, chrome: bool, **fields: object) -> Block:
        self.blocks.append(Block(tag, chrome, fields))
        return self.blocks[-1]

    @property
    def here(self) -> Block | None:
        return self.nest[-1] if self.nest else self.loose

    def sink(self, chrome: bool) -> Block:
        if self.here is None:
            self.loose = self.new("p", chrome)
        return self.here

    def take(self, event: object) -> None:
        match event:
            case Begin(tag, chrome) if tag in BLOCKS:
                self.loose = None
                self.nest.append(self.new(tag, chrome))
            case Begin("br", _) if self.nest:
                self.nest[-1].put("\n")
            case Begin(tag, _) | End(tag) if tag in BREAKS:
                self.loose = None
            case End(tag) if self.nest and self.nest[-1].tag == tag:
                self.nest.pop()
            case Words(text, chrome) if self.here is not None or text.strip():
                self.sink(chrome).put(text)
            case Picture(chrome, fields):
                self.loose = None
                if fields:
                    self.new("img", chrome, **fields)
            case LinkBegin(None, _):
                self.anchors.append(None)
            case LinkBegin(href, chrome):
                block, link = self.sink(chrome), Link(href)
                block.put(link)
                block.links.append(link)
                self.anchors.append((block, link, len(self.blocks)))
            case LinkEnd() if self.anchors:
                self.end_link(self.anchors.pop())

    def end_link(self, anchor: tuple[Block, Link, int] | None) -> None:
        if anchor is None:
            return
        block, link, at = anchor
        block.links.remove(link)
        link.whole = self.here is block
        if not link.whole and link.href.startswith(("http://", "https://")):
            # a card: a link around whole blocks, whose headings lead where it does
            for b in self.blocks[at:]:
                if b.tag in HEADINGS:
                    b.fields.setdefault("href", link.href)


def assemble(events: Iterable, page_url: str) -> list[dict]:
    """The page's blocks without empty ones, jumps inside the page, and repeats; a short repeated line with a digit stays."""
    work = Assembly()
    for event in events:
        work.take(event)
    here, out, known = page_url.partition("#")[0], [], set()
    for b in work.blocks:
        picture = b.tag == "img"
        text = "" if picture else squash_lines(joined(b.nodes))
        jump = re.fullmatch(r"\[[^\]]*\]\(([^)]*)#[^)]*\)", text)
        if not picture and not text or jump and jump[1] in ("", here):
            continue
        key = (b.tag, b.fields["src"] if picture else text)
        if key not in known or not picture and len(text) < DATED_CHARS and re.search(r"\d", text):
            known.add(key)
            out.append({"tag": b.tag, "text": text, "chrome": b.chrome, **b.fields})
    return out
