"""A page as a tree of elements."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

#: What marks the site's own frame, elements without content, elements whose content is no text.
FRAME_TAGS = {"header", "nav", "footer", "aside"}
FRAME_ROLES = {"banner", "navigation", "contentinfo", "complementary"}
FRAME = re.compile(r"(^|[\s_-])(site-header|site-footer|masthead|colophon|navbar|main-nav|primary-nav|site-nav|main-menu|primary-menu|global-header|global-footer|page-footer|topbar|top-bar)($|[\s_-])")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SKIPPED = {"script", "style", "noscript", "template", "svg"}


class Element:
    def __init__(self, tag: str, attrs: dict, parent: Element | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.content: list[Element | str] = []
        self.closed = False  # by an end tag of its own
        self.css = attrs.get("class", "").lower()

    @property
    def children(self) -> list[Element]:
        return [c for c in self.content if isinstance(c, Element)]

    def __iter__(self) -> Iterator[Element]:
        todo = [self]
        while todo:
            e = todo.pop()
            yield e
            todo += reversed(e.children)

    def up(self) -> Iterator[Element]:
        e = self.parent
        while e is not None:
            yield e
            e = e.parent

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif x is self or x.tag not in SKIPPED:
                todo += [" ", *reversed(x.content), " "] if x is not self else [*reversed(x.content)]
        return " ".join(html.unescape("".join(out)).split())

    def holds(self, other: Element) -> bool:
        return other is self or any(e is self for e in other.up())

    def links(self) -> int:
        return sum(e.tag == "a" and bool(e.attrs.get("href")) for e in self)

    def framed(self) -> bool:
        """Inside the site's own header, menu, footer or sidebar."""
        line = [self, *self.up()]
        for i, e in enumerate(line):
            role = e.attrs.get("role", "").lower()
            if e.tag in FRAME_TAGS or role in FRAME_ROLES or FRAME.search(f"{e.css} {e.attrs.get('id', '').lower()}"):
                own = e.tag in ("header", "footer") and not role and any(x.tag in ("main", "article") for x in line[i + 1 :])
                if not own:
                    return True
        return False

    def markup(self) -> str:
        return " ".join([*(f"{e.tag} " + " ".join(f"{k}={v}" for k, v in e.attrs.items() if v) for e in self), self.text()])


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("#root", {}, None)

    def put(self, tag: str, attrs: list) -> Element:
        e = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.content.append(e)
        return e

    def handle_starttag(self, tag: str, attrs: list) -> None:
        e = self.put(tag, attrs)
        self.at = self.at if tag in VOID else e

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.put(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        match = next((e for e in [self.at, *self.at.up()] if e.tag == tag), None)
        if match is not None and match is not self.root:
            self.at, match.closed = match.parent, True

    def handle_data(self, data: str) -> None:
        self.at.content.append(data)


def read(page: str | None) -> Element:
    """The page's tree; may raise on malformed declarations."""
    t = _Tree()
    t.feed(page or "")
    t.close()
    return t.root


def tree(page: str | None) -> Element:
    """The page's tree, empty where it cannot be read."""
    try:
        return read(page)
    except Exception:  # noqa: BLE001
        return Element("#root", {}, None)
