"""Reviews on a page: a quote and a name in one card, with date, platform and stars; and those in its structured data."""

from __future__ import annotations

import json
import re

from collections.abc import Iterator

from ..functions.text import DATE as DATE_PATTERN
from .elements import Element, tree

#: What marks authors, cards, quotes and platforms; most links of a card, longest name, shortest quote.
AUTHOR = re.compile(r"author|reviewer|(^|[\s_-])name($|[\s_-])|testimonial-name|client-name")
CARD = re.compile(r"review|testimonial|quote|card")
QUOTE = re.compile(r"text|body|content|quote|review|testimonial")
PLATFORMS = (("Google", r"google|#4285f4"), ("Facebook", r"facebook|#1877f2"), ("Yelp", r"yelp"), ("Trustpilot", r"trustpilot"), ("Houzz", r"houzz"), ("Angi", r"angi\b|angieslist"))
HEADING = re.compile(r"h[1-6]")
MOST_LINKS, NAME_CHARS, QUOTE_CHARS = 4, 60, 20
DATE = re.compile(DATE_PATTERN)


def _names(e: Element) -> bool:
    return e.tag == "cite" or e.attrs.get("itemprop") == "author" or bool(AUTHOR.search(e.css))


def _is_author(e: Element) -> bool:
    inner = [x for x in e if x is not e]
    return (
        e.tag != "#root" and _names(e) and not HEADING.fullmatch(e.tag) and "field--name-" not in e.css and not any(_names(x) or HEADING.fullmatch(x.tag) for x in inner)
        and not any(x.tag in ("a", "button") for x in [e, *e.up()]) and not e.framed()
    )


def _quote(card: Element, author: Element, name: str) -> str | None:
    """The longest quote of a card, if it can be one."""
    told = (e.text() for e in card if (e.tag in ("p", "blockquote") or e.attrs.get("itemprop") == "reviewBody" or QUOTE.search(e.css)) and not e.holds(author) and not author.holds(e))
    best = max(told, key=len, default="")
    return best if len(best) > QUOTE_CHARS and re.search("[a-z]", best) and name not in best else None


def page_reviews(page: str | None, url: str) -> list[dict]:
    out: list[dict] = []
    for author in filter(_is_author, tree(page)):
        name = re.sub(r"^[\s\-–—~•|]+", "", author.text())
        if not 0 < len(name) <= NAME_CHARS:
            continue
        for card in author.up():
            if card.tag in ("#root", "body", "main") or card.links() > MOST_LINKS:
                break
            if not (CARD.search(card.css) or card.tag in ("article", "li", "blockquote", "figure") or "Review" in card.attrs.get("itemtype", "")):
                continue
            quote = _quote(card, author, name)
            if quote is None:
                continue
            if all(r["quote"] != quote for r in out):
                markup, date = card.markup(), DATE.search(card.text())
                stars = sum("star" in e.css and not e.children for e in card)
                platform = next((p for p, words in PLATFORMS if re.search(words, markup, re.I)), None)
                out.append({"quote": quote, "name": name, "date": date[0] if date else None, "platform": platform, "stars": str(stars) if stars else None, "url": url, "origin": "page"})
            break
    return out


def _words(value: object) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _objects(value: object) -> Iterator[dict]:
    """Every object inside a JSON value, outer ones first, in order."""
    if isinstance(value, dict):
        yield value
    for inner in value if isinstance(value, list) else value.values() if isinstance(value, dict) else ():
        yield from _objects(inner)


def _is(o: dict, kind: str) -> bool:
    said = o.get("@type")
    return kind == said or isinstance(said, list) and kind in said


def _review(o: dict, url: str) -> dict:
    author, rated = o.get("author"), o.get("reviewRating")
    name = author.get("name") if isinstance(author, dict) else author
    stars = rated.get("ratingValue") if isinstance(rated, dict) else None
    return {"quote": _words(o.get("reviewBody") or o.get("description") or ""), "name": _words(name), "date": _words(o.get("datePublished")), "platform": None, "stars": _words(stars), "url": url, "origin": "jsonld"}


def _rating(o: dict, url: str) -> dict:
    return {"value": _words(o.get("ratingValue")), "count": _words(o.get("reviewCount") or o.get("ratingCount")), "best": _words(o.get("bestRating")), "url": url}


def jsonld_reviews(items: list[str], url: str) -> tuple[list[dict], list[dict]]:
    """Reviews and aggregate ratings anywhere inside JSON-LD items (JSON strings)."""
    objects = [o for item in items or [] for o in _objects(json.loads(item))]
    rated = (o if _is(o, "AggregateRating") else o.get("aggregateRating") for o in objects)
    reviews = (_review(o, url) for o in objects if _is(o, "Review"))
    return [r for r in reviews if r["quote"]], [_rating(r, url) for r in rated if isinstance(r, dict)]
