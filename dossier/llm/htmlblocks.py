"""Leaf blocks of an HTML page: texts with their ancestor tags, in page order."""

from __future__ import annotations

import html
import re

# Elements by their role in HTML.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre "
    "search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea noframes iframe xmp".split())
EMBEDDED = frozenset("template object canvas audio video".split())
CLOSES_P = BLOCK - frozenset("button option optgroup".split())
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*+\"|'[^']*+'|[^'\">]++)*+)>"
    r"|</?[a-zA-Z][^>]*>|<[!?/][^>]*>|(?P<text>[^<]+|<)",
    re.S,
)
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
TEMPLATE = re.compile(r"<template[\s/>]", re.I)
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


class Block:
    """Text of a run of inline content, its ancestors, and how much of it is links."""

    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, path: tuple, linked: int):
        self.text, self.path, self.linked = text, path, linked


def _names(rest: str) -> tuple[str, ...]:
    """Lower-case words of the class, id and role of a tag."""
    if "=" not in rest:
        return ()
    words = [w.lower() for value in NAMES.findall(rest) for w in PARTS.findall(value)]
    return tuple(dict.fromkeys(words))


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of the whole page; scripts, styles, comments and markup are never text.

    White space inside a block becomes one space, character references are
    decoded, empty blocks are left out. Unclosed and stray tags are repaired the
    way browsers do for paragraphs, list items and table cells. Formulas and
    drawings belong to the text around them; text inside other embedded elements
    is a block of its own, and what a template holds is not shown.
    """
    page = page or ""
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    path: tuple = ()
    pieces: list[str] = []
    linked = links = 0
    moved = False
    templates = TEMPLATE.search(page) is not None

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text and not (templates and any(tag == "template" for tag, _ in path)):
                found.append(Block(text, path, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def close(names: set[str], scope: set[str]) -> None:
        for place in range(len(stack) - 1, -1, -1):
            if stack[place][0] in scope:
                return
            if stack[place][0] in names:
                del stack[place:]
                return

    at = 0
    while token := TOKEN.match(page, at):
        at = token.end()
        text = token["text"]
        if text is not None:
            if moved and not text.isspace():
                flush()
                path, moved = tuple(stack), False
            decoded = html.unescape(text) if "&" in text else text
            pieces.append(decoded)
            if links:
                linked += len(decoded)
            continue
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            pieces.append(" ")
        elif tag == "a":
            links = 0 if token["end"] else 1
        elif token["end"]:
            if tag in BLOCK:
                flush()
                close({tag}, set())
                path, moved = tuple(stack), False
                links = 0
            elif tag in EMBEDDED:
                close({tag}, set())
                moved = path != tuple(stack)
        elif tag in RAW:
            if not token["rest"].rstrip().endswith("/"):
                end = RAW_END[tag].search(page, token.end())
                at = end.end() if end else len(page)
        elif tag in EMBEDDED:
            stack.append((tag, _names(token["rest"])))
            moved = True
        elif tag in BLOCK:
            flush()
            if tag in CLOSES_P:
                close({"p"}, {"button", "table", "td", "th", "li", "div", "article", "section", "aside", "form", "object", "template"})
            if tag in SIBLINGS:
                names, scope = SIBLINGS[tag]
                close(names, scope | {"object", "template"})
            if tag not in VOID:
                stack.append((tag, _names(token["rest"])))
            path, moved = tuple(stack), False
    flush()
    return found
