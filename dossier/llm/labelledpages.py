"""Labelled training pages: made-up sites whose blocks are known to be article or not."""

from __future__ import annotations

import random

# What the parts of a page are commonly called.
OTHER_TAGS = "nav header footer aside form".split()
OTHER_NAMES = (
    "ad ads advert advertisement banner sponsored promo sidebar menu nav navigation navbar topbar breadcrumb breadcrumbs "
    "header masthead footer copyright cookie cookies consent notice alert popup modal overlay newsletter subscribe subscription "
    "signup login search share sharing social related recommended trending widget tags pagination pager disclaimer legal toolbar "
    "comments comment replies reply discussion responses respond feedback form contact rail skip meta byline"
).split()
MAIN_NAMES = "content article post entry story text body main page prose".split()
COMMENT_NAMES = ("comments", "comment", "replies", "reply", "discussion", "responses", "respond", "feedback")
SYLLABLES = "an be cor del en fi gra ho in ju ka lo mi no or pe qua ri sa ter un ver wi xa yo zen ed ing tion".split()


class _Maker:
    def __init__(self, seed: int):
        self.random = random.Random(seed)
        self.parts: list[str] = []
        self.labels: list[tuple[str, int]] = []

    def words(self, n: int) -> str:
        r = self.random
        return " ".join("".join(r.choices(SYLLABLES, k=r.randint(1, 3))) for _ in range(n))

    def sentence(self, least: int, most: int) -> str:
        return self.words(self.random.randint(least, most)).capitalize() + "."

    def block(self, tag: str, text: str, label: int, attributes: str = "", link: bool = False) -> None:
        inner = f'<a href="/x">{text}</a>' if link else text
        self.parts.append(f"<{tag}{attributes}>{inner}</{tag}>")
        self.labels.append((text, label))

    def paragraph(self, label: int) -> None:
        r = self.random
        self.block("p", " ".join(self.sentence(4, 18) for _ in range(r.choice((1, 1, 2, 4, 6)))), label)

    def other(self, inside_article: bool) -> None:
        r = self.random
        if r.random() < 0.4:
            tag, name = r.choice(OTHER_TAGS), ""
            where = f' class="{r.choice(OTHER_NAMES)}"' if r.random() < 0.3 else ""
        else:
            tag, name = r.choice(("div", "div", "section", "ul")), r.choice(OTHER_NAMES)
            key = r.choice(("class", "class", "id"))
            shape = r.choice(("{0}", "{0}", "{0}-box", "site-{0}", "page {0}", "{0}_list"))
            where = f' {key}="{shape.format(name)}"'
        self.parts.append(f"<{tag}{where}>")
        if tag == "ul":
            for _ in range(r.randint(1, 5)):
                self.block("li", self.words(r.randint(1, 3)), 0, link=r.random() < 0.7)
        elif name in COMMENT_NAMES:
            for _ in range(r.randint(1, 4)):
                self.parts.append(r.choice(("<div>", '<div class="comment">', '<article class="comment">', '<li class="reply">')))
                closing = {"<d": "</div>", "<a": "</article>", "<l": "</li>"}[self.parts[-1][:2]]
                self.paragraph(0)
                self.parts.append(closing)
        elif tag == "form":
            self.block("label", self.words(2), 0)
            self.parts[-1] = f"<p>{self.parts[-1]}</p>"
            self.block("button", self.words(1), 0)
        else:
            for _ in range(r.randint(1, 3)):
                kind = r.random()
                if kind < 0.4:
                    self.block("li", self.words(r.randint(1, 3)), 0, link=True)
                    self.parts[-1] = f"<ul>{self.parts[-1]}</ul>"
                elif kind < 0.7:
                    self.block(r.choice(("p", "div", "span", "h3")), self.sentence(2, 10), 0)
                    if self.parts[-1].startswith("<span"):
                        self.parts[-1] = f"<div>{self.parts[-1]}</div>"
                else:
                    self.paragraph(0)
        self.parts.append(f"</{tag}>")

    def main(self) -> None:
        r = self.random
        if r.random() < 0.8:
            self.block(r.choice(("h1", "h1", "h2")), self.words(r.randint(2, 10)).capitalize(), 1)
        for _ in range(r.choice((1, 2, 3, 5, 8, 12))):
            kind = r.random()
            if kind < 0.72:
                self.paragraph(1)
            elif kind < 0.8:
                self.block(r.choice(("h2", "h3", "blockquote", "pre")), self.sentence(2, 12), 1)
            elif kind < 0.86:
                self.parts.append("<ul>")
                for _ in range(r.randint(1, 4)):
                    self.block("li", self.sentence(2, 12), 1)
                self.parts.append("</ul>")
            elif kind < 0.9:
                self.parts.append("<table><tr>")
                for _ in range(r.randint(2, 4)):
                    self.block("td", self.words(r.randint(1, 4)), 1)
                self.parts.append("</tr></table>")
            elif kind < 0.93:
                self.block("p", self.words(r.randint(1, 2)).capitalize() + ".", 1)
            else:
                self.other(True)

    def page(self) -> tuple[str, list[int]]:
        r = self.random
        title, around = self.words(5), r.choice((0, 2, 4, 4, 4))
        if r.random() < 0.8:
            self.parts.append(f"<html><head><title>{title}</title><style>p{{}}</style></head><body>")
            self.labels.append((title, 0))
        for _ in range(r.randint(0, around)):
            self.other(False)
        wraps = [
            ("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"),
            ("<div>", "</div>"), (f'<div class="{r.choice(MAIN_NAMES)}">', "</div>"), (f'<div id="{r.choice(MAIN_NAMES)}-area">', "</div>"),
            (f'<section class="{r.choice(MAIN_NAMES)}">', "</section>"),
        ]
        before, after = r.choice(wraps)
        self.parts.append(before)
        self.main()
        self.parts.append(after)
        for _ in range(r.randint(0, around)):
            self.other(False)
        self.parts.append("</body></html>")
        return "".join(self.parts), [label for _, label in self.labels]


def labelled_pages(count: int, seed: int = 1) -> list[tuple[str, list[int]]]:
    """Pages with one label per leaf block, 1 for the article."""
    return [_Maker(seed * 1_000_003 + n).page() for n in range(count)]
