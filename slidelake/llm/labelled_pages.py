"""Labelled pages by rule: the training set of the block labeller.

Each page is dealt from common layouts: a site header, menus, notices, adverts, sidebars, forms, reader comments and a
footer round an article that may itself hold adverts, related links or a form.  An article's text stands in paragraphs,
divs, spans, sections, lists (also of links), definitions or tables, with or without a heading, in an article element, a
container with or without a name, or the body itself, and may be a single block; boilerplate stands in the same tags, so
that a tag alone decides nothing.  The words are made up, so a model can learn from structure and shape only.
"""

from __future__ import annotations

import random

MENU_NAMES = ["menu", "nav", "navbar", "main-nav", "breadcrumb", "breadcrumbs", "site-nav", "toolbar", "pagination", "tabs"]
AD_NAMES = ["ad", "ads", "advert", "advertisement", "banner", "promo", "sponsored", "sponsor", "ad-slot"]
NOTICE_NAMES = ["notice", "cookie", "cookie-notice", "consent", "alert", "popup", "gdpr", "message", "cookie-banner"]
SIDE_NAMES = ["sidebar", "side", "widget", "related", "recommended", "trending", "more-stories", "aside"]
COMMENT_NAMES = ["comments", "comment", "reply", "replies", "discussion", "responses", "comment-list"]
FORM_NAMES = ["newsletter", "subscribe", "login", "search", "signup", "contact"]
HEAD_NAMES = ["header", "masthead", "site-header", "top", "logo"]
FOOT_NAMES = ["footer", "site-footer", "copyright", "legal", "bottom", "share", "social", "tags"]
BODY_NAMES = ["article", "content", "post", "entry", "entry-content", "post-body", "story", "article-body", "main-content", "text"]

Block = tuple[str, int]


class PageMaker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.html: list[str] = []
        self.blocks: list[Block] = []

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = ["".join(r.choice("aeiou") + r.choice("bdfglmnrst") for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        return " ".join(out)

    def sentences(self, low: int, high: int) -> str:
        text = " ".join(self.words(3, 18).capitalize() + self.r.choice("...!?") for _ in range(self.r.randint(low, high)))
        return text[:-1] if self.r.random() < 0.15 else text

    def add(self, tag: str, text: str, label: int, closed: bool = True) -> None:
        # The shape of a text is a weak sign: some are tables, shouts or fragments.
        odd = self.r.random()
        if odd < 0.1:
            text = text.lower()
        elif odd < 0.15:
            text = text.replace(" ", " | ")
        elif odd < 0.2:
            text = text.upper()
        elif odd < 0.25:
            text = str(self.r.randint(1, 9999)) + " " + text
        self.html.append(f"<{tag}>{text}" + (f"</{tag.split()[0]}>" if closed else ""))
        self.blocks.append((text, label))

    def named(self, names: list[str]) -> str:
        return f'{self.r.choice(["class", "class", "id"])}="{self.r.choice(names)}"'

    def within(self, tag: str, fill) -> None:
        self.html.append(f"<{tag}>")
        fill()
        self.html.append(f"</{tag.split()[0]}>")

    def menu(self) -> None:
        def items() -> None:
            for _ in range(self.r.randint(2, 9)):
                text = self.words(1, 3)
                self.html.append(f'<li><a href="/{len(self.html)}">{text}</a></li>')
                self.blocks.append((text, 0))

        outer = self.r.choice(["nav", "nav", f"div {self.named(MENU_NAMES)}", "header"])
        self.within(outer, lambda: self.within(self.r.choice(["ul", f"ul {self.named(MENU_NAMES)}"]), items))

    def boilerplate(self, tags: list[str], names: list[str], low: int, high: int) -> None:
        def fill() -> None:
            for _ in range(self.r.randint(1, 3)):
                inner = self.r.choice(["p", "div", "span", "h3", "li"])
                text = self.sentences(low, high) if self.r.random() < 0.7 else self.words(1, 6)
                if inner == "span":
                    self.html.append("<div><span>" + text + "</span></div>")
                    self.blocks.append((text, 0))
                else:
                    self.add(inner, text, 0)

        self.within(self.r.choice([*tags, f"div {self.named(names)}", f"div {self.named(names)}", f"section {self.named(names)}"]), fill)

    def plain(self, tag: str, names: list[str], low: int, high: int) -> None:
        """A container whose text stands in it directly."""
        self.add(f"{tag} {self.named(names)}", self.sentences(low, high), 0)

    def form(self) -> None:
        def fill() -> None:
            for tag in self.r.sample(["label", "p", "button", "legend", "option"], 3):
                self.html.append(f"<div><{tag}>")
                text = self.words(1, 8)
                self.html.append(f"{text}</{tag}></div>")
                self.blocks.append((text, 0))

        self.within(self.r.choice(["form", f"form {self.named(FORM_NAMES)}"]), fill)

    def comments(self) -> None:
        def fill() -> None:
            self.add("h3", self.words(1, 3), 0)
            for _ in range(self.r.randint(1, 5)):
                tag = self.r.choice(["div", "li", "article"])
                self.within(f"{tag} {self.named(COMMENT_NAMES)}", lambda: (self.add("p", self.sentences(1, 5), 0), None))

        self.within(f"{self.r.choice(['section', 'div', 'ol'])} {self.named(COMMENT_NAMES)}", fill)

    def linked(self, tag: str, text: str) -> None:
        """A block of the article that is all link, or has a link in it."""
        self.html.append(f'<{tag}><a href="/{len(self.html)}">{text}</a></{tag}>')
        self.blocks.append((text, 1))

    def paragraph(self, usual: str) -> None:
        r, text = self.r, self.sentences(1, 7)
        if usual == "span":
            self.html.append(f"<div><span>{text}</span></div>")
            self.blocks.append((text, 1))
        elif usual == "section":
            self.within("section", lambda: self.add(r.choice(["p", "div"]), text, 1))
        else:
            self.add(usual, text, 1, closed=usual != "p" or r.random() < 0.8)

    def article(self) -> None:
        r = self.r
        usual = r.choice(["p", "p", "p", "p", "div", "div", "span", "section"])
        n = r.choice([1, 1, 2, 3, *range(2, 13)])
        heading = r.random() < 0.7

        def fill() -> None:
            if heading:
                title = lambda: self.add(r.choice(["h1", "h1", "h2"]), self.words(2, 10).capitalize(), 1)
                if r.random() < 0.2:
                    self.within("header", title)
                else:
                    title()
            for _ in range(n):
                kind = r.random()
                if n == 1 or kind < 0.66:
                    self.paragraph(usual if r.random() < 0.8 else "p")
                elif kind < 0.72:
                    self.add(r.choice(["h2", "h3"]), self.words(1, 8).capitalize(), 1)
                elif kind < 0.79:
                    self.within(r.choice(["ul", "ol"]), lambda: [self.add("li", self.words(2, 15), 1) for _ in range(r.randint(2, 5))])
                elif kind < 0.83:
                    self.within(r.choice(["ul", "ol"]), lambda: [self.linked("li", self.words(1, 6)) for _ in range(r.randint(2, 5))])
                elif kind < 0.85:
                    self.linked(r.choice(["p", "div"]), self.words(2, 8))
                elif kind < 0.88:
                    self.within("dl", lambda: [self.add(t, self.words(1, 12), 1) for _ in range(r.randint(1, 3)) for t in ("dt", "dd")])
                elif kind < 0.92:
                    self.add(r.choice(["blockquote", "pre", "figcaption"]), self.sentences(1, 3), 1)
                elif kind < 0.94:
                    self.within("table", lambda: self.within("tr", lambda: [self.add("td", self.words(1, 4), 1) for _ in range(3)]))
                elif kind < 0.96:
                    self.plain(r.choice(["div", "p", "section"]), AD_NAMES, 1, 2)
                elif kind < 0.98:
                    self.boilerplate(["aside"], SIDE_NAMES, 1, 2)
                else:
                    self.form()

        named = f"{r.choice(['div', 'div', 'section'])} {self.named(BODY_NAMES)}"
        body = r.choice(["article", "article", "article", "main", named, named, f"article {self.named(BODY_NAMES)}", "div", ""])
        if not body:
            fill()
        elif r.random() < 0.3:
            self.within(r.choice(["main", f"div {self.named(BODY_NAMES)}", "div"]), lambda: self.within(body, fill))
        else:
            self.within(body, fill)

    def page(self) -> tuple[str, list[Block]]:
        r = self.r
        before = [
            self.menu,
            lambda: self.boilerplate(["header"], HEAD_NAMES, 1, 1),
            lambda: self.boilerplate([], NOTICE_NAMES, 1, 2),
            lambda: self.plain("div", NOTICE_NAMES, 1, 2),
            lambda: self.plain("div", AD_NAMES, 1, 2),
            lambda: self.boilerplate(["aside"], SIDE_NAMES, 1, 3),
            self.form,
        ]
        after = [
            self.comments,
            self.menu,
            lambda: self.boilerplate(["aside"], SIDE_NAMES, 1, 3),
            lambda: self.plain("div", AD_NAMES, 1, 2),
            lambda: self.plain(r.choice(["footer", "div"]), FOOT_NAMES, 1, 4),
            lambda: self.boilerplate(["footer"], FOOT_NAMES, 1, 3),
            self.form,
        ]
        for part in r.sample(before, r.randint(0, 4)):
            part()
        if r.random() < 0.97:
            self.article()
        for part in r.sample(after, r.randint(0, 4)):
            part()
        if r.random() < 0.7:
            self.add("footer", "&copy; " + self.sentences(1, 3), 0)
        return "<html><head><title>t</title></head><body>" + "".join(self.html) + "</body></html>", self.blocks


def labelled_pages(n: int, seed: int = 0) -> list[tuple[str, list[Block]]]:
    """``n`` pages, each with its blocks in page order and whether they are main text."""
    return [PageMaker(seed * 1_000_003 + i).page() for i in range(n)]
