"""Labelled pages for the extractor: templates with every kind of furniture.

A page is a list of (markup, label) leaf blocks inside containers; the text of
each is made up from syllables, so the field cannot learn words of a corpus."""

from __future__ import annotations

import random

from .html_extract import Block, blocks

PAGES = 600
# Syllables of made-up words.
SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve wi xo ya zé ön ça ñe ül".split()
# Class words that pages give to their parts.
ARTICLE = "content entry post body article story text main copy prose page".split()
AD = "ad ads advert advertisement banner promo sponsor sponsored".split()
SIDE = "sidebar side widget related aside rail trending popular recommended".split()
NOTICE = "cookie consent notice alert popup modal gdpr newsletter subscribe paywall".split()
COMMENTS = "comments comment replies reply discussion responses disqus".split()
MENU = "menu nav navbar navigation breadcrumb breadcrumbs topbar tabs pagination tags share social".split()
FOOT = "footer foot bottom legal copyright".split()
HEAD = "header masthead top branding logo".split()


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.labels: list[int] = []

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, least: int, most: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(least, most)))

    def prose(self) -> str:
        parts = []
        for _ in range(self.r.choice((1, 1, 2, 3, 5, 8))):
            s = self.words(1, 24).capitalize()
            if self.r.random() < 0.5:
                s = s.replace(" ", ", ", 1)
            parts.append(s + self.r.choice("...!?"))
        if self.r.random() < 0.05:
            parts.append(f"<a href='/{self.word()}'>{self.word()}</a>")
        return " ".join(parts)

    def leaf(self, label: int, tag: str, text: str) -> str:
        self.labels.append(label)
        return f"<{tag}>{text}</{tag}>"

    def box(self, tags: str, names: list[str], inner: str, plain: float = 0.2) -> str:
        tag = self.r.choice(tags.split())
        kind = "" if self.r.random() < plain else f' {self.r.choice(("class", "class", "id"))}="{self.r.choice(names)}{self.r.choice(("", "-box", " wide", "_list"))}"'
        return f"<{tag}{kind}>{inner}</{tag}>"

    def link(self) -> str:
        return f'<a href="/{self.word()}">{self.words(1, 4)}</a>'

    def links(self, n: int) -> str:
        return "<ul>" + "".join(self.leaf(0, "li", self.link()) for _ in range(n)) + "</ul>"

    def menu(self) -> str:
        inner = self.links(self.r.randint(2, 8))
        return f"<nav>{inner}</nav>" if self.r.random() < 0.6 else self.box("div ul nav", MENU, inner, 0)

    def bare(self, text: str) -> str:
        self.labels.append(0)
        return text

    def advert(self) -> str:
        text = self.r.choice((self.words(1, 3).capitalize(), self.words(2, 12), self.prose()))
        inner = self.bare(text) if self.r.random() < 0.5 else self.leaf(0, "p", text)
        return self.box("div div section aside", AD, inner, 0)

    def side(self) -> str:
        inner = self.leaf(0, "h3", self.words(1, 4)) + (self.links(self.r.randint(2, 5)) if self.r.random() < 0.6 else self.leaf(0, "p", self.prose()))
        return f"<aside>{inner}</aside>" if self.r.random() < 0.5 else self.box("div aside section", SIDE, inner, 0)

    def notice(self) -> str:
        return self.box("div section dialog", NOTICE, self.leaf(0, "p", self.prose()), 0)

    def form(self) -> str:
        inner = self.leaf(0, self.r.choice(("p", "div", "legend", "h3")), self.words(1, 6)) + '<input type="text">'
        if self.r.random() < 0.5:
            inner += self.leaf(0, "p", self.prose())
        return f"<form action='/x'>{inner}</form>"

    def comments(self) -> str:
        tag = self.r.choice(("div", "li", "article", "p"))
        inner = self.leaf(0, "h3", self.words(1, 3))
        for _ in range(self.r.randint(1, 4)):
            if tag == "p":
                inner += self.leaf(0, "p", self.prose())
            else:
                inner += f'<{tag} class="comment">' + self.leaf(0, self.r.choice(("p", "div")), self.prose()) + f"</{tag}>"
        return self.box("div section ol", COMMENTS, inner, 0)

    def header(self) -> str:
        inner = self.leaf(0, self.r.choice(("h1", "div", "p", "h2")), self.words(1, 4))
        if self.r.random() < 0.4:
            inner += self.menu()
        return f"<header>{inner}</header>" if self.r.random() < 0.6 else self.box("div header", HEAD, inner, 0)

    def footer(self) -> str:
        text = f"&copy; {self.word()}.example &middot; {self.r.choice((self.words(2, 8), self.prose()))}"
        inner = self.bare(text) if self.r.random() < 0.5 else self.leaf(0, "p", text)
        if self.r.random() < 0.3:
            inner += self.links(self.r.randint(1, 4))
        return f"<footer>{inner}</footer>" if self.r.random() < 0.7 else self.box("div footer section", FOOT, inner, 0)

    def article(self) -> str:
        inner = self.leaf(1, self.r.choice(("h1", "h1", "h2")), self.words(3, 14)) if self.r.random() < 0.9 else ""
        for _ in range(self.r.randint(1, 9)):
            kind = self.r.random()
            if kind < 0.68:
                self.labels.append(1)
                text = self.prose()
                inner += self.r.choice((f"<p>{text}</p>", f"<p>{text}</p>", f"<p><b>{text}<br></p>", f"<p>{text}", f"<div>{text}</div>"))
            elif kind < 0.74:
                inner += self.leaf(1, "h2", self.words(1, 6))
            elif kind < 0.79:
                inner += "<ul>" + "".join(self.leaf(1, "li", self.words(2, 14)) for _ in range(self.r.randint(1, 4))) + "</ul>"
            elif kind < 0.82:
                inner += self.leaf(1, self.r.choice(("blockquote", "pre", "figcaption")), self.prose())
            elif kind < 0.84:
                inner += "<table><tr>" + self.leaf(1, "td", self.words(1, 3)) + self.leaf(1, "td", self.words(1, 3)) + "</tr></table>"
            else:
                inner += self.r.choice((self.advert, self.side, self.notice, self.form))()
        how = self.r.random()
        if how < 0.55:
            return f"<article>{inner}</article>"
        if how < 0.7:
            return f"<main>{inner}</main>"
        return self.box("div section main", ARTICLE, inner, 0.1)

    def page(self) -> str:
        before = [f for f in (self.header, self.menu, self.notice, self.advert, self.side, self.form) if self.r.random() < 0.35]
        after = [f for f in (self.side, self.advert, self.comments, self.form, self.menu, self.notice) if self.r.random() < 0.35]
        self.r.shuffle(before)
        self.r.shuffle(after)
        parts = [f() for f in before] + ([self.article()] if self.r.random() < 0.97 else []) + [f() for f in after]
        if self.r.random() < 0.85:
            parts.append(self.footer())
        body = "".join(parts) if self.r.random() < 0.6 else f'<div class="{self.r.choice(("wrapper", "container", "page", "site", "row"))}">' + "".join(parts) + "</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title></head><body>{body}</body></html>"


def labelled_page(seed: int) -> tuple[str, list[Block], list[int]]:
    maker = _Maker(seed)
    page = maker.page()
    found = blocks(page)
    if len(found) != len(maker.labels):
        raise AssertionError(f"page {seed}: {len(found)} blocks, {len(maker.labels)} labels")
    return page, found, maker.labels


def labelled_pages(n: int = PAGES, first: int = 0) -> list[tuple[list[Block], list[int]]]:
    return [labelled_page(seed)[1:] for seed in range(first, first + n)]
