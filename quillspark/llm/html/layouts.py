"""Labelled pages to learn from, generated from a seed: articles among menus, notices, adverts, forms and comments.

Elements of main text carry no mark in the page; the truth is kept beside it by page order.
"""

from __future__ import annotations

import random

from .nodes import LEXICON

#: Pages that are generated.
PAGES = 700


class Maker:
    def __init__(self, rng: random.Random) -> None:
        self.rng, self.out, self.truth, self.main_tag = rng, [], [], ""
        self.unknown = rng.choice([0, 0, 0.3, 0.9])
        self.own_words = ["".join(rng.choices("bcdfghjklmnpqrstvwxz", k=rng.randint(2, 6))) for _ in range(12)]

    def words(self, low: int, high: int) -> str:
        rng = self.rng
        own = ["".join(rng.choices("abcdefghijklmnoprstuvwyzäéñ", k=rng.randint(1, 9))) for _ in range(rng.randint(low, high))]
        text = " ".join(own)
        return text[:1].upper() + text[1:]

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(3, 14) + self.rng.choice(".....!?") for _ in range(self.rng.randint(low, high)))

    def token(self, group: str) -> str:
        """A word of the group; or, on pages whose makers use words of their own, one that tells nothing."""
        return self.rng.choice(self.own_words if self.rng.random() < self.unknown else LEXICON[group].split())

    def open(self, tag: str, good: bool, group: str | None = None) -> None:
        """A start tag; ``good`` is whether it is main text. ``group`` names words of which its class may be made."""
        rng, attrs = self.rng, ""
        if group and rng.random() < 0.8:
            token = self.token(group)
            other = rng.choice(["", "", f"-{rng.choice(['box', 'wrap', 'block', 'area', 'list', 'item', 'inner', 'x1'])}", f" {rng.choice(['left', 'wide', 'row', 'col', 'clearfix', 'js'])}"])
            attrs = rng.choice([' class="{}"', ' id="{}"', " class='{}'", ' data-k="1" class="{}"']).format(token + other)
        elif rng.random() < 0.2:
            attrs = f' class="{rng.choice(["row", "col", "wrap", "inner", "c12", "x"])}"'
        self.out.append(f"<{tag}{attrs}>")
        self.truth.append((tag, good))

    def close(self, tag: str) -> None:
        self.out.append(f"</{tag}>")

    def leaf(self, tag: str, text: str, good: bool, group: str | None = None) -> None:
        self.open(tag, good, group)
        self.out.append(text)
        self.close(tag)

    def link(self, text: str) -> str:
        return f'<a href="/{self.rng.randint(1, 999)}">{text}</a>'

    def links(self, low: int, high: int) -> None:
        tag = self.rng.choice(["ul", "ul", "ol", "menu"])
        self.open(tag, False)
        for _ in range(self.rng.randint(low, high)):
            self.leaf("li", self.link(self.words(1, 4)), False)
        self.close(tag)

    def noise(self, inside: bool) -> None:
        """One part that is no main text; outside of a named article also text without any sign."""
        rng = self.rng
        if not inside and self.main_tag in ("article", "main") and rng.random() < 0.12:
            self.leaf(rng.choice(["p", "p", "h1", "h2", "div"]), self.sentences(1, 4) if rng.random() < 0.6 else self.words(1, 6), False)
            return
        kind = rng.choice(["menu", "advert", "notice", "sidebar", "share", "form", "comment", "top", "bottom"])
        tag = {"menu": ["nav", "nav", "div", "ul"], "advert": ["div", "div", "aside", "section", "ins", "p"], "notice": ["div", "div", "section", "dialog", "p", "p"], "sidebar": ["aside", "aside", "div", "section"], "share": ["div", "ul", "p"], "form": ["form", "form", "div", "section"], "comment": ["section", "div", "ol", "div"], "top": ["header", "header", "div"], "bottom": ["footer", "footer", "div"]}[kind]
        tag = rng.choice(tag)
        # an element without a telling name has a telling class
        named = tag in ("nav", "aside", "form", "header", "footer", "dialog")
        group = kind if not named or rng.random() < 0.6 else None
        self.open(tag, False, group)
        self.out[-1] = self.out[-1] if named or "class" in self.out[-1] or "id=" in self.out[-1] else f'<{tag} class="{self.token(kind)}">'
        if kind in ("menu", "share"):
            if tag == "p":
                self.out.append(" ".join(self.link(self.words(1, 2)) for _ in range(rng.randint(1, 4))))
            elif tag in ("ul", "ol"):
                for _ in range(rng.randint(2, 8)):
                    self.leaf("li", self.link(self.words(1, 3)), False)
            else:
                self.links(2, 9)
        elif kind == "form":
            self.leaf("label", self.words(1, 3), False)
            self.out.append('<input name="q">')
            self.leaf("button", self.words(1, 2), False)
            if rng.random() < 0.4:
                self.leaf("p", self.sentences(1, 2), False)
        elif kind == "comment":
            self.leaf(rng.choice(["h2", "h3", "h4"]), self.words(1, 3), False)
            for _ in range(rng.randint(1, 6)):
                sub = rng.choice(["div", "li", "article", "section"])
                self.open(sub, False, "comment" if rng.random() < 0.6 else None)
                self.leaf(rng.choice(["p", "div"]), self.sentences(1, 5), False)
                self.close(sub)
        elif kind in ("sidebar", "top"):
            if rng.random() < 0.7:
                self.leaf(rng.choice(["h1", "h2", "h3", "div"]) if kind == "top" else rng.choice(["h2", "h3", "h4"]), self.words(1, 5), False)
            if rng.random() < 0.6:
                self.links(1, 8)
            else:
                self.leaf("p", self.sentences(1, 4), False)
        else:
            text = self.sentences(1, 3) if rng.random() < 0.7 else self.link(self.words(2, 8))
            if tag == "p" or rng.random() < 0.5:
                self.out.append(text)
            else:
                self.leaf(rng.choice(["p", "div"]), text, False)
            if kind == "bottom" and tag != "p" and rng.random() < 0.5:
                self.links(2, 6)
        self.close(tag)

    def main(self) -> None:
        rng = self.rng
        tag = self.main_tag
        named = tag in ("div", "section", "td") and rng.random() < 0.8
        if tag:
            self.open(tag, True, "content" if named or rng.random() < 0.3 else None)
        if named and tag != "td" and "class" not in self.out[-1] and "id=" not in self.out[-1]:
            self.out[-1] = f'<{tag} class="{self.token("content")}">'
        inner = rng.choice([None, None, None, "div", "section"])
        if inner:
            self.open(inner, True, rng.choice([None, "content"]))
        if rng.random() < 0.8:
            self.leaf("h1", self.words(1, 12), True)
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 15])):
            r = rng.random()
            if r < 0.66:
                text = self.sentences(1, 7) if rng.random() < 0.85 else self.words(1, 4) + rng.choice(["", "."])
                if rng.random() < 0.15:
                    text = f"{self.words(1, 5)} {self.link(self.words(1, 3))} {text}"
                if rng.random() < 0.1:
                    text = f"<b>{text}<br>"
                self.leaf("p", text, True)
            elif r < 0.72:
                self.leaf(rng.choice(["h2", "h3"]), self.words(1, 7), True)
            elif r < 0.78:
                own = rng.choice(["ul", "ol"])
                self.open(own, True)
                for _ in range(rng.randint(1, 6)):
                    self.leaf("li", self.words(1, 14), True)
                self.close(own)
            elif r < 0.82:
                self.open("blockquote", True)
                self.leaf("p", self.sentences(1, 3), True)
                self.close("blockquote")
            elif r < 0.85:
                self.open("figure", True)
                self.out.append('<img src="x">')
                self.leaf("figcaption", self.words(2, 9), True)
                self.close("figure")
            elif r < 0.88:
                self.open("table", True)
                for _ in range(rng.randint(1, 4)):
                    self.open("tr", True)
                    for _ in range(rng.randint(1, 3)):
                        self.leaf("td", self.words(1, 4), True)
                    self.close("tr")
                self.close("table")
            elif r < 0.91:
                self.leaf(rng.choice(["pre", "div"]), self.sentences(1, 3), True)
            else:
                self.noise(True)
        if inner:
            self.close(inner)
        if rng.random() < 0.3:
            self.noise(True)
        if tag:
            self.close(tag)

    def page(self) -> str:
        rng = self.rng
        self.out.append("<!DOCTYPE html><html><head><title>x</title><script>var a='</p>';</script></head>")
        self.open("body", False)
        self.main_tag = rng.choice(["article", "article", "article", "article", "main", "div", "div", "section", "td", "", ""])
        wraps = [rng.choice(["div", "div", "section"]) for _ in range(rng.choice([0, 0, 1, 2]))]
        for _ in range(rng.randint(0, 3)):
            self.noise(False)
        for w in wraps:
            self.open(w, False)
            for _ in range(rng.choice([0, 0, 1])):
                self.noise(False)
        cells = rng.random() < 0.1
        self.main()
        for w in reversed(wraps):
            for _ in range(rng.choice([0, 1, 1])):
                self.noise(False)
            self.close(w)
        for _ in range(rng.randint(0 if not cells else 1, 3)):
            self.noise(False)
        return "".join(self.out) + "</body></html>"


def pages(n: int = PAGES, seed: int = 3) -> list[tuple[str, list[tuple[str, bool]]]]:
    """Pages and, for their elements that the maker opened in turn, the name and whether it is main text."""
    out = []
    for k in range(n):
        m = Maker(random.Random(f"{seed}-{k}"))
        page = m.page()
        out.append((page, m.truth))
    return out
