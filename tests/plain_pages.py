"""The page walk over a tree, element by element: what the joins and scans of the engine have to give."""

from __future__ import annotations

from dataclasses import dataclass
from html.parser import HTMLParser

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


@dataclass(slots=True)
class Node:
    name: str
    children: list
    parent: object = None

    def text(self) -> str:
        """All text pieces, each trimmed, joined without a space."""
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x.strip())
            else:
                todo.extend(reversed(x.children))
        return "".join(out)

    def find_all(self, names: set[str]) -> list[Node]:
        out, todo = [], [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            x = todo.pop()
            if x.name in names:
                out.append(x)
            todo.extend(c for c in reversed(x.children) if isinstance(c, Node))
        return out


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", [])
        self.cut = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _ENDS_P or tag in ("li", "tr", "td", "th", "dd", "dt"):
            names = {"p"} if tag in _ENDS_P else {tag}
            x = self.at
            while x.name != "#root" and x.name not in ("ul", "ol", "table", "div", "section", "article") and x.name not in names:
                x = x.parent
            if x.name in names:
                self.at = x.parent
        node = Node(tag, [], self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        x = self.at
        while x.name not in ("#root", tag):
            x = x.parent
        if x.name == tag:
            self.at = x.parent

    def handle_data(self, data: str) -> None:
        """A run of text is one piece, also where the parser hands a lone bracket on its own."""
        if self.at.name not in ("script", "style"):
            if self.at.children and isinstance(self.at.children[-1], str) and not self.cut:
                self.at.children[-1] += data
            else:
                self.at.children.append(data)
            self.cut = False

    def handle_comment(self, data: str) -> None:
        self.cut = True


def tree(html: str) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def section_elements(root: Node, header: str, tag: str = "h2") -> list[Node]:
    """Elements after the first header that contains the text, up to the next header beside it."""
    for h in root.find_all({tag}):
        if header.lower() in h.text().lower():
            beside = h.parent.children
            after = [x for x in beside[next(i for i, x in enumerate(beside) if x is h) + 1 :] if isinstance(x, Node)]
            stop = next((i for i, x in enumerate(after) if x.name == tag), len(after))
            return after[:stop]
    return []


def participant_lines(elements: list[Node]) -> list[str]:
    """Texts of 4 to 149 characters of paragraphs, items and bold parts, then of each element itself if it is new."""
    out: list[str] = []
    for el in elements:
        for child in el.find_all({"p", "li", "strong"}) or [el]:
            if 3 < len(x := child.text()) < 150:
                out.append(x)
        if 3 < len(x := el.text()) < 150 and x not in out:
            out.append(x)
    return out


def labelled_elements(elements: list[Node], label: str = "strong") -> list[tuple[bool, str | None, str]]:
    """(is a speaker's label, label, text) in order; wrappers are opened one level.

    What follows the label in its own element is a text after it. Validity follows the label's length and full stops.
    """
    flat = []
    for el in elements:
        flat += [c for c in el.children if isinstance(c, Node)] if el.name in ("div", "section", "article") else [el]
    out: list[tuple[bool, str | None, str]] = []
    for el in flat:
        text = el.text()
        if not text:
            continue
        bold = el.find_all({label})
        if (bold and len(text) < 200 and el.name in ("p", "div")) or el.name == label:
            name = bold[0].text() if bold else text
            if name and len(name) < 120 and name.count(".") <= 1:
                out.append((True, name, text.replace(name, "").strip() if bold else ""))
                continue
        out.append((False, None, text))
    return out
