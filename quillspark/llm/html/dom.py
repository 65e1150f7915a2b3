"""A tolerant parser that keeps what text extraction needs: elements, their attribute tokens, and runs of text."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Generator
from dataclasses import dataclass, field

# Element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noembed noframes textarea title xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark object option optgroup q rp rt ruby s samp select small span strike strong sub sup svg time tt u var wbr img".split())
MATH = frozenset("math annotation menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: A start tag that ends an open element of these names, up to the element in the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, {"html"}),
}
#: A tag whose attributes hold no angle bracket: a match reads no further than the next one.
_PLAIN = re.compile(r"""<(/?)([a-zA-Z][^\s/><]*+)([^<>"']*+(?:"[^"<>]*+"[^<>"']*+|'[^'<>]*+'[^<>"']*+)*+)>""")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_END = re.compile("[>\"']")
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop|aria-label)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?(?=[\s/"'>]|\Z)""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass
class Tree:
    """Elements in page order; element 0 is the root. A run of text knows its element and the block it belongs to."""

    tag: list[str] = field(default_factory=lambda: ["#root"])
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    tokens: list[list[str]] = field(default_factory=lambda: [[]])
    runs: list[tuple[int, int, str, bool]] = field(default_factory=list)  # element, block, text, inside a link


def attribute_tokens(attrs: str) -> list[str]:
    """Lower-case words of the attributes that tell what an element is for."""
    if not attrs or attrs.isspace():
        return []
    out = []
    for m in _ATTR.finditer(attrs):
        name = m[1].lower()
        value = entities.unescape(m[2] or m[3] or m[4] or "")
        if name == "style":
            out += ["hidden"] if "display:none" in value.replace(" ", "").lower() else []
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            out.append("hidden")
        else:
            out += [t.lower() for t in _TOKEN.findall(value)]
    return out


def tags(page: str) -> Generator[tuple[int, int, str, bool, str], int | None]:
    """(start, end, lower-case name, whether it ends an element, attributes) of tags; comments and others have no name.

    A quoted value may hold angle brackets; where a quote is left open, the tag ends at the next bracket. What is no tag is
    text. The end may be moved on by sending a place. Time is in proportion to the page.
    """
    at, last = 0, page.rfind(">")
    final = {q: page.rfind(q) for q in "\"'"}
    ends: dict[int, int] = {}  # where the tag ends in which a quote opens, 0 if a quote of it is left open

    def end_of(i: int) -> int:
        """The end of the tag that is read up to ``i``; 0 if a quote is left open. Each quote opens once, so no part is read again."""
        opened, end = [], 0
        while q := _END.search(page, i):
            if q[0] == ">":
                end = q.end()
                break
            if q.start() in ends:
                end = ends[q.start()]
                break
            opened.append(q.start())
            if q.end() > final[q[0]]:
                break
            i = page.find(q[0], q.end()) + 1
        ends.update(dict.fromkeys(opened, end))
        return end

    while True:
        lt = page.find("<", at)
        if lt < 0 or lt > last and not page.startswith("<!--", lt):
            lt = page.find("<!--", lt) if lt >= 0 else -1
            if lt < 0:
                return
        m = _PLAIN.match(page, lt)
        if m:
            end, found = m.end(), (m[2].lower(), bool(m[1]), m[3])
        elif page.startswith("<!--", lt):
            end, found = page.find("-->", lt + 4) + 3, ("", False, "")
            end = len(page) if end < 3 else end
        elif m := _NAME.match(page, lt):
            end = end_of(m.end()) or page.find(">", m.end()) + 1
            found = (m[2].lower(), bool(m[1]), page[m.end() : end - 1])
        elif page[lt + 1 : lt + 2] in ("!", "?", "/"):
            end, found = page.find(">", lt) + 1, ("", False, "")
        else:
            at = lt + 1
            continue
        moved = yield (lt, end, *found)
        at = end if moved is None else moved


def parse(page: str | None) -> Tree:
    """The tree of a page; an empty one for null. Every input gives a tree.

    Text in a list of choices is left out, as is the content of raw elements; that of formulas, pictures and objects stays.
    """
    t = Tree()
    page = page or ""
    stack, open_names, links, block = [0], {"#root": 1}, 0, 0
    places: dict[str, list[int]] = {}  # of the open elements of each name in the stack, the nearest last
    lower: str | None = None
    at = 0

    def inline(name: str) -> bool:
        return name in INLINE or name in MATH or bool(open_names.get("svg"))

    def pop() -> None:
        nonlocal links, block
        name = t.tag[stack.pop()]
        open_names[name] -= 1
        places[name].pop()
        links -= name == "a"
        block += not inline(name)

    def close(names: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        """End the open element of these names that is nearest, unless one of ``stop`` is nearer; and what is in it."""
        nearest = lambda of: max((places[n][-1] for n in of if places.get(n)), default=0)
        k = nearest(names)
        if k > nearest(stop):
            while len(stack) > k:
                pop()

    def text(data: str) -> None:
        if data and not open_names.get("select"):
            t.runs.append((stack[-1], block, entities.unescape(data) if "&" in data else data, links > 0))

    found = tags(page)
    tag = next(found, None)
    while tag:
        start, end, name, ends, attrs = tag
        text(page[at:start])
        at, moved = end, None
        if name == "br":
            text(" ")
        elif ends:
            if open_names.get(name):
                close({name}, frozenset())
            elif not inline(name):
                block += 1
        elif name:
            if name in CLOSES_P:
                if open_names.get("select"):
                    close({"select"}, frozenset())
                if open_names.get("p"):
                    close({"p"}, {"table", "td", "th", "button", "#root"})
            if name in ENDS:
                names, stop = ENDS[name]
                while any(open_names.get(n) for n in names) and (n := len(stack)):
                    close(names, stop)
                    if len(stack) == n:
                        break
            if name == "a" and links:
                close({"a"}, {"table", "td", "th"})
            if not inline(name):
                block += 1
            if name not in VOID:
                i = len(t.tag)
                t.tag.append(name)
                t.parent.append(stack[-1])
                t.depth.append(len(stack))
                t.tokens.append(attribute_tokens(attrs))
                if name in RAW:
                    lower = page.lower() if lower is None else lower
                    stop_at = lower.find(f"</{name}", at) if len(lower) == len(page) else -1
                    if stop_at < 0:
                        own = re.compile(f"</{re.escape(name)}", re.I).search(page, at)
                        stop_at = own.start() if own else len(page)
                    at = moved = page.find(">", stop_at) + 1 or len(page)
                    block += not inline(name)
                elif not attrs.endswith("/") or name not in ("svg", "math") and not open_names.get("svg") and not open_names.get("math"):
                    places.setdefault(name, []).append(len(stack))
                    stack.append(i)
                    open_names[name] = open_names.get(name, 0) + 1
                    links += name == "a"
        try:
            tag = found.send(moved)
        except StopIteration:
            tag = None
    text(page[at:])
    return t
