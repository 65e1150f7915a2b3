"""Features of the nodes that are kept or dropped, and hierarchical decoding of their scores."""

from __future__ import annotations

import re

import numpy as np

from .dom import INLINE, MATH, Tree

# Attribute tokens that tell what a part of a page is for.
LEXICON = {
    "advert": "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted commercial outbrain taboola dfp",
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs crumbs pagination pager tabs toolbar topbar sitemap toc skip",
    "comment": "comment comments commentlist discussion disqus reply replies respond response responses reader readers feedback guestbook thread",
    "sidebar": "sidebar side aside rail related recommended recommendation recommendations widget widgets trending popular more latest teaser teasers complementary",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay paywall newsletter subscribe subscription signup disclaimer warning banner legal",
    "share": "share sharing social facebook twitter follow tags tagcloud meta author byline",
    "form": "form login search signin register input contact",
    "top": "header masthead head logo brand branding hero",
    "bottom": "footer foot copyright colophon bottom contentinfo credits",
    "content": "article content contents main body text story post entry page prose articlebody maincontent copy",
    "hidden": "hidden hide invisible",
}
#: The one group that speaks for main text.
_GOOD = list(LEXICON).index("content")
_GROUP = {token: k for k, words in enumerate(LEXICON.values()) for token in words.split()}
GROUPS = len(LEXICON)
# Elements with a feature of their own.
TAGS = "p div article section main nav header footer aside form ul ol li table td th h1 h2 h3 h4 blockquote pre figure figcaption dl dd button label body html head fieldset details address menu dialog".split()
_TAG = {name: k for k, name in enumerate(TAGS)}
_ROLE = {"article": 1, "main": 1, "nav": -1, "header": -1, "footer": -1, "aside": -1, "form": -1, "menu": -1, "dialog": -1, "fieldset": -1, "button": -1, "label": -1, "head": -1, "address": -1}
_STOPS = re.compile(r"[.!?;:,…。]")

NUMERIC = [
    "depth", "children", "same siblings before", "same siblings", "elements below", "log characters", "own log characters", "link share", "stops per character", "characters per element",
    "words per block", "share of page", "place in page", "parent link share", "parent characters per element", "parent share of page", "role", "roles above good", "roles above bad", "tokens", "telling tokens", "telling tokens above", "beside an article",
]
FEATURES = len(TAGS) + 1 + 2 * GROUPS + len(NUMERIC)


def scored(tree: Tree) -> list[int]:
    """For every element its node: itself if it is no inline one, or one named like no content; else its parent's."""
    out = [0] * len(tree.tag)
    drawn = [False] * len(tree.tag)
    for i in range(1, len(out)):
        drawn[i] = drawn[tree.parent[i]] or tree.tag[i] in ("svg", "math")
        mine = tree.tag[i] not in INLINE and tree.tag[i] not in MATH and not drawn[i] or any(_GROUP.get(w, 9) in (0, 1, 2, 3, 4, 5) for w in tree.tokens[i]) and tree.tag[i] in ("span", "small")
        out[i] = i if mine else out[tree.parent[i]]
    return out


def features(tree: Tree, owner: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, their parents as row numbers or -1, features) in page order."""
    n = len(tree.tag)
    chars, links, stops, words, below = [0] * n, [0] * n, [0] * n, [0] * n, [1] * n
    own, blocks, last, place = [0] * n, [0] * n, [-1] * n, [0] * n
    seen = 0
    for element, block, text, link in tree.runs:
        size = len(text.strip())
        if not size:
            continue
        i = owner[element]
        own[i] += size
        chars[i] += size
        links[i] += size if link else 0
        stops[i] += len(_STOPS.findall(text))
        words[i] += text.count(" ") + 1
        if last[i] != block:
            last[i] = block
            blocks[i] += 1
    nodes = [i for i in range(n) if owner[i] == i]
    row = {i: k for k, i in enumerate(nodes)}
    up = [owner[tree.parent[i]] if i else -1 for i in range(n)]
    for i in nodes:
        place[i] = seen
        seen += own[i]
    children = [0] * n
    same: dict[tuple[int, str], int] = {}
    before = [0] * n
    for i in nodes[1:]:
        children[up[i]] += 1
        before[i] = same.get((up[i], tree.tag[i]), 0)
        same[up[i], tree.tag[i]] = before[i] + 1
    for i in range(n - 1, 0, -1):
        p = tree.parent[i] if owner[i] != i else up[i]
        below[p] += below[i]
    for i in reversed(nodes[1:]):
        for a in (chars, links, stops, words, blocks):
            a[up[i]] += a[i]
    total = max(1, chars[0])
    x = np.zeros((len(nodes), FEATURES), np.float32)
    good, bad, told, above = [0] * n, [0] * n, [0] * n, [0] * n
    leads = [0] * n  # 1: inside an article, or one is inside
    named = [i for i in nodes if _ROLE.get(tree.tag[i], 0) > 0 or "main" in tree.tokens[i]]
    for i in named:
        while i >= 0 and not leads[i]:
            leads[i] = 1
            i = up[i]
    inside = set(named)
    at = len(TAGS) + 1
    for k, i in enumerate(nodes):
        x[k, _TAG.get(tree.tag[i], len(TAGS))] = 1
        for w in tree.tokens[i]:
            if w in _GROUP:
                x[k, at + _GROUP[w]] = 1
        p = max(up[i], 0)
        if p in inside:
            inside.add(i)
            leads[i] = 1
        told[i] = sum(_GROUP.get(w, _GOOD) != _GOOD for w in tree.tokens[i])
        above[i] = above[p] + told[p] if i else 0
        role = _ROLE.get(tree.tag[i], 0)
        if i:
            q = row[up[i]]
            x[k, at + GROUPS : at + 2 * GROUPS] = np.maximum(x[q, at : at + GROUPS], x[q, at + GROUPS : at + 2 * GROUPS])
            good[i], bad[i] = good[p] + (_ROLE.get(tree.tag[p], 0) > 0), bad[p] + (_ROLE.get(tree.tag[p], 0) < 0)
        x[k, at + 2 * GROUPS :] = (
            tree.depth[i], children[i], before[i], same.get((up[i], tree.tag[i]), 1), below[i], np.log1p(chars[i]), np.log1p(own[i]), links[i] / max(1, chars[i]), stops[i] / max(1, chars[i]), chars[i] / below[i],
            words[i] / max(1, blocks[i]), chars[i] / total, place[i] / total, links[p] / max(1, chars[p]), chars[p] / below[p], chars[p] / total, role, good[i], bad[i], len(tree.tokens[i]), told[i], above[i], bool(named) and not leads[i],
        )
    parents = np.array([row[up[i]] if i else -1 for i in nodes])
    return np.array(nodes), parents, x


#: What the decoder pays for entering main text and for leaving it again.
SWITCH = 0.7
OUT, IN, CUT = 0, 1, 2


def decode(parents: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Which nodes are main text: the best labelling in which, from the root down, a node is outside, then in, then cut.

    A node in main text never has a part outside it above another part inside: below a cut node all is cut, and what
    is in hangs together up to its topmost node. ``odds`` are log odds that a node is main text.
    """
    n = len(parents)
    keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    best = np.stack([drop, keep, drop], 1).tolist()
    choice: list[tuple[int, int]] = [(OUT, IN)] * n
    for i in range(n - 1, 0, -1):
        p, b = parents[i], best[i]
        from_out = OUT if b[OUT] >= b[IN] - SWITCH else IN
        from_in = IN if b[IN] >= b[CUT] - SWITCH else CUT
        choice[i] = (from_out, from_in)
        best[p][OUT] += max(b[OUT], b[IN] - SWITCH)
        best[p][IN] += max(b[IN], b[CUT] - SWITCH)
        best[p][CUT] += b[CUT]
    state = [OUT] * n
    for i in range(1, n):
        above = state[parents[i]]
        state[i] = CUT if above == CUT else choice[i][above]
    return np.array(state) == IN
