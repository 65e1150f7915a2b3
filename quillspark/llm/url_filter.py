"""URL allow and block lists as a trie over reversed host labels and path segments."""

from __future__ import annotations

import uuid
from bisect import bisect_left
from dataclasses import dataclass, field

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules of one broadcast trie at most; a longer list is applied in parts, of which the best match wins.
MAX_RULES = 2_000_000
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(slots=True)
class Node:
    labels: dict[str, Node] = field(default_factory=dict)
    segments: dict[str, Node] = field(default_factory=dict)
    #: Rules that end here: what the rest of the path has to start with, and the rule and its verdict.
    rests: dict[str, tuple[str, str]] = field(default_factory=dict)
    #: Lengths of the rests, longest first: a rest is looked up by its length, however many there are.
    sizes: list[int] = field(default_factory=list)


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path; both empty for null or without ``://``."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    end = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    slash = rest.find("/", 0, end)
    slash = end if slash < 0 else slash
    return rest[:slash].translate(_LOWER), rest[slash:end]


class UrlTrie:
    """Rules ``host/path`` with a verdict each; a rule fits its host and all subdomains where the path starts as its own.

    The rule with most host labels wins, then the longest path; of equal rules the one that blocks.
    """

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        self.root = Node()
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.labels.setdefault(label, Node())
            *whole, rest = (slash + path).split("/")
            for segment in whole:
                node = node.segments.setdefault(segment, Node())
            if node.rests.get(rest, ("", ""))[1] != "block":
                if rest not in node.rests:
                    at = bisect_left(node.sizes, -len(rest), key=lambda n: -n)
                    if node.sizes[at : at + 1] != [len(rest)]:
                        node.sizes.insert(at, len(rest))
                node.rests[rest] = (rule, verdict)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        best, node = None, self.root
        if not host:
            return None
        parts = path.split("/")
        for label in reversed(host.split(".")):
            node = node.labels.get(label)
            if node is None:
                break
            best = self._path(node, parts) or best
        return best

    @staticmethod
    def _path(node: Node, parts: list[str]) -> tuple[str, str] | None:
        """The longest rule below ``node`` that the path, split at its slashes, starts with."""
        found = None
        for k, part in enumerate(parts):
            for n in node.sizes[bisect_left(node.sizes, -len(part), key=lambda n: -n) :]:
                if part[:n] in node.rests:
                    found = node.rests[part[:n]]
                    break
            node = node.segments.get(part) if k < len(parts) - 1 else None
            if node is None:
                break
        return found


#: Rules of the tries that a worker holds at most, besides the one in use: those used longest ago go first.
HELD_RULES = 4 * MAX_RULES
#: Tries of this worker and their numbers of rules, by their list and its part: built once a worker, not once a task.
_tries: dict[tuple[str, int], tuple[UrlTrie, int]] = {}


def _trie(name: str, part: int, rules: Broadcast) -> UrlTrie:
    own = _tries.pop((name, part), None)
    if own is None:
        own = UrlTrie(rules.value), len(rules.value)
        while _tries and own[1] + sum(n for _, n in _tries.values()) > HELD_RULES:
            del _tries[next(iter(_tries))]
    _tries[name, part] = own
    return own[0]


def judge_urls(df: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", default: str = "allow", part: int = MAX_RULES) -> DataFrame:
    """``df`` with a struct ``judged`` (host, path, rule, verdict) for each row.

    Null, empty and malformed urls have no host and get the ``default`` verdict with a null rule. Rows keep their other
    columns; one named ``judged`` is replaced. ``part``: rules of one trie at most.
    """
    name = uuid.uuid4().hex
    columns = [_judged(df, rules[i : i + part], F.col(url_col), name, i) for i in range(0, max(1, len(rules)), part)]
    best = columns[0] if len(columns) == 1 else F.greatest(*columns)
    own = df.withColumn("judged", best)
    fields = ["host", "path", "rule"]
    return own.withColumn("judged", F.struct(*[F.col(f"judged.{c}").alias(c) for c in fields], F.coalesce("judged.verdict", F.lit(default)).alias("verdict")))


def _judged(df: DataFrame, rules: list[tuple[str, str]], url: F.Column, name: str, part: int) -> F.Column:
    """Rank of the best rule (labels, path length, whether it blocks; null without one), then host, path, rule, verdict."""
    shared = df.sparkSession.sparkContext.broadcast(rules)

    @F.pandas_udf("labels int, length int, blocks int, host string, path string, rule string, verdict string")
    def judged(urls: pd.Series) -> pd.DataFrame:
        trie, out = _trie(name, part, shared), []
        for url in urls:
            host, path = split_url(url)
            rule, verdict = trie.match(host, path) or (None, None)
            own, slash, rest = (rule or "").partition("/")
            rank = (0, 0, 0) if rule is None else (1 + own.count("."), len(slash + rest), int(verdict == "block"))
            out.append((*rank, host, path, rule, verdict))
        return pd.DataFrame(out, columns=["labels", "length", "blocks", "host", "path", "rule", "verdict"])

    return judged(url)
