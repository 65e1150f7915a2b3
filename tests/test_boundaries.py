"""Learnt sentence boundaries against a plain version over lists, and on texts whose boundaries are known."""

import math
import os
import re
from collections import Counter

import pytest

from quillspark.functions import text as t
from quillspark.operators import boundaries as b

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\s\x1c-\x1f]+")


def bare(word):
    out = re.sub(r"^[\W_]+", "", word)
    return re.sub(r"[^\w.!?]+$|_+$", "", out)


def kind(word):
    own = re.sub(r"[.!?]+$", "", bare(word)).lower()
    return b.NUMBER if re.match(r"^[0-9][0-9.,\-]*$", own) else own


def first_is(word, test):
    return bool(bare(word)) and test(bare(word)[0])


def ll(pairs):
    return sum(0.0 if n <= 0 else n * math.log(max(p, 1e-300)) for n, p in pairs)


def ratio(k, first, second, n):
    p, p1, p2 = second / n, k / first, (second - k) / max(n - first, 1)
    like = lambda q1, q2: ll([(k, q1), (first - k, 1 - q1), (second - k, q2), (n - first - second + k, 1 - q2)])
    return -2 * (like(p, p) - like(p1, p2))


def special(w):
    return w == b.NUMBER or (len(w) == 1 and w.isalpha())


def plain(texts):
    """Positions of the words of each text whose stop ends no sentence."""
    docs = [[w for w in SPACE.split(x or "") if w] for x in texts]
    n, dots, lower, inside = Counter(), Counter(), Counter(), Counter()
    stops = lambda w: w.endswith(".") and not w.endswith("..")
    for ws in docs:
        for i, w in enumerate(ws):
            k = kind(w)
            if k:
                n[k] += 1
                dots[k] += stops(w)
                lower[k] += first_is(w, str.islower)
                inside[k] += first_is(w, str.isupper) and i > 0 and not re.search(r"[.!?][\W\d_]*$", ws[i - 1])
    total = sum(n.values())
    chance = min(max(sum(dots.values()) / max(total, 1), 1e-12), 1 - 1e-12)
    short = set()
    for w, c in dots.items():
        size = len(w.replace(".", ""))
        like = lambda p: c * math.log(p) + (n[w] - c) * math.log(1 - p)
        if c and re.search(r"[^\W\d_]", w) and not special(w):
            if -2 * (like(chance) - like(b.SURE)) * math.exp(-size) * (len(w) - size + 1) * max(size, 1) ** -(n[w] - c) >= b.ABBREVIATION:
                short.add(w)
    starts, pairs = Counter(), Counter()
    for ws in docs:
        for w, x in zip(ws, ws[1:]):
            k, f = kind(w), kind(x)
            if stops(w) and k and f:
                if k in short or special(k):
                    pairs[k, f] += 1
                else:
                    starts[f] += 1
    ends = sum(starts.values()) or 1
    starters = {w for w, c in starts.items() if c / ends > n[w] / total and ratio(c, ends, n[w], total) >= b.STARTER}
    fixed = {p for p, c in pairs.items() if c > 1 and c / n[p[0]] > n[p[1]] / total and ratio(c, n[p[0]], n[p[1]], total) >= b.COLLOCATION}
    out = []
    for ws in docs:
        own = set()
        for i, (w, x) in enumerate(zip(ws, ws[1:])):
            k, f = kind(w), kind(x)
            if not (stops(w) and k and f and (k in short or special(k))):
                continue
            up, down = first_is(x, str.isupper), first_is(x, str.islower)
            if (k, f) in fixed and f not in starters:
                join = True
            elif k in short:
                join = not (up and (f in starters or (lower[f] > 0 and inside[f] == 0)))
            else:
                join = down or (len(k) == 1 and up and lower[f] == 0)
            if join:
                own.add(i)
        out.append((ws, own))
    return out, short


def plain_sentences(ws, own):
    out = [[]]
    for i, w in enumerate(ws):
        out[-1].append(w)
        if re.search(r"[.!?]$", w) and i not in own:
            out.append([])
    return [" ".join(s) for s in out if s]


TEXTS = [
    "The firm earns U.S. revenue every year. It sells in the U.S. and abroad.",
    "Mr. Miller of Dr. Smith said so. Then he left. The house was dark.",
    "Growth of U.S. sales was high. Mr. Jones agreed. Prof. Brown did not.",
    "We met on 3. May in Bern. Nothing happened there. The end was near!",
    "J. Miller wrote it. Who knows? Nobody knows. We paid approx. three dollars.",
    "Costs were approx. four dollars. Mr. Miller paid. The bank paid approx. two.",
]


def corpus():
    """The texts whose boundaries are known, and others in which their words also come without a stop."""
    calm = "the market was calm every year so it said they left abroad in dark and high times, agreed to what bern did not and was near; he wrote and knows there is nothing, two and three and four dollars happened, it knows then"
    filler = [f"{calm} in week number {i} and the price was low. Then the river rose. It paid approx. {i} coins of U.S. make to Mr. Miller and Dr. Smith of Prof. Brown. They sold the house" for i in range(60)]
    return TEXTS * 3 + filler


@pytest.mark.parametrize("texts", ["made", "table"])
def test_boundaries_are_the_plain_ones(spark, texts):
    if texts == "table":
        if not os.path.isdir(SF):
            pytest.skip("no test tables")
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    else:
        rows = list(enumerate([*corpus(), None, "", "  ", ".", "a."]))
    df = spark.createDataFrame(rows, "i long, text string")
    model = b.learn(df)
    want, short = plain([x for _, x in rows])
    assert {r.word for r in model.words.where("abbreviation").collect()} == short
    got = {r.i: r.sentences for r in b.split(df, model, longer_than=0).collect()}
    for (i, _), (ws, own) in zip(rows, want):
        assert got[i] == plain_sentences(ws, own), i
    shuffled = {r.i: r.sentences for r in b.split(df, b.learn(df, broadcast=0), longer_than=0).collect()}
    assert shuffled == got


def test_more_right_than_the_rule(spark):
    """Of the known boundaries of the made texts the rule gets many wrong, the learnt ones none."""
    df = spark.createDataFrame(list(enumerate(corpus())), "i long, text string")
    rows = b.split(df, b.learn(df), longer_than=0).withColumn("rule", t.sentences(df["text"], 0)).where(f"i < {len(TEXTS)}").collect()
    truth = {0: 2, 1: 3, 2: 3, 3: 3, 4: 4, 5: 3}
    assert sum(len(r.rule) != truth[r.i] for r in rows) >= 5
    assert {r.i: len(r.sentences) for r in rows} == truth
    first = next(r for r in rows if r.i == 0)
    assert first.sentences[0] == "The firm earns U.S. revenue every year."


def test_parse_with_boundaries(spark):
    from quillspark.plans import pipeline

    from .test_transcripts import PAGE

    df = spark.createDataFrame(list(enumerate(corpus())), "i long, text string")
    raw = spark.createDataFrame([("AB_2024-01-15_Q1-2024.html", PAGE)], "name string, html string")
    plain_row, row = pipeline.parse(raw).first(), pipeline.parse(raw, boundaries=b.learn(df)).first()
    assert row.sentence_count == plain_row.sentence_count > 0
