"""Personal data by aggregated weak supervision, in DataFrame expressions only.

Patterns propose spans; a regex, a gazetteer, a context and a shape labeler vote on each. Votes are counted by their
pattern, a bounded table, from which expectation-maximisation estimates the labelers' reliabilities without labels.
The posteriors are the soft labels from which a logistic classifier learns the spans' own traits: length, separators,
repeated digits, first character, word before and character after. It decides on every span that the base patterns alone
would not give. Base spans always stay. The context labeler reads the CONTEXT characters before a span, but no further back
than the end of the match of the same pattern before it. Work grows in proportion to a document's spans, but for sorting.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, table

KINDS = ("email", "ip", "card", "phone")

# Patterns of the base spans. Possessive, and anchored where a run of characters begins, so each text is
# read once; they match what the plain patterns match.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Further candidates.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9A-Za-z+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
GUARD = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
LOOSE_GUARD = {"email": r"[\[(]at[\])]", "phone": r"[0-9]{3}[ .-][0-9]{4}"}
# Gazetteers of top-level domains, address blocks, issuer numbers and calling codes.
GAZETTEER = {
    "email": r"(?i)(?:\.|[\[(]dot[\])] ?)(?:com|org|net|edu|gov|int|info|biz|io|co|ai|app|dev|de|fr|es|it|nl|uk|us|eu|ch|at|be|pl|pt|se|no|dk|fi|ru|cn|jp|br|mx|in|au|ca)$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[4-9]|6011|62|65)",
    "phone": r"^\+?\(?(?:1|7|[2-9][0-9]{2}\)?[ .-][2-9]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
}
# Words before a span that speak for it, and against it.
FOR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|courriel|correo)\b",
    "ip": r"(?i)\b(?:ip|host|server|addr|address|adresse|client)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|téléphone|teléfono)\b",
}
AGAINST = r"(?i)(?:\b(?:version|ver|v|section|isbn|order|serial|invoice|hash|token|part)\W{0,3}|[=/_#])$"
#: Characters before a span that the context labeler reads; spans from which probability on are taken; rounds of EM.
CONTEXT, ACCEPT, ROUNDS = 40, 0.5, 40
#: Share of a kind's spans as which that belief counts.
TRUST = 0.2
LABELERS = ("regex", "gazetteer", "context", "shape")
#: Elements that one step of a scan copies at most, and how often blocks are taken of blocks.
SCAN_BLOCK, SCAN_LEVELS = 64, 3
#: Words before a span are told apart by so many values of a hash.
WORDS = 8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scan(values: Column, zero: int, merge: Callable[[Column, Column], Column], levels: int = SCAN_LEVELS) -> Column:
    """What ``merge`` makes of all elements before each one, in an array of ints; ``merge`` is associative.

    An array cannot be appended to without a copy, so blocks are scanned apart, and then the blocks' totals.
    """

    def plain(block: Column) -> Column:  # one longer than the block: its total comes last
        first = F.array(F.lit(zero)).cast("array<int>")
        return F.aggregate(block, first, lambda acc, x: F.concat(acc, F.array(merge(F.element_at(acc, -1), x))).cast("array<int>"))

    if levels == 1:
        return F.slice(plain(values), F.lit(1), F.size(values))

    def whole(v: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / SCAN_BLOCK).cast("int"))
        blocks = F.transform(places, lambda b: plain(F.slice(v, b * SCAN_BLOCK + 1, F.lit(SCAN_BLOCK))))
        return _let(blocks, lambda own: joined(own, _scan(F.transform(own, lambda x: F.element_at(x, -1)), zero, merge, levels - 1)))

    def joined(blocks: Column, before: Column) -> Column:
        return F.flatten(F.zip_with(blocks, before, lambda x, a: F.transform(F.slice(x, F.lit(1), F.size(x) - 1), lambda y: merge(a, y))))

    return _let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(v))


def _matches(text: Column, pattern: str) -> Column:
    """Every match with its code points [s, e) and the text around it: splits and matches come from the same search."""

    def placed(x: Column) -> Column:
        parts, found = x["parts"], x["found"]
        steps = F.transform(found, lambda m, i: F.length(parts[i]) + F.length(m))

        def one(m: Column, i: Column, at: Column) -> Column:
            before = parts[i]
            s = at[i] + F.length(before)
            near = F.substring(before, F.greatest(F.length(before) - (CONTEXT - 1), F.lit(1)), F.lit(CONTEXT))
            return F.struct(s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m"), near.alias("pre"), F.substring(parts[i + 1], 1, 1).alias("post"))

        return _let(_scan(steps, 0, lambda a, y: a + y), lambda at: F.transform(found, lambda m, i: one(m, i, at)))

    own = F.struct(F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return _let(own, placed)


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    return {
        "email": F.lit(True),
        "ip": match.rlike(rf"^{part}(?:\.{part}){{3}}$"),
        "card": F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False),
        "phone": F.length(digits).between(9, 15),
    }[kind]


def _voted(kind: str, loose: bool) -> Callable[[Column], Column]:
    """(s, e, base, votes, traits) of a match x: the votes as kind, source and a sign for each labeler, and the traits as
    kind, source and a letter for each of six."""

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, "+").when(no, "-").otherwise("0")

    def one(x: Column) -> Column:
        m, pre, post = x["m"], x["pre"], x["post"]
        valid = F.lit(False) if loose else _valid(kind, m)
        key = F.regexp_replace(m, "[^0-9]", "") if kind == "card" else m
        inside = pre.rlike(r"[A-Za-z0-9_]$") | post.rlike(r"^[A-Za-z0-9_]")
        votes = [
            F.lit("0") if loose else vote(valid, ~valid),
            vote(key.rlike(GAZETTEER[kind]), F.lit(True)),
            vote(pre.rlike(FOR[kind]), pre.rlike(AGAINST)),
            vote(~inside, F.lit(True)),
        ]
        word = F.lower(F.regexp_extract(pre, r"(\p{L}+)\P{L}*$", 1))
        has = lambda c: F.when(m.rlike(c), "1").otherwise("0")
        traits = [
            F.when(F.length(m) < 12, "s").when(F.length(m) < 20, "m").otherwise("l"),
            F.concat(has(r"\."), has(r"[ -]"), has(r"[(\[]")),
            has(r"([0-9])\1{3}"),
            F.when(m.rlike(r"^[A-Za-z]"), "a").when(m.rlike(r"^[0-9]"), "0").otherwise("x"),
            F.when(word == "", "-").otherwise(F.pmod(F.xxhash64(word), F.lit(WORDS)).cast("string")),
            F.when(post.rlike(r"^[A-Za-z0-9_]"), "a").when(post.rlike(r"^\s?$"), "s").otherwise("x"),
        ]
        source = f"{kind}|{'loose' if loose else 'found'}|"
        return F.struct(
            x["s"].alias("s"), x["e"].alias("e"), valid.alias("base"), F.concat(F.lit(source), *votes).alias("votes"), F.concat(F.lit(source), F.concat_ws("|", *traits)).alias("traits")
        )

    return one


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, and for each kind the voted matches of its patterns; one row per document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.array().cast("array<struct<s:int,e:int,base:boolean,votes:string,traits:string>>")
    columns = []
    for kind in KINDS:
        sources = [(BASE[kind], GUARD[kind], False)] + ([(LOOSE[kind], LOOSE_GUARD[kind], True)] if kind in LOOSE else [])
        for pattern, guard, loose in sources:
            has = F.contains(text, F.lit(guard)) if guard == "@" else text.rlike(guard)
            found = F.transform(_matches(text, pattern), _voted(kind, loose))
            columns.append(F.when(has, found).otherwise(none).alias(f"{kind}_{'loose' if loose else 'found'}"))
    return docs.select(F.col(id_col).alias("id"), *columns)


def reliabilities(counts: dict[str, int]) -> dict[str, dict]:
    """EM over vote patterns of each kind: prior and P(vote | personal or not) of every labeler, and posteriors."""
    out = {}
    for kind in KINDS:
        rows = [(p, p.split("|")[2], n) for p, n in sorted(counts.items()) if p.split("|")[0] == kind]
        if not rows:
            continue
        post = {p: 1 / (1 + math.exp(-1.5 * (v.count("+") - 2 * v.count("-")) - 1.5 * (v[0] == "+"))) for p, v, _ in rows}
        for _ in range(ROUNDS):
            total = sum(n for *_, n in rows)
            prior = (1 + sum(n * post[p] for p, _, n in rows)) / (2 + total)
            given = {}
            for k, name in enumerate(LABELERS):
                for y in (0, 1):
                    right = "+" if y else "-"  # a prior belief that labelers are better than chance keeps the classes' names
                    weight = {s: 0.5 + (s == right) * TRUST * total + sum(n * (post[p] if y else 1 - post[p]) for p, v, n in rows if v[k] == s) for s in "+-0"}
                    given[name, y] = {s: w / sum(weight.values()) for s, w in weight.items()}
            for p, v, _ in rows:
                odds = math.log(prior) - math.log(1 - prior)
                odds += sum(math.log(given[name, 1][v[k]]) - math.log(given[name, 0][v[k]]) for k, name in enumerate(LABELERS))
                post[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        out[kind] = {"prior": prior, "given": given, "posterior": post}
    return out


def _features(traits: str) -> list[str]:
    kind, source, *own = traits.split("|")
    return ["bias", kind, f"{kind} {source}"] + [f"{kind} {k} {v}" for k, v in enumerate(own)]


def classifier(rows: dict[str, tuple[int, float]], rounds: int = 200, rate: float = 2.0, ridge: float = 1e-3) -> dict[str, float]:
    """Logistic weights of the traits' features, fit to (spans, mean posterior); traits weigh as the root of their spans."""
    weights = dict.fromkeys((f for t in rows for f in _features(t)), 0.0)
    known = [(_features(t), y, math.sqrt(n)) for t, (n, y) in sorted(rows.items())]
    total = sum(w for *_, w in known)
    for _ in range(rounds):
        slope = {f: ridge * w for f, w in weights.items()}
        for names, y, w in known:
            e = w / total * (1 / (1 + math.exp(-sum(weights[f] for f in names))) - y)
            for f in names:
                slope[f] += e
        for f, s in slope.items():
            weights[f] -= rate * s
    return weights


def probability(weights: dict[str, float], traits: str) -> float:
    return 1 / (1 + math.exp(-sum(weights.get(f, 0.0) for f in _features(traits))))


def accepted_traits(found: DataFrame) -> list[str]:
    """Traits that the span classifier takes, learned from all spans of ``found``.

    Both tables that come to the driver are bounded whatever the number of spans: kinds x sources x 3^4 votes, and kinds
    x sources x 5184 traits.
    """
    spans = found.select(F.explode(F.concat(*[F.col(c) for c in found.columns if c != "id"])).alias("x"))
    counts = {r["votes"]: r["count"] for r in spans.groupBy(F.col("x.votes").alias("votes")).count().collect()}
    posterior = {p: q for k in reliabilities(counts).values() for p, q in k["posterior"].items()}
    if not posterior:
        return []
    belief = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(posterior.items()) for x in pair]), F.col("votes"))
    both = spans.groupBy(F.col("x.traits").alias("traits"), F.col("x.votes").alias("votes")).count()
    known = both.groupBy("traits").agg(F.sum("count").alias("n"), F.sum(belief * F.col("count")).alias("y"))
    rows = {r["traits"]: (r["n"], r["y"] / r["n"]) for r in known.collect()}
    weights = classifier(rows)
    return sorted(t for t in rows if probability(weights, t) >= ACCEPT)


def _clear(xs: Column, ys: Column) -> Column:
    """The spans of ``xs`` that overlap none of ``ys``, sorted: no end before is beyond their start, no start after before their end."""
    far = 2**31 - 1
    bare = lambda a, own: F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(own).alias("own")))

    def swept(every: Column) -> Column:
        ends = _scan(F.transform(every, lambda x: F.when(x["own"], 0).otherwise(x["e"])), 0, F.greatest)
        starts = _scan(F.reverse(F.transform(every, lambda x: F.when(x["own"], far).otherwise(x["s"]))), far, F.least)

        def kept(ends: Column, starts: Column) -> Column:
            free = F.filter(every, lambda x, i: x["own"] & (ends[i] <= x["s"]) & (starts[i] >= x["e"]))
            return F.transform(free, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))

        return _let(ends, lambda a: _let(F.reverse(starts), lambda b: kept(a, b)))

    plain = F.transform(xs, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    swept_all = _let(F.array_sort(F.concat(bare(xs, True), bare(ys, False))), swept)
    return F.when((F.size(xs) == 0) | (F.size(ys) == 0), plain).otherwise(swept_all)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, and arrays ``email``, ``ip``, ``card``, ``phone`` of (s, e, base), by start; one row per document.

    Null and empty texts have none. Ids may be null or repeated, and other columns are ignored. Further spans never
    overlap a base span of any kind, nor does one of the looser patterns overlap another span of its own kind.
    """
    found = table(candidates(docs, id_col, text_col), "spans")
    accepted = accepted_traits(found)
    base = F.concat(*[F.filter(f"{k}_found", lambda x: x["base"]) for k in KINDS])
    own = found.withColumn("_base", base)
    taken = lambda c: F.filter(c, lambda x: ~x["base"] & x["traits"].isin(accepted)) if accepted else F.slice(c, 1, 0)
    own = own.withColumns({f"_{c}": taken(c) for c in found.columns if c != "id"})
    own = own.select("id", *[f"{k}_found" for k in KINDS], *[_clear(F.col(f"_{c}"), F.col("_base")).alias(f"_{c}") for c in found.columns if c != "id"])
    out = []
    for kind in KINDS:
        spans = lambda a, b: F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(b).alias("base")))
        parts = [spans(F.filter(f"{kind}_found", lambda x: x["base"]), True), spans(F.col(f"_{kind}_found"), False)]
        if kind in LOOSE:
            parts.append(spans(_clear(F.col(f"_{kind}_loose"), F.col(f"_{kind}_found")), False))
        out.append(F.array_sort(F.concat(*parts)).alias(kind))
    return own.select("id", *out)


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``found`` (of unique ids) replaced by its kind in angle brackets."""
    named = lambda kind: F.transform(kind, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"<{kind}>").alias("k")))
    spans = F.concat(*[named(kind) for kind in KINDS])
    key, listed = fresh(docs, "_id", "_spans")
    own = found.select(F.col("id").alias(key), F.array_sort(spans).alias(listed))
    joined = docs.join(own, F.col(id_col) == F.col(key), "left")
    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        keep = F.substring(F.col(text_col), acc["pos"] + 1, F.greatest(x["s"] - acc["pos"], F.lit(0)))
        return F.struct(F.greatest(acc["pos"], x["e"]).alias("pos"), F.concat(acc["out"], keep, F.when(x["s"] >= acc["pos"], x["k"]).otherwise(F.lit(""))).alias("out"))

    done = F.aggregate(listed, zero, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), acc["pos"] + 1, F.length(text_col))))
    return joined.withColumn(text_col, F.when(F.size(listed) > 0, done).otherwise(F.col(text_col))).drop(key, listed)
