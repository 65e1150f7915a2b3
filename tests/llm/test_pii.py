import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from quillspark.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def cases():
    rng = random.Random(4)
    card = lambda: next(c for c in iter(lambda: "".join(rng.choices("0123456789", k=rng.choice([12, 13, 16, 19, 20]))), "") if luhn(c))
    parts = ["a.b@c.de", "@", "x@y", "x@foo.bar_baz@q.com", "a@b.c.d@e.f", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "001.02.3.0255", "0.0.0.0", "+1 (444) 555-3382", "+1", "+12 ", "+1 23.45-67 89)", "+123456789012345678", "(212) 555-0199", "212-555-0199", "bob [at] example (dot) com", "é𝄞ü", "\n", " ", ",", "phone ", "card: ", "5", "12-34", "v1.2.3.4"]
    out = [None, "", "𝄞 a@b.co 𝄞 1.2.3.4", "1" * 3000, "1 " * 9000 + "x", "a" * 50_000 + "@b.c", ".".join(["1"] * 4000), "+1" * 2000, "+" + "1(" * 4000 + "1", "@" * 999]
    for _ in range(250):
        out.append(rng.choice(["", " "]).join(rng.choice(parts) if rng.random() < 0.8 else rng.choice(["", "-", " "]).join(card()) for _ in range(rng.randint(1, 12))))
    out += ["".join(rng.choices("01+-.@ a(", k=rng.randint(1, 60))) for _ in range(400)]
    return out


def test_base_spans_are_the_plain_patterns(spark):
    texts = cases()
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, "a@b.co", "c"), (2, "a@b.co", "c")], "doc_id long, text string, email string")
    found = pii.personal_data(df)
    rows = found.collect()
    assert len(rows) == len(texts) + 2
    seen = set()
    for r in rows:
        base = [(k, x.s, x.e) for k in pii.KINDS for x in r[k] if x.base]
        if r.id is not None and r.id != 2:
            assert base == plain(texts[r.id]), texts[r.id][:99]
        every = [(x.s, x.e, x.base) for k in pii.KINDS for x in r[k]]
        for s, e, b in every:
            if not b:
                assert all(e <= s2 or e2 <= s for s2, e2, b2 in every if b2)
        for k in pii.KINDS:
            assert list(r[k]) == sorted(r[k])
        seen |= {k for k in pii.KINDS for x in r[k] if not x.base}
    assert pii.personal_data(df.limit(0)).count() == 0


def test_classifier_learns_from_votes(spark):
    """Loose spans whose votes agree with those of true ones are taken; those that all labelers doubt are not."""
    good = [(i, f"My phone is (212) 555-01{i:02d}. Mail a{i}@b.com and call +1 212 555 01{i:02d}.") for i in range(40)]
    bad = [(100 + i, f"version 1.2.3.{300 + i} and order#{4111111111111112 + i}x") for i in range(40)]
    rows = {r.id: r for r in pii.personal_data(spark.createDataFrame(good + bad, "doc_id long, text string")).collect()}
    assert all([(x.s, x.e) for x in rows[i].phone if not x.base] == [(12, 26)] for i in range(40))
    assert not any(x for i in range(40) for k in pii.KINDS for x in rows[100 + i][k] if not x.base)


def test_query_digests(spark, tmp_path):
    texts = cases()
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op4_pii(spark, str(tmp_path)).collect():
        base = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in base) for k in pii.KINDS]
        spans = [tuple(x.split(":")) for x in r.spans.split(",") if x]
        assert {(k, str(a), str(b)) for k, a, b in base} <= set(spans)
        assert spans == sorted(spans, key=lambda x: (pii.KINDS.index(x[0]), int(x[1])))


def test_redact(spark):
    df = spark.createDataFrame([(1, "é a@b.co, 1.2.3.4!"), (2, "none"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(df, pii.personal_data(df)).collect()}
    assert got == {1: "é <email>, <ip>!", 2: "none", 3: None}


def test_no_python_in_plans(spark):
    df = spark.createDataFrame([(1, "a@b.co")], "doc_id long, text string")
    for plan in (pii.candidates(df), pii.personal_data(df).select(F.sha2(F.col("email").cast("string"), 256))):
        assert not re.search("Python|Arrow|Pandas", plan._jdf.queryExecution().executedPlan().toString())


LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9A-Za-z+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}


def plain_spans(text, taken):
    """All spans: the base ones, then taken matches clear of them, then taken loose matches clear of those of their kind.

    ``taken`` tells which (kind, source, start, end) the classifier takes.
    """
    base = plain(text)
    clear = lambda s, e, others: all(e <= a or b <= s for a, b in others)
    out = []
    for kind, pattern in PLAIN.items():
        own = [(a, b) for k, a, b in base if k == kind]
        every = [(a, b) for _, a, b in base]
        matches = [(m.start(), m.end()) for m in re.finditer(pattern, text or "")]
        found = [x for x in matches if x not in own and (kind, "found", *x) in taken and clear(*x, every)]
        loose = [(m.start(), m.end()) for m in re.finditer(LOOSE[kind], text or "")] if kind in LOOSE else []
        loose = [x for x in loose if (kind, "loose", *x) in taken and clear(*x, every) and clear(*x, found)]
        out += [(kind, *x) for x in sorted(own + found + loose)]
    return out


def test_all_spans_against_a_plain_version(spark):
    extra = [f"mail a.b [at] c{i}.de or {i}.b@c.de (212) 555-0{i:03d} 300.1.1.{i} +12 1.2.3.4 x (at) y.z@q.com tel 212 555 0{i:03d}" for i in range(60)]
    texts = cases() + extra
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.table(pii.candidates(df), "spans")
    accepted = set(pii.accepted_traits(found))
    assert accepted and any("loose" in t for t in accepted)
    taken = {}
    for r in found.collect():
        taken[r.id] = {(k, src, x.s, x.e) for k in pii.KINDS for src in ("found", "loose") if f"{k}_{src}" in found.columns for x in r[f"{k}_{src}"] if x.traits in accepted}
    more = 0
    for r in pii.personal_data(df).collect():
        got = [(k, x.s, x.e) for k in pii.KINDS for x in r[k]]
        assert got == plain_spans(texts[r.id], taken[r.id]), texts[r.id][:99]
        more += len(got) - len(plain(texts[r.id]))
    assert more > 60


def test_classifier_reads_traits():
    """Traits of spans that the votes believe are taken, unseen combinations of them too."""
    rows = {"phone|loose|m|011|0|x|3|x": (50, 0.95), "phone|loose|m|010|0|0|3|x": (50, 0.9), "phone|loose|m|010|1|0|5|a": (50, 0.05), "ip|found|s|100|0|0|2|x": (80, 0.02)}
    weights = pii.classifier(rows)
    assert all((pii.probability(weights, t) >= 0.5) == (y > 0.5) for t, (_, y) in rows.items())
    assert pii.probability(weights, "phone|loose|m|011|0|0|3|x") > 0.5 > pii.probability(weights, "ip|found|s|100|1|0|2|x")


def test_time_grows_with_the_spans(spark):
    """50,000 addresses in one document end in seconds; so do as many matches that are no base spans beside them."""
    took = []
    for n in (5_000, 50_000):
        text = " ".join(f"user{i}@host{i}.org 300.1.{i}.9" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        begun = time.perf_counter()
        [r] = pii.personal_data(df).select(F.size("email").alias("n"), F.sha2(F.col("email").cast("string"), 256)).collect()
        took.append(time.perf_counter() - begun)
        assert r.n == n
    assert took[1] < 30 and took[1] < 20 * took[0] + 5, took
