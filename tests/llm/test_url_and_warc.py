import hashlib
import io
import random
import time

import pytest

from quillspark.llm import url_filter, warc
from quillspark.llm.queries import URL_RULES


def plain_match(rules, host, path):
    best = None
    for rule, verdict in rules:
        h, slash, p = rule.partition("/")
        if host and (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            rank = (h.count("."), len(slash + p))
            if best is None or rank > best[0] or rank == best[0] and verdict == "block":
                best = rank, (rule, verdict)
    return best and best[1]


def test_trie_against_all_rules():
    rng = random.Random(4)
    labels, paths = ["a", "b", "com", "net"], ["", "/", "/x", "/x/", "/x/y", "/xy/", "//", "/x/y/z"]
    for _ in range(40):
        rules = list({".".join(rng.choices(labels, k=rng.randint(1, 3))) + rng.choice(paths): rng.choice(["allow", "block"]) for _ in range(8)}.items())
        trie = url_filter.UrlTrie(rules)
        for _ in range(60):
            host, path = ".".join(rng.choices(labels, k=rng.randint(1, 4))), rng.choice(paths) + rng.choice(["", "q", "/x"])
            assert trie.match(host, path) == plain_match(rules, host, path)


def test_many_rules_below_one_slash():
    """The time of a match does not grow with the rules of one host."""
    times = []
    for n in (100, 100_000):
        trie = url_filter.UrlTrie([(f"a.com/p{i}", "block") for i in range(n)] + [("a.com/p", "allow")])
        begun = time.perf_counter()
        for i in range(2000):
            assert trie.match("x.a.com", f"/p{i % n}/q")[0] == f"a.com/p{i % n}"
            assert trie.match("a.com", "/pq") == ("a.com/p", "allow")
        times.append(time.perf_counter() - begun)
    assert times[1] < 10 * times[0] + 0.1


def test_judge(spark):
    urls = {
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no-scheme.net/x": ("", "", None, "allow"),
        "http://A.NET": ("a.net", "", None, "allow"), "http://a.net/": ("a.net", "/", "net/", "block"), "http://a.net?x=/": ("a.net", "", None, "allow"),
        "https://www.Example.net/en/1#t": ("www.example.net", "/en/1", "example.net/en/", "allow"), "http://xexample.com/de/": ("xexample.com", "/de/", None, "allow"),
        "s://example.com/de/a?b#c": ("example.com", "/de/a", "example.com/de/", "block"), "http://É.org/fr/://x": ("É.org", "/fr/://x", "org/fr/", "allow"),
        "http://a.net#/en": ("a.net", "", None, "allow"), "http:///p": ("", "/p", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)] + [(0, "", 2)], "page_id long, url string, judged int")
    for part in (url_filter.MAX_RULES, 1, 3):
        got = url_filter.judge_urls(df, URL_RULES, part=part)
        assert got.columns == df.columns and {r.url: tuple(r.judged) for r in got.collect()} == urls
    assert {r.judged.verdict for r in url_filter.judge_urls(df, []).collect()} == {"allow"}
    assert url_filter.judge_urls(df.limit(0), URL_RULES).count() == 0


def test_tries_of_several_lists_stay(monkeypatch):
    """Lists that take turns are built once each; beyond the bound those used longest ago go."""
    class Rules:
        def __init__(self, n):
            self.value = [(f"h{i}.com/", "block") for i in range(n)]

    monkeypatch.setattr(url_filter, "_tries", {})
    lists = {name: Rules(30) for name in "abc"}
    first = {name: url_filter._trie(name, 0, r) for name, r in lists.items()}
    assert all(url_filter._trie(name, 0, lists[name]) is first[name] for name in "abcabc")
    monkeypatch.setattr(url_filter, "HELD_RULES", 70)
    assert url_filter._trie("d", 0, Rules(30)) is not None and [k for k, _ in url_filter._tries] == ["c", "d"]
    assert url_filter._trie("c", 0, lists["c"]) is first["c"] and url_filter._trie("e", 0, Rules(500)).match("h7.com", "/")
    assert [k for k, _ in url_filter._tries] == ["e"]


PAGES = [(1, "http://a/\r\nx y", "é" * 60), (2, None, "é" * 60), (3, "u", "é" * 60), (4, "u", "x" * 99), (5, "u", "x" * 99), (6, "u", None), (7, "u", ""), (8, None, "\r\n\r\n" * 40), (None, "n", "é" * 60), (1, "again", "é" * 60), (None, "n", "q" * 200), (None, "n", "q" * 200)]


def test_round_trip(spark):
    df = spark.createDataFrame([(*p, "d") for p in PAGES], "page_id long, url string, html string, digest string")
    manifest = warc.write_archives(df)
    got = warc.read_archives(manifest, payloads=True).collect()
    first = {}
    for i, _, h in PAGES:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        to = first.get(h) if len(b) >= 100 and i != first.get(h) else None
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if to else "response", to, b"" if to else b))
    key = lambda rows: sorted(map(repr, rows))
    assert key((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got) == key(want)
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def archive(records):
    sink = io.BytesIO()
    w = warc.ArchiveWriter(sink, warc.train_dictionary([]))
    for r in records:
        w.write(r)
    return sink.getvalue()


def record(payload=b"abc" * 50):
    return warc.build_record(1, "u", payload, hashlib.sha256(payload).hexdigest(), None)


def test_reader_validates():
    good = record()
    big = record(bytes(range(256)) * 9000)
    assert list(warc.read_archive(io.BytesIO(archive([good, big, good])), step=777)) == [good, big, good]
    data = archive([good])
    for bad in (b"", data[:6], data[40:], data[:30], data[:-3], data[:-30] + b"\0" * 30):
        with pytest.raises(warc.WarcError):
            assert list(warc.read_archive(io.BytesIO(bad))) != [good]
            raise warc.WarcError
    for frame in (good[:-1], good + b"x", good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date: ", b"X-Date: "), good.replace(b"abcabc", b"abcabd", 1), good.replace(b"Content-Length: 150", b"Content-Length: 151"), good.replace(b"Type: response", b"Type: revisit")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(frame)
