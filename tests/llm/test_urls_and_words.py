"""URL reputations, resampling towards a target, and spelling variants against brute force, on awkward rows too."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from factloom.llm import importance, spelling, url_filter

DOCS = "doc_id long, text string, name string, key long, word string, n string, score string"


def counted(rows):
    return Counter(tuple(r) for r in rows)


# --- URL filters

URLS = [
    (1, "HTTP://A.Example.ORG/es/x?q=/en/"), (2, "https://example.org/en/12#top"), (3, "http://www.site.com/fr"), (4, "http://www.site.com/fr/1"), (5, "https://u:p@shop.site.com:8080/de/1"),
    (6, "https://site.com"), (7, None), (8, ""), (9, "no scheme/at all"), (10, "x://://y/z"), (11, "http://10.0.0.1/a"), (12, "http://10.0.0.1:81/b"), (13, "ftp://a.b.co.uk./p"), (14, "http://org"),
    (15, "http://org/"), (16, "http://notexample.org/es/1"), (None, "http://nowhere.net/a"), (4, "http://www.site.com/fr/1"), (17, "http://Über.de/Ä/\nq"), (18, "http:///empty/host"), (19, "http://" + "a." * 900 + "net/" + "p" * 50_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, "clash", "clash") for i, u in URLS], "page_id long, url string, host string, bad string")


@pytest.fixture(scope="module")
def outcomes(spark):
    rows = [(1, True), (2, False), (4, True), (4, False), (5, None), (None, True), (11, False), (999, True)]
    return spark.createDataFrame(rows, "page_id long, bad boolean")


def test_rules_and_hosts(pages, outcomes):
    def expected(url):
        at = (url or "").find("://")
        if at < 0:
            return "", "", None
        rest = url[at + 3 :]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [h + p for _, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits, key=len, default=None)

    out = url_filter.filter_urls(pages, outcomes, url_filter.RULES).select("page_id", "host", "path", "rule").collect()
    assert counted(out) == Counter((i, *expected(u)) for i, u in URLS)


def test_longest_rule_wins(spark):
    pages = spark.createDataFrame([(1, "x://a.b.c/d/e")], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    assert url_filter.filter_urls(pages, none, [("allow", "c", "/d/e"), ("block", "b.c", "/d/"), ("block", "c", "/")]).first()["rule"] == "b.c/d/"
    with pytest.raises(ValueError):
        url_filter.filter_urls(pages, none, [("allow", f"h{i}", "/") for i in range(url_filter.MOST_RULES + 1)])


def test_units(spark):
    hosts = ["blog.x.example.com", "example.com", "com", "a.b.co.uk", "co.uk", "u@h.net:80", "10.0.0.1:5", "[::1]:80", "x.net.", "", "a.gov"]
    rows = spark.createDataFrame([(h,) for h in hosts], "host string")
    name, domain, suffix = url_filter.units("host")
    assert [tuple(r) for r in rows.select(name, domain, suffix).collect()] == [
        ("blog.x.example.com", "example.com", "com"), ("example.com", "example.com", "com"), ("com", "com", "com"), ("a.b.co.uk", "b.co.uk", "co.uk"), ("co.uk", "co.uk", "uk"), ("h.net", "h.net", "net"),
        ("10.0.0.1", "10.0.0.1", ""), ("[::1]", "[::1]", ""), ("x.net", "x.net", "net"), ("", "", ""), ("a.gov", "a.gov", "gov"),
    ]


def reputation(hosts, z=1.645):
    """name -> mean and lower bound, level by level in plain Python."""

    def strength(rows):
        x = sum((f - n * m) ** 2 - n * m * (1 - m) for n, f, m in rows if n)
        p = sum(n * (n - 1) * m * (1 - m) for n, f, m in rows if n)
        return 10.0 if not p else 1000.0 if x <= 0 else min(max(p / x - 1, 2.0), 1000.0)

    def level(key, prior):
        sums = {}
        for h in hosts:
            n, f, m = sums.get(h[key], (0, 0, prior(h)))
            sums[h[key]] = n + h[3], f + h[4], m
        s = strength(list(sums.values()))
        return {k: ((f + m * s) / (n + s), f + m * s, n - f + (1 - m) * s) for k, (n, f, m) in sums.items()}

    base = (sum(h[4] for h in hosts) + 0.05) / (sum(h[3] for h in hosts) + 1)
    suffixes = level(2, lambda h: base)
    domains = level(1, lambda h: suffixes[h[2]][0])
    return {k: (m, m - z * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))) for k, (m, a, b) in level(0, lambda h: domains[h[1]][0]).items()}


def test_reputations(spark):
    r = random.Random(3)
    hosts = [(f"h{i}.d{i % 7}.{x}", f"d{i % 7}.{x}", x, n := r.choice([0, 1, 2, 5, 40, 300]), sum(r.random() < (0.9 if i % 7 == 3 else 0.1) for _ in range(n))) for i in range(60) for x in ("com", "net")]
    out = {x["name"]: (x["bad_rate"], x["bad_bound"]) for x in url_filter.reputations(spark.createDataFrame(hosts, "name string, domain string, suffix string, n long, f long")).collect()}
    expected = reputation(hosts)
    assert set(out) == set(expected) and all(out[k] == pytest.approx(expected[k]) for k in out)
    assert all((out[h[0]][1] > 0.25) == ("d3." in h[0]) for h in hosts if h[3] >= 40)
    assert out["h0.d0.com"][1] < 0.25 < out["h3.d3.com"][1]


def test_bad_hosts_are_blocked(spark):
    rows = [(i, f"http://spam.bad.net/{i}") for i in range(40)] + [(100 + i, f"http://good.fine.net/{i}") for i in range(200)] + [(500, "http://new.bad.net/"), (501, "http://once.fine.net/"), (502, "http://spam.bad.net/ok/1")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    outcomes = spark.createDataFrame([(i, i < 36) for i in [*range(40), *range(100, 300)]] + [(501, True)], "page_id long, bad boolean")
    out = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages, outcomes, [("allow", "bad.net", "/ok/")]).collect()}
    assert {out[i] for i in range(40)} == {"block"} and {out[100 + i] for i in range(200)} == {"allow"}
    assert out[501] == "allow" and out[502] == "allow"  # one outcome is not enough; a rule decides before the host


def test_url_filter_empty_and_oracle(spark, pages, outcomes, tmp_path):
    assert url_filter.filter_urls(pages.limit(0), outcomes).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(pages, outcomes.limit(0)).collect()} == {"allow"}
    labels = spark.createDataFrame([(i, 0 if i in (1, 2, 4) else 1, 1 if i == 3 else None) for i in range(1, 12)], "doc_id long, quality int, toxic int")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    db = duckdb.connect()
    for t in ("pages", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    out = url_filter.op11_query(spark, str(tmp_path))
    assert counted(out.collect()) == counted(db.execute(f"SELECT page_id, host, path, rule, verdict FROM ({url_filter.OP11_SQL})").fetchall())


# --- Resampling towards a target


def _texts():
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "日本", "It's", "a-b", "X2", "×"]
    plain = [" ".join(r.choice(vocabulary[: 20 if i % 3 else 66]) for _ in range(r.randint(0, 60))) for i in range(150)]
    rows = [(i, t) for i, t in enumerate(plain)] + [(None, plain[5]), (7, plain[7]), (7, plain[7]), (200, None), (201, ""), (202, ",;."), (203, "w1 " * 30_000), (204, "longword" * 9000)]
    return [(i, t, "clash", 1, "clash", "clash", "clash") for i, t in rows]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(_texts(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(f"w{i} w{i + 1} w7 日本, ünï",) for i in range(9)] + [(None,), ("",)], "text string")


@pytest.mark.parametrize("longest, buckets", [(1, 10_000), (3, 97)])
def test_resampling(texts, target, longest, buckets, monkeypatch):
    monkeypatch.setattr(importance, "NODES", 30)
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))

    def features(t):
        w = split(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    raw, good = Counter(), Counter()
    for r in _texts():
        raw.update(features(r[1]))
    for r in target.collect():
        good.update(features(r[0]))
    big_s, big_t = sum(raw.values()), sum(good.values())
    gain = [math.floor(1000 * math.log((good[b] + 1) * (big_s + buckets) / ((raw[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, t, *_ in _texts():
        f = features(t)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((i, len(split(t)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in rows if x[1] >= 20), key=lambda x: (-x[4], -1 if x[0] is None else x[0]))
    ranks = {i: place for place, i in enumerate(able[: 10 * len(able) // 100], 1)}
    out = importance.resample_towards(texts, target, longest=longest, buckets=buckets).collect()
    assert counted(r[:5] for r in out) == Counter(rows)
    drawn = sorted((r for r in out if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, len(ranks) + 1))
    assert [tuple(r[:5]) for r in drawn] == able[: len(ranks)]


def test_resampling_empty(texts, target):
    assert importance.resample_towards(texts.limit(0), target).count() == 0
    out = importance.resample_towards(texts, target.limit(0)).collect()
    assert len(out) == len(_texts()) and sum(r["rank"] is not None for r in out) > 0


# --- Spelling variants


def variants(rows, shortest=7, least=2, times=10, every=31):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= shortest:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= least}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        long, short = (a, b) if len(a) > len(b) else (b, a)
        return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    found = {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        found[w] = (best if best is not None and counts[best] >= times * n else None, len(others))
    out = Counter()
    for w, (form, n) in found.items():
        root = w
        while found[root][0] is not None:
            root = found[root][0]
        out[(w, form, root, counts[w], n, counts[form] if form else None)] += 1
    return out


def _spelled_rows():
    r = random.Random(4)
    stems = ["category", "ähnlicher", "possession", "beginning", "colourful", "bookkeeper", "parallels"]
    words = []
    for s in stems:
        words += [s] * 300
        for _ in range(25):
            at, c = r.randrange(len(s)), r.choice("abcdeéß÷")
            words += [r.choice([s[:at] + s[at + 1 :], s[:at] + c + s[at:], s[:at] + c + s[at + 1 :]])] * r.choice([1, 2, 3, 30, 31])
    words += ["aaaaaaa"] * 40 + ["aaaaaaaa"] * 3 + ["short", "日本語日本語日本", "İstanbulx", "İstanbulx"]
    r.shuffle(words)
    rows = [(i, " ".join(w.upper() if r.random() < 0.2 and w.isascii() else w for w in words[i * 50 : i * 50 + 50])) for i in range(len(words) // 50 + 1)]
    return [*rows, (None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1]), (900, None), (901, ""), (902, "a1b2"), (903, "x" * 60_000), (904, "x" * 60_000), (905, "Possession," * 4000)]


@pytest.mark.parametrize("every", [31, 0, 3])
def test_spelling(spark, every, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 50)
    rows = _spelled_rows()
    docs = spark.createDataFrame([(i, t, "clash", 1, "clash", "clash", "clash") for i, t in rows], DOCS).repartition(5)
    out = spelling.spelling_variants(docs, every=every)
    assert counted(out.collect()) == variants(rows, every=every)
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_colliding_keys_are_told_apart(spark, monkeypatch):
    """With one key for all deletions only strings decide."""
    words = [b"category", b"categorx", b"categorxy", b"kategorx", b"zzzzzzzz"]
    of, kind, at, key = spelling.deletion_keys(words)
    rows = [(int(k), int(a), words[o].decode(), 5 + int(o)) for o, k, a in zip(of, kind, at)]
    met = Counter()
    for word, n, *_ in spelling._meet(rows):
        met[word] += n
    assert met == {"category": 2, "categorx": 3, "categorxy": 2, "kategorx": 1}
    assert len(np.unique(key)) < len(key)
