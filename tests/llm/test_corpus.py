"""Corpus operators on awkward rows: missing values, empty and repeated texts, ties, clashing columns, empty tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from factloom.llm import ann, byte_bpe, line_dedup, near_dedup, packing, quality_classifier, quality_rules, sharding, substring_dedup, tokens

SCHEMA = "doc_id long, text string, source string, doc_key string, n_words string, v long"
WORDS = [f"w{i}" for i in range(400)] + ["Ünï", "日本", "x,", "y!!", "<|endoftext|>", "it's"]


def words(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    base, passage = words(r, 120), words(r, 60)
    out = [(None, "lonely words here", None), (1, None, "a"), (2, "", "a"), (3, " \n\t", "a"), (4, "one", "a"), (5, "x " * 40_000, "b")]
    out += [(10 + i, base, "hot") for i in range(30)] + [(10, base, "hot")]
    out += [(50 + i, base.replace(base.split()[7 + i], f"changed{i}", 1), "hot") for i in range(5)]
    out += [(60 + i, f"{words(r, 30)} {passage} {words(r, 30)}", "c") for i in range(4)]
    out += [(70 + i, "\n".join([words(r, 9), "same line one", "same line two", "", words(r, 8)]), "c") for i in range(4)]
    out += [(80, "a" * 70_000, "d"), (81, "tab\tand\x0bodd space  two", "d"), (82, ("long " + words(r, 20) + "\n") * 900, "d")]
    return [(i, t, s, "clash", "clash", 1) for i, t, s in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return (text or "").encode().split()


def test_sharding(docs, rows, empty):
    out = sharding.shard_documents(docs, 4).collect()
    assert len(out) == len(rows) and sharding.shard_documents(empty, 4).count() == 0
    shards = {}
    for r in out:
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in shards.values())
    by_text = {}
    for r in out:
        by_text.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(x) == 1 for x in by_text.values())
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    # no shard is larger than the smallest capacity that any cut of the ordered groups allows
    groups = Counter()
    for _, t, *_ in rows:
        groups[hashlib.md5((t or "").encode()).hexdigest()] += size(t)
    ordered = [groups[g] for g in sorted(groups)]
    best = {(0, 0): 0}  # (groups, shards) -> the least that the largest shard can hold
    for n in range(1, 5):
        for i in range(len(ordered) + 1):
            best[i, n] = min(max(best[j, n - 1], sum(ordered[j:i])) for j in range(i + 1) if (j, n - 1) in best)
    filled = Counter()
    for r in out:
        filled[r["shard"]] += r["size"]
    assert set(filled) <= set(range(4)) and max(filled.values()) == best[len(ordered), 4]


def test_minimax_is_smallest(spark):
    r = random.Random(1)
    sizes = [r.randint(1, 500) for _ in range(700)]
    prefix = np.cumsum(sizes).tolist()

    def fits(c):
        n, held = 1, 0
        for s in sizes:
            n, held = (n + 1, s) if held + s > c else (n, held + s)
        return n <= 9

    best = next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))
    cuts = sharding.minimax_cuts(spark.createDataFrame([(p,) for p in prefix], "prefix long"), sum(sizes), max(sizes), 9)
    assert max(b - a for a, b in zip([0, *cuts], cuts)) == best and cuts[-1] == sum(sizes)


def test_quality_rules(docs, rows, empty):
    out = Counter((r["doc_id"], r["n_words"], r["n_repeat_words"], r["base_failed"]) for r in quality_rules.host_rules(docs).collect())

    def expected(t):
        w = split(t)
        g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        c = Counter(g)
        n = len({i + j for i, x in enumerate(g) if c[x] > 1 for j in range(5)})
        return len(w), n, len(w) < 10 or 100 * n > 20 * len(w)

    assert out == Counter((i, *expected(t)) for i, t, *_ in rows)
    assert quality_rules.host_rules(empty).count() == 0


def test_token_counts(docs, rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = Counter((r["doc_id"], r["n_tokens"]) for r in tokens.token_counts(docs, chunk=3000, overlap=64).collect())
    assert out == Counter((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, *_ in rows)
    assert tokens.token_counts(empty).count() == 0


def test_byte_bpe(docs, rows, empty):
    import tiktoken

    ranks = byte_bpe.ranks_of(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda x: hashlib.sha256(x).hexdigest()
    expected = Counter((i, len(ids := e.encode_ordinary(x or "")), digest(np.array(ids, "<u4").tobytes()), digest((x or "").encode())) for i, x, *_ in rows)
    assert Counter(tuple(r) for r in byte_bpe.encode_decode(docs, block_bytes=5000).collect()) == expected
    assert byte_bpe.encode_decode(empty).count() == 0


def held_in_sequences(out, length):
    """Checks that each sequence is gapless; returns the share of padding."""
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in sequences.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= length
    return 1 - sum(r["length"] for r in out) / (length * len(sequences))


def test_packing(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["Don't STOP... 'S the <|endoftext|>. X's", "e\u0301a J\u030c. \u1e9eß İi 3rd,4th?! a\u00a0b c\u200bd", "<|ENDOFTEXT|> (a)!, b*. «x». \ufb01n\u2028y", "ends.\x1cthere\x85 now."]
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(200 + i, x) for i, x in enumerate(odd)], "doc_id long, text string"))
    out = packing.pack(more, length=256).collect()
    assert packing.pack(empty).count() == 0
    expected = Counter()
    for i, x in [(i, x) for i, x, *_ in rows] + [(200 + i, x) for i, x in enumerate(odd)]:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        for start in range(0, len(ids), 256):
            part = ids[start : start + 256]
            expected[i, start, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter(tuple(r)[:5] for r in out) == expected
    held_in_sequences(out, 256)


def test_packing_of_short_texts(spark):
    r = random.Random(6)
    short = spark.createDataFrame([(i, None if i % 3 == 0 else words(r, r.choice([0, 1, 3, 17, 18]))) for i in range(6000)], "doc_id long, text string")
    out = packing.pack(short, length=512).collect()
    assert len(out) == 6000 and held_in_sequences(out, 512) < 0.03


def test_plan_holds_demand():
    r = np.random.default_rng(3)
    demand = r.poisson(np.exp(-np.arange(64) / 20) * 50)
    plan = packing.plan(demand)
    assert (sum(n * c for n, c in plan) == demand).all() and all(c @ np.arange(1, 65) <= 64 for _, c in plan)
    assert sum(n for n, _ in plan) <= 1.02 * (demand @ np.arange(1, 65)) / 64 + 2


def test_line_dedup(docs, rows, empty):
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).filter("doc_id between 70 and 73").collect()}
    assert "same line one" in out[70]["text"] and out[70]["n_removed_lines"] == 0
    assert all("same line" not in out[i]["text"] and out[i]["n_removed_lines"] == 2 and out[i]["doc_key"] == "clash" for i in (71, 72, 73))
    one = line_dedup.dedup_lines(docs).filter("doc_id = 82").first()
    assert one["n_removed_lines"] > 800 and line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.dedup_lines(docs).filter("doc_id = 1").first()["text"] is None


def test_line_dedup_by_brute_force(spark, docs, rows):
    r = random.Random(8)
    pool = [words(r, n) for n in (1, 1, 2, 3, 12, 14)] + ["", " \t"]
    more = [(i if r.random() < 0.9 else None, "\n".join(r.choice(pool) if r.random() < 0.7 else words(r, 2) for _ in range(r.randint(0, 12))) if r.random() < 0.95 else None) for i in range(100, 180)]
    more += more[:5]
    all_ = [(i, t) for i, t, *_ in rows] + more
    hashes = {x["text"]: x["h"] for x in spark.createDataFrame(more, "doc_id long, text string").union(docs.select("doc_id", "text")).selectExpr("text", "xxhash64(coalesce(text, '')) h").collect()}
    first, gone = {}, {}
    order = sorted({(-(2**63) if i is None else i, hashes[t], t or "") for i, t in all_})
    for i, h, t in order:
        lines = [(n, x) for n, x in enumerate(t.split("\n")) if x.strip(" \t\n\x0b\x0c\r")]
        for m, (n, x) in enumerate(lines):
            for run in ([(n, x)], lines[m : m + 2]):
                key = tuple(x for _, x in run)
                if len(key) > 1 or len(x) >= 40 and len(run) == 1:
                    if first.setdefault(key, (i, h, n)) != (i, h, n):
                        gone.setdefault((i, h), set()).update(range(run[0][0], run[-1][0] + 1))
    expected = Counter()
    for i, t in all_:
        out = gone.get((-(2**63) if i is None else i, hashes[t]), set())
        left = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in out)
        expected[i, left, 0 if t is None else t.count("\n") + 1, len(out)] += 1
    both = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    found = line_dedup.dedup_lines(both)
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed_lines"]) for r in found.collect()) == expected
    assert max(len(x) for x in gone.values()) > 8


def test_near_duplicates(docs, rows, empty):
    sets = {}
    for i, t, *_ in rows:
        w = split(t.lower() if t else t)
        s = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
        sets.setdefault(i, s)
    ids = sorted(sets, key=lambda x: (x is not None, x))
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)), key=ids.index)
                root[y] = x
    out = near_dedup.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == {i: (len(sets[i]), find(i)) for i in ids}
    assert near_dedup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("most", [100_000, 300, 1])
def test_substring_dedup(docs, rows, empty, most, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", most)
    least = {}
    key = lambda i: -1 if i is None else i
    for i, t, *_ in rows:
        w = split(t)
        for j in range(len(w) - 12):
            g = tuple(w[j : j + 13])
            least[g] = min(least.get(g, key(i)), key(i))
    expected = Counter()
    for i, t, *_ in rows:
        w = split(t)
        gone = {j + k for j in range(len(w) - 12) if least[tuple(w[j : j + 13])] < key(i) for k in range(13)}
        expected[i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()] += 1
    out = substring_dedup.remove_repeats(docs)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_words"]) for r in out.collect()) == expected
    assert substring_dedup.remove_repeats(empty).count() == 0 and "doc_key" in out.columns


def test_substring_dedup_of_repeated_rows(spark):
    """Rows that repeat an id (or have none) and a text are gathered once, however many there are."""
    r = random.Random(9)
    passage, own = words(r, 40), words(r, 200)
    rows = [(1, f"{words(r, 20)} {passage}")] + [(7, f"{own[:600]} {passage}")] * 1_500 + [(None, f"{words(r, 20)} other words")] * 1_500
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).groupBy("doc_id", "n_words", "n_removed").count().collect()
    expected = Counter((i, len(split(t)), 40 if i == 7 else 0) for i, t in rows)
    assert {(x["doc_id"], x["n_words"], x["n_removed"]): x["count"] for x in out} == dict(expected)


def test_nearest(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((400, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (None, [1.0] * 16), (904, x[3].tolist())]
    rows += [(1000 + i, x[20].tolist()) for i in range(1, 10)] + [(40, x[41].tolist()), (920, [1.0] * 15)]  # ties at the last rank, a query's id twice, another size
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=5, block=90).collect()
    known = [(i, np.array(v)) for i, v in rows if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    asked = {}
    for i, v in known:
        if i % 20 == 0:
            asked[i] = v if i not in asked else min(asked[i], v, key=list)
    hits = 0
    for q, v in asked.items():
        order = sorted((-float((w * v).sum()), i) for i, w in known if i != q)[:5]
        own = sorted((x["rank"], -x["score"], x["vec_id"]) for x in found if x["query_id"] == q)
        assert [x[0] for x in own] == [1, 2, 3, 4, 5] and [x[1:] for x in own] == sorted(x[1:] for x in own)
        hits += len(set(order) & {x[1:] for x in own})
    assert len(asked) == 20 and hits >= 0.95 * 5 * 20 and len(found) == 100
    assert [x["vec_id"] for x in sorted(found, key=lambda x: x["rank"]) if x["query_id"] == 20] == [1001, 1002, 1003, 1004, 1005]
    assert ann.nearest(vectors.limit(0), vectors.limit(0)).count() == 0
    assert ann.nearest(vectors.filter("vec_id < 3"), vectors.filter("vec_id = 0"), k=5).count() == 2


def test_nearest_walks_narrow_windows():
    """Tight clusters: windows stay narrow, few vectors of other clusters are verified, and the nearest are found."""
    r = np.random.default_rng(4)
    centres = r.standard_normal((200, 32))
    x = (centres[:, None] + 0.02 * r.standard_normal((200, 30, 32))).reshape(-1, 32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    lines = np.random.default_rng(11).standard_normal((128, 33))
    spot = np.append(x[7], 0.0) @ lines.T
    chosen = ann.ProjectionIndex(np.pad(x, ((0, 0), (0, 1))), lines).colliding(spot, ann.WIDTH * 0.04, 80)
    assert set(chosen.tolist()) <= set(range(30)) and 7 in chosen
    ids, _, scores = (np.concatenate(v) for v in ann.search_block(np.arange(6000), x, np.array([7]), x[7:8], np.array([np.inf]), 20, lines, 0.62, 1.0))
    assert len(scores) == 20 and set(np.argsort(-(x @ x[7]))[1:21].tolist()) == set(ann.search_block(np.arange(6000), x, np.array([7]), x[7:8], np.array([np.inf]), 20, lines, 0.62, 1.0)[1][0].tolist())


@pytest.mark.parametrize("m", [128, 255, 256, 400])
def test_collisions_are_counted_on_any_number_of_lines(m):
    r = np.random.default_rng(6)
    index = ann.ProjectionIndex(r.standard_normal((500, 8)), r.standard_normal((m, 8)))
    assert len(index.colliding(np.zeros(m), 1e6, m)) == 500


def test_quality_classifier(spark, empty):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        rows.append((i, words(r, 60) if good else " ".join(x.upper() + "!!" for x in words(r, 60).split())))
        if i < 150:
            labels.append((i, int(good), 0))
    rows += [(None, None), (400, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {x["doc_id"]: x["kept"] for x in quality_classifier.resample(docs, labels).collect()}
    right = sum(kept[i] == (i % 3 > 0) for i in range(150, 300))
    assert right >= 142 and len(kept) == 302
    assert quality_classifier.resample(empty, labels).count() == 0
    assert quality_classifier.resample(docs, labels.limit(0)).filter(F.col("kept")).count() == 302


def test_quality_classifier_rejects_toxic(spark):
    """Few toxic words in otherwise good text; half of the toxic documents carry no label."""
    r = random.Random(11)
    rows, labels = [], []
    for i in range(400):
        text = words(r, 80).split()
        if i % 4 == 0:
            for w in r.sample(["vile", "scorn", "spite", "venom"], 3):
                text.insert(r.randrange(len(text)), w)
        rows.append((i, " ".join(text) if i % 10 < 8 else " ".join(x.upper() + "!!" for x in text)))
        if i < 200:
            labels.append((i, int(i % 10 < 8) if i % 8 else None, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {x["doc_id"]: x["kept"] for x in quality_classifier.resample(docs, labels).collect()}
    toxic = [i for i in range(400) if i % 4 == 0 and i % 10 < 8]
    clean = [i for i in range(400) if i % 4 and i % 10 < 8]
    assert sum(kept[i] for i in toxic) <= 0.02 * len(toxic) and sum(kept[i] for i in clean) >= 0.9 * len(clean)
