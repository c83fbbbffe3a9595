"""The classifier and the whole pipeline against plain loops over the same rows."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from factloom.llm import quality_classifier as qc

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def split_at(known):
    """The threshold of best_split(), from its definition: try the middle between all neighbouring values."""
    good, bad = [v for v, g in known if g], [v for v, g in known if not g]
    values, best, at = sorted({v for v, _ in known}), (3.0, 0.0), float("-inf")
    if not good or not bad:
        return at
    for a, b in zip(values, values[1:]):
        value = 3 * sum(v > a for v in good) / len(good) + sum(v <= a for v in bad) / len(bad)
        if value > best[0] + 1e-12:
            best, at = (value, b - a), (a + b) / 2
    return at


def keeps(spark, docs, labels):
    """Rows (doc_id, text) that the classifier keeps, by loops; docs and labels are lists, ids are there."""
    hashed = spark.createDataFrame([(i,) for i in {i for i, _ in docs} | {x[0] for x in labels}], "i long")
    hashed = {r["i"]: (r["h"], r["g"]) for r in hashed.selectExpr("i", "pmod(xxhash64(i, 'labels'), 2) = 0 h", "(pmod(xxhash64(i, 7), 4503599627370496) + 0.5) / 4503599627370496D g").collect()}
    marks = {}
    for i, quality, toxic in labels:
        q, t = marks.get(i, (None, 0))
        marks[i] = (quality if q is None else q if quality is None else min(q, quality), max(t, toxic or 0))
    kind = {i: ("toxic" if t else "poor" if q == 0 else "good") for i, (q, t) in marks.items() if q is not None or t}
    poor = {i for i, (q, _) in marks.items() if q == 0}
    ids = [qc._ids(t) for _, t in docs]
    grams = [Counter(qc.ngram_buckets(x).tolist()) for x in ids]
    all_, target, held, n = Counter(), Counter(), {"good": Counter(), "toxic": Counter()}, Counter()
    for (i, _), x, g in zip(docs, ids, grams):
        all_.update(g)
        k = kind.get(i)
        if k and hashed[i][0]:
            if k == "good" and i not in poor:
                target.update(g)
            if k in held:
                held[k].update(set(x[:, 0].tolist()))
                n[k] += 1
    share = sum(target.values()) / max(sum(all_.values()), 1)
    weight = {b: np.log((target[b] + qc.SHRINK) / (c * share + qc.SHRINK)) for b, c in all_.items()}
    strong = {}
    for w, t in held["toxic"].items():
        ratio = (t + qc.SHRINK) / (held["good"][w] * n["toxic"] / max(n["good"], 1) + qc.SHRINK)
        if t >= qc.SHRINK and ratio >= 2 and t * max(n["good"], 1) >= 2.0 * held["good"][w] * n["toxic"]:
            strong[w] = np.log(ratio)
    rows = []
    for (i, _), x, g in zip(docs, ids, grams):
        total = sum(weight[b] * c for b, c in g.items())
        rows.append((i, total, total / max(sum(g.values()), 1), -sum(strong.get(w, 0.0) for w in set(x[:, 0].tolist())), total - np.log(-np.log(hashed[i][1]))))
    other = [r for r in rows if r[0] in kind and not hashed[r[0]][0]]
    threshold = split_at([(round(r[2], 3), kind[r[0]] == "good") for r in other if kind[r[0]] == "good" or r[0] in poor])
    limit = split_at([(round(r[3], 3), kind[r[0]] == "good") for r in other if kind[r[0]] in ("good", "toxic")])
    clean = [r[3] >= limit for r in rows]
    k = sum(c and r[2] >= threshold for c, r in zip(clean, rows))
    keys = sorted((r[4] for c, r in zip(clean, rows) if c), reverse=True)
    return [c and k > 0 and (k == len(rows) or r[4] >= keys[k - 1] - 1e-9) for c, r in zip(clean, rows)]


def test_classifier_by_brute_force(spark):
    r = random.Random(12)
    pool = [f"w{i}" for i in range(150)]
    docs, labels = [], []
    for i in range(300):
        text = [r.choice(pool) for _ in range(r.randint(0, 60))]
        if i % 5 == 0:
            text = [x.upper() + "!!" for x in text]
        if i % 6 == 0:
            text += r.sample(["vile", "scorn", "spite"], 2)
        docs.append((i, " ".join(text) if i % 50 else None))
        if i % 2 == 0:
            labels.append((i, int(i % 5 > 0) if i % 14 else None, int(i % 6 == 0)))
    out = qc.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    expected = dict(zip([i for i, _ in docs], keeps(spark, docs, labels)))
    assert {x["doc_id"]: x["kept"] for x in out.collect()} == expected and 20 < sum(expected.values()) < 280


def lines_left(docs):
    first, out = {}, []
    for i, t in docs:
        lines = [(n, x) for n, x in enumerate((t or "").split("\n")) if x.strip(SPACE)]
        gone = set()
        for m, (n, x) in enumerate(lines):
            if len(x) >= 40 and first.setdefault((x,), (i, n)) != (i, n):
                gone.add(n)
            if m + 1 < len(lines) and first.setdefault((x, lines[m + 1][1]), (i, n)) != (i, n):
                gone.update(range(n, lines[m + 1][0] + 1))
        text = "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone) if gone else t
        if not gone or text.strip(SPACE):
            out.append((i, text))
    return out


def firsts_of_groups(docs):
    sets, root = {}, {}
    for i, t in docs:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        sets[i], root[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set(), i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(i, t) for i, t in docs if find(i) == i]


def passages_left(docs, width):
    least, out = {}, []
    for i, t in docs:
        w = (t or "").encode().split()
        for j in range(len(w) - width + 1):
            least.setdefault(tuple(w[j : j + width]), i)
    for i, t in docs:
        w = (t or "").encode().split()
        gone = {j + k for j in range(len(w) - width + 1) if least[tuple(w[j : j + width])] < i for k in range(width)}
        text = b" ".join(x for j, x in enumerate(w) if j not in gone).decode() if gone else t
        if not gone or text:
            out.append((i, text))
    return out


@pytest.mark.parametrize("folder", [SF])
def test_pipeline_by_brute_force(spark, folder):
    from tokenizers import Tokenizer

    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    left = [d for d, kept in zip(docs, keeps(spark, docs, labels)) if kept]
    sizes = [len(docs), len(left)]
    for stage in (lines_left, firsts_of_groups, lambda x: passages_left(x, corpus_pipeline.PASSAGE_WORDS)):
        left = stage(left)
        sizes.append(len(left))
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = Counter()
    for i, x in left:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        for start in range(0, len(ids), 4096):
            part = ids[start : start + 4096]
            expected[i, start, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    out = corpus_pipeline.run(spark, folder).collect()
    assert Counter(tuple(r)[:5] for r in out) == expected and sizes[0] > sizes[1] > sizes[3] > 50
