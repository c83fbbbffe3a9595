"""Quality classifier by importance resampling over hashed n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Hashed n-gram buckets of the two generative models, a power of two.
BUCKETS = 1 << 16
#: At most so many labelled documents of each class (good, poor, toxic) are read for the models and for the thresholds.
LABELLED = 20_000
#: Pseudo-counts that pull the ratio of a rarely seen bucket towards 1.
SHRINK = 5.0
#: Words that a worker keeps hashed.
_CACHE_SIZE = 400_000
_SHAPES = [(re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z]+"), b"a"), (re.compile(rb"[0-9]+"), b"0"), (re.compile(rb"[\x80-\xff]+"), b"u")]


def _hashes(word: bytes) -> bytes:
    """Two 64-bit hashes, of a word and of its shape: runs of capitals, small letters, digits and other letters, and all punctuation."""
    import xxhash

    shape = word
    for pattern, mark in _SHAPES:
        shape = pattern.sub(mark, shape)
    return xxhash.xxh64_digest(word) + xxhash.xxh64_digest(shape[:16], 1)


def _ids(text: str | None) -> np.ndarray:
    """A row for each word of one whole text: the hashes of the word and of its shape."""
    words = text.encode().split() if text else []
    if not words:
        return np.zeros((0, 2), np.uint64)
    cache = common.kept("hashes", dict)
    if len(cache) > _CACHE_SIZE:
        cache.clear()
    try:
        found = b"".join(map(cache.__getitem__, words))
    except KeyError:
        for w in words:
            if w not in cache:
                cache[w] = _hashes(w)
        found = b"".join(map(cache.__getitem__, words))
    return np.frombuffer(found, ">u8").astype(np.uint64).reshape(-1, 2)


def ngram_buckets(ids: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of all uni- and bigrams of the words of one whole text, and of their shapes, from its _ids()."""
    pairs = ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:]
    return (np.concatenate([ids.ravel(), (pairs ^ (pairs >> np.uint64(29))).ravel()]) & np.uint64(buckets - 1)).astype(np.int64)


def _rows(kind: int, names: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(names), kind, np.int32)), pa.array(names.astype(np.int64)), pa.array(n.astype(np.int64))], ["kind", "name", "n"])


def _tally(totals: np.ndarray, waiting: tuple[list, list]) -> None:
    """Adds the buckets of texts outside and inside the target to the totals of all and of the target."""
    for inside, found in enumerate(waiting):
        if found:
            n = np.bincount(np.concatenate(found), minlength=BUCKETS)
            totals[0] += n
            totals[1] += n * inside


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind, name, n: how often a bucket occurs in all text (0) and in good labelled text (1); how many good (2) and toxic (3)
    labelled documents hold a word, named by its whole hash; the number of such documents (4, 5; named 0)."""
    totals = np.zeros((2, BUCKETS), np.int64)
    for batch in common.few(batches, 5000):
        held, waiting, size = ([], []), ([], []), 0
        for text, good, toxic, fit in zip(*(batch.column(i).to_pylist() for i in range(4))):
            ids = _ids(text)
            waiting[bool(fit and good)].append(ngram_buckets(ids))
            size += len(ids)
            if size > 500_000:
                _tally(totals, waiting)
                waiting, size = ([], []), 0
            if fit and (good or toxic):
                held[bool(toxic)].append(np.unique(ids[:, 0]))
        _tally(totals, waiting)
        for kind, words in enumerate(held):
            if words:
                names, n = np.unique(np.concatenate(words), return_counts=True)
                yield _rows(2 + kind, names.view(np.int64), n)
                yield _rows(4 + kind, np.zeros(1), np.array([len(words)]))
    for kind in (0, 1):
        at = np.flatnonzero(totals[kind])
        yield _rows(kind, at, totals[kind][at])


def toxic_weights(held: dict[int, tuple[int, int]], n_good: int, n_toxic: int) -> dict[int, float]:
    """Word hash -> log ratio of toxic over good documents that hold the word, where it is log 2 or more: plain words do not make
    up for toxic ones. `held` has the numbers of good and toxic documents of each word."""
    ratio = {w: (toxic + SHRINK) / (good * n_toxic / max(n_good, 1) + SHRINK) for w, (good, toxic) in held.items()}
    return {w: float(np.log(x)) for w, x in ratio.items() if x >= 2}


def _labelled(labels: DataFrame, label_id: str) -> DataFrame:
    """At most LABELLED good, poor and toxic document ids each, chosen by a hash of the id."""
    known = labels.select(F.col(label_id).cast("long").alias("label_key"), "quality", F.coalesce("toxic", F.lit(0)).alias("toxic"))
    known = known.filter("label_key is not null and (quality is not null or toxic = 1)").groupBy("label_key")
    known = known.agg(F.coalesce(F.min("quality") == 0, F.lit(False)).alias("poor"), (F.max("toxic") == 1).alias("toxic"))
    known = known.withColumn("good", ~F.col("poor") & ~F.col("toxic"))
    order = F.xxhash64("label_key", F.lit("labels"))
    good, poor, toxic = (known.filter(x).orderBy(order, "label_key").limit(LABELLED) for x in ("good", "poor and not toxic", "toxic"))
    # one half fits the models, the other half sets the thresholds
    return good.unionByName(poor).unionByName(toxic).select("label_key", "good", "poor", "toxic", (F.pmod(order, F.lit(2)) == 0).alias("fit"))


def _top(scored: DataFrame, k: int) -> float:
    """The k-th largest sampling key.

    Each round counts the keys of 4,096 bins and looks into the bin where the k-th lies, so nothing is sorted or gathered.
    """
    low, high = scored.agg(F.min("sampling_key"), F.max("sampling_key")).first()
    while low < high:
        width = (high - low) / 4096
        if width == 0 or low + width == low:
            break
        rows = scored.filter(F.col("sampling_key").between(low, high)).groupBy(F.floor((F.col("sampling_key") - low) / width).alias("bin"))
        bins = sorted(rows.agg(F.count(F.lit(1)).alias("n"), F.min("sampling_key").alias("low"), F.max("sampling_key").alias("high")).collect(), key=lambda r: -r["bin"])
        for r in bins:
            if k <= r["n"]:
                low, high = r["low"], r["high"]
                break
            k -= r["n"]
    return low


def importance_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", seed: int = 7) -> DataFrame:
    """doc_id, n_ngrams, log_weight (target over raw, summed), toxic_weight, sampling_key (log_weight plus Gumbel noise), good, poor, toxic and fit (label and its half, or null)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = common.store(_labelled(labels, label_id), "labelled")
    marked = rows.join(F.broadcast(known), F.col("doc_id") == F.col("label_key"), "left").select("doc_id", "text", "good", "poor", "toxic", "fit")
    counted = common.store(marked.select("text", "good", "toxic", "fit").mapInArrow(_count, "kind int, name long, n long").groupBy("kind", "name").agg(F.sum("n").alias("n")), "counts")
    counts, labelled = np.zeros((2, BUCKETS)), {4: 0, 5: 0}
    for r in counted.filter("kind in (0, 1, 4, 5)").collect():  # at most 2 * BUCKETS + 2 rows
        if r["kind"] < 2:
            counts[r["kind"], r["name"]] = r["n"]
        else:
            labelled[r["kind"]] = r["n"]
    expected = counts[0] * (counts[1].sum() / max(counts[0].sum(), 1.0))  # of the target text under the raw model
    weights = np.log((counts[1] + SHRINK) / (expected + SHRINK))
    words = counted.filter("kind in (2, 3)").groupBy("name").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(x) for k, x in ((2, "good"), (3, "toxic"))))
    # a ratio of 2 needs as many toxic documents as SHRINK: few words are left
    held = {r["name"] % 2**64: (r["good"], r["toxic"]) for r in words.filter((F.col("toxic") >= SHRINK) & (F.col("toxic") * max(labelled[4], 1) >= 2.0 * F.col("good") * labelled[5])).collect()}
    strong = toxic_weights(held, labelled[4], labelled[5])
    ratio = spark.sparkContext.broadcast((weights, strong))  # BUCKETS doubles, and the toxic words

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, strong = ratio.value
        maybe, low = np.zeros(1 << 16, bool), np.uint64((1 << 16) - 1)
        maybe[[w & 0xFFFF for w in strong]] = True
        for batch in common.few(batches):
            rows = ([], [], [])
            for text in batch.column(1).to_pylist():
                ids = _ids(text)
                found = ngram_buckets(ids)
                words = set(ids[maybe[ids[:, 0] & low], 0].tolist())
                for column, x in zip(rows, (len(found), float(weight[found].sum()), float(sum(strong.get(w, 0.0) for w in sorted(words))))):
                    column.append(x)
            sums = (pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.float64(), pa.float64())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(i) for i in range(2, 6)), *sums], ["doc_id", "good", "poor", "toxic", "fit", "n_ngrams", "log_weight", "toxic_weight"])

    scored = marked.mapInArrow(score, "doc_id long, good boolean, poor boolean, toxic boolean, fit boolean, n_ngrams long, log_weight double, toxic_weight double")
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return scored.withColumn("sampling_key", F.col("log_weight") - F.log(-F.log(uniform)))


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", seed: int = 7) -> DataFrame:
    """Importance resampling of documents towards labelled good text, by Gumbel top-k.

    Two hashed models of uni- and bigrams, of words and of their shapes, are fitted: one of all `docs`, one of good
    labelled documents (quality 1, not toxic; one half of at most LABELLED of them). A document's log importance weight is the sum of its n-grams' log ratios; the k
    documents of the largest weight plus Gumbel noise are kept. k is the number of documents whose mean log ratio reaches
    the threshold that best splits good from poor (quality 0) ones in the other half of the labelled documents. Toxic text is
    judged apart, since it may be well written: of the words that a share at least twice as large of toxic as of good labelled
    documents holds, each that a document has adds its log ratio once, whatever the document's length; a document whose sum is beyond
    the value that best splits good from toxic ones in the other half is never kept and not counted in k. Returns doc_id, n_ngrams, log_weight, sampling_key,
    kept.

    A missing or empty text has weight 0 and is judged as such. Ids may be missing or repeat; each row is judged by itself,
    repeated rows alike. Without labels the models are equal, and all documents stay. Labels of one id that differ count
    as the worst. An empty table gives an empty result. Other columns of `docs` are not read.
    """
    scored = common.store(importance_scores(docs, labels, id_col, text_col, label_id, seed), "scores")
    mean = F.col("log_weight") / F.greatest("n_ngrams", F.lit(1))
    held = scored.filter("not fit").select("good", "poor", "toxic", F.round(mean, 3).alias("mean"), F.round(-F.col("toxic_weight"), 3).alias("clean"))

    def split(of: str, by: str) -> float:
        known = held.filter(f"good or {of}").groupBy("good", by).agg(F.count(F.lit(1)).alias("n")).collect()  # of at most 3 * LABELLED documents
        return best_split([(r[by], r["n"], r["good"]) for r in known])

    threshold, limit = split("poor", "mean"), split("toxic", "clean")
    clean = -F.col("toxic_weight") >= limit
    total, k = scored.agg(F.count_if(clean), F.count_if(clean & (mean >= threshold))).first()
    if k == total:
        kept = clean
    elif not k:
        kept = F.lit(False)
    else:
        kept = clean & (F.col("sampling_key") >= _top(scored.filter(clean), k))  # equal keys, of repeated rows, stay together
    return scored.select("doc_id", "n_ngrams", "log_weight", "sampling_key", kept.alias("kept"))


def best_split(known: list[tuple[float, int, bool]]) -> float:
    """The threshold with the best sum of the two classes' shares on the right side; -infinity if a class is missing.

    The middle of the widest gap is taken where several are equally good, a bad document more being worth losing no good one."""
    good, bad = sum(n for _, n, g in known if g), sum(n for _, n, g in known if not g)
    if not good or not bad:
        return float("-inf")
    kept_good, kept_bad, best, at = good, bad, 0.0, float("-inf")
    known = sorted(known)
    for i, (mean, n, g) in enumerate(known):
        kept_good, kept_bad = kept_good - n * g, kept_bad - n * (not g)
        value = 3 * kept_good / good + 1 - kept_bad / bad
        following = known[i + 1][0] if i + 1 < len(known) else mean
        if following > mean and (value, following - mean) > (best, 0.0) and value > 3.0:
            if value > best:
                best, at = value, (mean + following) / 2
    return at


def op2_query(spark, sf_dir: str) -> DataFrame:
    out = resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_ngrams", F.round("log_weight", 6).alias("log_weight"), "kept")
