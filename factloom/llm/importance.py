"""Resampling towards a target distribution: tries of words count features, then carry each feature's gain."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Buckets that features are dealt into.
BUCKETS = 10_000
#: Nodes that a trie holds at most; a fuller one is emptied and begun anew.
NODES = 400_000
#: Words of texts that are walked together.
_TOGETHER = 300_000
#: Bytes of words: digits, letters and all bytes of other characters; A-Z become a-z, what is left parts words.
_WORD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of one whole text as UTF-8, A-Z lower-cased; a missing text has none."""
    return text.encode().translate(_WORD).split() if text else []


class Trie:
    """Runs of 1 to `longest` words as paths: a node has the CRC state of its words joined by spaces, hence its bucket.

    Node 0 is the root, words have numbers of their own, and a child is found by (node, word)."""

    def __init__(self, longest: int, buckets: int):
        self.longest, self.buckets = longest, buckets
        self.words: dict[bytes, int] = {}
        self.first: dict[bytes, int] = {}
        self.names: list[bytes] = []
        self.child: dict[int, int] = {}
        self.crc, self.size = np.zeros(1024, np.int64), 1

    def _node(self, crc: int) -> int:
        if self.size == len(self.crc):
            self.crc = np.concatenate([self.crc, np.zeros(self.size, np.int64)])
        self.crc[self.size] = crc
        self.size += 1
        return self.size - 1

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """Nodes of single words."""
        try:
            return np.fromiter(map(self.first.__getitem__, words), np.int64, len(words))
        except KeyError:
            for w in words:
                if w not in self.first:
                    self.first[w] = self._node(zlib.crc32(w))
            return np.fromiter(map(self.first.__getitem__, words), np.int64, len(words))

    def walk(self, words: list[bytes], texts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length of runs: the nodes of all runs that lie in one text, and these texts; `texts` numbers each word's text."""
        first = self._numbers(words)
        nodes, of = first, texts
        yield nodes, of
        if self.longest == 1:
            return
        for w in words:
            if w not in self.words:
                self.words[w] = len(self.names)
                self.names.append(w)
        numbers = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        at = np.arange(len(words))
        for n in range(1, self.longest):
            goes_on = (at + n < len(words)) & (texts[np.minimum(at + n, len(words) - 1)] == of)
            nodes, of, at = nodes[goes_on], of[goes_on], at[goes_on]
            keys, where = np.unique((nodes << 32) | numbers[at + n], return_inverse=True)
            found = np.empty(len(keys), np.int64)
            for i, key in enumerate(keys.tolist()):
                if (node := self.child.get(key)) is None:
                    node = self.child[key] = self._node(zlib.crc32(b" " + self.names[key & 0xFFFFFFFF], int(self.crc[key >> 32])))
                found[i] = node
            nodes = found[where]
            yield nodes, of

    def bucket(self) -> np.ndarray:
        return self.crc[: self.size] % self.buckets


def _groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes], np.ndarray]]:
    """Slices of batches with the words of all their texts, and the text (row of the slice) of each word."""
    for batch in common.few(batches):
        texts, start, words, lengths = batch.column(column).to_pylist(), 0, [], []
        for i, text in enumerate(texts):
            own = words_of(text)
            words += own
            lengths.append(len(own))
            if len(words) > _TOGETHER or i == len(texts) - 1:
                yield batch.slice(start, i + 1 - start), words, np.repeat(np.arange(len(lengths)), lengths)
                start, words, lengths = i + 1, [], []


def bucket_totals(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """bucket, n: how often features of each bucket occur in texts(text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, trie, held = np.zeros(buckets, np.int64), Trie(longest, buckets), np.zeros(1, np.int64)
        for _, words, of in _groups(batches, 0):
            for nodes, _ in trie.walk(words, of):
                more = np.bincount(nodes, minlength=len(held))
                more[: len(held)] += held
                held = more
            if trie.size > NODES:
                totals += np.bincount(trie.bucket(), np.pad(held, (0, trie.size - len(held))), buckets).astype(np.int64)
                trie, held = Trie(longest, buckets), np.zeros(1, np.int64)
        totals += np.bincount(trie.bucket(), np.pad(held, (0, trie.size - len(held))), buckets).astype(np.int64)
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(totals[at])], ["bucket", "n"])

    return texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain, floor(1000 ln of the smoothed ratio of target over raw shares)."""
    buckets = len(raw)
    of_raw, of_target = float(raw.sum() + buckets), float(target.sum() + buckets)
    return np.array([math.floor(1000 * math.log((t + 1.0) * of_raw / ((s + 1.0) * of_target))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def _ranked(scored: DataFrame) -> DataFrame:
    """The rows numbered from 1 as `place`, by falling score and rising doc_id, without a task that sees all.

    Rows are dealt by ranges of (score, doc_id, row), so equal keys can be parted as well; a range's rows are numbered by
    themselves, and the counts of the ranges, one row each, give what lies before."""
    ranges = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scored.repartitionByRange(ranges, F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("_row")).withColumn("_range", F.spark_partition_id())
    dealt = common.store(dealt, "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("_row"))
    out = dealt.withColumn("_at", F.row_number().over(inside)).join(F.broadcast(counts), "_range")  # a row for each range
    return out.withColumn("place", F.col("_before") + F.col("_at"))


def resample_towards(
    docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: int = 2024,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document, drawn towards the texts of `target`.

    Features are all runs of 1 to `longest` consecutive words, joined by a space, repeats counted; a feature's bucket is its
    CRC-32 modulo `buckets`. Each task keeps a trie of words, whose nodes hold counts and CRC states, so that a run's CRC goes
    on from that of its shorter run; tasks give totals by bucket, and these add up to those of all documents and of the target. A second walk sums
    the gains of a document's nodes (weight). score adds Gumbel noise from the document's id; of the documents of at least
    `min_words` words, `percent` in a hundred of the highest scores are drawn (rank 1, 2, ...; null for others).

    A missing or empty text has no features and weight 0, and is not drawn unless `min_words` is 0. A missing id hashes as an empty one and ranks first
    among equal scores. Ids may repeat: rows of one id and text have equal scores, and each its own rank. Empty tables count as no features.
    Other columns are not read. What is collected is a number for each bucket; a trie is emptied at NODES nodes.
    """
    spark = docs.sparkSession
    totals = {}
    for name, texts in (("raw", docs.select(F.col(text_col).cast("string"))), ("target", target.select(F.col(target_col).cast("string")))):
        totals[name] = np.zeros(buckets, np.int64)
        for r in bucket_totals(texts, longest, buckets).collect():  # at most `buckets` rows
            totals[name][r["bucket"]] = r["n"]
    gain = spark.sparkContext.broadcast(gains(totals["raw"], totals["target"]))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_bucket = gain.value
        trie, attached = Trie(longest, buckets), np.zeros(1, np.int64)
        for batch, words, of in _groups(batches, 1):
            n = batch.num_rows
            weight, features = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for nodes, texts in trie.walk(words, of):
                if trie.size > len(attached):
                    new = trie.crc[len(attached) : trie.size] % buckets
                    attached = np.concatenate([attached, of_bucket[new]])
                weight += np.bincount(texts, attached[nodes], n).astype(np.int64)  # whole numbers below 2^53
                features += np.bincount(texts, minlength=n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.bincount(of, minlength=n).astype(np.int64)), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])
            if trie.size > NODES:
                trie, attached = Trie(longest, buckets), np.zeros(1, np.int64)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    weighed = rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    score = F.col("weight") + F.floor(-1000.0 * F.log(-F.log(uniform))).cast("long")
    scored = common.store(weighed.withColumn("score", score).withColumn("_row", F.monotonically_increasing_id()), "scores")
    able = F.col("n_words") >= min_words
    drawn = scored.filter(able).count() * percent // 100
    ranked = _ranked(scored.filter(able)).withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")).cast("long"))
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return ranked.select(columns).unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")).select(columns))


def op12_query(spark, sf_dir: str) -> DataFrame:
    out = resample_towards(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
