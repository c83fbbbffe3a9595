"""Quality rules with host-level verdicts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
_FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_window_words(words: list, width: int = 5) -> int:
    """Words that lie in a window of `width` words whose sequence is found twice or more, first windows included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    vocab: dict = {}
    ids = np.fromiter((vocab.setdefault(w, len(vocab)) for w in words), np.int64, len(words))
    codes, limit = ids[:n], len(vocab)
    for j in range(1, width):
        if limit * len(vocab) >= 2**62:
            codes = np.unique(codes, return_inverse=True)[1]
            limit = n
        codes, limit = codes * len(vocab) + ids[j : n + j], limit * len(vocab)
    _, inverse, counts = np.unique(codes, return_inverse=True, return_counts=True)
    if len(counts) == n:
        return 0
    ends = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(counts[inverse] > 1)
    np.add.at(ends, starts, 1)
    np.add.at(ends, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(ends)))


def text_features(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text (missing: none)."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()  # bytes are split at exactly \x20 and \x09-\x0D
    spaces = sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), len(text) - spaces, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_window_words(words)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [text_features(x) for x in batch.column(2).to_pylist()]
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "host", *_FEATURES])


def host_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    min_words: int = 10, max_repeat_percent: int = 20, max_host_failures: float = 0.5,
) -> DataFrame:
    """Base rules for each document, and a verdict for each host that is joined back to its documents.

    A document fails where it has fewer than `min_words` words or more than `max_repeat_percent` % of its words lie in
    repeated five-word windows. Failures are counted by host; the hosts' rates give a beta prior (method of moments);
    a host whose shrunk rate (failures + a) / (documents + a + b) is above `max_host_failures` loses its other documents
    too. Returns doc_id, host, the features, base_failed, host_rate, kept.

    A missing text has no words and fails; a missing host is one host of its own, ''. Ids may be missing or repeat: each
    row is judged by itself. An empty table gives an empty result; one host alone keeps the prior a = b = 1. Other columns
    are not read. Texts are read once; a hot host's rows are counted before the shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, host string, " + ", ".join(f"{x} long" for x in _FEATURES)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    features = common.store(rows.mapInArrow(_features, schema).withColumn("base_failed", failed), "features")
    hosts = features.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if("base_failed").alias("f"))
    rates = hosts.select(F.avg(F.col("f") / F.col("n")).alias("m"), F.var_samp(F.col("f") / F.col("n")).alias("v"))
    strength = F.least(F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(2.0)), F.lit(1000.0))
    prior = rates.select(F.coalesce(F.col("m"), F.lit(0.5)).alias("m"), F.when((F.col("v") > 0) & F.col("m").between(1e-9, 1 - 1e-9), strength).otherwise(F.lit(2.0)).alias("s"))
    mean, strength = prior.first()
    shrunk = (F.col("f") + F.lit(mean) * F.lit(strength)) / (F.col("n") + F.lit(strength))
    verdicts = hosts.select("host", shrunk.alias("host_rate"))
    # Spark broadcasts the verdicts only while they are small, and splits a hot host in a sort-merge join else
    return features.join(verdicts, "host", "left").withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_host_failures))


def op3_query(spark, sf_dir: str) -> DataFrame:
    out = host_rules(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", *_FEATURES, "base_failed", "kept")


OP3_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
win AS (
  SELECT k, i, array_to_string(ws[i:i+4], ' ') AS g
  FROM (SELECT k, ws, unnest(range(1, greatest(len(ws) - 3, 1))) AS i FROM w)),
rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT k, count(DISTINCT i + j) AS n FROM rep, (SELECT unnest(range(0, 5)) AS j) GROUP BY k),
lin AS (SELECT k, unnest(string_split(t, chr(10))) AS l FROM w),
dup AS (SELECT k, count(*) - count(DISTINCT l) AS n FROM lin WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY k),
f AS (
  SELECT w.k, doc_id, host, len(ws)::BIGINT AS n_words,
         coalesce(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN dup ON dup.k = w.k LEFT JOIN cov ON cov.k = w.k),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
h AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE base_failed) AS fl FROM b GROUP BY host),
m AS (SELECT avg(fl / n) AS m, var_samp(fl / n) AS v FROM h),
p AS (SELECT m, CASE WHEN v > 0 AND m BETWEEN 1e-9 AND 1 - 1e-9 THEN least(greatest(m * (1 - m) / v - 1, 2.0), 1000.0) ELSE 2.0 END AS s FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (fl + m * s) / (n + s) <= 0.5 AS kept
FROM b JOIN h USING (host), p
"""
