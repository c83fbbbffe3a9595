"""Substring dedup: suffix automata of reference shards, and documents streamed for matching statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .words import mix, word_hashes

#: Words of an anchor: of the anchors in a window, the one of the smallest hash stands for it.
ANCHOR = 5
#: Words of the distinct passages that one automaton holds, at most; anchors with more are dealt by two anchors, and so on.
SHARD_WORDS = 100_000
#: Part of an anchor row whose anchor is known to be shared, dealt together with part 0.
KNOWN = -1
PLACES = "anchor long, passage binary, doc_key long, text_key long, start long"
_P = np.uint64(0x9E3779B97F4A7C15)


class SuffixAutomaton:
    """Of many word sequences, each with its document: knows the smallest document of every substring."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.least = [-1], [0], [None]

    def _state(self, length: int, following: dict, link: int, least) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.least.append(least)
        return len(self.length) - 1

    def _clone(self, p: int, q: int, word) -> int:
        new = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], self.least[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = new
            p = self.link[p]
        return new

    def add(self, words, document) -> None:
        last, length, link, following = 0, self.length, self.link, self.next
        for word in words:
            q = following[last].get(word)
            if q is not None:  # known already, from another sequence
                last = q if length[q] == length[last] + 1 else self._clone(last, q, word)
            else:
                new, p = self._state(length[last] + 1, {}, 0, None), last
                while p >= 0 and word not in following[p]:
                    following[p][word] = new
                    p = link[p]
                if p >= 0:
                    q = following[p][word]
                    link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, word)
                last = new
            if self.least[last] is None or document < self.least[last]:
                self.least[last] = document

    def finish(self) -> None:
        """The smallest document of a state is that of all states that its strings are suffixes of."""
        order = np.argsort(np.array(self.length), kind="stable")[::-1]
        for s in order.tolist():
            up, own = self.link[s], self.least[s]
            if up > 0 and own is not None and (self.least[up] is None or own < self.least[up]):
                self.least[up] = own

    def windows(self, words, width: int) -> list:
        """Matching statistics of a sequence, cut at `width`: the smallest document that has each window of that many words."""
        out, state, matched = [], 0, 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            while state and self.length[self.link[state]] >= width:
                state = self.link[state]
                matched = self.length[state]
            if i >= width - 1:
                out.append(self.least[state] if matched >= width else None)
        return out


def anchors(ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first window and number of windows of each anchor of a text's word hashes: every window of `width` words belongs to the anchor of the
    smallest hash in it (of equal ones the last), so equal windows have equal anchors at equal places."""
    n = len(ids) - width + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = min(ANCHOR, width)
    m = len(ids) - k + 1
    h = ids[:m].copy()
    for j in range(1, k):
        h = h * _P + ids[j : m + j]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    # sliding minimum over width - k + 1 anchors, by doubling; the place breaks ties
    span = width - k + 1
    best, at, size = h, np.arange(m), 1
    while size < span:
        step = min(size, span - size)
        left, right = best[: len(best) - step], best[step:]
        later = right <= left
        best, at, size = np.where(later, right, left), np.where(later, at[step:], at[: len(at) - step]), size + step
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return h[at[first]].view(np.int64), first, np.diff(first, append=n)


def _anchor_rows(width: int):
    """(doc_key, row_key, text) -> anchor, doc_key, row_key, part.

    Of an anchor that several documents of a batch share, one row goes to part KNOWN, which tells the other batches;
    the others are known to be shared and get parts of their own, above 0. The rest are in part 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.kept("substring_dedup", dict)
        for batch in batches:
            found = [np.unique(anchors(word_hashes(x)[0], width)[0]) for x in batch.column(2).cast(pa.binary()).to_pylist()]
            h = np.concatenate(found) if found else np.zeros(0, np.int64)
            if not len(h):
                continue
            row = np.repeat(np.arange(len(found)), [len(x) for x in found])
            order = np.argsort(h, kind="stable")
            h, row = h[order], row[order]
            docs = batch.column(0).to_numpy()[row]
            begins = np.ones(len(h), bool)
            begins[1:] = h[1:] != h[:-1]
            starts = np.flatnonzero(begins)
            known = (np.minimum.reduceat(docs, starts) < np.maximum.reduceat(docs, starts))[np.cumsum(begins) - 1]
            part = np.where(known, np.where(begins, KNOWN, 1 + docs % 1024), 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(docs), batch.column(1).take(pa.array(row)), pa.array(part)], ["anchor", "doc_key", "row_key", "part"])

    return run


def _passage_rows(width: int):
    """(doc_key, text_key, text, shared anchors) -> the passages of the shared anchors: the words of all their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.few(batches):
            columns: tuple = ([], [], [], [], [])
            for i, (text, wanted) in enumerate(zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3))):
                ids, begin, end = word_hashes(text)
                h, first, n = anchors(ids, width)
                chosen = np.isin(h, wanted.values.to_numpy())
                h, first, n = h[chosen], first[chosen], n[chosen]
                columns[0].extend(h.tolist())
                columns[1].extend([b" ".join(text[a:b].split()) for a, b in zip(begin[first].tolist(), end[first + n + width - 2].tolist())])
                columns[2].extend([i] * len(h))
                columns[3].extend(first.tolist())
            row = pa.array(columns[2], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), batch.column(0).take(row), batch.column(1).take(row), pa.array(columns[3], pa.int64())],
                ["anchor", "passage", "doc_key", "text_key", "start"],
            )

    return run


def _finer(width: int, level: int):
    """Passages of an anchor with too many -> their windows under that anchor together with the window's `level`-th smallest one."""
    k = min(ANCHOR, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple = ([], [], [], [])
            for i, (anchor, passage, start) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 4)))):
                ids, begin, end = word_hashes(passage)
                grams = ids[: len(ids) - k + 1].copy()
                for j in range(1, k):
                    grams = mix(grams * _P + ids[j : len(grams) + j])
                spans = np.sort(np.lib.stride_tricks.sliding_window_view(grams, width - k + 1), axis=1)
                keys = mix((np.uint64(anchor % 2**64) * _P) ^ spans[:, min(level, spans.shape[1]) - 1]).view(np.int64)
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                for a, n in zip(first.tolist(), np.diff(first, append=len(keys)).tolist()):
                    rows[0].append(keys[a])
                    rows[1].append(passage[begin[a] : end[a + n + width - 2]])
                    rows[2].append(i)
                    rows[3].append(start + a)
            row = pa.array(rows[2], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), batch.column(2).take(row), batch.column(3).take(row), pa.array(rows[3], pa.int64())], batch.schema.names)

    return run


def _matched(width: int):
    """Distinct passages in the order of their anchors -> the smallest document of each of their windows.

    Anchors are taken together to shards of at most SHARD_WORDS words (or one anchor); a shard's automaton is built, its passages are
    streamed through it, and it is dropped. A passage that is alone under its anchor needs none: it is its own match.
    """

    def answers(shard: list) -> list:
        automaton, by_anchor = SuffixAutomaton(), {}
        for anchor, *_ in shard:
            by_anchor[anchor] = by_anchor.get(anchor, 0) + 1
        vocab: dict[bytes, int] = {}
        sequences = []
        for anchor, passage, least, _ in shard:
            words = passage.split()
            if by_anchor[anchor] == 1:
                sequences.append(len(words) - width + 1)
                continue
            words = [vocab.setdefault(w, len(vocab)) for w in words]
            automaton.add(words, least)
            sequences.append(words)
        automaton.finish()
        return [[x[2]] * words if isinstance(words, int) else automaton.windows(words, width) for x, words in zip(shard, sequences)]

    def flush(shard: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in shard], pa.int64()), pa.array([x[3] for x in shard], pa.int64()), pa.array(answers(shard), pa.list_(pa.int64()))],
            ["anchor", "passage_key", "least"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size, own, n = [], 0, [], 0  # whole anchors, and the current one
        for batch in batches:
            for x in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if own and x[0] != own[0][0]:
                    shard.extend(own)
                    size, own, n = size + n, [], 0
                own.append(x)
                n += x[1].count(b" ") + 1
                if shard and size + n > SHARD_WORDS:
                    yield flush(shard)
                    shard, size = [], 0
        if shard or own:
            yield flush(shard + own)

    return run


def _without(width: int, columns: list[str], text_col: str):
    """Whole rows and the first words of their covered windows -> rows with what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.few(batches):
            texts, totals, removed, kept = [], [], [], []
            for text, runs in zip(batch.column(columns.index(text_col)).to_pylist(), batch.column(len(columns)).to_pylist()):
                words = text.encode().split() if text else []
                left = words
                if runs:
                    # maximal spans: the union of the covered windows
                    ends = np.zeros(len(words) + 1, np.int64)
                    at = np.array(runs, np.int64)
                    np.add.at(ends, at, 1)
                    np.add.at(ends, at + width, -1)
                    left = [words[i] for i in np.flatnonzero(np.cumsum(ends[:-1]) == 0).tolist()]
                joined = b" ".join(left).decode()
                texts.append(joined if len(left) < len(words) else text)
                totals.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(joined)
            arrays = [pa.array(texts, batch.column(i).type) if c == text_col else batch.column(i) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], [*columns, "n_words", "n_removed", "kept_words"])

    return run


def remove_repeats(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word that lies in a window of `width` words which a document of a smaller id has too.

    Returns all columns of `docs`, with the words that stay (joined by one space) as the text where any were removed, and
    n_words, n_removed (long) and kept_words (the words that stay, joined, of every row). Windows are judged on the input.

    Every window has an anchor, the five words of the smallest hash in it. Only anchors of several documents can stand
    for repeated windows; their passages (the words of all windows of one anchor) are the reference text. Passages are dealt by anchor into
    shards; each task builds the suffix automaton of a shard's distinct passages, with the smallest document of every
    state, and streams the passages through it for matching statistics. What it says of a distinct passage is joined
    back to all its places, and covered windows form the maximal spans that go.

    A missing or empty text has no words. A missing id is smaller than any other; rows of one id are one document, so
    their windows don't cover each other; rows that repeat an id and a text are gathered as one. An empty table gives an empty result. Columns named n_words, n_removed or
    kept_words are replaced; others, whatever their names, pass through. An anchor that many documents share is reduced in
    each task before the shuffle. Where an anchor's distinct passages have more than SHARD_WORDS words, their windows are dealt anew by that
    anchor and the next smallest in each window, until every anchor is within the bound or its windows have the same anchors throughout.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_words")]
    text = F.col(text_col).cast("string")
    keys = ["doc_key", "text_key"]
    rows = docs.filter(text.isNotNull()).select(common.key_of(id_col).alias("doc_key"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    rows = rows.withColumn("row_key", F.hash(*keys))  # tells rows of one id, or of none, apart; others of its value do no harm
    found = rows.select("doc_key", "row_key", "text").mapInArrow(_anchor_rows(width), "anchor long, doc_key long, row_key int, part int")
    alike = Window.partitionBy("anchor", F.greatest("part", F.lit(0)))
    shared = (F.col("part") > 0) | (F.min("part").over(alike) == KNOWN) | (F.min("doc_key").over(alike) < F.max("doc_key").over(alike))
    wanted = found.withColumn("shared", shared).filter("shared").groupBy("doc_key", "row_key").agg(F.collect_set("anchor").alias("anchors"))
    wanted = common.store(wanted, "wanted")
    common.release(spark)
    places = rows.join(wanted, ["doc_key", "row_key"]).select(*keys, "text", "anchors").mapInArrow(_passage_rows(width), PLACES)
    places = common.store(places.withColumn("passage_key", F.xxhash64("passage")), "places")
    common.discard(wanted)
    common.release(spark)
    passages = lambda df: df.groupBy("anchor", "passage_key", "passage").agg(F.min("doc_key").alias("least"))
    distinct = common.store(passages(places), "passages")
    common.release(spark)
    stored, level = [places, distinct], 1
    crowded = lambda df: common.store(df.groupBy("anchor").agg(F.sum(F.regexp_count(F.col("passage").cast("string"), F.lit(" ")) + 1).alias("n")).filter(F.col("n") > SHARD_WORDS).select("anchor"), "crowded")
    hot, parts = crowded(distinct), []
    while level < width - min(ANCHOR, width) + 1 and not hot.isEmpty():  # only these anchors' rows are written again
        level += 1
        finer = places.join(hot, "anchor", "left_semi").select("anchor", "passage", *keys, "start").mapInArrow(_finer(width, level), PLACES)
        finer = common.store(finer.withColumn("passage_key", F.xxhash64("passage")), "finer_places")
        parts.append((places.join(hot, "anchor", "left_anti"), distinct.join(hot, "anchor", "left_anti")))
        places, distinct = finer, common.store(passages(finer), "finer_passages")
        stored += [places, distinct]
        hot = crowded(distinct)
        common.release(spark)
    for other, few in parts:
        places, distinct = places.unionByName(other), distinct.unionByName(few)
    dealt = distinct.select("anchor", "passage", "least", "passage_key").repartition("anchor").sortWithinPartitions("anchor")
    matched = common.store(dealt.mapInArrow(_matched(width), "anchor long, passage_key long, least array<long>"), "matched")
    common.release(spark)
    # Spark splits a passage of very many places in this join
    placed = places.select("anchor", "passage_key", *keys, "start").join(matched, ["anchor", "passage_key"])
    covered = F.filter(F.transform("least", lambda x, i: F.when(x < F.col("doc_key"), F.col("start") + i)), lambda x: x.isNotNull())
    placed = placed.select(*keys, covered.alias("covered")).filter(F.size("covered") > 0)
    runs = common.store(placed.groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_set("covered"))).alias("covered")), "covered")
    common.discard(*stored, matched)
    common.release(spark)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), common.key_of(id_col).alias("doc_key"), F.xxhash64(text).alias("text_key"))
    whole = whole.join(runs, keys, "left").select(*[F.col("row").getField(c).alias(c) for c in columns], F.col("covered").alias("_covered"))
    schema = docs.select(*[F.col(f"`{c}`") for c in columns]).schema
    for name, kind in (("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_words", T.StringType())):
        schema = schema.add(name, kind)
    return whole.mapInArrow(_without(width, columns, text_col), schema)


def op9_query(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_words", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, hash(array_to_string(ws[i:i+12], ' ')) AS a, md5(array_to_string(ws[i:i+12], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 11, 1))) AS i FROM w)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY a, g) AS least FROM g) WHERE least < doc_id),
c AS (SELECT DISTINCT doc_id, i + j AS k FROM f, (SELECT unnest(range(0, 13)) AS j)),
r AS (SELECT doc_id, list(k) AS ks FROM c GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN ks IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(ks, i)), lambda i: ws[i]) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN r ON r.doc_id = w.doc_id
"""
