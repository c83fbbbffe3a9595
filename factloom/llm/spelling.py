"""Spelling variants: words one edit apart, found by integer keys of their deletions."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import mix

#: Distinct words that a task counts before it hands the counts on.
HELD = 200_000
#: Deletion keys that a task makes at once.
_KEYS = 200_000
#: Letters of runs in Latin-1, where a byte is a code point: A-Z as a-z, and C0 to FF; what is left parts runs.
_LETTER = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0xC0 else 0x20 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(20020601)
#: A random factor for each letter.
_LETTERS = _random.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
#: Distinguish keys of one length, and those of a place as well.
_LENGTHS, _PLACES = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
#: What a key of a word stands for: the word itself, the word less a letter, the word with any letter at one place.
OWN, LESS, PLACE = 0, 1, 2


def runs_of(text: str | None) -> list[bytes]:
    """Maximal runs of letters of one whole text in Latin-1, A-Z lower-cased; no other character is a letter."""
    return text.encode("latin-1", "replace").translate(_LETTER).split() if text else []


def spelled(doc_id: int | None, runs: Counter, shortest: int, every: int) -> Iterator[tuple[bytes, int]]:
    """Words and their numbers in one document: a run whose CRC-32 of `doc_id:run` `every` divides (0: none does) loses the letter at the CRC modulo its length."""
    start = zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":")
    for run, n in runs.items():
        if len(run) < shortest:
            continue
        if every and not (crc := zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)) % every:
            at = crc % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < shortest:
                continue
        yield run, n


def deletion_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each key of each word: the word's number, what the key stands for, the place (of a letter taken out), and the key.

    A word's hash is the sum of its letters' factors times powers of the base. Sums of prefixes, and of suffixes moved by one
    place, give the hash of the word without any one letter in two additions; of a run of equal letters only the first is taken out for LESS."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"".join(words), np.uint8)
    first = np.cumsum(lengths) - lengths
    of = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(raw)) - first[of]
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(lengths.max(initial=0)) + 1, _BASE)]), dtype=np.uint64)
    here, moved = _LETTERS[raw] * powers[at], _LETTERS[raw] * powers[np.maximum(at - 1, 0)]
    sums, shifted = (np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (here, moved))
    last = (first + lengths)[of]
    index = np.arange(len(raw))
    without = (sums[index] - sums[first[of]]) + (shifted[last] - shifted[index + 1])
    whole = sums[first + lengths] - sums[first]
    length = lengths.astype(np.uint64) * _LENGTHS
    less = mix(without + length[of] - _LENGTHS)
    place = mix(without + length[of] + (at.astype(np.uint64) + np.uint64(1)) * _PLACES)
    new = (at == 0) | (raw != np.concatenate([raw[:1], raw[:-1]]))
    n = len(words)
    return (
        np.concatenate([np.arange(n), of[new], of]), np.repeat([OWN, LESS, PLACE], [n, int(new.sum()), len(raw)]),
        np.concatenate([np.zeros(n, np.int64), at[new], at]), np.concatenate([mix(whole + length), less[new], place]).view(np.int64),
    )


def word_counts(docs: DataFrame, shortest: int, least: int, every: int, id_col: str, text_col: str) -> DataFrame:
    """word, n: words of at least `shortest` letters that occur `least` times or more in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in common.few(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, n in spelled(doc_id, Counter(runs_of(text)), shortest, every):
                    held[word] = held.get(word, 0) + n
                if len(held) > HELD:
                    yield rows()
                    held.clear()
        yield rows()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, word -> key, kind, at, id: all keys of each word, without the word, so that a long word's keys stay short."""
    for batch in common.few(batches, 10_000):
        words = [w.encode("latin-1") for w in batch.column(1).to_pylist()]
        sizes, start, ids = np.cumsum([2 * len(w) + 1 for w in words]), 0, batch.column(0).to_numpy()
        while start < len(words):
            end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + _KEYS)))
            of, kind, at, key = deletion_keys(words[start:end])
            for i in range(0, len(key), _KEYS):
                part = slice(i, i + _KEYS)
                columns = [pa.array(key[part]), pa.array(kind[part].astype(np.int8)), pa.array(at[part].astype(np.int32)), pa.array(ids[start:end][of[part]])]
                yield pa.RecordBatch.from_arrays(columns, ["key", "kind", "at", "id"])
            start = end


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Rows in the order of their keys -> tables of those whose key another row has too, and where each key begins and the last ends."""

    def shared(table: pa.Table) -> tuple[pa.Table, list[int]]:
        keys = table.column(0).to_numpy()
        new = np.ones(len(keys) + 1, bool)
        new[1:-1] = keys[1:] != keys[:-1]
        found = np.flatnonzero(~(new[:-1] & new[1:]))
        starts = np.flatnonzero(new[:-1][found])
        return table.take(pa.array(found)), [*starts.tolist(), len(found)]

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        if waiting and waiting[0].column(0)[0].as_py() != keys[0]:
            yield shared(pa.Table.from_batches(waiting))
            waiting = []
        last = int(np.searchsorted(keys, keys[-1]))  # the last key's rows wait for the next batch
        if last:
            yield shared(pa.Table.from_batches([*waiting, batch.slice(0, last)]))
            waiting = []
        waiting.append(batch.slice(last))
    if waiting:
        yield shared(pa.Table.from_batches(waiting))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, _ in _by_key(batches):
        yield from table.to_batches()


def _best(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The two first of rows (word, n) by falling n and rising word."""
    return sorted(rows, key=lambda r: (-r[1], r[0]))[:2]


def _meet(rows: list[tuple[int, int, str, int]]) -> Iterator[tuple[str, int, str, int]]:
    """word, n_near, best, best_n for words of rows (kind, at, word, n) of one key. Rows meet only where their strings are the same after the
    deletion, so words whose hashes collide stay apart; they meet by sums, and no pair is written."""
    met: dict = {}
    for kind, at, word, n in rows:
        text = word if kind == OWN else word[:at] + word[at + 1 :]
        met.setdefault((at, text) if kind == PLACE else text, ([], [], []))[kind].append((word, n))
    for own, less, place in met.values():
        if len(place) > 1:  # they differ in one letter
            best = _best(place)
            for word, _ in place:
                yield word, len(place) - 1, *(best[1] if best[0][0] == word else best[0])
        if own and less:  # the longer ones have one letter more than the own one
            yield own[0][0], len(less), *_best(less)[0]
            for word, _ in less:
                yield word, 1, *own[0]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, kind, at, word, n in the order of keys -> word, n_near, best, best_n of each key that rows share."""
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best", pa.string()), ("best_n", pa.int64())])
    for table, starts in _by_key(batches):
        rows = list(zip(*(table.column(i).to_pylist() for i in range(1, 5))))
        found = [x for a, b in zip(starts, starts[1:]) for x in _meet(rows[a:b])]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*found), schema)], schema=schema)


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms(word, form), whose chains end: each round doubles how far a word has come."""
    at = common.store(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        far = at.toDF("root", "farther")
        after = common.store(at.join(far, "root", "left").select("word", F.coalesce("farther", "root").alias("root"), F.col("farther").isNotNull().alias("moved")), "roots")
        common.discard(at)
        if after.filter("moved").isEmpty():
            return after.select("word", "root")
        at = common.store(after.select("word", "root"), "roots")
        common.discard(after)


def spelling_variants(
    docs: DataFrame, shortest: int = 7, least: int = 2, times: int = 10, every: int = 31, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """word, form, root, n, n_near and form_n of all words of at least `shortest` letters that occur `least` times or more.

    Runs of letters [A-Za-z\\u00C0-\\u00FF] of whole texts are words, A-Z lower-cased; with `every`, the documents misspell some of them
    (see spelled()). Words are near if they differ by one letter more, less or other: then the one less a letter is the other, or
    both less the letter of one place are the same. Every word sends out an integer key for itself and for each deletion; keys are dealt by their
    leading bits and sorted, words of equal keys meet, and their strings are compared. n_near is a word's number of near words; its form is
    the most frequent of them (ties: the smaller word), if that is at least `times` as frequent as the word itself; root follows forms to the last.
    Only words whose keys meet another's are looked up as strings.

    A missing or empty text has no words; a missing id misspells like an empty one. Ids and rows may repeat, and each row counts. An
    empty table gives an empty result. Other columns are not read. A key has one word for each letter at most, so
    none grows with the data; words are counted before the shuffle, and no pair of words is written.
    """
    spark = docs.sparkSession
    words = common.store(word_counts(docs, shortest, least, every, id_col, text_col), "counts")
    words = common.store(words.withColumn("id", F.monotonically_increasing_id()), "words")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = words.select("id", "word").mapInArrow(_keyed, "key long, kind byte, at int, id long")
    leading = F.shiftright("key", 44)  # 20 bits
    shared = common.store(keyed.repartition(ranges, leading).sortWithinPartitions("key").mapInArrow(_shared, "key long, kind byte, at int, id long"), "keys")
    spelt = shared.join(words, "id").select("key", "kind", "at", "word", "n")
    met = spelt.repartition(ranges, leading).sortWithinPartitions("key").mapInArrow(_near, "word string, n_near long, best string, best_n long")
    order = F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))
    met = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(order).alias("first"))
    found = words.join(met, "word", "left")
    best_n = -F.col("first.less")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(best_n >= times * F.col("n"), F.struct(F.col("first.best").alias("form"), best_n.alias("form_n"))).alias("f"))
    found = common.store(found.select("word", "n", "n_near", "f.form", "f.form_n"), "near")
    out = found.join(roots(found.filter("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_query(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(common.table(spark, sf_dir, "documents"))
