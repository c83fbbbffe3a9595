"""Packing documents into fixed-length sequences by cutting-stock column generation."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Tokens of one unit of length; lengths are rounded up to units for the linear program, so a sequence of 4,096 tokens has 256.
UNIT = 16
#: Rests of fewer tokens than this are bundled with others of their length, so that little of a bundle's last unit is empty.
SHORT = 128
#: Full stops and the like: after a letter or digit they begin a pre-token of their own.
_STOPS = b".,;:!?"
#: Pieces that one worker keeps encoded, characters of the texts whose unknown pieces are encoded together, and pieces of one library call.
_CACHE_SIZE, _GROUP, _CALL = 500_000, 30_000, 128


class WordCoder:
    """ids of whole texts, as little-endian unsigned 32-bit integers, by word_bpe_49k.json or another tokenizer that lower-cases,
    drops white space and never joins across it: texts are split at \\x20 and \\x09-\\x0D, and each distinct piece is encoded once while it is cached."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), {}

    def raw(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def together(self, pieces: list[bytes]) -> list[bytes]:
        """Pieces without white space, encoded in one call with line ends between them."""
        text = b"\n".join(pieces).decode()
        encoded = self.tokenizer.encode(text, add_special_tokens=False)
        ids = np.array(encoded.ids, "<u4").tobytes()
        starts = np.cumsum([0, *(len(x) + 1 for x in text.split("\n"))])
        cuts = (4 * np.searchsorted(np.array([a for a, _ in encoded.offsets], np.int64), starts)).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def learn(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        """Unknown pieces. Stops after a letter or digit are cut off, plain letters lower-cased, so that forms of a word are encoded once."""
        cache, known, split, unknown = self.cache, {}, [], set()
        for p in pieces:
            base = p.rstrip(_STOPS)
            if base == p or not base[-1:].isalnum():
                base, stops = p, b""
            else:
                stops = p[len(base) :]
            if base.isalnum():
                base = base.lower()
            split.append((p, base, stops))
            if base not in cache:
                unknown.add(base)
            if stops and stops not in cache:
                unknown.add(stops)
        plain = [x for x in unknown if b"<|" not in x]
        for i in range(0, len(plain), _CALL):
            part = plain[i : i + _CALL]
            known.update(zip(part, self.together(part)))
        known.update((x, self.raw(x.decode())) for x in unknown if b"<|" in x)
        for p, base, stops in split:
            ids = known[base] if base in known else cache[base]
            known[p] = ids + (known[stops] if stops in known else cache[stops]) if stops else ids
        return known

    def ids(self, texts: list[str]) -> list[bytes]:
        lists, cache = [x.encode().split() for x in texts], self.cache
        new = self.learn(set().union(*lists).difference(cache))
        room = _CACHE_SIZE - len(cache)
        cache.update(new)
        out = [b"".join(map(cache.__getitem__, x)) for x in lists]
        for x in list(new)[max(room, 0) :]:  # what came first stays: frequent pieces come soon
            del cache[x]
        return out


def _grouped(texts: list[str], most: int = _GROUP) -> Iterator[list[str]]:
    group, size = [], 0
    for x in texts:
        group.append(x)
        size += len(x)
        if size > most:
            yield group
            group, size = [], 0
    yield group


def _pieces(path: str, length: int, end: int):
    """(doc_id, text) -> the pieces of each document: as many of full length as there are, and the rest."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, tail = common.kept(("words", path), lambda: WordCoder(path)), np.array([end], "<u4").tobytes()
        for batch in common.few(batches):
            rows, at = ([], [], [], [], []), iter(batch.column(0).to_pylist())
            for group in _grouped(batch.column(1).to_pylist()):
                for ids, doc in zip(coder.ids(group), at):  # ids first, so that no document is taken without them
                    ids += tail
                    n = len(ids) // 4
                    for start in range(0, n, length):
                        part = ids[4 * start : 4 * (start + length)]
                        for column, x in zip(rows, (doc, start, len(part) // 4, zlib.crc32(part), n)):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], schema=schema)

    return run


def knapsack(values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack over items of sizes 1, 2, ...: the best sum of `values` within each capacity, and its last item."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        n = min(c, len(values))
        sums = best[c - n : c][::-1] + values[:n]
        i = int(np.argmax(sums))
        best[c], last[c] = (sums[i], i + 1) if sums[i] > best[c - 1] + 1e-12 else (best[c - 1], 0)
    return best, last


def column_generation(demand: np.ndarray, most: int = 12_000, gap: float = 0.001) -> list[tuple[float, np.ndarray]]:
    """The linear program `fewest sequences whose patterns hold the demand`: patterns with their (fractional) numbers.

    demand[i] items have size i + 1; a sequence holds len(demand) units. Revised simplex; one knapsack over the prices
    gives, for each size, the best pattern that holds it, and all that still gain enter in turn. It ends within `gap` of
    the fill without any padding, at the optimum or after `most` steps; any basis reached holds the demand.
    """
    capacity, sizes = len(demand), np.flatnonzero(demand)
    if not len(sizes):
        return []
    d, row = demand[sizes].astype(float), np.full(capacity, -1)
    row[sizes] = np.arange(len(sizes))
    per = capacity // (sizes + 1)
    basis, inverse, x = np.diag(per).astype(float), np.diag(1.0 / per), d / per
    steps, gained, bound = 0, True, float(demand @ np.arange(1, capacity + 1)) / capacity
    while gained and steps < most and x.sum() > (1 + gap) * bound:
        gained, prices = False, np.zeros(capacity)
        prices[sizes] = np.maximum(inverse.sum(axis=0), 0)
        best, last = knapsack(prices, capacity)
        worth = prices[sizes] + best[capacity - sizes - 1]
        for i in sizes[np.argsort(-worth, kind="stable")]:
            if prices[i] + best[capacity - i - 1] <= 1 + 1e-7 or steps >= most:
                break
            column, c = np.zeros(len(sizes)), capacity - int(i) - 1
            column[row[i]] += 1
            while c > 0:
                if last[c]:
                    column[row[last[c] - 1]] += 1
                c -= max(1, int(last[c]))
            if inverse.sum(axis=0) @ column <= 1 + 1e-7:
                continue
            way = inverse @ column
            ratios = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
            out = int(np.argmin(ratios))
            step = ratios[out]
            if not np.isfinite(step):
                continue
            x = np.maximum(x - step * way, 0)
            x[out] = step
            basis[:, out] = column
            pivot = inverse[out] / way[out]
            inverse = inverse - np.outer(way, pivot)
            inverse[out] = pivot
            steps, gained = steps + 1, True
    patterns = []
    for j in range(len(sizes)):
        counts = np.zeros(capacity, np.int64)
        counts[sizes] = basis[:, j].round().astype(np.int64)
        patterns.append((float(x[j]), counts))
    return patterns


def fullest(left: np.ndarray) -> np.ndarray:
    """Of the items left, those that fill one sequence best (a subset sum over sizes with their numbers)."""
    capacity, items = len(left), []
    for i in np.flatnonzero(left)[::-1]:
        n, k = min(int(left[i]), capacity // (int(i) + 1)), 1
        while n > 0:
            items.append((int(i), min(k, n)))
            n, k = n - k, 2 * k
    reach, steps, mask = 1, [], (1 << (capacity + 1)) - 1
    for i, k in items:
        steps.append(reach)
        reach = (reach | reach << ((i + 1) * k)) & mask
        if reach >> capacity & 1:
            break
    c, out = reach.bit_length() - 1, np.zeros(capacity, np.int64)
    for (i, k), before in zip(items[: len(steps)][::-1], steps[::-1]):
        if not before >> c & 1:
            out[i] += k
            c -= (i + 1) * k
    return out


def plan(demand: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Patterns and how many sequences follow each; together they hold exactly the demand."""
    left, chosen = demand.astype(np.int64).copy(), []
    for x, counts in sorted(column_generation(demand), key=lambda p: -p[0]):
        held = counts > 0
        n = min(int(x + 1e-9), int((left[held] // counts[held]).min())) if held.any() else 0
        if n:
            chosen.append((n, counts))
            left -= n * counts
    while left.any():  # what rounding left over: at most about one sequence for each size
        counts = fullest(left)
        n = int((left[counts > 0] // counts[counts > 0]).min())
        chosen.append((n, counts))
        left -= n * counts
    return chosen


def bundle(length: int, unit: int, most: int = 64) -> tuple[int, int]:
    """How many rests of this length are taken together, and the units that they fill with least waste, of at most `most`."""
    best = min(range(1, most + 1), key=lambda u: (1.0, u) if unit * u < length else (round(1 - unit * u // length * length / (unit * u), 3), u))
    return (unit * best // length, best) if unit * best >= length else (1, -(-length // unit))


def pack(
    docs: DataFrame, length: int = 4096, end_id: int = 2, vocabulary: str = "word_bpe_49k.json", unit: int = UNIT, short: int = SHORT, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pack the tokens of whole documents, each closed by `end_id`, into sequences of at most `length` tokens.

    Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A document longer
    than a sequence is cut into full sequences and a rest; the rests, and all shorter documents, stay whole. Rests of less
    than `short` tokens are bundled with others of their length to items of nearly whole units. The items' lengths
    in units of `unit` tokens make a histogram (at most short + length / unit numbers, the only thing that the driver gathers); column generation over its
    patterns solves the cutting-stock program (it may end within a thousandth of the optimum, or after 12,000 steps), rounding down and
    filling up gives the patterns, and documents take the places of their length in the order of their rank.

    vocabulary: word_bpe_49k.json, by name for public_tokenizers.path() or as a path, or one that splits and lower-cases alike.

    A missing text counts as empty: one token, the end. Ids may be missing or repeat: each row is packed by itself. An
    empty table gives an empty result. Other columns are not read. Texts are read once and never shuffled.
    """
    path = public_tokenizers.path(vocabulary) if os.sep not in vocabulary else vocabulary
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    pieces = rows.mapInArrow(_pieces(path, length, end_id), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    # the kind of a piece: 0 is a full sequence, a short one has its exact length, others their units beyond
    kind = F.when(F.col("length") == length, 0).when(F.col("length") < short, F.col("length")).otherwise(short + F.ceil(F.col("length") / unit)).cast("int")
    pieces = common.store(common.with_bin(pieces.withColumn("kind", kind)), "pieces")
    histogram = {r["kind"]: r["n"] for r in pieces.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    demand, items = np.zeros(length // unit, np.int64), []
    for k, n in sorted(histogram.items()):
        each, units = bundle(k, unit, length // unit) if 0 < k < short else (1, k - short)
        if not k:
            continue
        for lo, hi, each, units in ((0, n // each * each, each, units), (n // each * each, n, 1, -(-k // unit) if k < short else units)):
            if hi > lo:
                items.append((k, lo, hi, each, units, int(demand[units - 1])))
                demand[units - 1] += (hi - lo) // each
    entries, taken, sequences = [], np.zeros(len(demand), np.int64), 0
    for n, counts in plan(demand):
        for place, i in enumerate(np.flatnonzero(counts)[::-1]):
            a = int(counts[i])
            entries.append((int(i) + 1, int(taken[i]), int(taken[i]) + n * a, a, sequences, place))
            taken[i] += n * a
        sequences += n
    ranked = common.number_within(pieces, ["kind"], ["doc_id", "start", "ids_crc32"], "rank")
    spark, ahead = docs.sparkSession, [F.lit(0).alias(x) for x in ("place", "within", "inner")]
    full = ranked.filter("kind = 0").select("*", (F.col("rank") + F.lit(sequences)).alias("sequence_id"), *ahead)
    # a few hundred kinds, and patterns of at most length / unit entries: bounded by the histogram
    made = F.broadcast(spark.createDataFrame(items, "kind int, first long, last long, each long, units int, base long"))
    places = F.broadcast(spark.createDataFrame(entries, "units int, lo long, hi long, a long, start_id long, place int"))
    rest = ranked.filter("kind > 0").join(made, "kind").filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    in_kind = F.col("rank") - F.col("first")
    rest = rest.withColumn("item", F.col("base") + F.floor(in_kind / F.col("each"))).withColumn("inner", F.pmod(in_kind, F.col("each")).cast("int"))
    in_pattern = F.col("item") - F.col("lo")
    rest = rest.join(places, "units").filter((F.col("item") >= F.col("lo")) & (F.col("item") < F.col("hi")))
    rest = rest.withColumn("sequence_id", F.col("start_id") + F.floor(in_pattern / F.col("a"))).withColumn("within", F.pmod(in_pattern, F.col("a")).cast("int"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "place", "within", "inner"]
    before = Window.partitionBy("sequence_id").orderBy("place", "within", "inner").rowsBetween(Window.unboundedPreceding, -1)
    placed = rest.select(columns).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    out = full.select(columns).withColumn("offset", F.lit(0).cast("long")).unionByName(placed)
    return out.select(*columns[:5], F.col("sequence_id").cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))


def op1_query(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
