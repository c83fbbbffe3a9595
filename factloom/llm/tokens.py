"""Token counts of whole texts by a byte-level BPE, with overlap resynchronisation for huge documents."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Texts of more characters are cut into chunks of so many.
CHUNK = 32_768
#: Characters that the first overlap of two chunks has.
OVERLAP = 512
#: White space by any library's definition, or something that may be: only a run of other characters counts as a word.
_ODD = re.compile(r"[^\S \n]|[\x1c-\x1f\x85\u180e\u200b\ufeff]|[ \n]{2}")
_STABLE = re.compile(r"(?<=[^\s\x1c-\x1f\x85\u180e\u200b\ufeff])(?=[ \n])")
_SIMPLE = re.compile(r"([ \n][^\W\d_]+)([.,;:!?]+)?")
#: Pieces, and letter runs of pieces, that one worker keeps counted.
_CACHE_SIZE, _PARTS_SIZE = 300_000, 1_000_000


class Counter:
    """Counts tokens piece by piece: a place between a word's last character and the blank after it is always a
    boundary of the byte-level pre-tokenizer, whatever stands around, so counts of the pieces between them add up."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.cache, self.parts = Tokenizer.from_file(path), {}, {}

    def raw(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def together(self, parts: list[str]) -> dict[str, int]:
        """Parts that begin with a blank and hold no other, counted in one call: what stands before a blank ends there."""
        encoded = self.tokenizer.encode("".join(parts), add_special_tokens=False)
        starts = np.cumsum([0, *map(len, parts)])
        cuts = np.searchsorted(np.array([a for a, _ in encoded.offsets], np.int64), starts)
        return dict(zip(parts, np.diff(cuts).tolist()))

    def learn(self, pieces: set[str]) -> dict[str, int]:
        """Unknown pieces: a word after its blank and punctuation behind it are pre-tokens, and kept by themselves."""
        split, unknown = {}, {}
        for p in pieces:
            text = p if p[0] == "\n" else " " + p
            simple = _SIMPLE.fullmatch(text)
            split[p] = [x for x in simple.groups() if x] if simple else [text]
            unknown.update((x, None) for x in split[p] if x not in self.parts)
        plain = [x for x in unknown if x[0] in " \n" and "<|" not in x]
        new = self.together(plain) if plain else {}
        new.update((x, self.raw(x)) for x in unknown if x not in new)
        out = {p: sum(new[x] if x in new else self.parts[x] for x in own) for p, own in split.items()}
        if len(self.parts) < _PARTS_SIZE:
            self.parts.update(new)
        if len(self.cache) < _CACHE_SIZE:
            self.cache.update(out)
        return out

    def count(self, text: str) -> int:
        if not text:
            return 0
        if _ODD.search(text):
            cuts = [0, *(m.start() for m in _STABLE.finditer(text)), len(text)]
            return sum(self.raw(text[a:b]) for a, b in zip(cuts, cuts[1:])) if len(cuts) > 2 and len(text) > 2000 else self.raw(text)
        first, *pieces = text.replace("\n", " \n").split(" ")
        if not pieces:
            return self.raw(text)
        total, cache = self.raw(first) if first else 0, self.cache
        if pieces[-1] == "":  # the text ends with a blank
            total, pieces = total + self.raw(" "), pieces[:-1]
        try:
            return total + sum(map(cache.__getitem__, pieces))
        except KeyError:
            new = self.learn({p for p in pieces if p not in cache})
            return total + sum([cache[p] if p in cache else new[p] for p in pieces])


def counter(path: str) -> Counter:
    return common.kept(("counter", path), lambda: Counter(path))


def chunk_boundaries(tokenizer, text: str, head: int, tail: int, most: int = 16) -> tuple[list[tuple[int, int]], list[tuple[int, int]], int]:
    """Encode one chunk with offsets: boundaries at stable places of its first `head` and of its characters from `tail`
    on, each with the number of tokens before it, and the number of all tokens."""
    encoded = tokenizer.encode(text, add_special_tokens=False)
    starts: dict[int, int] = {}
    for i, (a, _) in enumerate(encoded.offsets):
        starts.setdefault(a, i)
    ends = {b for _, b in encoded.offsets}
    found = ([], [])
    for side, lo, hi in ((0, 1, head), (1, max(tail, 1), len(text))):
        for m in _STABLE.finditer(text, lo, hi):
            p = m.start()
            if p in starts and p in ends:  # a token ends here and the next one begins
                found[side].append((p, starts[p]))
                if len(found[side]) == most:
                    break
    return *found, len(encoded.ids)


def _huge(docs: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """key, text -> key, n_tokens, for texts longer than `chunk`; widens overlaps until all neighbours align."""
    spot = "array<struct<pos:long,n:long>>"

    def cut(overlap: int):
        def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    starts = range(0, len(text), chunk) if overlap < len(text) else [0]
                    for k, s in enumerate(starts):
                        last = k == len(starts) - 1
                        part = text[s:] if last else text[s : s + chunk + overlap]
                        yield pa.RecordBatch.from_pylist([{"key": key, "k": k, "last": last, "at": s, "part": part}])

        return chunks

    def encode(overlap: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokenizer = counter(path).tokenizer
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    head, tail, n = chunk_boundaries(tokenizer, r["part"], overlap if r["k"] else 0, len(r["part"]) if r["last"] else chunk)
                    spots = [[{"pos": p + r["at"], "n": i} for p, i in side] for side in (head, tail)]
                    rows.append({"key": r["key"], "k": r["k"], "last": r["last"], "head": spots[0], "tail": spots[1], "n": n})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("key", pa.string()), ("k", pa.int64()), ("last", pa.bool_()), ("head", spot_type), ("tail", spot_type), ("n", pa.int64())]))

        spot_type = pa.list_(pa.struct([("pos", pa.int64()), ("n", pa.int64())]))
        return run

    done, open_ = None, docs
    while True:
        parts = open_.mapInArrow(cut(overlap), "key string, k long, last boolean, at long, part string")
        parts = parts.repartition(F.col("key"), F.col("k"))  # a huge document's chunks go to many tasks
        coded = parts.mapInArrow(encode(overlap), f"key string, k long, last boolean, head {spot}, tail {spot}, n long")
        by = Window.partitionBy("key").orderBy("k")
        before = lambda side: F.get(F.filter(side, lambda x: x["pos"] == F.col("splice")), F.lit(0))["n"]
        shared = F.array_intersect(F.transform("tail", lambda x: x["pos"]), F.transform("next", lambda x: x["pos"]))
        linked = coded.withColumn("next", F.lead("head").over(by)).withColumn("splice", F.try_element_at(shared, F.lit(1)))
        # tokens of this chunk up to the splice, less those of the next chunk before it
        part = F.when(F.col("last"), F.col("n")).otherwise(before("tail") - before("next"))
        sums = linked.groupBy("key").agg(F.sum(part).alias("n_tokens"), F.bool_and(F.col("last") | F.col("splice").isNotNull()).alias("aligned"))
        sums = common.store(sums, f"aligned_{overlap}")
        good = sums.filter("aligned").select("key", "n_tokens")
        done = good if done is None else done.unionByName(good)
        if sums.filter("not aligned").isEmpty():
            return done
        open_ = open_.join(sums.filter("not aligned").select("key"), "key", "left_semi")
        overlap *= 8


def token_counts(
    docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """n_bytes, n_tokens and over_limit of every whole text, as the library for `vocabulary` counts them.

    vocabulary: a name for public_tokenizers.path(), or a path. Texts of at most `chunk` characters are encoded where
    they are read. Longer ones are cut into overlapping chunks that go to many tasks; each is encoded with offsets, and
    neighbours are spliced at the first common token boundary that is provably stable (between a word's end and the blank
    after it). Documents with a splice that has none are done again with an overlap eight times as wide, at last whole.

    A missing text counts as empty: 0 tokens. Ids may be missing or repeat: each row is counted by itself. An empty table
    gives an empty result. Other columns are not read. Only documents longer than `chunk` are shuffled.
    """
    path = public_tokenizers.path(vocabulary) if os.sep not in vocabulary else vocabulary

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = counter(path)
        for batch in batches:
            counts = [one.count(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    # texts of equal content have equal counts, so a text's digest is its key
    long_ = F.char_length("text") > chunk
    short = rows.filter(~long_).mapInArrow(small, "doc_id long, n_bytes long, n_tokens long")
    huge = rows.filter(long_).withColumn("key", F.md5("text"))
    counted = _huge(huge.select("key", "text").dropDuplicates(["key"]), path, chunk, overlap)
    huge = huge.select("doc_id", "n_bytes", "key").join(counted, "key").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(huge).withColumn("over_limit", F.col("n_tokens") > limit)


def op4_query(spark, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"))
