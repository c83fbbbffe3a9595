"""Byte-level BPE encoding and decoding by a global shuffle of distinct words."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Text bytes of one block of documents, which meets its distinct words again in one task.
BLOCK_BYTES = 32 << 20
_loaded: dict[str, object] = {}


def ranks_of(path: str) -> dict[bytes, int]:
    """The token-byte table: token bytes -> id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _pattern():
    if "pattern" not in _loaded:
        import regex

        _loaded["pattern"] = regex.compile(public_tokenizers.PATTERN).findall
    return _loaded["pattern"]


def _coder(path: str):
    """Encodes one pre-token, and the bytes of each id."""
    if path not in _loaded:
        import tiktoken

        ranks = ranks_of(path)
        # every pre-token is one piece here, whatever stands in it
        whole = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        _loaded[path] = whole.encode_ordinary, {i: b for b, i in ranks.items()}
    return _loaded[path]


def _planes(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit integers as four planes of bytes, of which the high ones compress to nothing."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _pack(words: list[str], ids: list[bytes] | None = None) -> bytes:
    """Words, which may hold any character, with their ids if any, as one compressed block."""
    data = [w.encode() for w in words]
    text = b"".join(data)
    parts = [np.array([len(words), len(text)], "<u4").tobytes(), _planes(np.array([len(x) for x in data])), text]
    if ids is not None:
        parts += [_planes(np.array([len(x) // 4 for x in ids])), _planes(np.frombuffer(b"".join(ids), "<u4"))]
    return zstandard.ZstdCompressor(level=6).compress(b"".join(parts))


def _unpack(block: bytes) -> tuple[list[str], list[bytes]]:
    data = zstandard.ZstdDecompressor().decompress(block)
    n, size = np.frombuffer(data, "<u4", 2).tolist()
    at = np.concatenate([[0], np.cumsum(_numbers(data[8 : 8 + 4 * n]), dtype=np.int64)]) + 8 + 4 * n
    words, end = [data[a:b].decode() for a, b in zip(at, at[1:])], 8 + 4 * n + size
    if end == len(data):
        return words, []
    at = np.concatenate([[0], 4 * np.cumsum(_numbers(data[end : end + 4 * n]), dtype=np.int64)])
    ids = _numbers(data[end + 4 * n :]).tobytes()
    return words, [ids[a:b] for a, b in zip(at, at[1:])]


class _Blocks:
    """Numbers the blocks of one task's documents, alike in every pass over the same rows."""

    def __init__(self, size: int):
        from pyspark import TaskContext

        context = TaskContext.get()
        self.size, self.task, self.filled, self.number = size, context.partitionId() if context else 0, 0, 0

    def cut(self, sizes: list[int]) -> Iterator[tuple[int, int, int]]:
        """block, and the first and last row of a batch that belong to it."""
        start = 0
        for i, n in enumerate(sizes):
            if self.filled and self.filled + n > self.size:
                if i > start:
                    yield self.task << 32 | self.number, start, i
                start, self.filled, self.number = i, 0, self.number + 1
            self.filled += n
        if len(sizes) > start:
            yield self.task << 32 | self.number, start, len(sizes)


def _words_of_blocks(ranges: int, block_bytes: int):
    """(doc_id, text) -> the distinct pre-tokens of each block, one row for each word range."""

    def flush(block: int, words: set[str]) -> Iterator[pa.RecordBatch]:
        dealt: dict[int, list[str]] = {}
        for w in sorted(words):
            dealt.setdefault(int.from_bytes(hashlib.blake2b(w.encode(), digest_size=4).digest(), "little") % ranges, []).append(w)
        for r, own in dealt.items():
            yield pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int32()), "block": pa.array([block], pa.int64()), "data": pa.array([_pack(own)], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, blocks, current, words = _pattern(), _Blocks(block_bytes), None, set()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for block, a, b in blocks.cut(list(map(len, texts))):
                if block != current:
                    yield from flush(current, words)
                    current, words = block, set()
                for text in texts[a:b]:
                    words.update(split(text))
        yield from flush(current, words)

    return run


def _encode_words(path: str):
    """Rows of one word range, in order -> each block's words with their ids; each distinct word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = _coder(path)
        known: dict[str, bytes] = {}
        current = None
        for batch in batches:
            for r, block, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if r != current:
                    current, known = r, {}
                words, _ = _unpack(data)
                ids = []
                for w in words:
                    x = known.get(w)
                    if x is None:
                        x = known[w] = np.array(encode(w), "<u4").tobytes()
                    ids.append(x)
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "kind": pa.array([0], pa.int32()), "data": pa.array([_pack(words, ids)], pa.binary())})

    return run


def _pack_documents(block_bytes: int):
    """(doc_id, text) -> compressed pieces of each block's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(block_bytes)
        for batch in batches:
            for block, a, b in blocks.cut(list(map(len, batch.column(1).to_pylist()))):
                sink = pa.BufferOutputStream()
                part = batch.slice(a, b - a)
                with pa.ipc.new_stream(sink, part.schema) as writer:
                    writer.write_batch(part)
                data = zstandard.ZstdCompressor(level=6).compress(sink.getvalue().to_pybytes())
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "kind": pa.array([1], pa.int32()), "data": pa.array([data], pa.binary())})

    return run


def _encode_documents(path: str):
    """Rows of each block in order, its words first -> a digest row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, token_bytes = _coder(path)
        split, current, ids_of, bytes_of = _pattern(), None, {}, {}
        for batch in batches:
            for block, kind, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if block != current:
                    current, ids_of, bytes_of = block, {}, {}
                if kind == 0:
                    words, ids = _unpack(data)
                    ids_of.update(zip(words, ids))
                    # decoding: the ids joined with the token-byte table
                    bytes_of.update((x, b"".join(map(token_bytes.__getitem__, np.frombuffer(x, "<u4").tolist()))) for x in ids if x not in bytes_of)
                    continue
                part = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all()
                rows = ([], [], [])
                for text in part.column(1).to_pylist():
                    words = split(text)
                    try:
                        ids = list(map(ids_of.__getitem__, words))  # by position
                    except KeyError:  # a source that deals its rows anew each time: words that this block did not ask for
                        for w in {w for w in words if w not in ids_of}:
                            x = ids_of[w] = np.array(encode(w), "<u4").tobytes()
                            bytes_of[x] = b"".join(map(token_bytes.__getitem__, np.frombuffer(x, "<u4").tolist()))
                        ids = list(map(ids_of.__getitem__, words))
                    joined = b"".join(ids)
                    rows[0].append(len(joined) // 4)
                    rows[1].append(hashlib.sha256(joined).hexdigest())
                    rows[2].append(hashlib.sha256(b"".join(map(bytes_of.__getitem__, ids))).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0).combine_chunks(), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_decode(docs: DataFrame, vocabulary: str = "byte_bpe_multi_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Encode whole texts by a byte-level BPE and decode the ids again: n_tokens and the digests of ids and bytes.

    vocabulary: a name for public_tokenizers.path(), or a path, of a rank table. Each task's documents form blocks of
    about `block_bytes` of text. Pre-tokens are exploded where documents are read; the distinct ones of each block
    are sent once, dealt by word, so a frequent word costs no more than a rare one. Where a word arrives it is encoded
    once for the whole corpus, and its ids go back to the blocks that asked. Every block then meets its documents: ids are
    put together by position, and decoded through the token-byte table.

    A missing text counts as empty: 0 tokens and the digest of nothing. Ids may be missing or repeat; each row is encoded
    by itself. An empty table gives an empty result. Other columns are not read. A task holds one block's distinct words,
    or one word range's.
    """
    path = public_tokenizers.path(vocabulary) if os.sep not in vocabulary else vocabulary
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    parts = max(12, size // block_bytes)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    asked = rows.mapInArrow(_words_of_blocks(parts, block_bytes), "range int, block long, data binary")
    answers = asked.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(_encode_words(path), "block long, kind int, data binary")
    packed = rows.mapInArrow(_pack_documents(block_bytes), "block long, kind int, data binary")
    # documents come first, so that their tasks have the numbers that they had when words were asked for
    met = packed.unionByName(answers).repartition(parts, "block").sortWithinPartitions("block", "kind")
    return met.mapInArrow(_encode_documents(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_query(spark, sf_dir: str) -> DataFrame:
    return encode_decode(common.table(spark, sf_dir, "documents"))
