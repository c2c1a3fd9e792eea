"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves every pre-token that is itself a
vocabulary entry. Tier two: the misses are merged with a heap of adjacent pairs over a linked list of
bytes, lowest rank first. Texts are handled in byte-bounded passes; within a pass each distinct
pre-token is resolved once.

Edge cases: a null text is the empty text (no ids, empty decoding); a text of any length is encoded
whole; repeated rows give repeated results; an empty table gives an empty result; a null doc_id is
carried through; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.llm import common

#: Misses remembered by one Python worker before it starts anew.
MEMO_ENTRIES = 400_000

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
IDS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def read_ranks(path: str) -> list[bytes]:
    """Token bytes in order of rank from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        ranked = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [ranked[i] for i in range(len(ranked))]


def joined(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(keys) + 1, np.int64)
    np.cumsum([len(k) for k in keys], out=offsets[1:])
    return np.frombuffer(b"".join(keys), np.uint8), offsets


class PerfectHash:
    """Minimal perfect hash by levels: n keys take exactly n slots.

    Each level hashes the keys left over into twice as many bits; keys alone on their bit stay there,
    the others go on to the next level. A key's slot is the number of set bits before its own.
    """

    def __init__(self, keys: list[bytes]) -> None:
        self.n = n = len(keys)
        self.data, self.offsets = joined(keys)
        hashed = self.hash(self.data, self.offsets)
        if len(np.unique(hashed)) != n:
            raise ValueError("the keys are not distinct")
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.value = np.zeros(n, np.int64)
        left, taken = np.arange(n), 0
        while len(left):
            size = 2 * len(left)
            bit = self.bit(hashed[left], len(self.levels), size)
            alone = np.bincount(bit, minlength=size) == 1
            slots = taken + np.cumsum(alone) - 1
            self.levels.append((alone, slots))
            stay = alone[bit]
            self.value[slots[bit[stay]]] = left[stay]
            taken += int(alone.sum())
            left = left[~stay]

    @staticmethod
    def hash(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return common.word_hashes(data, offsets[:-1], offsets[1:])

    @staticmethod
    def bit(hashed: np.ndarray, level: int, size: int) -> np.ndarray:
        return (common.mix(hashed + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    def find(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Index of each key, -1 for strings that are no key (bytes are compared)."""
        hashed = self.hash(data, offsets)
        found, open_ = np.full(len(hashed), -1, np.int64), np.arange(len(hashed))
        for level, (alone, slots) in enumerate(self.levels):
            bit = self.bit(hashed[open_], level, len(alone))
            here = alone[bit]
            found[open_[here]] = self.value[slots[bit[here]]]
            open_ = open_[~here]
        sizes = np.diff(offsets)
        rows = np.flatnonzero((found >= 0) & (sizes > 0) & (sizes == self.offsets[found + 1] - self.offsets[found]))
        size = sizes[rows]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        differ = data[inside + np.repeat(offsets[rows], size)] != self.data[inside + np.repeat(self.offsets[found[rows]], size)]
        same = np.bincount(np.repeat(np.arange(len(rows)), size), weights=differ, minlength=len(rows)) == 0
        out = np.full(len(hashed), -1, np.int64)
        out[rows[same]] = found[rows[same]]
        return out


class ByteBPE:
    """Encoder and decoder for ranks in which every single byte is a token."""

    def __init__(self, tokens: list[bytes], pattern: str) -> None:
        import regex

        self.tokens = tokens
        self.split = regex.compile(pattern).findall
        self.table = PerfectHash(tokens)
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.memo: dict[bytes, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token by repeated merging of the leftmost pair of lowest rank."""
        ids = self.memo.get(piece)
        if ids is not None:
            return ids
        ranks, n = self.ranks, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at a byte
        live = bytearray(b"\1") * n
        heap = []
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                heap.append((rank, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not live[i] or (middle := end[i]) >= stop or end[middle] != stop:
                continue
            live[middle] = 0
            end[i] = stop
            if stop < n:
                before[stop] = i
                rank = ranks.get(piece[i : end[stop]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, end[stop]))
            if (left := before[i]) >= 0:
                rank = ranks.get(piece[left:stop])
                if rank is not None:
                    heapq.heappush(heap, (rank, left, stop))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = end[i]
        if len(self.memo) >= MEMO_ENTRIES:
            self.memo.clear()
        self.memo[piece] = ids
        return ids

    def resolve(self, pieces: list[str]) -> list[list[int]]:
        """Ids of distinct pre-tokens."""
        raw = [p.encode("utf-8") for p in pieces]
        found = self.table.find(*joined(raw)).tolist()
        return [[k] if k >= 0 else self.merge(p) for k, p in zip(found, raw, strict=True)]

    def encode_batch(self, texts: list[str | None]) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
        """Ids of the distinct pre-tokens, the pre-token at each place, and each text's first place."""
        places: list[str] = []
        first = np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            if text:
                places += self.split(text)
            first[i + 1] = len(places)
        codes, distinct = pd.factorize(np.array(places, dtype=object)) if places else (np.zeros(0, np.int64), [])
        return self.resolve(list(distinct)), codes, first

    def encode(self, text: str | None) -> list[int]:
        ids, codes, _ = self.encode_batch([text])
        return [x for c in codes.tolist() for x in ids[c]]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_encoders: dict[tuple[str | None, str], ByteBPE] = {}


def encoder(name: str, folder: str | None, pattern: str | None) -> ByteBPE:
    """The worker's encoder, built once."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    path = common.vocabulary(name, folder)
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = ByteBPE(read_ranks(path), pattern)
    return _encoders[path, pattern]


def digests(docs: DataFrame, name: str = "byte_bpe_50k.tiktoken", folder: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per document: number of ids, digest of the ids and of what they decode to."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.enter("byte_bpe", _encoders.clear)
        coder = encoder(name, folder, pattern)
        for batch in batch_iter:
            column = batch.column(1)
            for a, b, _, _ in common.text_passes(column):
                ids, codes, first = coder.encode_batch(column.slice(a, b - a).to_pylist())
                counts = np.fromiter(map(len, ids), np.int64, len(ids))
                words, pieces = np.empty(len(ids), object), np.empty(len(ids), object)
                words[:] = [" ".join(map(str, x)) for x in ids]
                pieces[:] = [coder.decode(x) for x in ids]
                parts = [codes[first[i] : first[i + 1]] for i in range(b - a)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).cast(pa.int64()),
                        pa.array([int(counts[p].sum()) for p in parts], pa.int64()),
                        pa.array([hashlib.sha256(" ".join(words[p].tolist()).encode()).hexdigest() for p in parts], pa.string()),
                        pa.array([hashlib.sha256(b"".join(pieces[p].tolist())).hexdigest() for p in parts], pa.string()),
                    ],
                    schema=SCHEMA,
                )

    common.tune(docs.sparkSession)
    return common.spread(docs.select(F.col("doc_id").cast("long"), "text")).transform(common.in_arrow, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, name: str = "byte_bpe_50k.tiktoken", folder: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per document with its ids."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.enter("byte_bpe", _encoders.clear)
        coder = encoder(name, folder, pattern)
        for batch in batch_iter:
            column = batch.column(1)
            for a, b, _, _ in common.text_passes(column):
                ids, codes, first = coder.encode_batch(column.slice(a, b - a).to_pylist())
                rows = [[x for c in codes[first[i] : first[i + 1]].tolist() for x in ids[c]] for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(rows, pa.list_(pa.int32()))], schema=IDS_SCHEMA)

    common.tune(docs.sparkSession)
    return common.spread(docs.select(F.col("doc_id").cast("long"), "text")).transform(common.in_arrow, run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, name: str = "byte_bpe_50k.tiktoken", folder: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per row of ``encoded`` (doc_id, ids) with the decoded bytes; null ids give empty bytes."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(name, folder, pattern)
        for batch in batch_iter:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([coder.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).transform(common.in_arrow, run, "doc_id long, decoded binary")
