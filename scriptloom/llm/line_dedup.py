"""Fuzzy line deduplication: one line stays of every component of similar lines.

1. Documents are packed into blocks (module blocks). Blocks send 128-bit hashes of their distinct lines
   (what stands between line ends) and learn which ones stand earlier. Only the first occurrence of each
   line goes on; a line is known by its block and its place there.
2. Those lines, lower-cased for A-Z, become sets of 8-character shingles and sketches of 64 registers; 16
   bands of 4 registers find candidates from a similarity of 0.8 on with a chance of 0.9998 or more.
3. Candidates' lines are asked for from their blocks, verified by exact Jaccard similarity and joined to
   components as near-duplicate documents are (module near_dedup), by distributed star contraction.
4. Of each component the occurrence in the smallest document, first line, stays. Blocks learn which of
   their lines go.

Edge cases: a null text is empty; blank lines are neither compared nor removed; a line shorter than a
shingle is one shingle; documents and lines of any length count in full; a document may lose all its
lines and then has an empty text; rows that repeat a doc_id are ordered by their block; a row without
a doc_id comes after all others; an empty table gives an empty result; other columns are ignored, or
carried through by ``without_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.llm import blocks, buckets, common, near_dedup

#: Characters of a shingle (hashed by doubling, so fixed here), hash bits that choose one of 64 registers, the
#: similarity in hundredths, and characters that are hashed at once.
SHINGLE, REGISTER_BITS, PERCENT, CHUNK = 8, 6, 80, 1 << 15
#: Bits of a line's id that tell its place in its block.
LINE_BITS = 28


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all lines, and each row's first line (one more than rows)."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    first = np.searchsorted(breaks, offsets) + np.arange(len(offsets))
    return starts, ends, first


def shingles(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the lines, in order, and each line's first (one more than lines)."""
    # A line is followed by as many spaces as keep shingles inside lines; those that begin in them are left out.
    pad = b" " * (SHINGLE - 1)
    text = pad.join(lines) + pad
    points = np.frombuffer(text.translate(common._lower).decode().encode("utf-32-le"), np.uint32)
    sizes = np.array([len(x) for x in lines], np.int64)
    if len(points) < len(text):
        extra = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) == 0x80, dtype=np.int32)])
        ends = np.cumsum(sizes + len(pad))
        sizes = sizes - (extra[ends] - extra[ends - len(pad) - sizes])
    begin = np.concatenate([[0], np.cumsum(sizes + len(pad))])[:-1]
    out = np.empty(len(points), np.uint64)
    for a in range(0, len(points), CHUNK):
        c = np.zeros(min(CHUNK, len(points) - a) + SHINGLE, np.uint64)
        part = points[a : a + len(c)]
        c[: len(part)] = part
        two = c[:-1] | c[1:] << np.uint64(21)
        four = common.mix(two[:-2] * common.GOLDEN + two[2:] * common.SECOND)
        out[a : a + CHUNK] = common.mix(four[:-4] * common.GOLDEN + four[4:] * common.THIRD)[: len(out[a : a + CHUNK])]
    count = np.maximum(sizes - SHINGLE + 1, 1)
    first = np.concatenate([[0], np.cumsum(count)])
    edge = np.zeros(len(points) + 1, np.int8)
    edge[begin] += 1
    edge[begin + count] -= 1
    found = out[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    short = np.flatnonzero(sizes < SHINGLE)
    found[first[:-1][short]] = common.mix(found[first[:-1][short]] + sizes[short].astype(np.uint64) * common.SECOND + common.GOLDEN)
    return found, first


def sketches(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Registers of each line: the least hash of each of 64 buckets."""
    rows, buckets_ = len(first) - 1, 1 << REGISTER_BITS
    least = np.full(rows * buckets_, np.uint64((1 << 64) - 1))
    place = np.repeat(np.arange(rows) * buckets_, np.diff(first)) + (hashes >> np.uint64(64 - REGISTER_BITS)).astype(np.int64)
    np.minimum.at(least, place, hashes << np.uint64(REGISTER_BITS))
    out = np.full(len(least), near_dedup.EMPTY)
    full = least != np.uint64((1 << 64) - 1)
    out[full] = near_dedup.compressed(least[full])
    return out.reshape(rows, buckets_)


def passes(lines: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first line, end line, shingle hashes, each line's first) for byte-bounded runs of lines."""
    for a, b in common.slices(np.fromiter(map(len, lines), np.int64, len(lines)), common.PASS_BYTES):
        yield a, b, *shingles(lines[a:b])


def _sets(lines: list[bytes]) -> list[np.ndarray]:
    """Shingle sets of lines: what travels is the line, a fraction of its set's size."""
    out: list[np.ndarray] = []
    for _, _, hashes, first in passes(lines):
        hashes, first = common.distinct_in_rows(hashes, first)
        out += [hashes[i:j] for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    return out


class LineBlock(blocks.Block):
    """The lines of a packed block; ``new`` are the first occurrences in the block of all that are not blank."""

    def __init__(self, rows: bytes) -> None:
        super().__init__(rows)
        self.starts, self.ends, self.first = line_spans(self.data, self.offsets)
        ink = np.concatenate([[0], np.cumsum(common.ink(self.data), dtype=np.int32)])
        self.ink = ink[self.ends] > ink[self.starts]

    def known(self) -> None:
        lines = np.flatnonzero(self.ink)
        keys = common.digests(self.data, self.starts[lines], self.ends[lines])
        _, new = np.unique(keys.view([("key", np.uint64), ("check", np.uint64)]).ravel(), return_index=True)
        new.sort()
        self.new, self.keys, self.checks = lines[new], np.ascontiguousarray(keys[new, 0]), np.ascontiguousarray(keys[new, 1])

    def owner(self, lines: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, lines, side="right") - 1

    def unseen(self, answers: dict[int, tuple], to: np.ndarray) -> np.ndarray:
        """The lines that stand nowhere earlier."""
        self.known()
        new = np.ones(len(self.new), bool)
        new[blocks.told(answers, self.keys, to)[0]] = False
        return self.new[new]

    def texts(self, lines: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.starts[lines].tolist(), self.ends[lines].tolist(), strict=True)]

    def removed(self, answers: blocks.Answers, to: np.ndarray) -> np.ndarray:
        gone = self.ink.copy()
        gone[self.unseen(answers[0] | answers[1], to)] = False
        gone[[x[0] for x in answers[2]]] = True
        return gone


def _steps(docs: DataFrame, percent: int) -> tuple[common.Stored, list[DataFrame], np.ndarray]:
    """The stored blocks, and the answers which of their lines go."""
    tasks = common.shuffle_partitions(docs.sparkSession)
    to = buckets.partition_keys(tasks)
    null = F.lit(None).cast("binary")
    made = common.store(blocks.packed(docs), "lines-blocks")

    def sent(block: LineBlock, _: blocks.Answers, number: int) -> Iterator[pa.RecordBatch]:
        block.known()
        yield blocks.sending(number, to, block.keys, block.checks, block.ids[block.owner(block.new)], block.new)

    given = blocks.with_answers(made, [], LineBlock, sent, blocks.SENT_DDL)
    exact = common.store(given.repartition(tasks, "p").transform(common.in_arrow, blocks.earlier(np.uint64, False), blocks.ANSWER_DDL), "lines-exact")

    def banded(block: LineBlock, got: blocks.Answers, number: int) -> Iterator[pa.RecordBatch]:
        lines = block.unseen(got[1], to)
        for a, b, hashes, first in passes(block.texts(lines)):
            keys = near_dedup.band_keys(sketches(hashes, first))
            yield pa.RecordBatch.from_arrays([pa.array((number << LINE_BITS) + lines[a:b]), pa.array([k.tobytes() for k in keys], pa.binary())], names=["id", "keys"])

    def keyed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        if not batch.num_rows:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64)
        return keys, np.repeat(batch.column(0).to_numpy(), len(keys) // batch.num_rows)

    pairs = buckets.bucket_pairs(blocks.with_answers(made, [exact.read()], LineBlock, banded, "id long, keys binary"), keyed, tasks, "lines-pairs")
    found: list[common.Stored] = []

    def of_block(ids: DataFrame) -> DataFrame:
        return ids.select(F.shiftright("id", LINE_BITS).alias("block"), F.lit(2).alias("kind"), F.col("id").bitwiseAND((1 << LINE_BITS) - 1).cast("int").alias("p"), F.lit(0).alias("n"), null.alias("x"), null.alias("y"), null.alias("z"))

    def listed(block: LineBlock, got: blocks.Answers, number: int) -> Iterator[pa.RecordBatch]:
        lines = np.array([x[0] for x in got[2]], np.int64)
        texts, row = block.texts(lines), block.owner(lines)
        for a, b, hashes, first in passes(texts):
            registers = sketches(hashes, first)
            _, kept = common.distinct_in_rows(hashes, first)
            yield pa.RecordBatch.from_arrays(
                [pa.array((number << LINE_BITS) + lines[a:b]), pa.array(np.diff(kept)), pa.array([r.tobytes() for r in registers], pa.binary()), pa.array(texts[a:b], pa.binary()), pa.array(block.ids[row[a:b]]), pa.array(lines[a:b] - block.first[row[a:b]])],
                names=["id", "n", "sketch", "items", "doc_id", "number"],
            )

    def gather(nodes: common.Stored) -> DataFrame:
        found.append(common.store(blocks.with_answers(made, [of_block(nodes.read())], LineBlock, listed, "id long, n long, sketch binary, items binary, doc_id long, number long"), "lines-found"))
        return found[0].read().select("id", "n", "sketch", "items")

    joined = near_dedup.settle(pairs, gather, percent, "lines", _sets)
    placed = found[0].read().select("id", "doc_id", "number").join(joined.read(), "id", "left").withColumn("component", F.coalesce("component", "id"))
    # Both sums are partial before the exchange, and the join is by line, so a component of any size is spread out.
    first = placed.groupBy("component").agg(F.min(F.struct("doc_id", "number", "id")).alias("first")).select(F.col("first.id").alias("id"))
    losers = common.store(placed.select("id").join(first, "id", "left_anti"), "lines-losers")
    found[0].drop()
    joined.drop()
    return made, [exact.read(), of_block(losers.read())], to


def _kept_texts(block: LineBlock, gone: np.ndarray) -> dict[int, bytes]:
    """Texts of the lines that stay, of the documents that lose some."""
    raw, total = block.data.tobytes(), np.concatenate([[0], np.cumsum(gone)])[block.first]
    out = {}
    for i in np.flatnonzero(np.diff(total)).tolist():
        left = np.flatnonzero(~gone[block.first[i] : block.first[i + 1]]) + block.first[i]
        out[i] = b"\n".join([raw[a:b] for a, b in zip(block.starts[left].tolist(), block.ends[left].tolist(), strict=True)])
    return out


def digests(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) for each row of ``docs`` (doc_id, text)."""
    common.tune(docs.sparkSession)
    made, answers, to = _steps(common.spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), percent)

    def use(block: LineBlock, got: blocks.Answers, _: int) -> Iterator[pa.RecordBatch]:
        gone = block.removed(got, to)
        lines, removed = (np.diff(np.concatenate([[0], np.cumsum(x)])[block.first]) for x in (block.ink, gone))
        raw, kept = block.data.tobytes(), _kept_texts(block, gone)
        shas = [hashlib.sha256(kept[i] if i in kept else raw[a:b]).hexdigest() for i, (a, b) in enumerate(zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True))]
        yield pa.RecordBatch.from_arrays([block.table.column("doc_id").combine_chunks(), pa.array(lines), pa.array(removed), pa.array(shas, pa.string())], names=["doc_id", "n_lines", "n_removed", "kept_sha256"])

    return blocks.with_answers(made, answers, LineBlock, use, "doc_id long, n_lines long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, with repeated lines cut out of ``text``; other texts stay as they are."""
    common.tune(docs.sparkSession)
    made, answers, to = _steps(docs, percent)

    def use(block: LineBlock, got: blocks.Answers, _: int) -> Iterator[pa.RecordBatch]:
        yield from block.with_texts(_kept_texts(block, block.removed(got, to))).to_batches()

    return blocks.with_answers(made, answers, LineBlock, use, docs.schema)
