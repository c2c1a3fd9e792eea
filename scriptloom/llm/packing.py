"""Best-fit packing of tokenised documents into sequences of fixed length.

Documents longer than a sequence are cut into full pieces and a rest. What fits together depends on
lengths alone, so the plan is made from the histogram of lengths (as many numbers as a sequence has
tokens, whatever the input): exact complements first - for each length, longest first, single lengths,
pairs, then triples whose sums fill the gap exactly, as often as their counts allow - then best fit for
the rest, whole groups of equal bins at a time. A piece finds its place from its rank among the pieces
of its length; ranks come from counts per task and a running sum, so a length that a third of all
pieces share is never gathered anywhere.

Edge cases: a null or empty text is one piece that holds only the separator; texts of any length are
packed whole; repeated rows are packed as often as they occur; ties in length are dealt by task and
order of reading; an empty table gives an empty result; a null doc_id is carried through; other columns
are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.llm import common

#: Distinct words whose ids one worker remembers before it starts anew, bytes encoded by one call, and
#: bytes of text whose new words are looked up together.
MEMO_WORDS, BATCH_BYTES, PASS_BYTES = 400_000, 32 << 10, 4 << 20
#: Punctuation between an ASCII letter and a gap is a pre-token of its own: it is set apart, so that fewer words differ.
_tail, _letter, _gap = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_tail[list(b".,;:!?*$#%&")] = True
_letter[[*range(65, 91), *range(97, 123)]] = True
_gap[[10, 32]] = True
#: End of the range of characters whose words of letters alone stay whole in the library, whatever its version of Unicode.
LATIN_END = "\u0130"


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all rows, and each row's first; words end at plain spaces, line ends, and before tails of punctuation."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(_gap[data], out=inside[1:-1])
    where = np.flatnonzero(inside[1:] != inside[:-1])
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    cut = cut[inside[cut] & inside[cut + 1]]  # rows that meet without a gap
    if len(cut):
        where = np.sort(np.concatenate([where, cut, cut]), kind="stable")
    starts, ends = where[0::2], where[1::2]
    at = ends - 1
    live = np.flatnonzero(_tail[data[at]])
    while len(live):
        at[live] -= 1
        live = live[(at[live] >= starts[live])]
        live = live[_tail[data[at[live]]]]
    tails = np.flatnonzero((at < ends - 1) & (at >= starts))
    tails = tails[_letter[data[at[tails]]]]
    begins = np.sort(np.concatenate([starts, at[tails] + 1]), kind="stable")
    ink = data[inside[1:-1]]
    sizes = np.diff(np.append(np.concatenate([[0], np.cumsum(inside[1:-1])])[begins], len(ink)))
    ends_at = np.zeros(len(begins) + 1, np.int32)
    np.cumsum(sizes, out=ends_at[1:])
    words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(ends_at), pa.py_buffer(np.ascontiguousarray(ink))])
    return words.dictionary_encode(), np.searchsorted(begins, offsets)


class WordTokenizer:
    """Ids of whole texts for a tokenizer that drops white space: each distinct word is encoded once.

    Words of Latin letters alone are one pre-token each. Where the file marks the ends of words, many of
    them are encoded as one text and told apart by those marks; all other words are encoded one by one.
    Words are lower-cased first (A-Z, as the library's normaliser does) unless special strings might occur.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        model = json.loads(Path(path).read_text(encoding="utf-8"))
        suffix = model["model"].get("end_of_word_suffix") or ""
        vocabulary = self.model.get_vocab()
        self.ending = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ending[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.marked = bool(suffix)
        self.lower = any(x.get("type") == "Lowercase" for x in (model.get("normalizer") or {}).get("normalizers", []))
        self.special = [x["content"].encode() for x in model["added_tokens"]]
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number of each word."""
        found = [e.ids for e in self.model.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.model.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ending[ids])
        if len(ends) != len(words) or len(ids) and not self.ending[ids[-1]]:
            return self._each(words)
        return ids, np.diff(ends, prepend=-1)

    def learn(self, new: list[bytes]) -> None:
        words = [w.decode() for w in new]
        plain = np.array([self.marked and w.isalpha() and max(w) < LATIN_END for w in words], bool)
        order = np.argsort(~plain, kind="stable")
        ids, sizes = [self.ids], []
        for which, encode in ((order[: plain.sum()], self._together), (order[plain.sum() :], self._each)):
            part = [words[i] for i in which.tolist()]
            for a, b in common.slices(np.fromiter(map(len, part), np.int64, len(part)), BATCH_BYTES):
                found, n = encode(part[a:b])
                ids.append(found)
                sizes.append(n)
        self.place.update(zip([new[i] for i in order.tolist()], range(len(self.place), len(self.place) + len(new)), strict=True))
        self.ids = np.concatenate(ids)
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate(sizes))]) if sizes else self.first

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and each row's first id (one more than rows)."""
        if self.lower:
            low = common.lowered(data)
            raw = low.tobytes()
            if not any(x.lower() in raw for x in self.special):
                data = low
        words, rows = words_of(data, offsets)
        distinct = words.dictionary.to_pylist()
        if len(self.place) > MEMO_WORDS:
            self.clear()
        new = [w for w in distinct if w not in self.place]
        if new:
            self.learn(new)
        at = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))[words.indices.to_numpy()]
        size = self.first[at + 1] - self.first[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.arange(ends[-1]) + np.repeat(self.first[at] - ends[:-1], size)], ends[rows]


_tokenizers: dict[str, WordTokenizer] = {}


def plan(counts: np.ndarray, size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins as (how many, [(length, copies), ...]) for counts[length] pieces of each length up to ``size``."""
    have = counts.astype(np.int64).copy()
    bins: list[tuple[int, list[tuple[int, int]]]] = []

    def use(lengths: list[int]) -> None:
        need = defaultdict(int)
        for x in lengths:
            need[x] += 1
        times = min(int(have[x]) // n for x, n in need.items())
        if times:
            for x, n in need.items():
                have[x] -= times * n
            bins.append((times, sorted(need.items(), reverse=True)))

    def pairs(total: int) -> Iterator[tuple[int, int]]:
        a = np.arange((total + 1) // 2, total)
        for x in a[(have[a] > 0) & (have[total - a] > 0)][::-1].tolist():
            yield x, total - x

    for length in range(size, 0, -1):
        gap = size - length
        if have[length] and gap == 0:
            use([length])
        if have[length] and 0 < gap:
            use([length, gap])
        if have[length] and gap > 1:
            for a, b in pairs(gap):
                use([length, a, b])
                if not have[length]:
                    break
        if have[length] and gap > 2:
            for a in (np.flatnonzero(have[1 : gap - 1]) + 1)[::-1].tolist():
                if a < gap / 3 or not have[length]:
                    break
                for b, c in pairs(gap - a):
                    if b <= a and have[a]:
                        use([length, a, b, c])
                        if not have[length]:
                            break

    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
    gaps = np.zeros(size + 1, bool)

    def put(gap: int, times: int, held: list[tuple[int, int]]) -> None:
        if times:
            open_[gap].append((times, held))
            gaps[gap] = True

    for length in range(size, 0, -1):
        left = int(have[length])
        while left:
            fit = np.flatnonzero(gaps[length:])
            if len(fit):
                gap = length + int(fit[0])
                times, held = open_[gap].pop()
                gaps[gap] = bool(open_[gap])
            else:
                gap, held = size, []
                times = -(-left // (size // length))
            copies = gap // length
            filled = min(times, left // copies)
            put(gap - copies * length, filled, [*held, (length, copies)])
            left -= filled * copies
            times -= filled
            if times and left:
                put(gap - left % copies * length, 1, [*held, (length, left % copies)])
                times, left = times - 1, 0
            if held:
                put(gap, times, held)
    return bins + [group for groups in open_.values() for group in groups]


def places(bins: list[tuple[int, list[tuple[int, int]]]]) -> tuple[np.ndarray, ...]:
    """For runs of ranks of one length, in order: length, first rank, copies in a bin, first sequence, offset."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for times, held in bins:
        offset = 0
        for length, copies in held:
            rows.append((length, used[length], copies, sequence, offset))
            used[length] += times * copies
            offset += length * copies
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return tuple(table.T)


def pieces(docs: DataFrame, size: int = 2048, name: str = "word_bpe_49k.json", folder: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], task, place): pieces, numbered by length within their task."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = common.vocabulary(name, folder)
        common.enter("packing", _tokenizers.clear)
        coder = _tokenizers.get(path) or _tokenizers.setdefault(path, WordTokenizer(path))
        task, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        last = np.array([end_id], np.uint32)
        for batch in batch_iter:
            for a, b, data, offsets in common.text_passes(batch.column(1), PASS_BYTES):
                doc_ids = batch.column(0).slice(a, b - a)
                row, piece, start, length, crc, place, kept = [], [], [], [], [], [], []
                found, first = coder.encode(data, offsets)
                for i, (x, y) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    ids = np.concatenate([found[x:y], last])
                    for n, at in enumerate(range(0, len(ids), size)):
                        part = ids[at : at + size]
                        row.append(i)
                        piece.append(n)
                        start.append(at)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.astype("<u4", copy=False)))
                        place.append(int(seen[len(part)]))
                        seen[len(part)] += 1
                        if with_ids:
                            kept.append(part.astype(np.int32))
                columns = [doc_ids.take(pa.array(row)).cast(pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([task] * len(row), pa.int32()), pa.array(place, pa.int64())], names=[*names, "task", "place"])

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids array<int>, " * with_ids + "task int, place long"
    return docs.transform(common.in_arrow, run, ddl)


def pack(docs: DataFrame, size: int = 2048, name: str = "word_bpe_49k.json", folder: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece with its sequence and its offset there, for ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    common.tune(spark)
    cut = common.store(pieces(common.spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), size, name, folder, end_id, with_ids), "packing-pieces")
    counted = cut.read().groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(size + 1, np.int64)
    for length, n in counted.groupBy("length").agg(F.sum("n")).collect():  # a row for each length at most
        counts[length] = n
    lengths, first, copies, sequence, offset = places(plan(counts, size))
    order = lengths * (1 << 44) + first
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.read().join(base, ["task", "length"]).withColumn("rank", F.col("base") + F.col("place"))

    def settle(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            length, rank = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            run = np.searchsorted(order, length * (1 << 44) + rank, side="right") - 1
            along = rank - first[run]
            found = [pa.array(sequence[run] + along // copies[run]), pa.array(offset[run] + along % copies[run] * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *found], names=[*batch.schema.names[2:-1], "length", "sequence_id", "offset"])

    kept = ["doc_id", "piece", "start", "ids_crc32", *["ids"] * with_ids]
    ddl = "doc_id long, piece int, start long, ids_crc32 long, " + "ids array<int>, " * with_ids + "length long, sequence_id long, offset long"
    placed = ranked.select("length", "rank", *kept, F.col("length").alias("size")).transform(common.in_arrow, settle, ddl)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset")
