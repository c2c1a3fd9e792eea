"""Documents packed into compressed blocks, and exchanges between blocks of the keys of what they hold.

A block is one row. Every step makes it anew from its bytes instead of storing what it holds. Keys
travel packed, one row for a block and partition; answers are bit maps over what a block sent, with the
place of the earliest holder of each key that occurs earlier.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scriptloom.llm import buckets, common

#: Bytes of text in a block, about.
BLOCK_BYTES = 2 << 20
#: Bits of a block's number that count the blocks of one task.
TASK_BITS = 14
#: Stands for the id of rows without one: they come after all others.
LAST = np.iinfo(np.int64).max
SENT = pa.schema([("p", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("checks", pa.binary()), ("docs", pa.binary()), ("places", pa.binary())])
SENT_DDL = "p int, block long, keys binary, checks binary, docs binary, places binary"
#: What a block is told. kind 0: bits; 1: bits, holders' blocks and places; 2: a place, a length and data; 9: the block.
ANSWER = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("p", pa.int32()), ("n", pa.int32()), ("x", pa.binary()), ("y", pa.binary()), ("z", pa.binary())])
ANSWER_DDL = "block long, kind int, p int, n int, x binary, y binary, z binary"
Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def packed(docs: DataFrame) -> DataFrame:
    """(block, rows): row batches of ``docs``, each in order of doc_id and compressed."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.enter("blocks")
        base, made = TaskContext.get().partitionId() << TASK_BITS, 0
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).sort_by("doc_id").combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_table(rows)
            return pa.RecordBatch.from_pydict({"block": pa.array([base + made], pa.int64()), "rows": [zstandard.ZstdCompressor(level=1).compress(memoryview(sink.getvalue()))]})

        for batch in batch_iter:
            _, offsets = common.text_buffer(batch.column(batch.schema.get_field_index("text")))
            for a, b in common.slices(np.diff(offsets), BLOCK_BYTES // 4):
                held.append(batch.slice(a, b - a))
                size += int(offsets[b] - offsets[a])
                if size >= BLOCK_BYTES:
                    yield flush()
                    held, size, made = [], 0, made + 1
                    if made >> TASK_BITS:
                        raise ValueError("too many blocks in one task: read the documents in more partitions")
        if held:
            yield flush()

    return docs.transform(common.in_arrow, run, "block long, rows binary")


class Block:
    """The rows of a packed block, in order of doc_id."""

    def __init__(self, rows: bytes) -> None:
        self.table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(rows)).read_all().combine_chunks()
        self.ids = self.table.column("doc_id").combine_chunks().cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)
        self.data, self.offsets = common.text_buffer(self.table.column("text"))

    def with_texts(self, texts: dict[int, bytes]) -> pa.Table:
        """The rows with new texts for some."""
        column = self.table.column("text")
        old = column.to_pylist()
        for i, text in texts.items():
            old[i] = text.decode()
        at = self.table.schema.get_field_index("text")
        return self.table.set_column(at, self.table.schema.field(at), pa.chunked_array([pa.array(old, column.type)]))


def deltas(values: np.ndarray, kind: type = np.int64) -> bytes:
    return np.diff(values, prepend=0).astype(kind).tobytes()


def undeltas(raw: bytes, kind: type = np.int64) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, kind), dtype=np.int64)


def sending(number: int, to: np.ndarray, keys: np.ndarray, checks: np.ndarray | None = None, docs: np.ndarray | None = None, places: np.ndarray | None = None) -> pa.RecordBatch:
    """What a block sends of its keys, a row for each partition."""
    rows = []
    for p, x in buckets.deal(keys, to):
        row = {"p": p, "block": number, "keys": keys[x].tobytes(), "checks": b"", "docs": b"", "places": b""}
        if checks is not None:
            row |= {"checks": checks[x].tobytes(), "docs": deltas(docs[x]), "places": deltas(places[x], np.int32)}
        rows.append(row)
    return pa.RecordBatch.from_pylist(rows, schema=SENT)


def _gathered(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    rows: dict[int, list[tuple]] = {}
    for batch in batch_iter:
        for p, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.setdefault(p, []).append(tuple(rest))
    for p, sent in rows.items():
        sent.sort(key=lambda x: x[0])
        yield p, sent


def shared(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tells blocks which of their keys others have too."""
    for p, sent in _gathered(batch_iter):
        keys = np.concatenate([np.frombuffer(x[1], np.uint64) for x in sent])
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        mark = np.zeros(len(keys), bool)
        mark[order[1:]] = same
        mark[order[:-1]] |= same
        end, out = 0, []
        for block, own, *_ in sent:
            a, end = end, end + len(own) // 8
            if mark[a:end].any():
                out.append({"block": block, "kind": 0, "p": p, "n": end - a, "x": np.packbits(mark[a:end]).tobytes()})
        yield pa.RecordBatch.from_pylist(out, schema=ANSWER)


def earlier(check: type, placed: bool) -> Run:
    """Tells blocks which of their keys stand in an earlier document or earlier in their own, and where first."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, sent in _gathered(batch_iter):
            keys, checks = (np.concatenate([np.frombuffer(x[i], kind) for x in sent]) for i, kind in ((1, np.uint64), (2, check)))
            docs = np.concatenate([undeltas(x[3]) for x in sent])
            order = np.lexsort((docs, keys))
            same = keys[order[1:]] == keys[order[:-1]]
            if (checks[order[1:]] != checks[order[:-1]])[same].any():  # unlike things of one key
                order = np.lexsort((docs, checks, keys))
                same = (keys[order[1:]] == keys[order[:-1]]) & (checks[order[1:]] == checks[order[:-1]])
            mark, head = np.zeros(len(keys), bool), np.ones(len(keys), bool)
            mark[order[1:]], head[1:] = same, ~same
            sizes = [len(x[1]) // 8 for x in sent]
            if placed:
                source = np.zeros(len(keys), np.int64)
                source[order] = order[np.maximum.accumulate(np.where(head, np.arange(len(keys)), 0))]
                holders, places = np.repeat(np.array([x[0] for x in sent], np.int64), sizes), np.concatenate([undeltas(x[4], np.int32) for x in sent])
            end, out = 0, []
            for (block, *_), size in zip(sent, sizes, strict=True):
                a, end = end, end + size
                if mark[a:end].any():
                    row = {"block": block, "kind": 1, "p": p, "n": size, "x": np.packbits(mark[a:end]).tobytes()}
                    if placed:
                        of = source[a:end][mark[a:end]]
                        row |= {"y": deltas(holders[of]), "z": deltas(places[of], np.int32)}
                    out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=ANSWER)

    return run


def told(answers: dict[int, tuple], keys: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of the keys that answers name, and the blocks and places that they give, if any."""
    none = np.zeros(0, np.int64)
    found = [(none, none, none)]
    for p, x in buckets.deal(keys, to):
        if p in answers:
            _, bits, holders, places = answers[p]
            named = x[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(x)).astype(bool)]
            found.append((named, undeltas(holders) if holders else none, undeltas(places, np.int32) if places else none))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


#: The answers of each kind: by partition, or (place, length, data) in lists.
Answers = tuple[dict[int, tuple], dict[int, tuple], list[tuple[int, int, bytes]]]


def with_answers(blocks: common.Stored, answers: list[DataFrame], make: Callable[[bytes], Block], use: Callable[[Block, Answers, int], Iterator[pa.RecordBatch]], ddl: str | StructType) -> DataFrame:
    """Makes each block, brings it together with its answers and calls ``use(block, answers, number)``."""
    null = F.lit(None).cast("binary")
    rows = blocks.read().select("block", F.lit(9).alias("kind"), F.lit(0).alias("p"), F.lit(0).alias("n"), F.col("rows").alias("x"), null.alias("y"), null.alias("z"))
    for df in answers:
        rows = rows.unionByName(df)

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.enter("blocks")
        number, got = -1, ({}, {}, [])
        for batch in batch_iter:
            for block, kind, p, n, x, y, z in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != number:
                    number, got = block, ({}, {}, [])
                if kind == 9:
                    yield from use(make(x), got, number)
                elif kind == 2:
                    got[2].append((p, n, x))
                else:
                    got[kind][p] = n, x, y, z

    if not answers:
        return rows.transform(common.in_arrow, run, ddl)
    return rows.repartition(common.shuffle_partitions(blocks.spark), "block").sortWithinPartitions("block", "kind", "p").transform(common.in_arrow, run, ddl)
