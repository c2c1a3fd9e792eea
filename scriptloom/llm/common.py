"""Helpers shared by the corpus operators: durable intermediates, byte-bounded batches, word hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one numpy pass takes at once; bounds a Python worker's memory.
PASS_BYTES = 1 << 20
#: Words are runs of anything but these ASCII white space characters.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only in local mode, where all tasks share this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='scriptloom-shared-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def tune(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's default, unless the user set their own."""
    for key, default, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"),
        ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b"),
    ):
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)


class Stored:
    """A written intermediate: survives lost executors, and can be dropped once it is not needed."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        if jvm is None:
            return
        target = jvm.org.apache.hadoop.fs.Path(self.path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_open: list[Stored] = []


def _drop_all() -> None:
    for stored in _open:
        try:
            if stored.spark.sparkContext._jsc is not None:
                stored.drop()
        except Exception:  # the application has already ended
            return


atexit.register(_drop_all)


def store(df: DataFrame, label: str) -> Stored:
    """Write ``df`` as Parquet into the shared folder, cutting its lineage."""
    spark = df.sparkSession
    stored = Stored(spark, f"{shared_dir(spark)}/scriptloom/{label}-{uuid.uuid4().hex}")
    stored.schema = df.schema
    df.write.option("compression", "zstd").parquet(stored.path)
    _open.append(stored)
    return stored


@contextlib.contextmanager
def collected(into: list[Stored]) -> Iterator[None]:
    """Moves what is stored meanwhile to a list of the caller, who drops it."""
    before = len(_open)
    try:
        yield
    finally:
        into += _open[before:]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A side is broadcast only up to this many ids (8 bytes each, some 40 in a hash table).
BROADCAST_IDS = 1_000_000


def semi_by_id(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi", limit: int | None = None) -> DataFrame:
    """``df`` joined with a stored table of ids: broadcast if counted small enough, else a shuffle."""
    return df.join(F.broadcast(ids) if ids.count() <= (BROADCAST_IDS if limit is None else limit) else ids, key, how)


def slices(sizes: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes add up to ``limit`` at most (single rows may exceed it)."""
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (one more than rows) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_passes(column: pa.Array, limit: int = PASS_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for byte-bounded runs of rows."""
    data, offsets = text_buffer(column)
    for a, b in slices(np.diff(offsets), limit):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


_kept: dict[str, Callable[[], None]] = {}
_now = ""


def enter(operator: str, clear: Callable[[], None] | None = None) -> None:
    """Called by an operator's tasks: frees what other operators keep in a reused Python worker."""
    global _now
    if operator != _now:
        for name, drop in _kept.items():
            if name != operator:
                drop()
        _now = operator
    if clear is not None:
        _kept[operator] = clear


def release() -> None:
    """Gives memory that is free inside this process back to the machine: reused workers wait beside busy ones."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def in_arrow(df: DataFrame, run: Run, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` whose tasks give their memory back when they end."""

    def task(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batch_iter)
        finally:
            release()

    return df.mapInArrow(task, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


GOLDEN, SECOND, THIRD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Words longer than this are hashed one by one.
LONG_WORD = 128
_below = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_ink = bytes(b not in SPACE_BYTES for b in range(256))
_lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def translated(data: np.ndarray, table: bytes) -> np.ndarray:
    """Each byte's entry in a table of 256, faster than by indexing."""
    return np.frombuffer(data.tobytes().translate(table), np.uint8)


def ink(data: np.ndarray) -> np.ndarray:
    """Whether each byte is something else than white space."""
    return translated(data, _ink).view(bool)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return translated(data, _lower)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and the index of each row's first word (one more than rows)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ink(data)
    edge = inside[1:] != inside[:-1]
    where = np.flatnonzero(edge)
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    both = cut[inside[cut] & inside[cut + 1]]  # a word that ends with one row, and one that starts the next
    if len(both):
        both = np.unique(both)
        where = np.sort(np.concatenate([where, both, both]), kind="stable")
    starts, ends = where[0::2], where[1::2]
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
    """64-bit hashes of data[start:end]: eight bytes at a time, mixed after each; other seeds give independent ones."""
    if lower:
        data = lowered(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    size, salt = ends - starts, np.uint64((seed * int(THIRD) + 1) & (1 << 64) - 1)
    out = mix(size.astype(np.uint64) * GOLDEN + salt)
    out = mix((out + salt) * SECOND + (eight[np.minimum(starts, len(data))] & _below[np.minimum(size, 8)]))
    live, at = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(live):
        out[live] = mix((out[live] + salt) * SECOND + (eight[starts[live] + at] & _below[np.minimum(size[live] - at, 8)]))
        at += 8
        live = live[size[live] > at]
    long = np.flatnonzero(size > LONG_WORD)
    if len(long):
        out[long] = [xxhash.xxh3_64_intdigest(data[a:b].tobytes(), seed) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return out


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit hashes of data[start:end], as two columns."""
    raw, digest = data.tobytes(), xxhash.xxh3_128_digest
    found = b"".join([digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(found, np.uint64).reshape(-1, 2)


def _fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * GOLDEN + b * SECOND)


def run_hashes(words: np.ndarray, at: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hashes of words[i : i + size] for each i of ``at``, by doubling; no step is linear in the words."""
    level, span, done, out = words, 1, 0, None
    while True:
        if size & span:
            part = level[at + done]
            out = part if out is None else _fold(out, part)
            done += span
        if done == size:
            return mix(out + np.uint64(((seed << 32) + size) * int(GOLDEN) & (1 << 64) - 1))
        level = _fold(level[: max(len(level) - span, 0)], level[span:])
        span *= 2


def window_places(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all runs of ``size`` words within rows, and each row's first run."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    rows = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=rows[1:])
    return np.arange(rows[-1]) + np.repeat(first[:-1] - rows[:-1], counts), rows


def distinct_in_rows(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values in ascending order without repeats within each row, and each row's first (one more than rows)."""
    out = values.copy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[first[:-1][first[:-1] < len(out)]] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[first]


def batches(rows: Iterable[dict[str, list]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for row in rows:
        yield pa.RecordBatch.from_pydict(row, schema=schema)


def vocabulary(name: str, folder: str | None = None) -> str:
    """Path of a public tokenizer file; ``folder`` overrides the installed package's."""
    if folder:
        return str(Path(folder) / name)
    import public_tokenizers

    return public_tokenizers.path(name)


def spread(df: DataFrame) -> DataFrame:
    """Deal out rows when the source has fewer partitions than the cluster has cores (small inputs only)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
