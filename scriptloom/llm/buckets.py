"""Bucketing of hashed keys by packed exchanges, and components of a graph by star contraction.

Keys and ids travel as packed arrays, one row per task and partition, instead of one row per key. Before
the exchange each task reduces every bucket to one pivot and links the bucket's other local members to
it, so a bucket of any size puts at most one entry per task into an exchange, and the links found are
linear in the members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.llm import common

PAIRS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])
PACKED = pa.schema([("p", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("more", pa.binary())])
PACKED_DDL = "p int, kind int, keys binary, ids binary, more binary"
#: Entries held by a task before it reduces and sends them.
FLUSH = 1 << 19
#: Links that one task reduces to stars.
TASK_EDGES = 200_000


def _murmur(value: int) -> int:
    """Spark's hash of an int, by which repartition() deals out rows."""
    mask = (1 << 32) - 1
    k = value * 0xCC9E2D51 & mask
    k = (k << 15 | k >> 17) * 0x1B873593 & mask
    h = 42 ^ k
    h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    h ^= 4
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def partition_keys(n: int) -> np.ndarray:
    """For each of n partitions an int that repartition(n, column) sends there."""
    out, missing, value = np.full(n, -1, np.int32), n, 0
    while missing:
        p = _murmur(value) % n
        if out[p] < 0:
            out[p] = value
            missing -= 1
        value += 1
    return out


def deal(keys: np.ndarray, to: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(partition key, indices) of the entries for each partition."""
    part = (common.mix(keys) % np.uint64(len(to))).astype(np.int64)
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(len(to) + 1))
    for p in np.flatnonzero(np.diff(bounds)).tolist():
        yield int(to[p]), order[bounds[p] : bounds[p + 1]]


def pivots(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each bucket's key and pivot (pseudo-random by bucket), and (pivot, member) of the other members."""
    order = np.lexsort((common.mix(ids.view(np.uint64) + keys), keys))
    keys, ids = keys[order], ids[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    pivot = ids[np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))]
    rest = ~first & (ids != pivot)
    return keys[first], ids[first], pivot[rest], ids[rest]


def counted(u: np.ndarray, v: np.ndarray, n: np.ndarray | None = None) -> pa.RecordBatch:
    """Distinct pairs, with how often each occurs; the second is the member that met the pivot."""
    if not len(u):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, schema=PAIRS)
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    first = np.ones(len(u), bool)
    first[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(first)
    return pa.RecordBatch.from_arrays([pa.array(u[at]), pa.array(v[at]), pa.array(np.diff(np.append(at, len(u))))], schema=PAIRS)


#: Turns a batch of rows into 64-bit bucket keys and ids.
Expander = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]


def bucket_pairs(rows: DataFrame, expand: Expander, partitions: int, label: str) -> common.Stored:
    """Candidate pairs (u, v, n): v was in n buckets with the pivot u."""
    to = partition_keys(partitions)

    def reduce_locally(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids in _chunks(batch_iter, expand):
            keys, ids, u, v = pivots(keys, ids)
            rows = [{"p": p, "kind": 0, "keys": keys[x].tobytes(), "ids": ids[x].tobytes(), "more": b""} for p, x in deal(keys, to)]
            if len(u):
                pairs = counted(u, v)
                u, v, n = (pairs.column(i).to_numpy() for i in range(3))
                rows += [{"p": p, "kind": 1, "keys": u[x].tobytes(), "ids": v[x].tobytes(), "more": n[x].tobytes()} for p, x in deal(u.view(np.uint64) + common.mix(v.view(np.uint64)), to)]
            yield pa.RecordBatch.from_pylist(rows, schema=PACKED)

    def meet(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in batch_iter:
            kinds = batch.column(1).to_numpy()
            for i in range(batch.num_rows):
                k, x = batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                if kinds[i]:
                    n = np.frombuffer(batch.column(4)[i].as_py(), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(k, np.int64)), pa.array(np.frombuffer(x, np.int64)), pa.array(n)], schema=PAIRS)
                else:
                    keys.append(np.frombuffer(k, np.uint64))
                    ids.append(np.frombuffer(x, np.int64))
        _, _, u, v = pivots(np.concatenate(keys), np.concatenate(ids))
        yield counted(u, v)

    sent = rows.transform(common.in_arrow, reduce_locally, PACKED_DDL).repartition(partitions, "p")
    pairs = sent.transform(common.in_arrow, meet, "u long, v long, n long").groupBy("u", "v").agg(F.sum("n").alias("n"))
    return common.store(pairs, label)


def _chunks(batch_iter: Iterator[pa.RecordBatch], expand: Expander) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batch_iter:
        held.append(expand(batch))
        size += len(held[-1][0])
        if size >= FLUSH:
            yield np.concatenate([k for k, _ in held]), np.concatenate([i for _, i in held])
            held, size = [], 0
    if size:
        yield np.concatenate([k for k, _ in held]), np.concatenate([i for _, i in held])


class Forest:
    """Union-find over the ids that one task sees; a component's root is its smallest id."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = parent.setdefault(x, x)
        while parent[top] != top:
            parent[top] = top = parent[parent[top]]
        return top

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart."""
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def stars(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (v, u) reduced to stars around the smallest id of each component that a task sees."""
    forest = Forest()
    for batch in batch_iter:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
    found = [(forest.root(x), x) for x in forest.parent]
    found = [s for s in found if s[0] != s[1]]
    yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in found], pa.int64()), pa.array([u for _, u in found], pa.int64())], names=["v", "u"])


def components(spark: SparkSession, links: DataFrame, label: str) -> common.Stored:
    """(id, component) of every id in ``links`` (u, v) but the components' own smallest ids.

    Tasks reduce their shares of the links to stars, again with fewer tasks while that at least halves
    them; what fits one task's bound is settled there. Else large-star and small-star steps, each a grouped
    minimum and a join, alternate until nothing changes: every id points to the smallest of its component.
    (Grouped minima are partial before the exchange, and Spark's skew join splits a large component's root.)
    """
    known = common.store(links.filter("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")), label)
    n, settled = known.read().count(), False
    while n and not settled:
        shares = -(-n // TASK_EDGES)
        new = common.store(known.read().repartition(shares).transform(common.in_arrow, stars, "v long, u long").distinct(), label)
        known.drop()
        known, before, n = new, n, new.read().count()
        settled = shares == 1
        if 2 * n > before:
            break
    state = None
    while not settled:
        edges = known.read()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == now or not now[0]:
            break
        state = now
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        new = common.store(small, label)
        known.drop()
        known = new
    known_read = known.read
    known.read = lambda: known_read().select(F.col("u").alias("id"), F.col("v").alias("component"))  # type: ignore[method-assign]
    return known
