"""Inner-product search between packed blocks of queries and of candidates.

Vectors travel as packed matrices, a block to a row. A task gets some blocks of queries of one part and a
stripe of the candidates' blocks, streams those one at a time and keeps the best k of each query, so that
its memory is bounded by a few blocks whatever the tables' sizes. A last window merges the stripes.
Before any of that, each block of queries meets the one block of longest vectors of its part: the k-th
scores found there bound the length that a vector must have to matter, and only blocks that hold such
vectors are sent to the queries (Cauchy-Schwarz).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.llm import common

#: Blocks of queries that a task holds, about.
GROUP = 8
BLOCK = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("n", pa.int32()), ("norm", pa.float64()), ("wide", pa.bool_()), ("ids", pa.binary()), ("data", pa.binary())])
BLOCK_DDL = "block long, part int, n int, norm double, wide boolean, ids binary, data binary"
HITS = pa.schema([("key", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("whole", pa.int64()), ("score", pa.float64())])
HITS_DDL = "key long, query_id long, vec_id long, whole long, score double"


def usable(vectors: DataFrame, id_col: str, vec_col: str, nonzero: bool = False) -> DataFrame:
    """(id, vec) of rows with an id and a vector of finite components, by JVM expressions."""
    x = F.col(vec_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    if nonzero:
        good &= F.exists(x, lambda v: v != 0)
    return vectors.filter(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), x.alias("vec"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to ``dim`` components."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(-1, dim).astype(np.float64)
    out = np.zeros((len(column), dim))
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def packed(block: int, part: int, ids: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
    """One block row; whole numbers of 16 bits are stored as such."""
    short = bool(len(data)) and bool((np.abs(data) < 1 << 15).all()) and bool((data == np.rint(data)).all())
    norm = float(np.sqrt((data * data).sum(axis=1)).max()) if len(data) else 0.0
    return pa.RecordBatch.from_pylist([{"block": block, "part": part, "n": len(ids), "norm": norm, "wide": not short, "ids": ids.astype(np.int64).tobytes(), "data": data.astype(np.int16 if short else np.float64).tobytes()}], schema=BLOCK)


def unpacked(n: int, wide: bool, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(data, np.float64 if wide else np.int16).astype(np.float64).reshape(n, -1)


def packer(dim: int, rows: int, scale: float | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs rows (part, id, vec), sorted by part, into blocks of ``rows`` rows of one part."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 24, 0
        held: list[tuple[int, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, made
            if held:
                yield packed(base + made, held[0][0], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]))
                held, made = [], made + 1

        for batch in batch_iter:
            if not batch.num_rows:
                continue
            parts, ids, data = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), dim)
            if scale is not None:
                data = np.floor(data * scale)
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                while a < b:
                    if held and held[0][0] != parts[a]:
                        yield from flush()
                    take = min(b - a, rows - sum(len(h[1]) for h in held))
                    held.append((int(parts[a]), ids[a : a + take], data[a : a + take]))
                    a += take
                    if sum(len(h[1]) for h in held) >= rows:
                        yield from flush()
        yield from flush()

    return run


class Best:
    """The best k candidates so far of each query of a block."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, k: int, whole: bool, basis: np.ndarray | None) -> None:
        self.ids, self.data, self.k, self.whole = ids, data, k, whole
        self.norm = np.sqrt((data * data).sum(axis=1))
        self.basis = basis
        if basis is not None:
            self.head = data @ basis
            self.rest = np.sqrt(np.maximum(self.norm**2 - (self.head**2).sum(axis=1), 0))
        self.q, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64 if whole else np.float64)
        self.least = np.full(len(ids), -np.inf)

    def exact(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        if not self.whole:
            return (self.data[q] * x).sum(axis=1)
        a, b = self.data[q], x
        if len(a) and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= 2.0**53:  # beyond what doubles add up exactly
            sums = [sum(int(u) * int(v) for u, v in zip(r, s, strict=True)) for r, s in zip(a, b, strict=True)]
            return np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in sums], np.int64)
        return (a * b).sum(axis=1).astype(np.int64)

    def add(self, ids: np.ndarray, data: np.ndarray, norm: float) -> None:
        slack = 1e-9 * (1 + self.norm * norm)
        live = np.flatnonzero(self.norm * norm + slack >= self.least)  # the longest vector of the block can still enter
        if not len(live) or not len(ids):
            return
        least, slack = self.least[live], slack[live]
        cols = np.arange(len(ids))
        scores = None
        if self.basis is not None and self.basis.shape[1] < data.shape[1] and np.isfinite(least).all():
            head = data @ self.basis
            rest = np.sqrt(np.maximum((data * data).sum(axis=1) - (head * head).sum(axis=1), 0))
            bound = self.head[live] @ head.T + np.outer(self.rest[live], rest) + slack[:, None]
            may = bound >= least[:, None]
            cols = np.flatnonzero(may.any(axis=0))
            rows = may.any(axis=1)
            live, least, slack = live[rows], least[rows], slack[rows]
            if not len(live):
                return
            if may.sum() < 0.05 * len(live) * len(cols):
                q, x = np.nonzero(may[rows][:, cols])
                scores = np.full((len(live), len(cols)), -np.inf)
                scores[q, x] = (self.data[live[q]] * data[cols[x]]).sum(axis=1)
        if scores is None:
            scores = self.data[live] @ data[cols].T
        scores[self.ids[live][:, None] == ids[cols][None, :]] = -np.inf
        if len(cols) > self.k:
            least = np.maximum(least, np.partition(scores, len(cols) - self.k, axis=1)[:, len(cols) - self.k])
        q, x = np.nonzero((scores >= (least - slack)[:, None]) & (scores > -np.inf))
        self.merge(live[q], ids[cols[x]], self.exact(live[q], data[cols[x]]))

    def merge(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        q, ids, score = np.concatenate([self.q, q]), np.concatenate([self.id, ids]), np.concatenate([self.score, score])
        order = np.lexsort((ids, ~score if self.whole else -score, q))
        q, ids, score = q[order], ids[order], score[order]
        first = np.searchsorted(q, q)
        keep = np.arange(len(q)) - first < self.k
        self.q, self.id, self.score = q[keep], ids[keep], score[keep]
        full = np.bincount(self.q, minlength=len(self.ids)) >= self.k
        last = np.searchsorted(self.q, np.arange(len(self.ids)), side="right") - 1
        self.least[full] = self.score[last[full]]

    def rows(self, block: int) -> pa.RecordBatch:
        nothing = np.zeros(len(self.q))
        return pa.RecordBatch.from_arrays([pa.array((block << 20) + self.q), pa.array(self.ids[self.q]), pa.array(self.id), pa.array(self.score if self.whole else nothing.astype(np.int64)), pa.array(nothing if self.whole else self.score)], schema=HITS)


def block_pairs(q: DataFrame, c: DataFrame, k: int, whole: bool, basis: np.ndarray | None) -> DataFrame:
    """(asker, block): the blocks of candidates that hold a vector long enough for some query of a block of its part."""
    longest = c.groupBy("part").agg(F.max_by("block", F.struct("norm", "block")).alias("block"))
    first = c.join(F.broadcast(longest.select("block")), "block", "left_semi")
    met = q.select("part", F.col("block").alias("asker"), *[F.col(x).alias(f"q_{x}") for x in ("n", "wide", "ids", "data")]).join(first, "part")

    def least(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            for row in range(batch.num_rows):
                asker, *of = (batch.column(i)[row].as_py() for i in range(10))
                best = Best(*unpacked(*of[:4]), k, whole, basis)
                best.add(*unpacked(of[4], *of[6:]), of[5])
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where((best.norm > 0) & np.isfinite(best.least), (best.least - 1e-9) / (best.norm * (1 + 1e-9)), -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array([asker], pa.int64()), pa.array([float(need.min()) if len(need) else np.inf])], names=["asker", "need"])

    bounds = met.select("asker", "q_n", "q_wide", "q_ids", "q_data", "n", "norm", "wide", "ids", "data").transform(common.in_arrow, least, "asker long, need double")
    askers = q.select("part", F.col("block").alias("asker")).join(bounds, "asker")
    return c.select("part", "block", "norm").join(askers, "part").filter(F.col("norm") * (1 + 1e-9) >= F.col("need")).select("asker", "block")


def best_of_stripes(queries: common.Stored, candidates: common.Stored, k: int, whole: bool, basis: np.ndarray | None) -> DataFrame:
    """(query_id, rank, vec_id, whole or score): the k best of each query among the candidates' blocks of its part.

    A task holds up to about GROUP blocks of queries of one part, so that a block of candidates is sent once to
    all of them that need it.
    """
    spark = queries.spark
    q, c = queries.read(), candidates.read()
    n_q, parts = q.agg(F.count("*"), F.count_distinct("part")).first()
    n_c = c.count()
    groups = max(1, math.ceil(n_q / (GROUP * max(1, parts))))
    stripes = max(1, min(n_c, math.ceil(2 * spark.sparkContext.defaultParallelism / max(1, groups * parts))))
    slot = F.pmod(F.xxhash64("asker"), F.lit(groups)).cast("int").alias("slot")
    pairs = common.store(block_pairs(q, c, k, whole, basis), "search-pairs").read()
    needed = pairs.select("block", "asker", slot).groupBy("block", "slot").agg(F.collect_list("asker").alias("askers"))
    given = (
        c.join(needed, "block")
        .withColumn("stripe", F.pmod(F.xxhash64("block", F.lit(1)), F.lit(stripes)).cast("int"))
        .select("part", "slot", "stripe", F.col("block").alias("place"), "askers", "n", "norm", "wide", "ids", "data")
    )
    own = q.withColumn("asker", F.col("block")).select(
        "part", slot, F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"), F.lit(-1).cast("long").alias("place"), F.array("asker").alias("askers"), "n", "norm", "wide", "ids", "data"
    )
    tasks = max(common.shuffle_partitions(spark), min(groups * parts * stripes, 4096))
    items = own.unionByName(given).repartition(tasks, "part", "slot", "stripe").sortWithinPartitions("part", "slot", "stripe", "place")

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Best] = {}
        now = None
        for batch in batch_iter:
            for row in range(batch.num_rows):
                *group, place, askers, n, norm, wide, ids, data = (batch.column(i)[row].as_py() for i in range(10))
                block = unpacked(n, wide, ids, data)
                if place == -1:
                    if group != now:
                        yield from (best.rows(asker) for asker, best in held.items())
                        held, now = {}, group
                    held[askers[0]] = Best(*block, k, whole, basis)
                else:
                    for asker in askers:
                        held[asker].add(*block, norm)
        yield from (best.rows(asker) for asker, best in held.items())

    order = Window.partitionBy("key").orderBy(F.col("whole").desc(), F.col("score").desc(), F.col("vec_id"))
    return items.transform(common.in_arrow, run, HITS_DDL).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
