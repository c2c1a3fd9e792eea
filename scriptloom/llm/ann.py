"""Approximate nearest neighbours over learned partitions.

On a bounded sample: the neighbour graph is cut into balanced parts (size-constrained label
propagation from a balanced start), then a small softmax classifier learns to tell the parts of a
vector's neighbours. Every row is indexed under its ``spill`` most probable parts; a query is routed
to its most probable parts, and the rows met there are ranked by the exact inner product. There are
more parts the more rows there are, up to what the sample can tell apart. How many parts a query probes
is measured: as few as find ``RECALL`` of the neighbours of sample rows that were held out of the fit.
Where vectors form clusters these are few; where directions are even, no partition of any kind can
leave out much.

Edge cases: rows without an id, and null, zero, or non-finite vectors take no part; vectors of unequal
length count as padded with zeros; a repeated row is a candidate as often as it occurs (once, if rows are
indexed under several parts), and a repeated query id gets one list; ties go to the smaller id; an empty
table gives an empty result; a sample of fewer than 64 rows makes one part, which is searched whole; other
columns are ignored. Parts of any size are split into blocks, so that a part that holds most rows is
searched by many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.llm import block_search, common
from scriptloom.llm.top_k import sample

#: Rows at most in the sample, neighbours in its graph, and sample rows for each part at least.
SAMPLE_ROWS, GRAPH_NEIGHBOURS, PART_ROWS = 8192, 16, 32
#: Parts of small tables, of the largest, and rows for each part from which on there are more than FEW_PARTS:
#: a query brings back a list from every part that it probes.
FEW_PARTS, PARTS, MANY_ROWS = 64, 256, 4096
#: Parts that a row is indexed under, and the share of held-out neighbours that probes are to find.
SPILL, RECALL = 1, 0.94
#: One of so many sample rows is held out, and neighbours of each that are looked for.
HELD_OUT, LOOKED_FOR = 8, 20


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of each sample row's k nearest others by inner product, in blocks of rows."""
    out = np.zeros((len(x), k), np.int64)
    for a in range(0, len(x), 256):
        s = x[a : a + 256] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 256] = np.argpartition(s, len(x) - k, axis=1)[:, len(x) - k :]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 6, slack: float = 1.1, seed: int = 7) -> np.ndarray:
    """Part of each sample row: few graph edges between parts, none larger than ``slack`` times the mean."""
    rng = np.random.default_rng(seed)
    n, most = len(x), math.ceil(slack * len(x) / parts)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    centre = unit[rng.choice(n, parts, replace=False)]
    label = np.zeros(n, np.int64)
    for _ in range(5):
        label = _capped(unit @ centre.T, most)
        centre = np.stack([unit[label == p].mean(axis=0) if (label == p).any() else unit[rng.integers(n)] for p in range(parts)])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-300)
    rows = np.repeat(np.arange(n), graph.shape[1])
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (rows, label[graph.ravel()]), 1.0)
        np.add.at(votes, (graph.ravel(), label[rows]), 1.0)
        votes[np.arange(n), label] += 0.5
        moved = _capped(votes, most)
        if (moved == label).all():
            break
        label = moved
    return label


def _capped(gain: np.ndarray, most: int) -> np.ndarray:
    """Each row's part of largest gain that still has room, rows of clearest preference first."""
    top = np.sort(gain, axis=1)
    order = np.argsort(-(top[:, -1] - top[:, -2 if gain.shape[1] > 1 else -1]), kind="stable")
    choice, room = np.argsort(-gain, axis=1, kind="stable"), np.full(gain.shape[1], most)
    label = np.zeros(len(gain), np.int64)
    for row in order.tolist():
        for p in choice[row]:
            if room[p]:
                room[p] -= 1
                label[row] = p
                break
    return label


def classifier(x: np.ndarray, target: np.ndarray, steps: int = 120, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression by full-batch Adam on soft targets."""
    scale = 1 / max(1e-12, float(np.sqrt((x * x).sum(axis=1).mean())))
    x = x * scale
    w = np.zeros((x.shape[1] + 1, target.shape[1]))
    m, v = np.zeros_like(w), np.zeros_like(w)
    ones = np.hstack([x, np.ones((len(x), 1))])
    for step in range(1, steps + 1):
        z = ones @ w
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        g = ones.T @ (p - target) / len(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1] * scale, w[-1]


def fit(x: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offsets of the router for a sample matrix."""
    if parts == 1:
        return np.zeros((x.shape[1] if x.ndim == 2 else 0, 1)), np.zeros(1)
    graph = neighbour_graph(x, min(GRAPH_NEIGHBOURS, len(x) - 1))
    label = balanced_parts(x, graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph.ravel()]), 1.0)
    target[np.arange(len(x)), label] += graph.shape[1]
    return classifier(x, target / target.sum(axis=1, keepdims=True))


def curve(fitted: np.ndarray, held: np.ndarray, model: tuple[np.ndarray, np.ndarray], spill: int) -> np.ndarray:
    """Share of the held-out rows' neighbours in the sample that 1, 2, ... probed parts find."""
    parts = model[0].shape[1]
    own = route(fitted, model, spill)
    place = np.argsort(route(held, model, parts), axis=1)  # of each part among a row's most probable ones
    found = np.zeros(parts)
    for a in range(0, len(held), 256):
        scores = held[a : a + 256] @ fitted.T
        near = np.argpartition(scores, max(0, len(fitted) - LOOKED_FOR), axis=1)[:, -LOOKED_FOR:]
        at = np.take_along_axis(place[a : a + 256][:, None, :], own[near], axis=2).min(axis=2)
        found += np.bincount(at.ravel(), minlength=parts)
    return np.cumsum(found) / found.sum()


def learned(x: np.ndarray, rows: int, spill: int = SPILL, recall: float = RECALL) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """The router for a sample matrix of a table of so many rows, and the parts that a query is to probe."""
    apart = np.arange(len(x)) % HELD_OUT == 0
    parts = max(1, min(PARTS, max(FEW_PARTS, rows // MANY_ROWS), int((~apart).sum()) // PART_ROWS)) if len(x) >= 2 * PART_ROWS else 1
    model = fit(x[~apart] if parts > 1 else x, parts)
    if parts == 1:
        return model, 1
    return model, int(np.searchsorted(curve(x[~apart], x[apart], model, min(spill, parts)), recall)) + 1


def route(x: np.ndarray, model: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """The n most probable parts of each row."""
    z = x @ model[0] + model[1]
    return np.argsort(-z, axis=1, kind="stable")[:, :n]


def search(queries: DataFrame, candidates: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", spill: int = SPILL, probes: int | None = None, query_rows: int = 1024, block_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row, its own id left out."""
    spark = candidates.sparkSession
    common.tune(spark)
    given = block_search.usable(candidates, id_col, vec_col, nonzero=True)
    asked = block_search.usable(queries, id_col, vec_col, nonzero=True)
    n, dim = given.agg(F.count("*"), F.max(F.size("vec"))).first()
    n_q, dim_q = asked.agg(F.count("*"), F.max(F.size("vec"))).first()
    dim = max(dim or 0, dim_q or 0, 1)
    fitted = sample(given, SAMPLE_ROWS, n)
    fitted = np.hstack([fitted, np.zeros((len(fitted), dim - fitted.shape[1]))])
    model, measured = learned(fitted, n, spill)
    parts, probes = model[0].shape[1], probes or measured
    asked = asked.groupBy("id").agg(F.min("vec").alias("vec"))

    def routed(times: int):
        def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batch_iter:
                if not batch.num_rows:
                    continue
                to = route(block_search.matrix(batch.column(1), dim), model, times)
                rows = pa.array(np.repeat(np.arange(batch.num_rows), to.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(to.ravel().astype(np.int32)), batch.column(0).take(rows), batch.column(1).take(rows)], names=["part", "id", "vec"])

        return run

    ddl = "part int, id long, vec array<double>"
    tasks = common.shuffle_partitions(spark)

    def blocks(rows: DataFrame, times: int, size: int, label: str, n_tasks: int) -> common.Stored:
        # Salted by the id's hash: a part of any size is cut into as many ranges as it needs.
        spread = rows.transform(common.in_arrow, routed(times), ddl).withColumn("salt", F.xxhash64("id")).repartitionByRange(n_tasks, "part", "salt").sortWithinPartitions("part", "salt")
        return common.store(spread.select("part", "id", "vec").transform(common.in_arrow, block_search.packer(dim, size, None), block_search.BLOCK_DDL), label)

    index = blocks(given, min(spill, parts), block_rows, "ann-index", tasks)
    held = blocks(asked, min(probes, parts), query_rows, "ann-queries", max(1, min(tasks, -(-n_q * probes // query_rows))))
    found = block_search.best_of_stripes(held, index, k, False, None)
    once = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    # The lists that a query got from several parts become one; a candidate met in several parts counts once.
    if spill > 1:
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    merged = found.select("query_id", "vec_id", "score").withColumn("rank", F.row_number().over(once)).filter(F.col("rank") <= k)
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
