"""Centroid clustering of whole-number vectors, exact, by annulus search.

Centroids are sorted by length. A vector's distance to the centroid it had before bounds the distance to
its nearest one, so only centroids whose lengths lie within that bound of its own length can be as near:
two binary searches find them, and they alone are compared, in whole numbers, those on the border too.
A vector that has no centroid yet takes the one of nearest length for its bound.

Vectors travel packed, some thousands in a row, with their labels. A round is one pass without a shuffle:
it reads the blocks, writes them with new labels and the sums of each cluster in each block, and those sums
alone (a column) are then added up by Spark. The driver holds k centroids. A round's table replaces the one
before it, so that lost executors cost their tasks' work and no more.

Edge cases: only vectors with exactly ``dim`` components, none null or non-finite, take part; a null id is
carried through, and its vector is chosen as a first centroid after all others; repeated rows count as often
as they occur, and equal hashes are ordered by their vectors; fewer vectors than centroids make as many
centroids as there are vectors; components beyond 2 ** 62 and distances beyond 64 bits are held at the limit
(distances are compared before that); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.llm import block_search, common

#: Vectors in a block, and in a tile that is compared with its centroids at once.
BLOCK_ROWS, TILE_ROWS = 4096, 256
#: Components are held at this limit; sums are kept in two parts, split at so many bits.
LIMIT, SPLIT = 1 << 62, 31
TOP = (1 << 63) - 1
DDL = "ids array<long>, wide boolean, data binary, labels array<int>, distances array<long>, compared long, sums array<struct<cluster:int,n:long,inertia:array<long>,high:array<long>,low:array<long>>>"


def kept(vectors: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, vec) of the vectors that take part."""
    x = F.col(vec_col).cast("array<double>")
    good = (F.size(x) == dim) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    return vectors.filter(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), x.alias("vec"))


def whole(values: np.ndarray, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * scale), -LIMIT, LIMIT).astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of c, exact: in doubles where they suffice, else in whole numbers of any size."""
    most = max([1, *(int(np.abs(m).max()) for m in (x, c) if m.size)])
    if 8 * x.shape[1] * most * most < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    kind = np.int64 if 8 * x.shape[1] * most * most < 1 << 63 else object
    a, b = x.astype(kind), c.astype(kind)
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1) if len(b) else np.zeros((len(a), 0), kind)


class Annuli:
    """Centroids sorted by length."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        self.length = self._length(centroids)
        self.order = np.argsort(self.length, kind="stable")
        self.sorted = self.length[self.order]

    @staticmethod
    def _length(m: np.ndarray) -> np.ndarray:
        return np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))

    def nearest(self, x: np.ndarray, labels: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Each vector's centroid and squared distance, ties to the smaller number, and how many pairs were compared."""
        size, k = self._length(x), len(self.order)
        if labels is None:
            at = np.clip(np.searchsorted(self.sorted, size), 1, max(1, k - 1))
            low = at - 1
            labels = self.order[np.where((k > 1) & (size - self.sorted[low] > self.sorted[np.minimum(at, k - 1)] - size), np.minimum(at, k - 1), low)]
        bound = self._length(x.astype(np.float64) - self.centroids[labels].astype(np.float64))
        slack = 1e-9 * (1 + size + self.sorted[-1])  # more than doubles lose
        low = np.searchsorted(self.sorted, size - bound - slack, side="left")
        high = np.searchsorted(self.sorted, size + bound + slack, side="right")
        found, distance = np.zeros(len(x), np.int32), np.zeros(len(x), object)
        rows = np.lexsort((high, low))
        for start in range(0, len(rows), TILE_ROWS):
            tile = rows[start : start + TILE_ROWS]
            a, b = int(low[tile].min()), int(high[tile].max())
            numbers = self.order[a:b]
            d = squared(x[tile], self.centroids[numbers])
            span = np.arange(a, b)
            inside = (span >= low[tile][:, None]) & (span < high[tile][:, None])
            far = d.max() + 1
            d = np.where(inside, d, far)
            least = d.min(axis=1)
            found[tile] = np.where(d == least[:, None], numbers, k).min(axis=1)
            distance[tile] = least
        held = np.array([min(int(v), TOP) for v in distance.tolist()], np.int64)
        return found, held, int((high - low).sum())


def _sums(x: np.ndarray, labels: np.ndarray, distances: np.ndarray) -> list[dict]:
    """Members, distances and components of each cluster in a block; a sum in two parts fits whole numbers at any count."""
    order = np.argsort(labels, kind="stable")
    clusters, first = np.unique(labels[order], return_index=True)
    ordered, far = x[order], distances[order]
    mask = (1 << SPLIT) - 1
    high, low = np.add.reduceat(ordered >> SPLIT, first), np.add.reduceat(ordered & mask, first)
    d_high, d_low = np.add.reduceat(far >> SPLIT, first), np.add.reduceat(far & mask, first)
    n = np.diff(np.append(first, len(order)))
    return [{"cluster": int(c), "n": int(n[i]), "inertia": [int(d_high[i]), int(d_low[i])], "high": high[i].tolist(), "low": low[i].tolist()} for i, c in enumerate(clusters.tolist())]


def _packed(dim: int, scale: float):
    """Rows (id, vec) into blocks without labels."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            ids, x = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held])
            held = []
            for a in range(0, len(x), BLOCK_ROWS):
                yield _row(ids[a : a + BLOCK_ROWS], x[a : a + BLOCK_ROWS])

        for batch in batch_iter:
            if batch.num_rows:
                held.append((batch.column(0), whole(block_search.matrix(batch.column(1), dim), scale)))
                if sum(len(h[1]) for h in held) >= BLOCK_ROWS:
                    yield from flush()
        if held:
            yield from flush()

    return run


_SCHEMA = pa.schema(
    [
        ("ids", pa.list_(pa.int64())), ("wide", pa.bool_()), ("data", pa.binary()), ("labels", pa.list_(pa.int32())), ("distances", pa.list_(pa.int64())), ("compared", pa.int64()),
        ("sums", pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("inertia", pa.list_(pa.int64())), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))]))),
    ]
)


def _row(ids: pa.Array, x: np.ndarray, labels: np.ndarray | None = None, distances: np.ndarray | None = None, compared: int = 0) -> pa.RecordBatch:
    wide = bool(x.size) and int(np.abs(x).max()) >= 1 << 15
    sums = None if labels is None else _sums(x, labels, distances)
    row = {"ids": ids.to_pylist(), "wide": wide, "data": x.astype(np.int64 if wide else np.int16).tobytes(), "labels": None if labels is None else labels.tolist(), "distances": None if distances is None else distances.tolist(), "compared": compared, "sums": sums}
    return pa.RecordBatch.from_pylist([row], schema=_SCHEMA)


def _assigned(centroids: np.ndarray):
    """Blocks with the labels, distances and sums that the centroids give."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = Annuli(centroids)
        for batch in batch_iter:
            for i in range(batch.num_rows):
                ids, wide, data, labels = (batch.column(c)[i] for c in range(4))
                x = np.frombuffer(data.as_py(), np.int64 if wide.as_py() else np.int16).reshape(len(ids.values), -1).astype(np.int64)
                before = None if not labels.is_valid else labels.values.to_numpy()
                yield _row(ids.values, x, *annuli.nearest(x, before))

    return run


def _totals(blocks: common.Stored, dim: int) -> dict[int, tuple[int, int, list[int]]]:
    """(members, inertia, sums of components) of each cluster that has members; dim + 1 rows for each."""
    parts = blocks.read().select(F.inline("sums"))
    values = F.arrays_zip(F.concat("high", F.slice("inertia", 1, 1)).alias("high"), F.concat("low", F.slice("inertia", 2, 1)).alias("low"))
    added = parts.select("cluster", "n", F.posexplode(values).alias("at", "value")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("value.high").alias("high"), F.sum("value.low").alias("low"))
    out: dict[int, tuple[int, int, list[int]]] = {}
    for r in sorted(added.collect()):
        total = (r.high << SPLIT) + r.low
        n, inertia, sums = out.get(r.cluster, (r.n, 0, []))
        out[r.cluster] = (n, total, sums) if r["at"] == dim else (n, inertia, [*sums, total])
    return out


def first_centroids(vectors: DataFrame, k: int, scale: float) -> np.ndarray:
    """The vectors of the k smallest hashes of ``1:<id>``, in that order."""
    hashed = vectors.withColumn("hash", F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256))
    rows = hashed.orderBy(F.asc_nulls_last("hash"), "vec").limit(k).select("vec").collect()
    return whole(np.array([r.vec for r in rows], np.float64), scale)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that takes part."""
    spark = vectors.sparkSession
    common.tune(spark)
    given = kept(vectors, id_col, vec_col, dim)
    centroids = first_centroids(given, k, scale)
    blocks = common.store(given.transform(common.in_arrow, _packed(dim, scale), DDL), "annulus-blocks")
    for round_ in range(rounds + 1 if len(centroids) else 0):
        before, blocks = blocks, common.store(common.spread(blocks.read().select("ids", "wide", "data", "labels")).transform(common.in_arrow, _assigned(centroids), DDL), "annulus-blocks")
        before.drop()
        totals = _totals(blocks, dim)
        if round_ < rounds:
            centroids = np.array([[s // totals[c][0] for s in totals[c][2]] if c in totals else row for c, row in enumerate(centroids.tolist())], np.int64)
    if not len(centroids):
        totals = {}
    all_ = min(TOP, sum(t[1] for t in totals.values()))
    shown = [(c, min(TOP, t[1]), all_, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, t in totals.items()]
    known = spark.createDataFrame(shown, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows at most
    rows = blocks.read().select(F.inline(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("labels").alias("cluster"), F.col("distances").alias("distance"))))
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = 16, rounds: int = 3, dim: int = 64) -> str:
    """The same in DuckDB's SQL, each round all vectors against all centroids."""
    out = [f"""WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, e) - 1 AS c, e FROM v QUALIFY c < {k}
)"""]
    for i in range(rounds + 1):
        out.append(f"""a{i} AS (
  SELECT r, vec_id, v.e, c, list_sum(list_transform(list_zip(v.e, m.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v CROSS JOIN c{i} m
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1
)""")
        if i < rounds:
            out.append(f"""s{i} AS (
  SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(e) AS x, unnest(range({dim})) AS j FROM a{i}) GROUP BY c, j
), c{i + 1} AS (
  SELECT o.c, coalesce(any_value(m.e), any_value(o.e)) AS e FROM c{i} o
  LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS e FROM s{i} GROUP BY c) m ON m.c = o.c GROUP BY o.c
)""")
    last = f"a{rounds}"
    return ",\n".join(out) + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m.e, ',')) AS centroid_sha256 FROM {last} a JOIN c{rounds} m ON m.c = a.c"""
