"""Exact top-k search by inner product of quantised vectors.

Candidates are dealt out and packed by descending length, so blocks come longest first: a block whose
longest vector cannot reach a query's k-th best score is passed over (Cauchy-Schwarz). Within a block
the first coordinates after an SVD rotation give a partial sum, and the lengths of what is left bound
the rest; only pairs that can still enter are scored exactly, in whole numbers. The rotation is fitted
on a bounded sample; any rotation gives the same result.

Edge cases: rows without an id, with a null vector or with null or non-finite components take no part;
vectors of unequal length count as padded with zeros; a repeated row is a candidate as often as it
occurs, and a repeated query row gets its list again; ties go to the smaller id; scores beyond 64 bits
are held at the limit; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.llm import block_search, common

#: Rows at most that the rotation is fitted on.
SAMPLE_ROWS = 4096


def sample(vectors: DataFrame, rows: int, total: int) -> np.ndarray:
    """A bounded, repeatable sample of (id, vec), collected to the driver."""
    share = min(1.0, rows / max(1, total))
    picked = vectors.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(rows).select("vec")
    column = picked.toArrow().column(0)
    dim = max((len(x) for x in column), default=0)
    return block_search.matrix(column, dim) if len(column) else np.zeros((0, 0))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding", query_rows: int = 1024, block_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query row, its own id left out."""
    spark = candidates.sparkSession
    common.tune(spark)
    given = block_search.usable(candidates, id_col, vec_col)
    asked = block_search.usable(queries, id_col, vec_col)
    n, dim = given.agg(F.count("*"), F.max(F.size("vec"))).first()
    n_q, dim_q = asked.agg(F.count("*"), F.max(F.size("vec"))).first()
    dim = max(dim or 0, dim_q or 0, 1)
    fitted = np.floor(sample(given, SAMPLE_ROWS, n) * scale)
    basis = None
    if len(fitted) and fitted.shape[1] == dim and dim >= 8 and np.isfinite(fitted @ fitted.T).all():
        basis = np.linalg.svd(fitted, full_matrices=False)[2][: dim // 2].T if len(fitted) >= dim else None
    length = F.aggregate("vec", F.lit(0.0), lambda s, v: s + F.pow(F.floor(v * scale), 2))
    ordered = given.select(F.lit(0).alias("part"), "id", "vec", length.alias("length")).repartitionByRange(common.shuffle_partitions(spark), F.desc("length"), F.col("id")).sortWithinPartitions(F.desc("length"), F.col("id"))
    blocks = common.store(ordered.select("part", "id", "vec").transform(common.in_arrow, block_search.packer(dim, block_rows, scale), block_search.BLOCK_DDL), "top-k-candidates")
    askers = asked.select(F.lit(0).alias("part"), "id", "vec").repartition(max(1, -(-n_q // query_rows)))
    held = common.store(askers.transform(common.in_arrow, block_search.packer(dim, query_rows, scale), block_search.BLOCK_DDL), "top-k-queries")
    found = block_search.best_of_stripes(held, blocks, k, True, basis)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("whole").alias("score"))
