import numpy as np
import pytest

from scriptloom.llm import ann, block_search, top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(400, 16)).astype(np.float32) * rng.uniform(0.2, 2, size=(400, 1)).astype(np.float32)
    base[40:80] = base[40]  # ties
    out = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    return out + [(400, None), (401, [float("nan")] * 16), (402, [None] * 16), (403, [float("inf")] * 16), (404, [0.0] * 16), (405, [1.0, 2.0]), (None, [1.0] * 16), (420, []), (500, [1.5] * 16)]


def brute(rows, whole, k):
    good = {i: np.pad(np.array(v, float), (0, 16 - len(v))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    if whole:
        good = {i: np.floor(64 * v) for i, v in good.items()}
    else:
        good = {i: v for i, v in good.items() if v.any()}
    out = []
    for q in good:
        if q % 20 == 0:
            best = sorted((-float(good[q] @ v), i) for i, v in good.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 20, 1000])
def test_top_k_is_exact(spark, rows, k):
    table = vectors(spark, rows)
    got = top_k.top_k(table.filter("vec_id % 20 = 0"), table, k=k, query_rows=7, block_rows=50)
    assert sorted((r.query_id, r.rank, r.vec_id, float(r.score)) for r in got.collect()) == brute(rows, True, k)


def test_large_scores_stay_whole(spark):
    table = vectors(spark, [(0, [2.0**30, 1.0]), (1, [2.0**30, 1.0]), (2, [1e30, 0.0])])
    got = {(r.query_id, r.vec_id): r.score for r in top_k.top_k(table.filter("vec_id = 0"), table).collect()}
    assert got[0, 1] == 2**72 // 1 or got[0, 1] == 2**63 - 1
    assert got[0, 2] == 2**63 - 1


def test_empty(spark):
    table = vectors(spark, [(1, None)]).filter("vec_id = 2")
    assert top_k.top_k(table, table).collect() == [] and ann.search(table, table).collect() == []


def test_ann_with_all_probes_is_exact(spark, rows):
    table = vectors(spark, rows)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(table.filter("vec_id % 20 = 0"), table, probes=99).collect())
    want = brute(rows, False, 20)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], rtol=1e-12)


def test_ann_recall(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 24)) * 2
    data = [(i, [float(x) for x in centre[i % 12] + rng.normal(size=24)]) for i in range(1500)]
    table = vectors(spark, data)
    m = np.array([v for _, v in data], np.float32).astype(float)
    got = ann.search(table.filter("vec_id % 20 = 0"), table, probes=4).collect()
    hit = 0
    for q in range(0, 1500, 20):
        s = m @ m[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert hit / (75 * 20) >= 0.9


def found_share(spark, m, **options):
    """Recall of the query's own settings against brute force."""
    table = vectors(spark, [(i, [float(x) for x in v]) for i, v in enumerate(m)])
    m = m.astype(np.float32).astype(float)
    got, hit = ann.search(table.filter("vec_id % 20 = 0"), table, **options).collect(), 0
    for q in range(0, len(m), 20):
        s = m @ m[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20].tolist()) & {r.vec_id for r in got if r.query_id == q})
    return hit / (len(range(0, len(m), 20)) * 20)


def test_probes_follow_the_data(spark):
    """Clusters need few parts, even directions most of them; recall holds in both."""
    rng = np.random.default_rng(4)
    clustered = rng.normal(size=(30, 24))[np.arange(3000) % 30] * 2 + rng.normal(size=(3000, 24)) * 0.6
    even = rng.normal(size=(3000, 24))
    few, most = (ann.learned(x, 3000)[1] / ann.learned(x, 3000)[0][0].shape[1] for x in (clustered, even))
    assert few < 0.2 < most < 0.8
    assert found_share(spark, clustered) >= 0.9 and found_share(spark, even) >= 0.9


def test_repeated_rows(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.4, 0.0])]
    table = vectors(spark, rows)
    got = ann.search(table.filter("vec_id % 20 = 0"), table).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(20, 1, 1), (20, 2, 1), (20, 3, 2)]
    got = top_k.top_k(table.filter("vec_id = 20"), table).collect()
    assert sorted((r.rank, r.vec_id) for r in got) == [(1, 1), (1, 1), (2, 1), (2, 1), (3, 2), (3, 2)]


def test_clashing_columns(spark):
    rows = [(0, [1.0, 0.0], 5, "a"), (1, [0.5, 0.0], 6, "b")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score string")
    for search in (top_k.top_k, ann.search):
        assert [(r.query_id, r.rank, r.vec_id) for r in search(table.filter("vec_id = 0"), table).collect()] == [(0, 1, 1)]


def test_short_vectors_are_not_sent(spark):
    """Blocks of vectors too short for any query of a block never meet it."""
    rng = np.random.default_rng(6)
    m = rng.normal(size=(2000, 8)) * (1.0 / (1 + np.arange(2000)))[:, None] * 1000
    table = vectors(spark, [(i, [float(x) for x in v]) for i, v in enumerate(m)])
    seen = []
    pairs = block_search.block_pairs
    block_search.block_pairs = lambda q, c, *rest: seen.append((q.count() * c.count(), (p := pairs(q, c, *rest)).count())) or p
    try:
        got = top_k.top_k(table.filter("vec_id % 20 = 0 and vec_id < 200"), table, query_rows=5, block_rows=100).collect()
    finally:
        block_search.block_pairs = pairs
    assert seen[0][1] < seen[0][0] / 2
    whole = np.floor(64 * m.astype(np.float32).astype(float))
    for q in range(0, 200, 20):
        best = sorted((-float(whole[q] @ v), i) for i, v in enumerate(whole) if i != q)[:20]
        assert [(r.vec_id, float(r.score)) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [(i, -s) for s, i in best]


def test_parts_are_balanced():
    x = np.random.default_rng(0).normal(size=(600, 8))
    label = ann.balanced_parts(x, ann.neighbour_graph(x, 8), 6)
    assert np.bincount(label, minlength=6).max() <= 110


def test_matrix_pads(spark):
    import pyarrow as pa

    assert block_search.matrix(pa.array([[1.0], [2.0, 3.0], []]), 2).tolist() == [[1, 0], [2, 3], [0, 0]]


def test_recall_on_the_given_vectors(spark):
    """The query as it is registered, against brute force over the table."""
    import os

    from scriptloom.llm import queries

    folder = "/root/testdata/sf0.01"
    if not os.path.exists(f"{folder}/embeddings.parquet"):
        pytest.skip("the tables are not here")
    rows = [r for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    ids, m = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float32).astype(float)
    found = {}
    for r in queries.op5_learned_partitions(spark, folder).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hit = total = 0
    for q, v in zip(ids, m, strict=True):
        if q % 20 == 0:
            s = np.where(ids == q, -np.inf, m @ v)
            best = set(ids[np.argsort(-s, kind="stable")[:20]].tolist())
            hit, total = hit + len(best & found[q]), total + len(best)
    assert hit / total >= 0.9
