import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptloom.llm import buckets, common, line_dedup, near_dedup, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def groups(sets, percent):
    """Smallest id of each id's component, by all pairs."""
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sets if sets[i]]
    for n, a in enumerate(ids):
        for b in ids[:n]:
            same = len(sets[a] & sets[b])
            if 100 * same >= percent * len(sets[a] | sets[b]):
                a_, b_ = sorted((root(a), root(b)))
                parent[b_] = a_
    return {i: root(i) for i in sets}


def test_words(corpus):
    column = pa.array([t for _, t in corpus])
    words = []
    for a, b, data, offsets in common.text_passes(column, 5000):
        starts, ends, first = common.word_spans(data, offsets)
        found = [bytes(data[i:j]).decode() for i, j in zip(starts, ends, strict=True)]
        words += [found[first[i] : first[i + 1]] for i in range(b - a)]
    assert words == [WORD.findall(t or "") for _, t in corpus]


def test_near_duplicates(docs, corpus, nothing):
    sets = {}
    for i, text in corpus:
        w = WORD.findall(low(text))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    component = groups(sets, 75)
    rows = near_dedup.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {i: (len(s), component[i], component[i] == i) for i, s in sets.items()}
    kept = near_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in sets if component[i] == i}
    assert near_dedup.near_duplicates(nothing).collect() == []


def test_near_duplicates_of_odd_ids(spark):
    rows = spark.createDataFrame([(None, "a b"), (3, "a b"), (2, "a b"), (2, "a b"), (9, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.component_id, r.kept) for r in near_dedup.near_duplicates(rows).collect())
    assert got == [(0, None, True), (2, 2, True), (2, 2, True), (3, 2, False), (9, 9, True)]


def test_estimate_corrects_collisions():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        items = rng.integers(0, 1 << 63, 900, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        a, b = np.sort(items[:600]), np.sort(items[100:])
        sketch = [near_dedup.sketches(x, np.array([0, len(x)])) for x in (a, b)]
        errors.append(near_dedup.estimate(*sketch, np.array([600]), np.array([800]))[0][0] - 500 / 900)
    assert abs(np.mean(errors)) < 0.02


@pytest.mark.parametrize("task_edges", [200_000, 60])
def test_components(spark, monkeypatch, task_edges):
    monkeypatch.setattr(buckets, "TASK_EDGES", task_edges)
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 450)] + [(500, i) for i in range(501, 540)] + [(7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    found = {r.id: r.component for r in buckets.components(spark, spark.createDataFrame(edges, "u long, v long"), "test").read().collect()}
    assert found == {i: root(i) for i in parent if root(i) != i}


def test_partition_keys(spark):
    keys = buckets.partition_keys(7)
    rows = spark.createDataFrame([(int(k),) for k in keys], "p int").repartition(7, "p").select("p", F.spark_partition_id().alias("at")).collect()
    assert {r.p: r["at"] for r in rows} == {int(k): i for i, k in enumerate(keys)}


def test_cross_links_finds_each_component():
    packs = [np.array(x, np.uint64) for x in ([1, 2, 3, 4], [1, 2, 3, 5], [9, 10])]

    def pack(ids, components, sets):
        ends = np.cumsum([8 * len(x) for x in sets])
        return near_dedup.Pack(np.array(ids, np.int64).tobytes(), np.array(components, np.int64).tobytes(), ends.astype(np.int64).tobytes(), np.concatenate(sets).tobytes(), near_dedup.as_hashes)

    a, b = pack([1], [1], packs[:1]), pack([2, 3, 4], [2, 3, 1], [packs[1], packs[2], packs[0]])
    u, v, _, _ = near_dedup.cross_links(a, b, 60)
    assert list(zip(u.tolist(), v.tolist(), strict=True)) == [(1, 2)]


@pytest.mark.parametrize("words", [20])
def test_substring_dedup(docs, corpus, nothing, words):
    seen, want, kept = set(), {}, {}
    for i, text in sorted(corpus):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for k in range(len(w) - words + 1):
            window = tuple(w[k : k + words])
            if window in seen:
                gone[k : k + words] = [True] * words
            seen.add(window)
        kept[i] = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept[i].encode()).hexdigest())
    assert sum(x[1] for x in want.values()) > 500
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digests(docs).collect()} == want
    cut = substring_dedup.without_repeats(docs)
    assert cut.columns == docs.columns
    before = dict(corpus)
    for r in cut.collect():
        assert " ".join(WORD.findall(r.text or "")) == kept[r.doc_id] and r.component_id == "clash"
        assert want[r.doc_id][1] or r.text == before[r.doc_id]
    spans = substring_dedup.spans(docs).collect()
    where = dict(corpus)
    for r in spans:  # the words at both coordinates are the same
        own, there = (WORD.findall(where[i])[k : k + r.length] for i, k in ((r.doc_id, r.start), (r.source_doc_id, r.source_start)))
        assert len(own) == r.length and own == there and (r.source_doc_id, r.source_start) < (r.doc_id, r.start)
    assert {r.doc_id for r in spans} == {i for i, x in want.items() if x[1]} and all(r.source_doc_id <= r.doc_id for r in spans)
    assert substring_dedup.digests(nothing).collect() == []


def test_line_dedup(docs, corpus, nothing, spark):
    extra = [(1000 + i, t) for i, t in enumerate(["the quick brown fox jumps over the lazy dog today, again and again\nunique a", "The quick brown fox jumps over the lazy dog today, again and again!\n\nunique b", "unique a\nunique a\nx", "x"])]
    rows = corpus + extra
    table = docs.unionByName(spark.createDataFrame([(i, t, "clash", None) for i, t in extra], docs.schema))
    first = {}
    for i, text in sorted(rows):
        for n, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\n\x0b\x0c\r"):
                first.setdefault(line, (i, n))
    lines = list(first)
    sets = {k: {low(x)[j : j + 8] for j in range(max(len(x) - 7, 1))} for k, x in enumerate(lines)}
    component = groups(sets, 80)
    keep = {}
    for k, line in enumerate(lines):
        keep[component[k]] = min(keep.get(component[k], (1 << 60, 0)), first[line])
    keep = set(keep.values())
    want = {}
    for i, text in rows:
        out, n, gone = [], 0, 0
        for k, line in enumerate((text or "").split("\n")):
            ink = bool(line.strip(" \t\n\x0b\x0c\r"))
            n += ink
            if ink and (i, k) not in keep:
                gone += 1
            else:
                out.append(line)
        want[i] = (n, gone, hashlib.sha256("\n".join(out).encode()).hexdigest())
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in line_dedup.digests(table).collect()} == want
    cut = line_dedup.without_repeats(table)
    assert cut.columns == docs.columns and {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in cut.collect()} == {i: x[2] for i, x in want.items()}
    assert line_dedup.digests(nothing).collect() == []


def thue_morse(bits):
    a, b = "a", "b"
    for _ in range(bits):
        a, b = a + b, b + a
    return a, b


def test_words_that_polynomial_hashes_confuse(spark):
    """Words that are equal under every polynomial hash modulo 2**64 stay unlike, and so do windows of such patterns."""
    one, other = thue_morse(10)
    rest = [f"w{i}" for i in range(19)]
    rows = [(1, " ".join([one, *rest])), (2, " ".join([other, *rest])), (3, f"x y {one} z t"), (4, f"x y {other} z t"), (5, f"{one}{one[::-1]}"), (6, f"{other}{one[::-1]}")]
    pattern = [{"a": "u", "b": "v"}[c] for c in thue_morse(4)[0]]
    rows += [(7, " ".join([*pattern, "c", "d", "e", "f"])), (8, " ".join([*({"u": "v", "v": "u"}[w] for w in pattern), "c", "d", "e", "f"]))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.digests(table).collect()] == [0] * 8
    near = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table).collect()}
    assert all(near[i] == i for i in (3, 4, 5, 6, 7, 8))
    lines = spark.createDataFrame([(1, one * 2), (2, other * 2), (3, "q" + one), (4, "q" + other)], "doc_id long, text string")
    sets = {r.doc_id: {r.text[i : i + 8] for i in range(len(r.text) - 7)} for r in lines.collect()}
    component = groups(sets, 80)
    assert {r.doc_id: r.n_removed for r in line_dedup.digests(lines).collect()} == {i: int(component[i] != i) for i in sets}


def test_paths_end_where_the_graph_branches(spark):
    a, b, c = ([f"{x}{i}" for i in range(40)] for x in "abc")
    rows = [(1, " ".join(a + b)), (2, " ".join(a + c)), (3, " ".join(a + b)), (4, " ".join(["z", *a[5:], "y"]))]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    _, runs = substring_dedup.repeats(table, 20)
    found = sorted((r.start, r.n, r.uses) for r in substring_dedup.paths(runs.read()).collect())
    # Document 2 leaves a's path after its 21 edges; document 4 joins it 5 edges later and leaves at the same place; 3 goes on.
    assert found == [(0, 5, 2), (5, 16, 3), (21, 40, 1)]
    assert {r.doc_id: r.n_removed for r in substring_dedup.digests(table).collect()} == {1: 0, 2: 40, 3: 80, 4: 35}


def test_false_matches_are_not_removed(spark):
    """Runs are removed only if the words at their source are the same."""
    text = " ".join(f"a{i}" for i in range(20))
    table = spark.createDataFrame([(1, text), (2, " ".join(f"b{i}" for i in range(20))), (3, text)], "doc_id long, text string").coalesce(1)
    made, _ = substring_dedup.repeats(table, 20)
    number, rows = made.read().first()
    digest = [bytearray(x) for x in substring_dedup.WordBlock(bytes(rows)).digest([(20, 40), (40, 60)])]
    claims = [(number, 20, 1, number, 0, digest[0]), (number, 40, 1, number, 0, digest[1])]
    runs = common.store(spark.createDataFrame(claims, "block long, at long, n long, source long, source_at long, digest binary"), "test-runs")
    assert [r.p for r in substring_dedup.verified(made, runs, 20).collect()] == [40]


def test_refuted_runs_are_verified_edge_by_edge(spark):
    """A run of three edges of which the last does not repeat: the others go, and no more."""
    words = [f"a{i}" for i in range(22)]
    other = [*words[:-1], "unlike"]
    table = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string").coalesce(1)
    made, _ = substring_dedup.repeats(table, 20)
    number, rows = made.read().first()
    block = substring_dedup.WordBlock(bytes(rows))
    claim = [(number, 22, 3, number, 0, bytearray(block.digest([(22, 44)])[0]))]
    runs = common.store(spark.createDataFrame(claim, "block long, at long, n long, source long, source_at long, digest binary"), "test-runs")
    assert sorted((r.p, r.n) for r in substring_dedup.verified(made, runs, 20).collect()) == [(22, 1), (23, 1)]


@pytest.mark.parametrize("limit", [-1])
def test_joins_without_broadcasts(spark, docs, corpus, monkeypatch, limit):
    """Every broadcast limit below any count: the same results by shuffles."""
    want = sorted(map(tuple, near_dedup.near_duplicates(docs).collect())), sorted(r.doc_id for r in near_dedup.keep_one_of_each(docs).collect())
    monkeypatch.setattr(common, "BROADCAST_IDS", limit)
    assert (sorted(map(tuple, near_dedup.near_duplicates(docs).collect())), sorted(r.doc_id for r in near_dedup.keep_one_of_each(docs).collect())) == want


def test_near_texts_that_met_only_unlike_pivots(spark):
    """2 and 3 are near, and were in the same buckets as the unlike 1 only; 4, like 1, is near none."""
    rng = np.random.default_rng(3)
    base, other = (np.sort(rng.integers(0, 1 << 63, 100).astype(np.uint64) * np.uint64(2)) for _ in range(2))
    sets = {1: base, 2: other, 3: np.sort(np.concatenate([other[:90], base[:5]])), 4: np.sort(np.concatenate([base[:70], other[90:]]))}
    rows = []
    for i, items in sets.items():
        rows.append((i, len(items), bytearray(near_dedup.sketches(items, np.array([0, len(items)]))[0].tobytes()), bytearray(items.tobytes())))
    gathered = spark.createDataFrame(rows, "id long, n long, sketch binary, items binary")
    pairs = common.store(spark.createDataFrame([(1, 2, 3), (1, 3, 3), (1, 4, 3)], "u long, v long, n long"), "test-pairs")
    assert [(r.id, r.component) for r in near_dedup.settle(pairs, lambda _: gathered, 75, "test").read().collect()] == [(3, 2)]
