import hashlib
import random
import zlib

import pytest

from scriptloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])


def climb(nodes):
    """The root of ordered nodes, and each one's siblings by level, before and after it."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for n, i in enumerate(at):
            run = runs[i // 16]
            paths[n].append((run[: i % 16], run[i % 16 + 1 :]))
        at, nodes = [i // 16 for i in at], [h(*run) for run in runs]
    return nodes[0], paths


def brute(rows):
    by: dict = {}
    for r in rows:
        by.setdefault(r[3], []).append((r, leaf(*r)))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[s] = climb([x for _, x in by[s]])
    root, tops = climb([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops, strict=True):
        for (r, own), path in zip(by[s], trees[s][1], strict=True):
            doc_id, text = r[0], r[1]
            path = path + top
            node = own
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None:
                node = leaf(doc_id, "".join(c.lower() if "A" <= c <= "Z" else c for c in text), *r[2:])
            for before, after in path:
                node = h(*before, node, *after)
            out.append((doc_id, own, trees[s][0], root, h(*[x for before, after in path for x in before + after]), node, node == root))
    return sorted(out, key=str)


def got(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, merkle.manifest(df).collect()), key=str)


@pytest.mark.parametrize("count", [1, 2, 16, 17, 256, 257, 700])
def test_equals_brute_force(spark, count):
    """One source holds nearly all rows; trees end at and beside the ends of runs and blocks."""
    rng = random.Random(count)
    rows = [(i, f"Text {rng.random()} ÀB", "en", "hot", i) for i in range(count)]
    rows += [(1000 + i, "x", None, s, None) for i, s in enumerate([None, "", "a", "a", "Z", "é", "\U0001f642", "\uffee"])]
    rng.shuffle(rows)
    assert got(spark, rows) == brute(rows)


def test_many_sources(spark):
    """More sources than one block of subroots holds."""
    rows = [(i, "A" * (i % 3), "de", f"host {i % 290}", 1) for i in range(600)]
    assert got(spark, rows) == brute(rows)


def test_nulls_repeats_and_long_texts(spark):
    rows = [(None, None, None, None, None), (5, None, "fr", "s", 0), (5, "B", "fr", "s", 0), (5, "A", "fr", "s", 0), (-7, "M:N-", "x", "s", 2**40), (8, "Long " * 200_000, "en", "t", 1), (9, "", "", "", 0)]
    rows += [(11, "same", "en", "s", 4)] * 40
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows[:1]) == brute(rows[:1])


def test_empty(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tampering_shows(spark):
    rows = [(i, "Ab", "en", "s", 2) for i in range(60)]
    ok = {i: v for i, *_, v in got(spark, rows)}
    assert {i for i, v in ok.items() if not v} == {i for i in ok if zlib.crc32(str(i).encode()) % 5 == 0} != set()
