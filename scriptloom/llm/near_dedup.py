"""MinHash near-duplicate detection with HyperMinHash sketches.

1. Every document gets the exact size of its set of word shingles, a 128-bit key of the set, and a
   sketch: for each of 128 hash buckets the leading-zero count and ten mantissa bits of the least hash.
   Documents with equal sets form a class; only a class's smallest document goes on.
2. Bands of the registers (empty ones borrowed from others by a fixed probing order) are bucketed.
   Every bucket is reduced to stars around pseudo-random pivots, tasks first.
3. A collision-corrected Jaccard estimate from the registers discards pairs that are far off. The members
   of pivots that lose some are bucketed once more, by bands of other registers, and estimated. What is
   left connects documents to clusters. A member's most frequent pivots are verified on full sets, and
   the links contracted to components.
4. In a cluster that still holds several components, all members outside the largest component are
   compared with the whole cluster on full sets, in packs spread over tasks, so that within a cluster no
   pair is left undecided unless it is already connected.

Edge cases: null or empty texts, and texts without words, have an empty set and are linked with
nothing; with fewer words than a shingle the whole sequence is the one shingle; texts of any length
count in full; rows that repeat a doc_id belong to one component; a row without a doc_id is returned
with no component and is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.llm import buckets, common

#: Registers of a sketch, registers of a band, and mantissa bits of a register.
REGISTERS, BAND, MANTISSA = 128, 4, 10
EMPTY = np.uint16(0xFFFF)
#: Pivots that a document is first compared with; later steps settle the rest.
FIRST_PIVOTS = 3
#: Sets and shingles in a pack, about, and matches expanded at once when two packs are compared.
PACK_SETS, PACK_ITEMS, EXPANDED = 128, 24_000, 1 << 20
#: Packs that one pack meets in one task.
MET = 8


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within rows, and each row's first (one more than rows)."""
    starts, ends, first = common.word_spans(data, offsets)
    hashes = common.word_hashes(data, starts, ends, lower=True)
    n = np.diff(first)
    at, rows = common.window_places(first, words)
    counts = np.where(n < words, np.minimum(n, 1), n - words + 1)
    begin = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(begin[-1], np.uint64)
    out[np.arange(len(at)) + np.repeat(begin[:-1] - rows[:-1], np.diff(rows))] = common.run_hashes(hashes, at, words)
    for size in range(1, words):
        short = np.flatnonzero(n == size)
        if len(short):
            out[begin[short]] = common.run_hashes(hashes[(first[short][:, None] + np.arange(size)).ravel()], np.arange(len(short)) * size, size)
    return common.distinct_in_rows(out, begin)


def sketches(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Registers of each row: the least hash of each bucket."""
    out = np.full((len(first) - 1, REGISTERS), EMPTY)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    bucket = (hashes >> np.uint64(57)).astype(np.int64)
    least = np.ones(len(hashes), bool)
    least[1:] = (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])
    out[owner[least], bucket[least]] = compressed(hashes[least] << np.uint64(7))
    return out


def compressed(least: np.ndarray) -> np.ndarray:
    """64-bit hashes as registers: leading zeros and mantissa."""
    fraction, exponent = np.frexp(least.astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 62)
    mantissa = np.clip((fraction * 2 - 1) * (1 << MANTISSA), 0, (1 << MANTISSA) - 1)
    return (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)


def densified(registers: np.ndarray) -> np.ndarray:
    """Empty registers take the value of the first filled one in their own probing order."""
    out, count = registers.copy(), registers.shape[1]
    row, place = np.nonzero(registers == EMPTY)
    filled = (registers != EMPTY).any(axis=1)[row]
    row, place = row[filled], place[filled]
    step = 1
    while len(row):
        probe = (common.mix((place + count * step).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(count)).astype(np.int64)
        value = registers[row, probe]
        got = value != EMPTY
        out[row[got], place[got]] = value[got]
        row, place, step = row[~got], place[~got], step + 1
    return out


def band_keys(registers: np.ndarray, crossed: bool = False) -> np.ndarray:
    """A 64-bit bucket key for each band of each row; crossed bands take registers that stand far apart."""
    registers = densified(registers)
    if crossed:
        registers = registers.reshape(len(registers), BAND, -1).swapaxes(1, 2).reshape(len(registers), -1)
    packed = np.ascontiguousarray(registers).view(np.uint64)
    return common.mix(common.mix(packed) + np.arange(packed.shape[1], dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of sketch pairs, corrected for equal registers of unequal hashes, and registers used."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    same = ((a == b) & (a != EMPTY)).sum(axis=1)
    zeros = 2.0 ** -np.arange(0, 48)

    def chances(n: np.ndarray) -> np.ndarray:
        none = (1 - zeros)[None, :] ** (np.maximum(n, 1)[:, None] / a.shape[1])
        return np.diff(none, axis=1)

    chance = (chances(n_a) * chances(n_b)).sum(axis=1) / (1 << MANTISSA)
    return (same / np.maximum(used, 1) - chance) / (1 - chance), used


def profiles(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, a, b, sketch): size, 128-bit key and sketch of each document's shingle set."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.enter("near_dedup")
        for batch in batch_iter:
            for i, j, data, offsets in common.text_passes(batch.column(1)):
                hashes, first = shingles(data, offsets, words)
                total = np.zeros((2, len(hashes) + 1), np.uint64)
                np.cumsum(common.mix(hashes), out=total[0, 1:])
                np.cumsum(common.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), out=total[1, 1:])
                a, b = (total[k, first[1:]] - total[k, first[:-1]] for k in (0, 1))
                registers = sketches(hashes, first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(np.diff(first)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array([r.tobytes() for r in registers], pa.binary())], names=["doc_id", "n", "a", "b", "sketch"])

    return docs.transform(common.in_arrow, run, "doc_id long, n long, a long, b long, sketch binary")


def packed_sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, n, sketch, items): each document's sketch and its shingle hashes, ascending."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            for i, j, data, offsets in common.text_passes(batch.column(1)):
                hashes, first = shingles(data, offsets, words)
                registers = sketches(hashes, first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(np.diff(first)), pa.array([r.tobytes() for r in registers], pa.binary()), pa.array([hashes[first[k] : first[k + 1]].tobytes() for k in range(j - i)], pa.binary())], names=["id", "n", "sketch", "items"])

    return docs.transform(common.in_arrow, run, "id long, n long, sketch binary, items binary")


def _sketch_rows(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint16).reshape(len(rows), -1)


def banded(batch: pa.RecordBatch, cross: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys and ids of a batch (id, sketch)."""
    if not batch.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = band_keys(_sketch_rows(batch.column(1)), cross)
    return keys.ravel(), np.repeat(batch.column(0).to_numpy(), keys.shape[1])


def crossed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """As ``banded``, by crossed bands."""
    return banded(batch, True)


def _hopeful(percent: int):
    """Says of pairs (u, v, n, nu, nv, su, sv) whether the estimate is within five deviations of the threshold."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            if not batch.num_rows:
                continue
            n_u, n_v = (batch.column(i).to_numpy() for i in (3, 4))
            near, used = estimate(_sketch_rows(batch.column(5)), _sketch_rows(batch.column(6)), n_u, n_v)
            sized = 100 * np.minimum(n_u, n_v) >= percent * np.maximum(n_u, n_v)
            keep = sized & (near >= percent / 100 - 5 * np.sqrt(0.1875 / np.maximum(used, 1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(keep)], names=["u", "v", "n", "near"])

    return run


#: Turns the items of many sets, as gathered, into ascending shingle hashes.
Expand = Callable[[list[bytes]], list[np.ndarray]]


def as_hashes(items: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in items]


def pieces_of(batch_iter: Iterator[pa.RecordBatch], *columns: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the binary columns named add up to a pass at most."""
    for batch in batch_iter:
        for a, b in common.slices(sum(pc.binary_length(batch.column(c)).to_numpy() for c in columns), common.PASS_BYTES):
            yield batch.slice(a, b - a)


def _verified(percent: int, expand: Expand):
    """Keeps pairs (u, v, iu, iv) whose full sets are similar enough."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batch_iter, 2, 3):
            keep = []
            for a, b in zip(expand(batch.column(2).to_pylist()), expand(batch.column(3).to_pylist()), strict=True):
                both = np.concatenate([a, b])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(a) + len(b) - same))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _packs(rows: DataFrame, partitions: int) -> DataFrame:
    """Rows (part, pack, id, component, items) as one row a pack: (part, pack, ids, components, ends, items)."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        now: tuple[int, int] | None = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                ends = np.cumsum([len(x) for _, _, x in held])
                ids, labels = (np.array([h[k] for h in held], np.int64).tobytes() for k in (0, 1))
                yield pa.RecordBatch.from_pydict({"part": pa.array([now[0]], pa.int64()), "pack": pa.array([now[1]], pa.int64()), "ids": [ids], "components": [labels], "ends": [ends.astype(np.int64).tobytes()], "items": [b"".join(h[2] for h in held)]})

        for batch in batch_iter:
            for part, pack, i, label, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (part, pack) != now:
                    yield from flush()
                    held, now = [], (part, pack)
                held.append((i, label, x))
        yield from flush()

    return rows.repartition(partitions, "part", "pack").sortWithinPartitions("part", "pack").transform(common.in_arrow, run, "part long, pack long, ids binary, components binary, ends binary, items binary")


class Pack:
    """Sets of one pack: ids, components, and the sets one after the other."""

    def __init__(self, ids: bytes, components: bytes, ends: bytes, items: bytes, expand: Expand | None, sets: list[np.ndarray] | None = None) -> None:
        self.ids, self.components = (np.frombuffer(x, np.int64) for x in (ids, components))
        if sets is None:
            sets = expand(self.cut(ends, items))
        self.sizes = np.array([len(x) for x in sets], np.int64)
        items = np.concatenate(sets)
        order = np.argsort(items)
        self.items, self.owner = items[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    @staticmethod
    def cut(ends: bytes, items: bytes) -> list[bytes]:
        cuts = [0, *np.frombuffer(ends, np.int64).tolist()]
        return [items[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def cross_links(a: Pack, b: Pack, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and components of similar sets of unequal components: for each set of ``a`` one of each component of ``b``."""
    low = np.searchsorted(b.items, a.items, "left")
    hit = np.flatnonzero(b.items[np.minimum(low, len(b.items) - 1)] == a.items) if len(b.items) else np.zeros(0, np.int64)
    low, mine = low[hit], a.owner[hit]
    hits = np.searchsorted(b.items, a.items[hit], "right") - low
    same = np.zeros(len(a.ids) * len(b.ids), np.int64)
    for i, j in common.slices(hits, EXPANDED):
        n = hits[i:j]
        at = np.arange(n.sum()) + np.repeat(low[i:j] - np.cumsum(n) + n, n)
        same += np.bincount(np.repeat(mine[i:j], n) * len(b.ids) + b.owner[at], minlength=len(same))
    same = same.reshape(len(a.ids), -1)
    near = 100 * same >= percent * (a.sizes[:, None] + b.sizes[None, :] - same)
    near &= a.components[:, None] != b.components[None, :]
    u, v = np.nonzero(near)
    kinds, codes = np.unique(b.components, return_inverse=True)
    _, first = np.unique(u * len(kinds) + codes[v], return_index=True)
    u, v = u[first], v[first]
    return a.ids[u], b.ids[v], a.components[u], b.components[v]


def _compared(percent: int, expand: Expand):
    """Links between the first pack of each (part, i, g), its own if ``alone``, and the packs j that follow it.

    A task leaves out links between components that its earlier links have joined already.
    """

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = buckets.Forest()
        first: Pack | None = None
        for batch in pieces_of(batch_iter, 8):
            # Most clusters are small: the sets of all packs of a batch are made at once.
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            sets, end = expand([x for row in rows for x in Pack.cut(*row[7:])]), 0
            for _, _, _, j, alone, *packed in rows:
                begin, end = end, end + len(packed[0]) // 8
                pack = Pack(*packed, None, sets[begin:end])
                if j < 0:
                    first = pack
                    if not alone:
                        continue
                links = cross_links(first, pack, percent)
                new = np.array([forest.join(x, y) for x, y in zip(links[2].tolist(), links[3].tolist(), strict=True)], bool)
                if len(new):
                    yield pa.RecordBatch.from_arrays([pa.array(links[0][new]), pa.array(links[1][new])], names=["u", "v"])

    return run


def settle(pairs: common.Stored, gather: Callable[[common.Stored], DataFrame], percent: int, label: str, expand: Expand = as_hashes) -> common.Stored:
    """(id, component) from candidate pairs (u, v, n).

    ``gather`` gives (id, n, sketch, items) of the ids in a stored table, and ``expand`` turns items into
    sets where they are compared. Candidates whose estimate is
    hopeful, of the pairs given or those that crossed bands find among the members of pivots unlike some,
    connect ids to clusters. Members are first verified against their most frequent pivots and
    contracted to components; then, in every cluster with more than one component, the members outside
    its largest component are compared with all of the cluster, pack by pack.
    """
    spark, made = pairs.spark, [pairs]
    tasks = common.shuffle_partitions(spark)

    def kept(df: DataFrame, what: str) -> common.Stored:
        made.append(common.store(df, f"{label}-{what}"))
        return made[-1]

    nodes = kept(pairs.read().select(F.explode(F.array("u", "v")).alias("id")).distinct(), "nodes")
    gathered = kept(gather(nodes), "sets")
    u = gathered.read().select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("su"))
    v = gathered.read().select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("sv"))

    def judged(candidates: common.Stored, what: str) -> DataFrame:
        both = candidates.read().join(v, "v").join(u, "u").select("u", "v", "n", "nu", "nv", "su", "sv")
        return kept(both.transform(common.in_arrow, _hopeful(percent), "u long, v long, n long, near boolean"), what).read()

    met = judged(pairs, "judged")
    # Where some members are unlike their pivot, as texts are that share a passage, those of all its buckets may be
    # near one another and have met in none: they are bucketed once more, by crossed bands and among themselves.
    unlike = met.filter("not near").select("u").distinct()
    anew = kept(met.join(unlike, "u", "left_semi").select(F.explode(F.array("u", "v")).alias("id")).distinct(), "anew")
    again = buckets.bucket_pairs(gathered.read().select("id", "sketch").join(anew.read(), "id", "left_semi"), crossed, tasks, f"{label}-again")
    made.append(again)
    hopeful = kept(met.union(judged(again, "judged-again")).filter("near").groupBy("u", "v").agg(F.sum("n").alias("n")), "hopeful")
    for done in made:
        if done is not nodes and done is not gathered and done is not hopeful:
            done.drop()
    frequent = Window.partitionBy("v").orderBy(F.col("n").desc(), F.col("u").desc())
    first = hopeful.read().withColumn("rank", F.row_number().over(frequent)).filter(F.col("rank") <= FIRST_PIVOTS).select("v", "u")
    su = gathered.read().select(F.col("id").alias("u"), F.col("items").alias("iu"))
    sv = gathered.read().select(F.col("id").alias("v"), F.col("items").alias("iv"))
    links = kept(first.join(sv, "v").join(su, "u").select("u", "v", "iu", "iv").transform(common.in_arrow, _verified(percent, expand), "u long, v long"), "links")
    joined = buckets.components(spark, links.read(), f"{label}-components")
    made.append(joined)

    labelled = kept(nodes.read().join(joined.read(), "id", "left").select("id", F.coalesce("component", "id").alias("component")), "labels")
    of_u = labelled.read().select(F.col("id").alias("u"), F.col("component").alias("cu"))
    of_v = labelled.read().select(F.col("id").alias("v"), F.col("component").alias("cv"))
    across = kept(hopeful.read().join(of_u, "u").join(of_v, "v").filter("cu <> cv").select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct(), "across")
    clustered = buckets.components(spark, across.read(), f"{label}-clusters")
    made.append(clustered)
    meeting = across.read().select(F.explode(F.array("u", "v")).alias("component")).distinct()
    part = meeting.join(clustered.read().select(F.col("id").alias("component"), F.col("component").alias("part")), "component", "left").select("component", F.coalesce("part", "component").alias("part"))
    members = kept(labelled.read().join(part, "component").join(gathered.read().select("id", "n", "items"), "id").select("part", "component", "id", "n", "items"), "members")
    sizes = members.read().groupBy("part", "component").agg(F.count("*").alias("docs"), F.sum("n").alias("items"))
    split = (
        sizes.groupBy("part")
        .agg(F.max_by("component", F.struct("docs", "component")).alias("main"), F.max(F.struct("docs", "component", "items")).alias("m"), F.sum("docs").alias("docs"), F.sum("items").alias("items"))
        .select(
            "part",
            "main",
            F.ceil(F.greatest(F.col("m.docs") / PACK_SETS, F.col("m.items") / PACK_ITEMS)).cast("long").alias("inside"),
            F.ceil(F.greatest((F.col("docs") - F.col("m.docs")) / PACK_SETS, (F.col("items") - F.col("m.items")) / PACK_ITEMS)).cast("long").alias("outside"),
        )
    )
    split = kept(split, "split").read()
    salt = F.xxhash64("id")
    dealt = members.read().join(split, "part").select("part", F.when(F.col("component") == F.col("main"), F.pmod(salt, "inside")).otherwise(F.col("inside") + F.pmod(salt, "outside")).alias("pack"), "id", "component", "items")
    packs = kept(_packs(dealt, tasks), "packs").read().join(split.drop("main"), "part")
    # Packs of the largest component meet those outside it; packs outside it meet all. A pack i goes once to each
    # group of MET packs j that it meets, and each j to the group in which i meets it.
    packed_ = ["ids", "components", "ends", "items"]
    last = F.col("inside") + F.col("outside") - 1
    group = (F.col("pack") / MET).cast("long")
    groups = F.explode(F.sequence((F.greatest("pack", "inside") / MET).cast("long"), (last / MET).cast("long")))
    given = packs.filter("outside > 0").withColumn("g", groups).select("part", F.col("pack").alias("i"), "g", F.lit(-1).cast("long").alias("j"), ((F.col("pack") >= F.col("inside")) & (F.col("g") == group)).alias("alone"), *packed_)
    others = packs.filter("pack >= inside and pack > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pack") - 1))).select("part", "i", group.alias("g"), F.col("pack").alias("j"), F.lit(False).alias("alone"), *packed_)
    meetings = given.union(others).repartition(tasks, "part", "i", "g").sortWithinPartitions("part", "i", "g", "j")
    more = kept(meetings.transform(common.in_arrow, _compared(percent, expand), "u long, v long"), "more-links")
    stars = joined.read().select(F.col("id").alias("u"), F.col("component").alias("v"))
    final = buckets.components(spark, stars.union(more.read()), f"{label}-final")
    for done in made:
        done.drop()
    return final


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    common.tune(spark)
    texts = common.spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    profile = common.store(profiles(texts, words), "near-profiles")
    countable = F.expr("n > 0 and doc_id is not null")
    linked = profile.read().filter(countable)
    classes = common.store(linked.groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep")), "near-classes")
    first = linked.select("doc_id", "sketch").join(classes.read().select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    pairs = buckets.bucket_pairs(first.select("doc_id", "sketch"), banded, common.shuffle_partitions(spark), "near-pairs")

    def gather(nodes: common.Stored) -> DataFrame:
        return packed_sets(common.semi_by_id(texts.filter("doc_id is not null"), nodes.read().withColumnRenamed("id", "doc_id"), "doc_id"), words)

    final = settle(pairs, gather, percent, "near")
    named = classes.read().join(final.read().withColumnRenamed("id", "rep"), "rep", "left").select("a", "b", "n", F.coalesce("component", "rep").alias("component_id"))
    # Classes of any size are split by Spark's skew join; rows that are linked with nothing stay out of it.
    joined = linked.select("doc_id", "n", "a", "b").join(named, ["a", "b", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = profile.read().filter(~countable | F.isnull(countable)).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` without those near duplicates whose component has a smaller doc_id."""
    gone = common.store(near_duplicates(docs, words, percent).filter("not kept").select("doc_id").distinct(), "near-removed")
    return common.semi_by_id(docs, gone.read(), "doc_id", "left_anti")
