"""Removal of repeated word spans over a compacted de Bruijn graph of word k-mers.

An edge of the graph is a window of 20 consecutive words. Documents are packed into blocks (module
blocks); a coordinate is a block and a word's place there.
1. As builders of compacted graphs do, every window is assigned to its minimiser (the least hash of the
   8-word runs inside it); each block sends its distinct minimisers, and learns which other blocks have
   too. Windows under a minimiser that no other block has cannot repeat outside their block.
2. The remaining windows, each block's first occurrences only, meet by hash. All but the earliest learn
   that they repeat, and the coordinate of the earliest, the edge's source.
3. Edges that follow one another in a document and at their source compact into runs; a run ends where
   the graph branches for this document. Joins by source bring the ends of all runs together: what lies
   between two ends is a nonbranching path, passed as a whole by all documents that touch it.
4. Joined back to the blocks of their sources, runs are verified: the words at the source coordinates
   are compared, by 128-bit digests of their bytes, with those of the run. Only words of verified runs
   are removed; a run that is refuted is verified edge by edge.
Answers travel as bit maps over what a block sent, so blocks recompute instead of storing windows.

Edge cases: a null or empty text has no words; texts shorter than a window keep all words; texts of any
length are one sequence; rows that repeat a doc_id are ordered by their block; a row without a doc_id
comes after all others; an empty table gives an empty result; other columns are ignored, or carried
through by ``without_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.llm import blocks, buckets, common

#: Words of the runs whose least hash is a window's minimiser.
SEED_WORDS = 8
#: Seeds of the two independent hashes of words.
KEY, CHECK = 0, 1


class WordBlock(blocks.Block):
    """The words of a packed block; windows and minimisers on demand."""

    def __init__(self, rows: bytes) -> None:
        super().__init__(rows)
        self.starts, self.ends, self.first = common.word_spans(self.data, self.offsets)
        self.sizes = (self.ends - self.starts).astype(np.uint32)

    def minimisers(self, hashes: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
        """The least hash of a run of SEED_WORDS words in each window."""
        if not len(at):
            return np.zeros(0, np.uint64)
        least = common.run_hashes(hashes, np.arange(len(hashes) - SEED_WORDS + 1), SEED_WORDS)
        span, need = 1, words - SEED_WORDS + 1
        while 2 * span <= need:
            least = np.minimum(least[: len(least) - span], least[span:])
            span *= 2
        return np.minimum(least[at], least[at + need - span])

    def seeds(self, words: int) -> np.ndarray:
        """The distinct minimisers, ascending."""
        at, _ = common.window_places(self.first, words)
        return np.unique(self.minimisers(common.word_hashes(self.data, self.starts, self.ends, seed=KEY), at, words))

    def windows(self, words: int, answers: dict[int, tuple], to: np.ndarray) -> None:
        """Keys and checks of all windows, repeats within the block, and what the block sends of them."""
        hashes = common.word_hashes(self.data, self.starts, self.ends, seed=KEY)
        self.at, self.rows = common.window_places(self.first, words)
        self.keys = common.run_hashes(hashes, self.at, words)
        minimisers = self.minimisers(hashes, self.at, words)
        hashes = common.word_hashes(self.data, self.starts, self.ends, seed=CHECK)
        self.checks = (common.run_hashes(hashes, self.at, words, CHECK) >> np.uint64(32)).astype(np.uint32)
        order = np.argsort(self.keys, kind="stable")
        k, c = self.keys[order], self.checks[order]
        again = np.zeros(len(order), bool)
        again[1:] = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
        if ((k[1:] == k[:-1]) & (c[1:] != c[:-1])).any():  # unlike windows of one key may part equal ones
            order = np.lexsort((self.checks, self.keys))
            k, c = self.keys[order], self.checks[order]
            again[1:] = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
        self.order, self.again = order, again
        anchors = np.unique(minimisers)
        new = np.zeros(len(self.keys), bool)
        new[order[~again]] = True
        elsewhere = anchors[blocks.told(answers, anchors, to)[0]]
        self.sent = np.flatnonzero(new & np.isin(minimisers, elsewhere))

    def owner(self, windows: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.rows, windows, side="right") - 1

    def sources(self, number: int, answers: dict[int, tuple], to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The coordinate (block, or -1, and place) of each window that occurs earlier."""
        holder, place = np.full(len(self.keys), -1, np.int64), np.zeros(len(self.keys), np.int64)
        named, holders, places = blocks.told(answers, self.keys[self.sent], to)
        holder[self.sent[named]], place[self.sent[named]] = holders, places
        if len(self.order):
            start = self.order[np.maximum.accumulate(np.where(~self.again, np.arange(len(self.order)), 0))][self.again]
            later = self.order[self.again]
            outside = holder[start] >= 0
            holder[later] = np.where(outside, holder[start], number)
            place[later] = np.where(outside, place[start], self.at[start])
        return holder, place

    def digest(self, spans: list[tuple[int, int]]) -> list[bytes]:
        """128-bit digests of the bytes of words and their lengths, for spans (first word, end)."""
        if not hasattr(self, "ink"):
            self.ink = self.data[common.ink(self.data)].tobytes()
            self.ink_at = np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)])
        return [xxhash.xxh3_128_digest(self.ink[self.ink_at[a] : self.ink_at[b]] + self.sizes[a:b].tobytes()) for a, b in spans]

    def kept(self, gone: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Each row's words that stay, joined by one space: bytes and offsets."""
        stay = np.flatnonzero(~gone)
        edge = np.zeros(len(self.data) + 1, np.int8)
        edge[self.starts[stay]] += 1
        edge[self.ends[stay]] -= 1
        mask = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        row = np.searchsorted(self.first, stay, side="right") - 1
        between = self.ends[stay[:-1][row[1:] == row[:-1]]] if len(stay) else stay
        mask[between] = True
        data = self.data.copy()
        data[between] = 32
        return data[mask].tobytes(), np.concatenate([[0], np.cumsum(mask)])[self.offsets]


def repeats(docs: DataFrame, words: int) -> tuple[common.Stored, common.Stored]:
    """The stored blocks, and the stored runs (block, at, n, source, source_at, digest) of n repeated edges."""
    tasks = common.shuffle_partitions(docs.sparkSession)
    to = buckets.partition_keys(tasks)
    made = common.store(blocks.packed(docs), "repeats-blocks")

    def seeds(block: WordBlock, _: blocks.Answers, number: int) -> Iterator[pa.RecordBatch]:
        yield blocks.sending(number, to, block.seeds(words))

    sent = blocks.with_answers(made, [], WordBlock, seeds, blocks.SENT_DDL)
    first = common.store(sent.repartition(tasks, "p").transform(common.in_arrow, blocks.shared, blocks.ANSWER_DDL), "repeats-minimisers")

    def windows(block: WordBlock, got: blocks.Answers, number: int) -> Iterator[pa.RecordBatch]:
        block.windows(words, got[0], to)
        yield blocks.sending(number, to, block.keys[block.sent], block.checks[block.sent], block.ids[block.owner(block.sent)], block.at[block.sent])

    sent = blocks.with_answers(made, [first.read()], WordBlock, windows, blocks.SENT_DDL)
    second = common.store(sent.repartition(tasks, "p").transform(common.in_arrow, blocks.earlier(np.uint32, True), blocks.ANSWER_DDL), "repeats-windows")

    def runs(block: WordBlock, got: blocks.Answers, number: int) -> Iterator[pa.RecordBatch]:
        block.windows(words, got[0], to)
        holder, place = block.sources(number, got[1], to)
        hit = np.flatnonzero(holder >= 0)
        at, source, source_at, row = block.at[hit], holder[hit], place[hit], block.owner(hit)
        new = np.ones(len(hit), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (source[1:] != source[:-1]) | (source_at[1:] != source_at[:-1] + 1) | (row[1:] != row[:-1])
        head = np.flatnonzero(new)
        n = np.diff(np.append(head, len(hit)))
        digests_ = block.digest(list(zip(at[head].tolist(), (at[head] + n + words - 1).tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array([number] * len(head), pa.int64()), *(pa.array(x.astype(np.int64)) for x in (at[head], n, source[head], source_at[head])), pa.array(digests_, pa.binary())], names=["block", "at", "n", "source", "source_at", "digest"])

    found = common.store(blocks.with_answers(made, [first.read(), second.read()], WordBlock, runs, "block long, at long, n long, source long, source_at long, digest binary"), "repeats-runs")
    first.drop()
    second.drop()
    return made, found


def paths(runs: DataFrame) -> DataFrame:
    """(source, start, n, uses): the nonbranching paths of n edges, at their sources, and how many runs pass through each.

    Runs start and end where the graph branches; between two such places of one source all runs go the
    same way. The places of a source are no more than its block's words, however many runs share them.
    """
    passed = runs.groupBy("source", "source_at", "n").agg(F.count("*").alias("uses"))
    ends = passed.select("source", F.col("source_at").alias("start"), "uses").union(passed.select("source", F.col("source_at") + F.col("n"), -F.col("uses")))
    ordered = Window.partitionBy("source").orderBy("start")
    cut = ends.groupBy("source", "start").agg(F.sum("uses").alias("change"))
    swept = cut.select("source", "start", (F.lead("start").over(ordered) - F.col("start")).alias("n"), F.sum("change").over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("uses"))
    return swept.filter("uses > 0")


def _told(df: DataFrame, block: str = "block", at: str = "at") -> DataFrame:
    """Places and lengths as answers to their blocks."""
    null = F.lit(None).cast("binary")
    return df.select(F.col(block).alias("block"), F.lit(2).alias("kind"), F.col(at).cast("int").alias("p"), F.col("n").cast("int").alias("n"), null.alias("x"), null.alias("y"), null.alias("z"))


def _digests_at(made: common.Stored, asked: DataFrame, words: int, label: str) -> DataFrame:
    """(source, source_at, n, there): digests of the words of n edges at each place asked for."""

    def run(block: WordBlock, got: blocks.Answers, number: int) -> Iterator[pa.RecordBatch]:
        found = block.digest([(at, at + n + words - 1) for at, n, _ in got[2]])
        yield pa.RecordBatch.from_arrays([pa.array([number] * len(found), pa.int64()), pa.array([x[0] for x in got[2]], pa.int64()), pa.array([x[1] for x in got[2]], pa.int64()), pa.array(found, pa.binary())], names=["source", "source_at", "n", "there"])

    return common.store(blocks.with_answers(made, [_told(asked, "source", "source_at")], WordBlock, run, "source long, source_at long, n long, there binary"), label).read()


def verified(made: common.Stored, runs: common.Stored, words: int) -> DataFrame:
    """Those runs whose words are the words at their source, as answers to their blocks; of others the edges for which that holds."""
    there = _digests_at(made, runs.read().select("source", "source_at", "n").distinct(), words, "repeats-sources")
    # A passage that a third of all documents share is one source row and many runs: Spark's skew join splits those.
    judged = common.store(runs.read().join(there, ["source", "source_at", "n"]).withColumn("same", F.col("digest") == F.col("there")).drop("digest", "there"), "repeats-judged").read()
    good, refuted = judged.filter("same"), judged.filter("not same")
    if refuted.isEmpty():
        return _told(good)
    # Unlike words of one hash: each edge of such a run stands for itself.
    k = F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("k")
    edges = refuted.select("block", "at", "source", "source_at", k).select("block", (F.col("at") + F.col("k")).alias("at"), "source", (F.col("source_at") + F.col("k")).alias("source_at"), F.lit(1).cast("long").alias("n"))
    places = edges.select("source", "source_at", "n").union(edges.select("block", "at", "n")).distinct()
    found = _digests_at(made, places, words, "repeats-edges")
    own = found.select(F.col("source").alias("block"), F.col("source_at").alias("at"), F.col("there").alias("here"))
    same = edges.join(own, ["block", "at"]).join(found, ["source", "source_at", "n"]).filter("here = there")
    return _told(good).unionByName(_told(same))


def _covered(block: WordBlock, spans: list[tuple[int, int, bytes]], words: int) -> np.ndarray:
    """Words inside the runs given."""
    edge = np.zeros(len(block.starts) + 1, np.int64)
    at, n = (np.array([x[i] for x in spans], np.int64) for i in (0, 1))
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n + words - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def digests(docs: DataFrame, words: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of ``docs`` (doc_id, text)."""
    common.tune(docs.sparkSession)
    made, runs = repeats(common.spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), words)

    def use(block: WordBlock, got: blocks.Answers, _: int) -> Iterator[pa.RecordBatch]:
        gone = _covered(block, got[2], words)
        total, (kept, at) = np.concatenate([[0], np.cumsum(gone)]), block.kept(gone)
        shas = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([block.table.column("doc_id").combine_chunks(), pa.array(np.diff(block.first)), pa.array(np.diff(total[block.first])), pa.array(shas, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return blocks.with_answers(made, [verified(made, runs, words)], WordBlock, use, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def spans(docs: DataFrame, words: int = 20) -> DataFrame:
    """(doc_id, start, length, source_doc_id, source_start): the verified runs, in words, and where they stand first."""
    common.tune(docs.sparkSession)
    made, runs = repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words)
    null = F.lit(None).cast("binary")

    def located(block: WordBlock, got: blocks.Answers, number: int) -> Iterator[pa.RecordBatch]:
        at = np.unique(np.array([x[0] for x in got[2]], np.int64))
        row = np.searchsorted(block.first, at, side="right") - 1
        yield pa.RecordBatch.from_arrays([pa.array([number] * len(at), pa.int64()), pa.array(at), block.table.column("doc_id").combine_chunks().take(pa.array(row)), pa.array(at - block.first[row])], names=["block", "at", "doc_id", "start"])

    good = runs.read().join(verified(made, runs, words).select("block", F.col("p").cast("long").alias("at"), F.col("n").cast("long").alias("n")), ["block", "at", "n"], "left_semi")
    wanted = good.select("block", "at").union(good.select("source", "source_at")).distinct()
    asked = wanted.select("block", F.lit(2).alias("kind"), F.col("at").cast("int").alias("p"), F.lit(0).alias("n"), null.alias("x"), null.alias("y"), null.alias("z"))
    names = common.store(blocks.with_answers(made, [asked], WordBlock, located, "block long, at long, doc_id long, start long"), "repeats-names").read()
    source = names.select(F.col("block").alias("source"), F.col("at").alias("source_at"), F.col("doc_id").alias("source_doc_id"), F.col("start").alias("source_start"))
    return good.join(names, ["block", "at"]).join(source, ["source", "source_at"]).select("doc_id", "start", (F.col("n") + words - 1).alias("length"), "source_doc_id", "source_start")


def without_repeats(docs: DataFrame, words: int = 20) -> DataFrame:
    """The rows of ``docs``, all columns, with repeated spans cut out of ``text``; other texts stay as they are."""
    common.tune(docs.sparkSession)
    made, runs = repeats(docs, words)

    def use(block: WordBlock, got: blocks.Answers, _: int) -> Iterator[pa.RecordBatch]:
        gone = _covered(block, got[2], words)
        data, first, texts = block.data.tobytes(), block.first, {}
        for i in np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(gone)])[first])).tolist():
            left = np.flatnonzero(~gone[first[i] : first[i + 1]]) + first[i]
            cuts = np.split(left, np.flatnonzero(np.diff(left) > 1) + 1) if len(left) else []
            texts[i] = b" ".join(data[block.starts[x[0]] : block.ends[x[-1]]] for x in cuts)
        yield from block.with_texts(texts).to_batches()

    return blocks.with_answers(made, [verified(made, runs, words)], WordBlock, use, docs.schema)
