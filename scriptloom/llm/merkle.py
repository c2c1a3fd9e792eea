"""A Merkle manifest of a dataset, with SQL expressions alone: leaves, subroots, a root, and a proof for every row.

H is the lowercase hex SHA-256 of its inputs joined, digests as hex text. A row's leaf is H of its fields,
each ``-`` if null, else its UTF-8 byte count, ``:`` and its value. The leaves of a source, in order, are
numbered and packed into arrays of 256; such a block collapses two levels of 16 by ``sequence``,
``transform`` and ``slice``, and the blocks' roots are packed again until each source has one node, its
subroot. The subroots, in order of their sources, are collapsed likewise. Proofs come back down the same
blocks: a block joins the path above it, a row of 256 leaves at a time, and ``aggregate`` folds each
leaf with its siblings.

Numbering: rows are dealt by ranges of (source, doc_id, leaf), so that a source of any size is spread over
many tasks; a row's number is its place in its range and the counts of the ranges before. No source, run or
tree is ever gathered: a task holds blocks of 256 nodes.

Edge cases: null fields count as ``-``; a null source is a source of its own and comes first; rows without
a doc_id come first in their source and are never tampered with; rows that repeat a doc_id follow the order
of their leaves, equal ones that of reading (they differ in their proofs alone); texts of any length are
hashed whole; a source of one row has its leaf as subroot, and a single subroot is the root; an empty table
gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.llm import common

#: Nodes of a run, and levels that one block collapses.
FAN, LEVELS = 16, 2
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<before:string,after:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(fields: Sequence[Column]) -> Column:
    """H of fields, each by its byte count and value."""
    shown = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in shown]))


def tampered(doc_id: Column, every: int = 5) -> Column:
    """Whether a row is among those whose text is tampered with."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(every)) == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, other, place): leaves, and those of tampered rows, as bytes; a tree is a source."""
    fields = [F.col(f) for f in FIELDS]
    changed = leaf([*fields[:-1], F.translate("text", UPPER, LOWER)])
    return docs.select(
        # A null source comes before all others, and is not equal to the empty one.
        F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(leaf(fields)).alias("leaf"),
        F.when(tampered(F.col("doc_id")), F.unhex(changed)).alias("other"),
        F.monotonically_increasing_id().alias("place"),
    )


def numbered(rows: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """``rows`` with the number ``at`` of each within its tree, by ``order``, and the ``total`` of its tree."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(common.shuffle_partitions(spark), "tree", *order).sortWithinPartitions("tree", *order)
    stored = common.store(dealt.withColumn("range", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), label)
    # A row for each tree of each range.
    counts = stored.read().groupBy("tree", "range").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    before = Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select("tree", "range", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("start"), F.sum("n").over(Window.partitionBy("tree")).alias("total"))
    start = common.store(start, f"{label}-starts").read()
    return stored.read().join(start, ["tree", "range"]).withColumn("at", F.col("seq") + F.col("start")).drop("range", "seq", "start")


def _collapsed(nodes: Column) -> Column:
    """The level above: H of every run."""
    runs = F.sequence(F.lit(0), ((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda j: digest(F.array_join(F.slice(nodes, j * FAN + 1, F.lit(FAN)), "")))


def blocks(nodes: DataFrame, info: Column, round_: int, label: str) -> common.Stored:
    """(tree, block, total, members, levels, node) of nodes (tree, at, total, leaf) and their ``info``, packed in order.

    ``levels`` holds the nodes of each level below ``node``; a block whose tree has no level left has none.
    """
    rows = nodes.select("tree", "total", F.floor(F.col("at") / BLOCK).cast("long").alias("block"), F.struct("at", "leaf", info.alias("info")).alias("member"))
    grouped = rows.groupBy("tree", "block").agg(F.first("total").alias("total"), F.array_sort(F.collect_list("member"), lambda x, y: (x["at"] - y["at"]).cast("int")).alias("members"))
    out = grouped.withColumn("height", _height(F.col("total")) - round_ * LEVELS).withColumn("level0", F.transform("members", lambda m: F.lower(F.hex(m["leaf"]))))
    for i in range(LEVELS):
        out = out.withColumn(f"level{i + 1}", F.when(F.col("height") > i, _collapsed(F.col(f"level{i}"))).otherwise(F.col(f"level{i}")))
    levels = F.slice(F.array(*[F.col(f"level{i}") for i in range(LEVELS)]), F.lit(1), F.greatest(F.least(F.col("height"), F.lit(LEVELS)), F.lit(0)))
    return common.store(out.select("tree", "block", "total", "members", levels.alias("levels"), F.get(f"level{LEVELS}", 0).alias("node")), label)


def _height(total: Column) -> Column:
    """Levels above the leaves of a tree: the least h with FAN ** h at least ``total``, in whole numbers."""
    return F.size(F.filter(F.array(*[F.lit(FAN**h) for h in range(15)]), lambda x: x < total))


def _path_of(i: Column, levels: Column) -> Column:
    """The siblings before and after node ``i`` of the lowest level, level by level."""

    def siblings(nodes: Column, level: Column) -> Column:
        at = F.floor(i / F.pow(F.lit(float(FAN)), level)).cast("int")
        inside = F.pmod(at, F.lit(FAN))
        before = F.slice(nodes, at - inside + 1, inside)
        after = F.slice(nodes, at + 2, F.lit(FAN - 1) - inside)
        return F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))

    return F.transform(levels, siblings)


def proof(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda node, s: digest(F.concat(s["before"], node, s["after"])))


class Forest:
    """Trees collapsed to their roots, round by round, with the blocks of every round."""

    def __init__(self, nodes: DataFrame, order: Sequence[str], info: Column, label: str) -> None:
        """``nodes`` have ``tree`` and ``leaf``; ``info`` goes with each."""
        given = numbered(nodes, order, f"merkle-{label}")
        height = given.agg(F.max(_height(F.col("total")))).first()[0] or 0
        self.rounds = [blocks(given, info, 0, f"merkle-{label}-blocks")]
        for r in range(1, -(-height // LEVELS)):
            below = self.rounds[-1].read().select("tree", F.col("block").alias("at"), "total", F.unhex("node").alias("leaf"))
            self.rounds.append(blocks(below, F.lit(None).cast("int"), r, f"merkle-{label}-blocks"))

    def roots(self) -> DataFrame:
        """(tree, node), a row for each tree."""
        return self.rounds[-1].read().select("tree", "node")

    def members(self, above: DataFrame) -> DataFrame:
        """(tree, leaf, info, path, subroot, root) of every node; ``above`` has subroot, root and the path above (rest) of each tree."""
        held = self.rounds[-1].read().join(above, "tree")
        for lower in reversed(self.rounds[:-1]):
            own = F.transform("members", lambda m, i: F.struct(m["at"].alias("block"), F.concat(_path_of(i, F.col("levels")), F.col("rest")).alias("rest")))
            held = lower.read().join(held.select("tree", "subroot", "root", F.inline(own)), ["tree", "block"])
        own = F.transform("members", lambda m, i: F.struct(F.lower(F.hex(m["leaf"])).alias("leaf"), m["info"].alias("info"), F.concat(_path_of(i, F.col("levels")), F.col("rest")).alias("path")))
        return held.select("tree", "subroot", "root", F.inline(own))


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``docs``."""
    common.tune(docs.sparkSession)
    found = common.store(leaves(docs), "merkle-leaves")
    sources = Forest(found.read(), ["doc_id", "leaf", "place"], F.struct("doc_id", "other"), "sources")
    # All subroots are one tree, in order of their sources.
    subroots = sources.roots().select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.unhex("node").alias("leaf"))
    top = Forest(subroots, ["source"], F.col("source"), "subroots")
    whole = top.roots().select("tree", F.lit("").alias("subroot"), F.col("node").alias("root"), F.array().cast(_PATH).alias("rest"))
    tops = common.store(top.members(whole).select(F.col("info").alias("tree"), F.col("leaf").alias("subroot"), "root", F.col("path").alias("rest")), "merkle-tops")
    rows = sources.members(tops.read())
    shown = rows.select(
        F.col("info")["doc_id"].alias("doc_id"), "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce(F.lower(F.hex(F.col("info")["other"])), F.col("leaf")), F.col("path")).alias("folded_root"),
    )
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_sql(depth: int = 6) -> str:
    """The same in DuckDB's SQL, with ``depth`` levels in each tree (16 ** depth nodes)."""
    shown = {f: f"CAST({f} AS VARCHAR)" for f in FIELDS}

    def hashed(text: str) -> str:
        values = [*[shown[f] for f in FIELDS[:-1]], text]
        return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"

    crc = _crc_sql("CAST(doc_id AS VARCHAR)")
    out = [f"""WITH given AS (
  SELECT doc_id, coalesce('+' || source, '') AS tree, {hashed("text")} AS leaf, {hashed(f"translate(text, '{UPPER}', '{LOWER}')")} AS changed, {crc} AS crc FROM documents
), rows0 AS (
  SELECT *, CASE WHEN coalesce(crc % 5 = 0, false) THEN changed ELSE leaf END AS start, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM given
), a0 AS (SELECT tree, pos, leaf AS h FROM rows0)"""]

    def levels(name: str) -> None:
        for i in range(depth):
            out.append(f"""{name}g{i} AS (SELECT tree, pos // {FAN} AS pos, list(h ORDER BY pos) AS hs, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}{i}) GROUP BY tree, pos // {FAN})""")
            out.append(f"""{name}{i + 1} AS (SELECT tree, pos, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {name}g{i})""")

    def climb(name: str, source: str, target: str) -> None:
        """Rows with (tree, pos, now, proof) climb all levels of their tree."""
        for i in range(depth):
            before, after = f"array_to_string(g.hs[1 : CAST(r.pos % {FAN} AS INTEGER)], '')", f"array_to_string(g.hs[CAST(r.pos % {FAN} AS INTEGER) + 2 :], '')"
            last = target if i == depth - 1 else f"{target}{i}"
            out.append(f"""{last} AS (SELECT r.* REPLACE (r.pos // {FAN} AS pos, CASE WHEN g.n > 1 THEN sha256({before} || now || {after}) ELSE now END AS now, CASE WHEN g.n > 1 THEN proof || {before} || {after} ELSE proof END AS proof)
  FROM {source if i == 0 else f"{target}{i - 1}"} r JOIN {name}g{i} g ON g.tree = r.tree AND g.pos = r.pos // {FAN})""")

    levels("a")
    out.append(f"b0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, h, tree AS source FROM a{depth})")
    levels("b")
    out.append("climb0 AS (SELECT doc_id, leaf, tree, pos, start AS now, '' AS proof, tree AS source FROM rows0)")
    climb("a", "climb0", "climbed")
    out.append("climb1 AS (SELECT c.doc_id, c.leaf, b.h AS subroot, b.tree, b.pos, c.now, c.proof FROM climbed c JOIN b0 b ON b.source = c.source)")
    climb("b", "climb1", "top")
    return ",\n".join(out) + f"""
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = h AS verified FROM top CROSS JOIN (SELECT h FROM b{depth})"""


def _crc_sql(text: str) -> str:
    """The checksum of a short ASCII text, bit by bit."""
    step = "list_reduce([c, 1, 2, 3, 4, 5, 6, 7, 8], lambda k, i: CASE WHEN k % 2 = 1 THEN xor(k >> 1, 3988292384) ELSE k >> 1 END)"
    bytes_ = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {bytes_}), lambda a, b: {step.replace('[c,', '[xor(a, b),')}), 4294967295)"
