"""Language identification by Bayesian fusion of evidence.

The likelihood of a text under each language comes from hashed byte trigrams, fitted on a bounded sample
of the distinct texts under each label; one more class with equal chances for all trigrams stands for no known language.
Grouped sums of the texts' posteriors over all documents give the distribution of languages of each
host, smoothed towards its address suffix's and that towards the whole corpus', and of each declared
language. A document's posterior multiplies text likelihood, host prior and declared evidence.

Edge cases: null or empty texts, and texts without letters, have no language ('und') and are rejected;
texts of any length count in full; copies of a text count once in the sample; a null host, suffix or declared language is no evidence; a language
without samples is not known; repeated rows are judged alike; ties go to the language first in the
alphabet; an empty table gives an empty result; other columns are carried through, and columns of the
input whose names clash with results are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from scriptloom.llm import common, html_extract

#: Distinct texts with letters in the sample of each label at most, trigram classes, and trigrams that a text counts as at most.
SAMPLE_DOCS, BINS, WEIGHT = 1200, 1 << 16, 60.0
#: Pseudo-documents by which a host leans on its suffix, and a suffix or declaration on the corpus.
HOST_SMOOTHING, SMOOTHING = 5.0, 20.0
#: Posterior from which a document is accepted.
ACCEPT = 0.5
BROADCAST_KEYS = 100_000
RESULTS = ("language", "posterior", "kept")
UNKNOWN = "und"


def _trigrams(data: np.ndarray) -> np.ndarray:
    low = common.lowered(data).astype(np.uint32)
    whole = low[:-2] | low[1:-1] << np.uint32(8) | low[2:] << np.uint32(16)
    return (whole * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.int64)


def _written(data: np.ndarray) -> np.ndarray:
    """Whether each trigram is of letters and white space only: numbers, addresses and codes tell no language."""
    good = _prose[data]
    return good[:-2] & good[1:-1] & good[2:]


_prose = np.zeros(256, bool)
_prose[[*range(65, 91), *range(97, 123), *range(128, 256), *common.SPACE_BYTES]] = True


def table_of(counts: np.ndarray) -> np.ndarray:
    """Log chances of the trigram classes under each language, and last under no known one."""
    counts, smooth = np.vstack([counts, np.zeros(BINS)]), 0.05
    table = np.log((counts + smooth) / (counts.sum(axis=1, keepdims=True) + smooth * BINS))
    table[-1] = -math.log(BINS)
    return table


def fit(sampled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and the log chances of the trigram classes under each and under no known language.

    Tasks count the trigrams of (label, text); what reaches the driver is BINS numbers for each language.
    """

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batch_iter:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held, data = counts.setdefault(label, np.zeros(BINS, np.int64)), np.frombuffer(text.encode(), np.uint8)
                if len(data) > 2:
                    held += np.bincount(_trigrams(data)[_written(data)], minlength=BINS)
        for label, held in counts.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([label] * (len(at) + 1), pa.string()), pa.array([*at.tolist(), 0], pa.int32()), pa.array([*held[at].tolist(), 0], pa.int64())], names=["label", "bin", "n"])

    found = sampled.transform(common.in_arrow, run, "label string, bin int, n long").groupBy("label", "bin").agg(F.sum("n").alias("n")).toArrow().combine_chunks()
    labels = found.column("label").to_pylist()
    languages = sorted(set(labels))
    counts, of = np.zeros((len(languages), BINS)), {x: i for i, x in enumerate(languages)}
    counts[[of[x] for x in labels], found.column("bin").to_numpy()] = found.column("n").to_numpy()
    return [*languages, UNKNOWN], table_of(counts)


#: A letter as has_letters() has it.
LETTER = r"[A-Za-z\x{C0}-\x{10FFFF}]"


def sample(train: DataFrame, label_col: str, text_col: str) -> DataFrame:
    """(label, text) of the ``SAMPLE_DOCS`` distinct texts with letters of least hash under each label.

    Tasks send their least hashes only, and then each chosen text once.
    """
    most = SAMPLE_DOCS
    keyed = train.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text")).filter((F.col("label") != "") & F.col("text").rlike(LETTER)).withColumn("hash", F.xxhash64("text"))

    def least(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batch_iter:
            codes = batch.column(0).dictionary_encode()
            which, hashes = codes.indices.to_numpy(), batch.column(1).to_numpy()
            for i, label in enumerate(codes.dictionary.to_pylist()):
                held[label] = np.unique(np.concatenate([held.get(label, hashes[:0]), hashes[which == i]]))[:most]
        for label, hashes in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(hashes), pa.string()), pa.array(hashes, pa.int64())], names=["label", "hash"])

    def once(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for batch in batch_iter:
            new = []
            for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new.append(key not in seen)
                seen.add(key)
            yield batch.filter(pa.array(new, pa.bool_()))

    # A label's least hashes are first taken in each of many buckets, so that no task ranks what all tasks have sent of it.
    bucket = F.pmod(F.xxhash64("hash"), F.lit(common.shuffle_partitions(train.sparkSession)))
    chosen = keyed.select("label", "hash").transform(common.in_arrow, least, "label string, hash long").distinct().withColumn("bucket", bucket)
    for by in (["label", "bucket"], ["label"]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("hash"))
        chosen = chosen.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")
    chosen = chosen.drop("bucket")
    chosen = common.store(chosen, "language-sample").read()
    hits = keyed.join(_small(chosen), ["label", "hash"]).select("label", "hash", "text")
    return hits.transform(common.in_arrow, once, "label string, hash long, text string").groupBy("label", "hash").agg(F.min("text").alias("text")).select("label", "text")


def likelihoods(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Log likelihood of each row's text under each class, weighted down for long texts."""
    out = np.zeros((len(offsets) - 1, len(table)))
    if len(data) < 3:
        return out
    bins, written = _trigrams(data), _written(data)
    first, ends = np.minimum(offsets[:-1], len(bins)), np.minimum(np.maximum(offsets[1:] - 2, offsets[:-1]), len(bins))
    counted = np.concatenate([[0], np.cumsum(written)])
    sizes = counted[ends] - counted[first]
    for k, row in enumerate(table):
        total = np.concatenate([[0.0], np.cumsum(row[bins] * written)])
        out[:, k] = total[ends] - total[first]
    return out * (np.minimum(sizes, WEIGHT) / np.maximum(sizes, 1))[:, None]


def has_letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    low = data | 0x20
    letters = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122) | (data >= 0xC3))])
    return letters[offsets[1:]] > letters[offsets[:-1]]


def _scored(docs: DataFrame, text_col: str, table: np.ndarray) -> DataFrame:
    """``docs`` with the log likelihoods of the text; none for texts without letters."""
    at = docs.columns.index(text_col)

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.enter("language_id")
        for batch in batch_iter:
            for a, b, data, offsets in common.text_passes(batch.column(at)):
                found = likelihoods(data, offsets, table)
                written = has_letters(data, offsets)
                rows = pa.array([r if w else None for r, w in zip(found, written, strict=True)], pa.list_(pa.float64()))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, rows], names=[*part.schema.names, "_lid_text"])

    return docs.transform(common.in_arrow, run, StructType([*docs.schema.fields, StructField("_lid_text", ArrayType(DoubleType()))]))


def _softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    shares = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(shares, lambda x: x / F.aggregate(shares, F.lit(0.0), lambda s, y: s + y))


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_KEYS else table


def identify(docs: DataFrame, text_col: str = "text", label_col: str | None = "lang", declared: Column | None = None, host: Column | None = None, suffix: Column | None = None, labelled: DataFrame | None = None, accept: float = ACCEPT) -> DataFrame:
    """``docs`` with language, posterior and kept. ``labelled`` (``docs`` if none) has ``label_col`` and ``text_col``."""
    spark = docs.sparkSession
    common.tune(spark)
    none = F.lit(None).cast("string")
    train = (labelled if labelled is not None else docs).filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    names, table = fit(sample(train, label_col, text_col))
    n = len(names)
    source = docs.select(
        *[c for c in docs.columns if c not in RESULTS],
        (host if host is not None else none).cast("string").alias("_lid_host"),
        (suffix if suffix is not None else none).cast("string").alias("_lid_suffix"),
        (declared if declared is not None else none).cast("string").alias("_lid_declared"),
    )
    keys = ["_lid_host", "_lid_suffix", "_lid_declared"]
    texts = _scored(source.select(text_col, *keys), text_col, table).filter("_lid_text is not null")
    sums = [F.sum(F.get(_softmax(F.col("_lid_text")), i)).alias(f"s{i}") for i in range(n)]
    counted = common.store(texts.groupBy(*keys).agg(*sums), "language-counts").read()

    def totals(*by: str) -> DataFrame:
        grouped = counted.groupBy(*by) if by else counted
        return grouped.agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(n)])

    first = totals().first()
    world = np.array([(first[i] or 0.0) + 1.0 for i in range(n)])
    world /= world.sum()
    everywhere = F.array(*[F.lit(float(x)) for x in world])

    # A row's own text is no evidence of what its host's, suffix's or declaration's texts are: it is left out of their sums.
    own = F.coalesce(_softmax(F.col("_lid_text")), F.array_repeat(F.lit(0.0), n))

    def smoothed(sums_: Column, parent: Column, weight: float) -> Column:
        others = F.zip_with(sums_, F.col("_lid_own"), lambda s, x: F.greatest(s - x, F.lit(0.0)))
        total = F.aggregate(others, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(others, parent, lambda s, p: (s + F.lit(weight) * p) / (total + F.lit(weight)))

    each = F.array(*[f"s{i}" for i in range(n)])
    by_suffix = totals("_lid_suffix").filter("_lid_suffix is not null").select("_lid_suffix", each.alias("_lid_in_suffix"))
    by_host = totals("_lid_host", "_lid_suffix").filter("_lid_host is not null").select("_lid_host", F.coalesce("_lid_suffix", F.lit("")).alias("_lid_of"), each.alias("_lid_in_host"))
    by_declared = totals("_lid_declared").filter("_lid_declared is not null").select("_lid_declared", each.alias("_lid_in_declared"))
    scored = _scored(source, text_col, table).withColumn("_lid_of", F.coalesce("_lid_suffix", F.lit(""))).withColumn("_lid_own", own)
    hosts = common.store(by_host, "language-hosts").read()
    joined = scored.join(_small(hosts), ["_lid_host", "_lid_of"], "left").join(_small(by_suffix), "_lid_suffix", "left").join(_small(by_declared), "_lid_declared", "left")
    joined = joined.withColumn("_lid_by_suffix", F.coalesce(smoothed(F.col("_lid_in_suffix"), everywhere, SMOOTHING), everywhere))
    joined = joined.withColumn("_lid_prior", F.coalesce(smoothed(F.col("_lid_in_host"), F.col("_lid_by_suffix"), HOST_SMOOTHING), F.col("_lid_by_suffix")))
    joined = joined.withColumn("_lid_said", F.coalesce(smoothed(F.col("_lid_in_declared"), everywhere, SMOOTHING), everywhere))
    evidence = F.arrays_zip(F.col("_lid_text").alias("t"), F.col("_lid_prior").alias("p"), F.col("_lid_said").alias("d"), everywhere.alias("w"))
    logits = F.transform(evidence, lambda x: x["t"] + F.log(x["p"]) + F.log(x["d"]) - F.log(x["w"]))
    judged = joined.withColumn("_lid_post", F.when(F.col("_lid_text").isNotNull(), _softmax(logits)))
    best = F.array_max("_lid_post")
    named = F.array(*[F.lit(x) for x in names])
    language = F.coalesce(F.get(named, F.array_position("_lid_post", best).cast("int") - 1), F.lit(UNKNOWN))
    out = judged.withColumn("language", language).withColumn("posterior", F.coalesce(best, F.lit(0.0)))
    out = out.withColumn("kept", (F.col("language") != UNKNOWN) & (F.col("posterior") >= accept))
    return out.select(*[c for c in docs.columns if c not in RESULTS], *RESULTS)


def page_evidence() -> dict[str, Column]:
    """Declared language, address suffix and host of rows with ``html`` and ``url``."""
    declared = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-zA-Z]+)", 1))
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://([^/?#:]+)", 1))
    return {"declared": F.nullif(declared, F.lit("")), "host": F.nullif(host, F.lit("")), "suffix": F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit(""))}


def document_evidence() -> dict[str, Column]:
    """Evidence of rows with ``source``, which stands in a host's place; their ``lang`` is the label only, and no evidence."""
    return {"host": F.col("source")}


def of_pages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """(page_id, url, language, posterior, kept) for each row of ``pages`` (page_id, url, html), by the main text as tag rules find it."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            texts = [html_extract.main_text(page or "", frozenset()) for page in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])

    common.tune(pages.sparkSession)
    source = common.spread(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", *[v.alias(k) for k, v in page_evidence().items()], "html"))
    texts = common.store(source.transform(common.in_arrow, run, "page_id long, url string, declared string, host string, suffix string, text string"), "language-pages").read()
    found = identify(texts, declared=F.col("declared"), host=F.col("host"), suffix=F.col("suffix"), labelled=labelled)
    return found.select("page_id", "url", "language", "posterior", "kept")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, source, ...) in a known language, columns as they are."""
    own = {c: f"_lid_own_{c}" for c in docs.columns if c in RESULTS}
    found = identify(docs.withColumnsRenamed(own), **document_evidence()).filter("kept")
    return found.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])
