"""The queries of the corpus operators: each applies one, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptloom.llm import ann, annulus, byte_bpe, html_extract, language_id, line_dedup, merkle, near_dedup, packing, prefix_bpe, substring_dedup, token_counts, top_k


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return top_k.top_k(vectors.filter("vec_id % 20 = 0"), vectors)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(_table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(_table(spark, sf_dir, "documents"))


def op5_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(vectors.filter("vec_id % 20 = 0"), vectors)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(_table(spark, sf_dir, "documents"), **language_id.document_evidence())
    return found.select("doc_id", "language", "posterior", "kept")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op10_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op11_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annulus.cluster(_table(spark, sf_dir, "embeddings"))


def op12_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe.digests(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def page_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6 over all pages, by the text model of the documents and the pages' markup, hosts and suffixes."""
    return language_id.of_pages(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_top_k, op2_line_dedup, op3_byte_bpe, op4_substring_dedup, op5_learned_partitions, op6_language_id, op7_near_dedup, op8_best_fit_packing, op9_token_counts, op10_template_extraction,
        op11_annulus_clusters, op12_prefix_bpe, op13_merkle_manifest,
    )
}
#: Further queries of the same operators.
MORE_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"page_language_id": page_language_id}

#: DuckDB SQL of those queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op7_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w WHERE len(w) > 0)
), c AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), e AS (
  SELECT u, v FROM p JOIN c cu ON cu.doc_id = u JOIN c cv ON cv.doc_id = v WHERE 100 * i >= 75 * (cu.n + cv.n - i)
), d AS (
  SELECT u, v FROM e UNION ALL SELECT v, u FROM e
), r AS (
  SELECT doc_id AS id, doc_id AS root FROM documents
  UNION
  SELECT d.v AS id, r.root FROM r JOIN d ON d.u = r.id
)
SELECT documents.doc_id, coalesce(any_value(c.n), 0) AS n_shingles, min(r.root) AS component_id, documents.doc_id = min(r.root) AS kept
FROM documents LEFT JOIN c ON c.doc_id = documents.doc_id JOIN r ON r.id = documents.doc_id GROUP BY documents.doc_id""",
    # All pairs of lines that share a shingle; equal rows wherever no pair is lost to chance (0.0002 at exactly 0.8).
    "op2_line_dedup": r"""
WITH RECURSIVE l AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents
), n AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS line FROM l
), ink AS (
  SELECT doc_id, i, line FROM n WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), first AS (
  SELECT line, min((doc_id, i)) AS place FROM ink GROUP BY line
), k AS (
  SELECT row_number() OVER (ORDER BY place) AS id, line, place, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM first
), s AS (
  SELECT DISTINCT id, unnest(CASE WHEN length(low) < 8 THEN [low || chr(10)] ELSE list_transform(range(1, length(low) - 6), lambda j: substring(low, j, 8)) END) AS s FROM k
), c AS (
  SELECT id, count(*) AS n FROM s GROUP BY id
), p AS (
  SELECT a.id AS u, b.id AS v, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY a.id, b.id
), e AS (
  SELECT u, v FROM p JOIN c cu ON cu.id = u JOIN c cv ON cv.id = v WHERE 100 * m >= 80 * (cu.n + cv.n - m)
), d AS (
  SELECT u, v FROM e UNION ALL SELECT v, u FROM e
), r AS (
  SELECT id, id AS root FROM k UNION SELECT d.v AS id, r.root FROM r JOIN d ON d.u = r.id
), kept AS (
  SELECT k.place FROM k JOIN (SELECT id, min(root) AS root FROM r GROUP BY id) m ON m.id = k.id WHERE m.root = k.id
), g AS (
  SELECT n.doc_id, n.i, n.line, ink.line IS NOT NULL AS ink, ink.line IS NULL OR kept.place IS NOT NULL AS stays
  FROM n LEFT JOIN ink ON ink.doc_id = n.doc_id AND ink.i = n.i LEFT JOIN kept ON kept.place = (n.doc_id, n.i)
)
SELECT doc_id, count(*) FILTER (WHERE ink) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stays), '')) AS kept_sha256 FROM g GROUP BY doc_id""",
    "op4_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), n AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM w WHERE len(w) >= 20
), k AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS k FROM n
), d AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM k
), g AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM d WHERE again
), g2 AS (
  SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(CASE WHEN gone IS NULL THEN array_to_string(w.w, ' ')
    ELSE array_to_string(list_transform(list_filter(range(1, len(w.w) + 1), lambda x: NOT list_contains(gone, x)), lambda x: w.w[x]), ' ') END, '')) AS kept_sha256
FROM w LEFT JOIN g2 ON w.doc_id = g2.doc_id""",
    "op1_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_annulus_clusters": annulus.oracle_sql(),
    "op13_merkle_manifest": merkle.oracle_sql(),
}
