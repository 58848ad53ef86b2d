"""The queries of this subpackage and their SQL: one for each operator over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import (
    bpe,
    byte_cnn,
    cross_polytope,
    decision_list,
    licenses,
    line_dedup,
    minhash_dedup,
    mixing,
    periodic_runs,
    prefix_trie,
    pseudo_likelihood,
    recompression,
    secrets,
)

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at a similarity of 0.8 of their 2-word shingles."""
    return minhash_dedup.dedup(_documents(spark, sf_dir), size=2)


def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every embedding whose vec_id is divisible by 20, found by cross-polytope tables."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return cross_polytope.search(vectors, vectors.filter(F.col("vec_id") % cross_polytope.EVERY == 0))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document for sources weighing 5, 2, 1, at one and a half times the corpus."""
    return mixing.mix(_documents(spark, sf_dir))


def op4_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document, the fixed base rules, and the verdict of the list learned from labels."""
    docs = _documents(spark, sf_dir)
    rules = decision_list.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return decision_list.judge(docs, rules)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: the fixed forms and incompressible strings in a sensitive context."""
    return secrets.scan(_documents(spark, sf_dir))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the bytes decoded from them."""
    return bpe.digests(_documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))


def op7_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document by a network learned from the labels outside the held-out fold."""
    docs = _documents(spark, sf_dir)
    model = byte_cnn.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = byte_cnn.scored(docs, model)
    return out.select(
        "doc_id",
        byte_cnn.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= byte_cnn.THRESHOLD).cast("int").alias("predicted"),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document, by the licence sentences that it holds."""
    return licenses.scan(_documents(spark, sf_dir))


def op9_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from every document because a window of 20 words that covers them also starts earlier."""
    return recompression.dedup(_documents(spark, sf_dir))


def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihoods of every document by a masked model of all documents."""
    docs = _documents(spark, sf_dir)
    return pseudo_likelihood.scored(docs, *pseudo_likelihood.fit(docs))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, one in ten of which is made to repeat its words first."""
    docs = _documents(spark, sf_dir)
    return periodic_runs.report(docs.select("doc_id", periodic_runs.repeating(F.col("doc_id"), F.col("text")).alias("text")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each starting with turns of the first of its five."""
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that at least ten documents hold, dropped."""
    return line_dedup.dedup(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_cross_polytope": op2_cross_polytope,
    "op3_mix_sources": op3_mix_sources,
    "op4_decision_list": op4_decision_list,
    "op5_secret_scan": op5_secret_scan,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_byte_cnn": op7_byte_cnn,
    "op8_license_scan": op8_license_scan,
    "op9_recompression_dedup": op9_recompression_dedup,
    "op10_pseudo_likelihood": op10_pseudo_likelihood,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_line_dedup": op13_line_dedup,
}

ORACLE: dict[str, str] = {
    "op1_minhash_dedup": r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS ws FROM documents
), placed AS (
    SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 1, 1))) AS i FROM worded WHERE len(ws) > 0
), shingles AS (
    SELECT DISTINCT doc_id, CASE WHEN len(ws) > 1 THEN ws[i] || ' ' || ws[i + 1] ELSE ws[1] END AS s FROM placed
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
    GROUP BY ALL
), links AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * common.n >= 80 * (x.n + y.n - common.n)
), reach AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other
), least AS (
    SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
""",
    "op9_recompression_dedup": r"""
WITH words AS (
    SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
    FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)
), windows AS (
    SELECT *, CASE WHEN count(*) OVER w = 20 THEN array_to_string(list(word) OVER w, ' ') END AS held
    FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), judged AS (
    SELECT *, held IS NOT NULL AND row_number() OVER (PARTITION BY held ORDER BY doc_id, i) > 1 AS again FROM windows
), covered AS (
    SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
    FROM judged
), totals AS (
    SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
    FROM covered GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
    sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN totals USING (doc_id)
""",
    "op8_license_scan": licenses.scan_sql(),
    "op11_periodic_runs": periodic_runs.report_sql(),
    "op12_prefix_trie": prefix_trie.prefix_trie_sql(),
    "op13_line_dedup": line_dedup.dedup_sql(),
    "op3_mix_sources": r"""
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), summed AS (
    SELECT source, sum(size)::BIGINT AS s, count(*) AS n FROM sized GROUP BY source
), weighed AS (
    SELECT source, s, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
    FROM summed
), filled AS (
    SELECT *, (1.5::DOUBLE * (SELECT sum(s) FROM summed)
            - coalesce(sum(2 * s) OVER (ORDER BY s::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY s::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
        row_number() OVER (ORDER BY s::DOUBLE / w, source NULLS LAST) AS place
    FROM weighed
), chosen AS (
    SELECT coalesce(arg_min(level, place), 0::DOUBLE) AS level FROM filled WHERE w * level < 2 * s
), planned AS (
    SELECT source, s, least(2::DOUBLE * s, w * (SELECT level FROM chosen)) AS target,
        CASE WHEN s > 0 THEN least(2::DOUBLE * s, w * (SELECT level FROM chosen)) / s ELSE 0 END AS rate
    FROM weighed
), dealt AS (
    SELECT doc_id, size, s AS source_size, target, (floor(rate) + CASE
            WHEN ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
                < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies
    FROM sized JOIN planned ON sized.source IS NOT DISTINCT FROM planned.source
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM dealt
""",
}
