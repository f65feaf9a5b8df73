"""Registered queries of this subpackage: each operator over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import alignment, decontamination, htmltext, neardup, negatives, packing, quality, secrets, sharding, substrings, topk, toxicity
from tagloom.llm.common import clean, durable, table  # clean: for whoever has stored a query's result

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_LEVEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op1_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_matrices(table(spark, sf_dir, "documents"), TOKENIZER)


def op2_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sum_of_squares(table(spark, sf_dir, "documents"), TOKENIZER)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_bounded_ring(table(spark, sf_dir, "documents"), 16)


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_main_text(table(spark, sf_dir, "pages"))


def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arrivals: an eighth of the versions, by hash of their content, is scanned first and written to a ledger.

    The scan of all rows then finds their blobs there and runs no rule on them again.
    """
    docs = table(spark, sf_dir, "documents")
    versions = secrets.addressed(docs)
    ledger = durable(secrets.scan_versions(versions.where(F.pmod(F.xxhash64("blob"), F.lit(8)) == 0)), "ledger")
    found = secrets.findings(docs, ledger)
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>"))
    joined = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(joined.cast("binary"), 256).alias("base_sha256"), joined.alias("spans"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256).select("query_id", "rank", "vec_id", "score")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"), BYTE_LEVEL, PIECES)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = negatives.mine_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label, positives=5, negatives=3, window=("0.5", "0.95"), scale=256)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.drop_repeated_passages(table(spark, sf_dir, "documents"), window=35)


QUERIES = {f.__name__: f for f in (op1_token_matrices, op2_sum_of_squares_packing, op3_toxicity, op4_bounded_ring, op5_main_text, op6_benchmark_leaks, op7_quality, op8_secret_scan, op9_near_duplicates, op10_topk, op11_tokenizer_alignment, op12_hard_negatives, op13_repeated_passages)}

_BASE = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{16,}",
}
ORACLE = {
    "op10_topk": """
        WITH v AS (SELECT vec_id, row_number() OVER () AS own, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, q.own, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
              FROM v q JOIN v c ON c.own <> q.own WHERE q.vec_id % 50 = 0)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op12_hard_negatives": """
        WITH v AS (SELECT vec_id, row_number() OVER () AS own, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, a.own AS anchor, c.vec_id, c.own, a.label = c.label AS alike, list_dot_product(a.e, c.e)::BIGINT AS score
              FROM v a JOIN v c ON c.own <> a.own WHERE a.vec_id % 50 = 0),
        p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place FROM s WHERE alike) WHERE place <= 5),
        n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
                     row_number() OVER (PARTITION BY p.anchor, p.own ORDER BY s.score DESC, s.vec_id) AS rank
              FROM p JOIN s ON p.anchor = s.anchor AND NOT s.alike AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
        SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    # a window is its first place, so a word goes if any of the 35 places up to it begins a repeated window
    "op13_repeated_passages": r"""
        WITH d AS (SELECT row_number() OVER () AS own, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
        p AS (SELECT own, unnest(range(1, len(words) + 1)) AS place, unnest(words) AS word, len(words) AS n FROM d),
        w AS (SELECT own, place, word, n, CASE WHEN place + 34 <= n THEN string_agg(word, ' ') OVER (PARTITION BY own ORDER BY place ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) END AS passage FROM p),
        r AS (SELECT own, place, word, passage IS NOT NULL AND count(*) OVER (PARTITION BY passage) > 1 AS repeated FROM w),
        k AS (SELECT own, place, word, NOT bool_or(repeated) OVER (PARTITION BY own ORDER BY place ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS kept FROM r),
        g AS (SELECT own, count(*) FILTER (NOT kept) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY place) FILTER (kept), '') AS rest FROM k GROUP BY own)
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM d LEFT JOIN g USING (own)""",
    # splitting at the pattern gives the pieces between matches, hence the places of matches
    "op8_secret_scan": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        k AS (SELECT doc_id, text, unnest([{{'kind': 'assign', 'rank': 0}}, {{'kind': 'access', 'rank': 1}}, {{'kind': 'hex', 'rank': 2}}]) AS k FROM d),
        m AS (SELECT doc_id, k.kind AS kind, k.rank AS rank,
                CASE k.rank WHEN 0 THEN string_split_regex(text, '{_BASE["assign"]}') WHEN 1 THEN string_split_regex(text, '{_BASE["access"]}') ELSE string_split_regex(text, '{_BASE["hex"]}') END AS gaps,
                CASE k.rank WHEN 0 THEN regexp_extract_all(text, '{_BASE["assign"]}', 0) WHEN 1 THEN regexp_extract_all(text, '{_BASE["access"]}', 0) ELSE regexp_extract_all(text, '{_BASE["hex"]}', 0) END AS hits,
                CASE k.rank WHEN 0 THEN regexp_extract_all(text, '{_BASE["assign"]}', 2) WHEN 1 THEN regexp_extract_all(text, '{_BASE["access"]}', 0) ELSE regexp_extract_all(text, '{_BASE["hex"]}', 0) END AS parts
              FROM k),
        n AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
        s AS (SELECT doc_id, kind, rank, list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)::BIGINT AS a, length(hits[i]) AS l
              FROM n WHERE length(parts[i]) >= CASE rank WHEN 0 THEN 12 WHEN 1 THEN 18 ELSE 16 END),
        g AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
                string_agg(kind || ':' || a || ':' || (a + l), ',' ORDER BY a, rank) AS spans FROM s GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
               sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)""",
}
