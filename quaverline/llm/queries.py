"""Queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import align, audit, bpe, classlm, decontam, exact, jaccard, langid, substring, topk, toxicity, warc, wavelet


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(_table(spark, sf_dir, "documents"), min_words=13)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"), min_revisit_bytes=1000)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classlm.class_scores(_table(spark, sf_dir, "documents"), held_out_remainder=1, modulus=5)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), held_out_remainder=0, modulus=5)


def op7_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"), width=5, percent=75)


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), k=10, query_modulus=100, scale=1024.0)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_table(spark, sf_dir, "documents"), held_out_remainder=2, modulus=4)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.token_alignment(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_warc": op3_warc,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_class_lm": op5_class_lm,
    "op6_toxicity": op6_toxicity,
    "op7_wavelet_tokens": op7_wavelet_tokens,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_topk": op9_topk,
    "op10_language_id": op10_language_id,
    "op11_filter_audit": op11_filter_audit,
    "op12_token_alignment": op12_token_alignment,
    "op13_exact_dedup": op13_exact_dedup,
}

ORACLE: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
             g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM d, unnest(range(1, len(w) - 11)) t(i)),
             f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
             c AS (SELECT DISTINCT g.doc_id, p FROM g JOIN f USING (s), unnest(range(g.i, g.i + 13)) u(p) WHERE f.first < g.doc_id),
             k AS (
                 SELECT d.doc_id, count(*) AS kept, string_agg(w[p], ' ' ORDER BY p) AS body
                 FROM d, unnest(range(1, len(w) + 1)) t(p) WHERE NOT EXISTS (FROM c WHERE c.doc_id = d.doc_id AND c.p = t.p) GROUP BY d.doc_id
             )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
             o AS (SELECT payload_digest, payload_bytes, max(page_id) AS original FROM d WHERE payload_bytes >= 1000 GROUP BY ALL)
        SELECT d.page_id, d.payload_bytes, d.payload_digest,
               CASE WHEN d.page_id < o.original THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN d.page_id < o.original THEN o.original END AS refers_to
        FROM d LEFT JOIN o USING (payload_digest, payload_bytes)""",
    "op8_jaccard_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
            FROM d, unnest(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - 3, 2) END)) t(i)
        ),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
        r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT r.a AS doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a""",
    "op9_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
        ),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 10""",
    "op11_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
             g AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
             l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
             f AS (
                 SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                        [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
                         regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > least, false)] AS fails
                 FROM d JOIN g USING (t) LEFT JOIN l ON l.doc_id = d.doc_id
             ),
             x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
             o AS (
                 SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM x a, x b, x c, x d, x e
                 WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
             ),
             s AS (
                 SELECT part, good, toxic, p, k, fails[p[k]] AS bad, len(list_filter(p[1:k - 1], lambda i: fails[i])) > 0 AS gone,
                        len(list_filter(fails, lambda b: b)) AS n
                 FROM f, o, (SELECT unnest([1, 2, 3, 4, 5]) AS k)
             ),
             r AS (
                 SELECT part, p, k, count(*) FILTER (NOT bad AND NOT gone) AS kept, count(*) FILTER (bad AND NOT gone) AS removed,
                        count(*) FILTER (bad AND gone) AS redundant, count(*) FILTER (bad AND n = 1) AS unique_fails,
                        count(*) FILTER (bad AND NOT gone AND good) AS good_lost, count(*) FILTER (bad AND NOT gone AND toxic) AS toxic_lost
                 FROM s GROUP BY part, p, k
             )
        SELECT part, array_to_string(list_transform(p, lambda i: chr(64 + CAST(i AS INTEGER))), '') AS filter_order, CAST(k AS INTEGER) AS step,
               kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, p[k]) AS BIGINT) AS shapley
        FROM r""",
    "op13_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS s FROM documents),
             k AS (SELECT s, count(*) AS group_size, max(n) AS most FROM d GROUP BY s),
             f AS (SELECT s, min(doc_id) AS keep_id FROM d JOIN k USING (s) WHERE n = most GROUP BY s)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, s AS text_sha256 FROM d JOIN k USING (s) JOIN f USING (s)""",
}
