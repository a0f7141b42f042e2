"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, labels, whole_text
from .exact_dedup import exact_dedup
from .lm_scoring import lm_scores
from .media import media_features, to_media
from .mixing import mix, taken_words
from .near_dedup import near_dedup
from .packing import pack
from .quality import score_quality
from .secrets import scan_secrets, span_list
from .sharding import external_shuffle
from .toxicity import toxicity


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir))
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(span_list("base"), 256).alias("base_sha256"), span_list("spans").alias("spans"), "n_live", "n_example")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(mix(documents(spark, sf_dir)))


def op3_pack_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op4_media_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(to_media(documents(spark, sf_dir)))


def op5_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir), words=4).select("doc_id", "n_shingles", "component_id", "kept")


def op7_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op8_lm_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm_scores(documents(spark, sf_dir), order=3)
    return scores.withColumns({"log_score": F.round("log_score", 6), "mean_log_score": F.round("mean_log_score", 8)})


def op9_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = external_shuffle(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "size", F.crc32(whole_text().cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_secret_ownership, op2_mix_sources, op3_pack_buckets, op4_media_png, op5_toxicity_gru, op6_near_dedup, op7_quality_discriminant, op8_lm_backoff, op9_external_shuffle, op10_exact_dedup)
    return {f.__name__: f for f in own}


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_SQL = {
    "op6_near_dedup": rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 3) + 1)) AS i FROM w WHERE len(ws) > 0) x),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM met JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 80 * (p.n + q.n - i)),
u AS MATERIALIZED (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(a, b) AS (SELECT x, y FROM u UNION SELECT a, y FROM r JOIN u ON x = b)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, least(documents.doc_id, coalesce(m, documents.doc_id)) AS component_id, documents.doc_id <= coalesce(m, documents.doc_id) AS kept
FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON a = documents.doc_id""",
    "op8_lm_backoff": rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
t AS (SELECT rid, unnest(list_prepend(chr(1), ws)) AS c, generate_subscripts(list_prepend(chr(1), ws), 1) - 1 AS pos FROM d WHERE len(ws) > 0),
g AS (SELECT rid, pos, c, lag(c) OVER p AS b, lag(c, 2) OVER p AS a FROM t WINDOW p AS (PARTITION BY rid ORDER BY pos)),
k AS (SELECT rid, pos, count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY rid, c) AS r1, CASE WHEN pos > 0 THEN count(*) OVER (PARTITION BY b, c) - count(*) OVER (PARTITION BY rid, b, c) ELSE 0 END AS r2, CASE WHEN pos > 1 THEN count(*) OVER (PARTITION BY a, b, c) - count(*) OVER (PARTITION BY rid, a, b, c) ELSE 0 END AS r3 FROM g),
q AS (SELECT *, lag(r1) OVER p AS d2, lag(r2) OVER p AS d3, (SELECT sum(len(ws)) FROM d) AS corpus FROM k WINDOW p AS (PARTITION BY rid ORDER BY pos)),
s AS (SELECT q.rid, count(*) FILTER (r3 > 0 AND d3 > 0) AS n_full, sum(CASE WHEN r3 > 0 AND d3 > 0 THEN ln(r3 / d3) WHEN r2 > 0 AND d2 > 0 THEN ln(r2 / d2) + ln(0.4) ELSE ln(greatest(r1, 0.5) / greatest(1, corpus - len(ws))) + 2 * ln(0.4) END) AS total FROM q JOIN d ON d.rid = q.rid WHERE pos > 0 GROUP BY q.rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_full, 0) AS n_full, round(coalesce(total, 0.0), 6) AS log_score, round(total / len(ws), 8) AS mean_log_score FROM d LEFT JOIN s ON s.rid = d.rid""",
    "op10_exact_dedup": r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents) x WINDOW g AS (PARTITION BY text_sha256)""",
}


def oracle_sql() -> dict[str, str]:
    """The others have none: seeded draws and permutations (op2, op3, op9), trained networks (op5, op7), zlib's bytes (op4), and look-arounds in patterns (op1)."""
    return dict(_SQL)
