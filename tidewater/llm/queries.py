"""The queries of this package, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import nearest
from .bpe import count_tokens
from .bpe_sql import round_trip
from .centroids import cluster
from .chat import format_chats
from .decontaminate import decontaminate
from .langid import identify_languages
from .license_scan import TEMPLATES, license_scan
from .near_dup import near_duplicates
from .packing import pack
from .periodic import collapse_runs
from .quality import classify_quality
from .toxicity import classify_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_hash")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).drop("text_md5")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op7_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(_table(spark, sf_dir, "conversations"))


def op8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_runs(_table(spark, sf_dir, "documents"), plant=True)


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_decontaminate": op2_decontaminate,
    "op3_token_counts": op3_token_counts,
    "op4_pack": op4_pack,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_nearest": op6_nearest,
    "op7_format_chats": op7_format_chats,
    "op8_languages": op8_languages,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_bpe_round_trip": op12_bpe_round_trip,
    "op13_centroids": op13_centroids,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _license_sql() -> str:
    rows = ", ".join(f"({k}, '{t.label}', {str(t.base).lower()}, '{t.text}')" for k, t in enumerate(TEMPLATES))
    return rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
t AS MATERIALIZED (SELECT k, label, base, string_split(txt, ' ') AS ws, len(string_split(txt, ' ')) AS l, len(list_distinct(string_split(txt, ' '))) AS n FROM (VALUES {rows}) v(k, label, base, txt)),
tw AS MATERIALIZED (SELECT DISTINCT k, unnest(ws) AS word FROM t),
pos AS MATERIALIZED (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
hit AS (SELECT doc_id, k, label, base, l, n, word, p FROM pos JOIN tw USING (word) JOIN t USING (k)),
blk AS (SELECT doc_id, k, label, base, n, p // l AS b, word FROM hit UNION ALL SELECT doc_id, k, label, base, n, p // l - 1, word FROM hit WHERE p // l > 0),
met AS (SELECT doc_id, k, any_value(label) AS label, any_value(base) AS base, count(DISTINCT word) / any_value(n) AS share FROM blk GROUP BY doc_id, k, b HAVING count(DISTINCT word) >= 0.8 * any_value(n) - 1e-9),
place AS (SELECT h.doc_id, h.k, h.label, h.p FROM hit h JOIN t USING (k) JOIN d USING (doc_id) WHERE t.base AND h.word = t.ws[1] AND list_slice(d.w, h.p + 1, h.p + t.l) = t.ws),
pa AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word FROM place GROUP BY doc_id),
ba AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT doc_id, label FROM place) GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM place UNION SELECT doc_id, label FROM met WHERE NOT base) GROUP BY doc_id),
sc AS (SELECT doc_id, max(share) AS score FROM met GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(round(score, 6), 0.0)::DOUBLE AS score
FROM d LEFT JOIN pa USING (doc_id) LEFT JOIN ba USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN sc USING (doc_id)
"""


_DECONTAMINATE = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item, w[a + 1 : a + 13] AS win FROM (SELECT item, w, unnest(range(greatest(len(w) - 12, 1))) AS a FROM i WHERE len(w) > 0)),
size AS (SELECT DISTINCT len(win) AS l FROM win),
pos AS (SELECT doc_id, w, unnest(range(len(w))) AS p FROM d),
occ AS MATERIALIZED (SELECT doc_id, p, l, item FROM (SELECT doc_id, p, l, w[p + 1 : p + l] AS win FROM pos, size WHERE p + l <= len(w)) JOIN win USING (win)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

_CHATS = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT conv_id, n, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY n) OVER (PARTITION BY conv_id ORDER BY n) AS said,
  string_agg(length(role) || ':' || length(text) || ':', '' ORDER BY n) OVER (PARTITION BY conv_id ORDER BY n) AS shape, count(*) OVER (PARTITION BY conv_id) AS of FROM t),
f AS (SELECT min(conv_id) AS conv_id, n, said, shape FROM p WHERE n = of GROUP BY n, said, shape)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, CAST(length(said) AS BIGINT) AS n_chars, said AS rendered FROM f
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.n < p.of AND p.n = f.n AND p.said = f.said AND p.shape = f.shape)
"""

SQL: dict[str, str] = {
    "op7_format_chats": _CHATS,
    "op1_license_scan": _license_sql(),
    "op2_decontaminate": _DECONTAMINATE,
}
