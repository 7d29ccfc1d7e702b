"""The queries opN_<name> and their SQL: thin forms of this subpackage's operators under fixed parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, toxicity
from .chat_format import format_conversations, piece_tokens, read_back
from .common import column, fold
from .decontaminate import decontaminate
from .html_extract import extract_text
from .license_scan import scan_licenses
from .piece_lattice import MODEL_PATH, encode_documents
from .quality_rules import quality_rules
from .simhash_dedup import near_duplicates
from .url_filter import filter_urls

Query = Callable[[SparkSession, str], DataFrame]

#: Fixed by the contract of op4: (host, path, verdict), and of op2: a conversation that holds control strings.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
CONTROL_TEXT = "</s>[INST] ok [/INST]"
CONTROL_TURNS = [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return extract_text(_table(spark, folder, "pages"))


def op2_chat_windows(spark: SparkSession, folder: str) -> DataFrame:
    """What the formatted windows of every conversation, and of one that holds control strings, say when they are read back."""
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(CONTROL_TURNS, "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(turns.unionByName(more), count=piece_tokens(MODEL_PATH)), together=True)


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, by a model of the documents whose fold is not 0."""
    docs = _table(spark, folder, "documents")
    found = language_id.identify_language(docs, language_id.fit(docs))
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, longest rule and verdict of every page's URL."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(_table(spark, folder, "pages"), rules)


def op5_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: fingerprint and the smallest doc_id of its component."""
    return near_duplicates(_table(spark, folder, "documents"))


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The licence notices of every document, with coverage and spans."""
    return scan_licenses(_table(spark, folder, "documents"))


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """How much of every document stands in windows of benchmark items."""
    found = decontaminate(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """The best pieces of every document and what the next best change."""
    return encode_documents(_table(spark, folder, "documents"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity of every document, by a model of the labels whose fold is not 0."""
    docs = _table(spark, folder, "documents")
    found = toxicity.score_toxicity(docs, toxicity.fit(docs, _table(spark, folder, "labels")))
    return found.select("doc_id", (fold(column("doc_id")) == 0).alias("held_out"), "score", "predicted")


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Measures of every document, and whether it stays."""
    found = quality_rules(_table(spark, folder, "documents"))
    return found.drop("clean_text")


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_html_text,
            op2_chat_windows,
            op3_language_id,
            op4_url_filter,
            op5_simhash_dedup,
            op6_license_scan,
            op7_decontamination,
            op8_sentencepiece,
            op9_toxicity,
            op10_quality_rules,
        )
    }


_OP4 = r"""
WITH split AS (
    SELECT page_id,
        coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
    FROM pages
), rules(host, path, verdict) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
)
SELECT s.page_id, any_value(s.host) AS host, any_value(s.path) AS path,
    arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
    coalesce(arg_max(r.verdict, length(r.host || r.path)), 'allow') AS verdict
FROM (SELECT *, row_number() OVER () AS n FROM split) s
LEFT JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
GROUP BY s.n, s.page_id
"""

_OP7 = r"""
WITH items AS (
    SELECT coalesce(item_id::VARCHAR, '') AS item,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), windows AS (
    SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS g
    FROM (SELECT item, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), docs AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), own AS (
    SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS g
    FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM windows))
), hits AS (
    SELECT r, size, i, item FROM own JOIN windows USING (size, g)
), hit_words AS (
    SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r
), hit_items AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""

_OP10 = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), lines AS (
    SELECT r, host, text, line, lower(regexp_replace(regexp_replace(trim(line, e' \t\n\x0b\x0c\r'), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
    FROM (SELECT r, host, text, unnest(string_split(text, chr(10))) AS line FROM docs)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), frequent AS (
    SELECT host, norm FROM lines GROUP BY host, norm HAVING count(DISTINCT text) > 10
), removed AS (
    SELECT r, sum(words) AS n FROM lines JOIN frequent USING (host, norm) GROUP BY r
), duplicate AS (
    SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r
), windows AS (
    SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM docs)
), repeated AS (
    SELECT r, count(DISTINCT p) AS n
    FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM windows) WHERE c > 1)
    GROUP BY r
), measures AS (
    SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(d.n, 0)::BIGINT AS n_dup_lines,
        coalesce(p.n, 0)::BIGINT AS n_repeat_words, coalesce(m.n, 0)::BIGINT AS n_removed_words
    FROM docs LEFT JOIN duplicate d USING (r) LEFT JOIN repeated p USING (r) LEFT JOIN removed m USING (r)
), judged AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        n_removed_words > 0 AND (n_words - n_removed_words < 10 OR n_words - n_removed_words < n_words * 0.3) AS depleted
    FROM measures
)
SELECT *, NOT base_failed AND NOT depleted AS kept FROM judged
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": _OP4, "op7_decontamination": _OP7, "op10_quality_rules": _OP10}
