"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (
    bpe,
    exact_dedup,
    jaccard_join,
    language_id,
    license_scan,
    packing,
    quality_rules,
    toxicity,
    url_filters,
    warc,
)
from .common import table


def vocabulary(name: str) -> bytes:
    """A public vocabulary's file; its place is asked of the library that brings it."""
    import public_tokenizers

    return bpe.read_vocabulary(public_tokenizers.path(name))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_filter(table(spark, sf_dir, "pages"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return counts.drop("reasons")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"), closest=True)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_histories(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), stable=True)


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_url_filters": op2_url_filters,
    "op3_license_scan": op3_license_scan,
    "op4_toxicity": op4_toxicity,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_packing": op6_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_language_id": op8_language_id,
    "op9_warc": op9_warc,
    "op10_byte_bpe": op10_byte_bpe,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TESTED = " UNION ALL ".join(
    f"SELECT '{rule}' AS rule, {k} AS k, {cutoff}::DOUBLE AS cutoff"
    for rule, cutoffs in quality_rules.CUTOFFS.items()
    for k, cutoff in enumerate(cutoffs)
)
_SHARE = quality_rules.ALPHA / len(quality_rules.CUTOFFS)

ORACLE_SQL = {
    "op1_jaccard_join": rf"""
        WITH RECURSIVE rows AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.replace("coalesce(text, '')", _LOW.format("coalesce(text, '')"))} AS w FROM documents),
        grams AS (
            SELECT DISTINCT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
                   ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END) AS g FROM rows),
        sizes AS (SELECT rid, count(*) AS n FROM grams GROUP BY rid),
        shared AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
        links AS (
            SELECT a, b FROM shared JOIN sizes x ON x.rid = a JOIN sizes y ON y.rid = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT rid AS a, rid AS b FROM rows UNION SELECT r.a, l.b FROM reach r JOIN edges l ON l.a = r.b),
        least AS (SELECT reach.a AS rid, min(doc_id) AS m FROM reach JOIN rows ON rows.rid = reach.b GROUP BY ALL),
        class AS (
            SELECT reach.a AS rid, min(o.doc_id) AS c FROM reach JOIN rows o ON o.rid = reach.b
            LEFT JOIN sizes x ON x.rid = reach.a LEFT JOIN sizes y ON y.rid = reach.b
            LEFT JOIN shared s ON s.a = least(reach.a, reach.b) AND s.b = greatest(reach.a, reach.b)
            WHERE reach.a = reach.b OR (x.n = y.n AND s.c = x.n) GROUP BY ALL)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS class_id, m AS component_id
        FROM rows LEFT JOIN sizes USING (rid) JOIN least USING (rid) JOIN class USING (rid)""",
    "op7_quality_rules": rf"""
        WITH rows AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS stratum, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
        lines AS (SELECT *, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^ 	-
]')) AS ls FROM rows),
        windows AS (SELECT rid, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4])) AS g FROM rows),
        again AS (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM windows),
        covered AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS j FROM again WHERE c > 1) GROUP BY rid),
        counts AS (
            SELECT rid, doc_id, stratum, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                   len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) AS n_lines,
                   len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
            FROM lines LEFT JOIN covered USING (rid)),
        measured AS (
            SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > 20 * n_words AS base_failed,
                   n_symbols / greatest(word_chars, 1) AS symbol_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
                   n_repeat_words / greatest(n_words, 1) AS repeat_ratio, word_chars / greatest(n_words, 1) AS mean_word_chars
            FROM counts),
        vals AS (UNPIVOT (SELECT rid, stratum, base_failed, doc_id, symbol_ratio, dup_line_ratio, repeat_ratio, mean_word_chars FROM measured)
                 ON symbol_ratio, dup_line_ratio, repeat_ratio, mean_word_chars INTO NAME rule VALUE v),
        tested AS ({_TESTED}),
        holdout AS (
            SELECT stratum, rule, k, cutoff, count(*) AS n, count(*) FILTER (v > cutoff) AS x
            FROM vals JOIN tested USING (rule)
            WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY ALL),
        bounds AS (
            SELECT *, CASE WHEN x >= n * {_SHARE} THEN 1 ELSE list_sum(list_transform(range(0, x + 1), lambda j:
                       exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_SHARE}) + (n - j) * ln(1 - {_SHARE})))) END AS p,
                   {quality_rules.DELTA} / ({len(quality_rules.CUTOFFS)} * (SELECT count(DISTINCT stratum) FROM holdout)) AS level
            FROM holdout),
        chosen AS (
            SELECT stratum, rule, arg_max(cutoff, k) AS cutoff
            FROM (SELECT *, max(p) OVER (PARTITION BY stratum, rule ORDER BY k) AS worst FROM bounds) WHERE worst <= level GROUP BY ALL),
        rejected AS (SELECT DISTINCT rid FROM vals JOIN chosen USING (stratum, rule) WHERE v > cutoff)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND rid NOT IN (SELECT rid FROM rejected) AS kept
        FROM measured""",
    "op2_url_filters": r"""
        WITH rules(action, host, prefix) AS (VALUES
            ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
            ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        blocked(host) AS (
            SELECT name || '.example.' || top
            FROM (VALUES ('ads-track'), ('spam-farm'), ('casino-win'), ('adult-x'), ('cheap-pills'), ('free-bets')) a(name),
                 (VALUES ('com'), ('net'), ('org')) b(top)),
        split AS (
            SELECT row_number() OVER () AS rid, page_id,
                   CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
            FROM pages),
        rows AS (
            SELECT rid, page_id,
                   translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                             'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM split),
        fits AS (
            SELECT rid, max_by(action, (length(r.host || r.prefix), length(r.host))) AS action,
                   max_by(r.host || r.prefix, (length(r.host || r.prefix), length(r.host))) AS rule
            FROM rows JOIN rules r
              ON (rows.host = r.host OR suffix(rows.host, '.' || r.host)) AND starts_with(rows.path, r.prefix)
            GROUP BY rid),
        listed AS (
            SELECT DISTINCT rid FROM rows JOIN blocked b ON rows.host = b.host OR suffix(rows.host, '.' || b.host))
        SELECT page_id, host, path, rule,
               coalesce(action, CASE WHEN listed.rid IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
        FROM rows LEFT JOIN fits USING (rid) LEFT JOIN listed USING (rid)""",
    "op5_exact_dedup": """
        WITH norm AS (
            SELECT doc_id, row_number() OVER () AS rid,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST, rid) = 1 AS kept,
               sha256(t) AS text_sha256
        FROM norm""",
}
