"""DuckDB SQL that gives the registered queries' results.

Its ``levenshtein`` counts bytes, so the letters beyond ASCII of the driver's tables are first mapped
to control characters that no text holds.
"""

from __future__ import annotations

from . import records as R

_CONTROL = "||".join(f"chr({c})" for c in [*range(1, 9), 11, 12, *range(14, 32)][: len(R.LETTERS)])


def _lev(a: str, b: str) -> str:
    code = lambda t: f"translate({t}, '{R.LETTERS}', {_CONTROL})"
    return f"levenshtein({code(a)}, {code(b)})"


def _norm(t: str) -> str:
    return rf"trim(regexp_replace(coalesce({t}, ''), '\s+', ' ', 'g'))"


def _words(t: str) -> str:
    return f"list_filter(string_split({t}, ' '), lambda w: w <> '')"


def _word_lev(r: str, h: str) -> str:
    """Words that both lists have get a character each, all others of a side the same one."""
    both = f"list_distinct(list_intersect({r}, {h}))"
    code = lambda words, other: (
        f"array_to_string(list_transform({words}, lambda w: "
        f"CASE WHEN list_contains({both}, w) THEN chr(2 + list_position(list_sort({both}), w)::INT) ELSE chr({other}) END), '')"
    )
    return f"levenshtein({code(r, 1)}, {code(h, 2)})"


_PREDICTION = R.PREDICTION
_SCORE = R.SCORE.replace("100.0D", "100.0::DOUBLE")

RECORDS = rf"""
pieces AS (SELECT conv_id, turn, role, string_split_regex(coalesce(text, ''), '[.\n]') AS p FROM conversations),
lines AS (SELECT conv_id, turn, role, unnest(p) AS reference, generate_subscripts(p, 1) - 1 AS line_no FROM pieces),
rec AS (
    SELECT *, concat_ws(':', conv_id, turn, line_no) AS sample_id, conv_id::VARCHAR AS source_page_id,
           conv_id * 1000000 + turn * 1000 + line_no AS pos, {_PREDICTION} AS prediction, ({_SCORE})::DOUBLE AS score,
           {", ".join(f"{e} AS {n}" for n, e in R.DIMENSIONS.items())}
    FROM lines)"""

RARE_CLASS = f"[{R.RARE}]"


def _only_rare(t: str) -> str:
    return f"regexp_replace(lower({t}), '[^{R.RARE}]', '', 'g')"


SCORED = f"""{RECORDS},
normed AS (SELECT *, {_norm("reference")} AS ref_n, {_norm("prediction")} AS hyp_n FROM rec),
measured AS (
    SELECT *, {_lev("ref_n", "hyp_n")} AS edits, length(ref_n) AS ref_len,
           length(hyp_n) / greatest(1, length(ref_n)) AS length_ratio, (ref_n = hyp_n)::INT::DOUBLE AS exact_match,
           CASE WHEN length(ref_n) < 32 THEN 'short' WHEN length(ref_n) < 128 THEN 'medium'
                WHEN length(ref_n) < 512 THEN 'long' ELSE 'very_long' END AS bucket,
           {_words("ref_n")} AS rw, {_words("hyp_n")} AS hw, {_only_rare("ref_n")} AS rr, {_only_rare("hyp_n")} AS hr
    FROM normed),
scored AS (
    SELECT *, edits / greatest(1, ref_len) AS cer, {_word_lev("rw", "hw")} / greatest(1, len(rw)) AS wer,
           CASE WHEN rr <> '' THEN {_lev("rr", "hr")} / length(rr) END AS rare_char_cer
    FROM measured)"""

_SUMMARY = {
    "val_rec_count": "count(*)::DOUBLE",
    "val_rec_cer": "avg(cer)",
    "val_rec_cer_micro": "sum(edits) / greatest(1, sum(ref_len))",
    "val_rec_wer": "avg(wer)",
    "val_rec_rare_char_cer": "avg(rare_char_cer)",
    "val_rec_exact_match": "avg(exact_match)",
    "val_rec_exact_match_short": "avg(exact_match) FILTER (bucket = 'short')",
    "val_rec_length_ratio": "avg(length_ratio)",
    "val_rec_empty_prediction_rate": "avg((hyp_n = '')::INT)",
    "val_rec_too_short_rate": "avg((length_ratio < 0.70)::INT)",
    "val_rec_too_long_rate": "avg((length_ratio > 1.30)::INT)",
}


def _columns(names: list[str] | None = None) -> str:
    return ", ".join(f"round({_SUMMARY[n]}, 6) AS {n}" for n in names or _SUMMARY)


#: Positions of two texts side by side; an empty character is the end of one.
def _diff(r: str, h: str, source: str) -> str:
    return f"""
diff AS (
    SELECT * EXCLUDE i, substr(r, i, 1) AS rc, substr(h, i, 1) AS hc
    FROM (SELECT *, unnest(range(1, greatest(length(r), length(h)) + 1)) AS i
          FROM (SELECT *, {r} AS r, {h} AS h FROM {source})))"""


def _chrf(beta: float, exact: bool = False) -> str:
    b2 = beta * beta
    score = f"avg(CASE WHEN none THEN 1 WHEN {b2} * p + q > 0 THEN (1 + {b2}) * p * q / ({b2} * p + q) ELSE 0 END)"
    return f"""
WITH {RECORDS},
texts AS (
    SELECT sample_id, 'r' AS side, lower({_norm("reference")}) AS t FROM rec
    UNION ALL SELECT sample_id, 'h', lower({_norm("prediction")}) FROM rec),
sizes AS (SELECT *, unnest([1, 2, 3, 4, 5, 6]) AS n FROM texts),
grams AS (
    SELECT sample_id, side, n, unnest(CASE WHEN length(t) = 0 THEN [] WHEN length(t) < n THEN [t]
           ELSE list_transform(range(1, length(t) - n + 2), lambda i: substr(t, i, n)) END) AS g
    FROM sizes),
counted AS (
    SELECT sample_id, n, g, count(*) FILTER (side = 'r') AS r, count(*) FILTER (side = 'h') AS h FROM grams GROUP BY ALL),
each AS (SELECT sample_id, n, sum(least(r, h)) AS o, sum(r) AS r, sum(h) AS h FROM counted GROUP BY ALL),
parts AS (
    SELECT s.sample_id, s.n, coalesce(o, 0) / greatest(1, coalesce(h, 0)) AS p, coalesce(o, 0) / greatest(1, coalesce(r, 0)) AS q,
           coalesce(r, 0) + coalesce(h, 0) = 0 AS none
    FROM (SELECT DISTINCT sample_id, n FROM sizes) s LEFT JOIN each USING (sample_id, n))
SELECT sample_id, {score if exact else f"round({score}, 6)"} AS chrf
FROM parts GROUP BY sample_id"""


_X = "10 + (turn % 2) * 300"
_Y = "(turn // 2) * 300 + line_no * 20 + (conv_id % 3) * 5"
BOXES = f"""{RECORDS},
boxes AS (
    SELECT source_page_id AS page_id, sample_id AS line_id, prediction, {R.VARIANT} AS variant, ({_X})::DOUBLE AS x1, ({_Y})::DOUBLE AS y1,
           ({_X} + least(280, 10 + 5 * length(reference)))::DOUBLE AS x2, ({_Y} + 16)::DOUBLE AS y2
    FROM rec),
zones AS (
    SELECT conv_id::VARCHAR AS page_id, concat_ws(':', conv_id, turn) AS zone_id, (5 + (turn % 2) * 300)::DOUBLE AS zx1,
           ((turn // 2) * 300)::DOUBLE AS zy1, (5 + (turn % 2) * 300 + 290)::DOUBLE AS zx2, ((turn // 2) * 300 + 200)::DOUBLE AS zy2,
           string_agg(reference, ' ' ORDER BY line_no) AS text,
           CASE WHEN conv_id % 3 = 0 THEN turn WHEN conv_id % 3 = 1 THEN -turn END AS given
    FROM rec GROUP BY conv_id, turn),
pairs AS (
    SELECT *, (least(x2, zx2) - greatest(x1, zx1)) * (least(y2, zy2) - greatest(y1, zy1)) / greatest(1, (x2 - x1) * (y2 - y1)) AS overlap
    FROM zones JOIN boxes USING (page_id)
    WHERE y2 > zy1 AND y1 < zy2 AND x2 > zx1 AND x1 < zx2),
placed AS (
    SELECT *, round_even(y1 / greatest(12, 0.5 * greatest(1, y2 - y1)), 0) AS line, {_norm("CASE WHEN variant <> 7 THEN prediction END")} AS shown
    FROM pairs WHERE overlap >= 0.5),
built AS (
    SELECT zone_id, string_agg(shown, chr(10) ORDER BY line, y1, x1, line_id) FILTER (shown <> '') AS prediction,
           string_agg(line_id, ',' ORDER BY line, y1, x1, line_id) AS line_ids, count(*) AS line_count
    FROM placed GROUP BY zone_id),
zone_texts AS (
    SELECT zones.*, coalesce(prediction, '') AS prediction, coalesce(line_ids, '') AS line_ids, coalesce(line_count, 0) AS line_count
    FROM zones LEFT JOIN built USING (zone_id))"""

PAGES = f"""{RECORDS},
pages_ AS (
    SELECT conv_id AS page_id, {_norm("string_agg(reference, ' ' ORDER BY turn, line_no)")} AS gt,
           {_norm("CASE WHEN conv_id % 2 = 0 THEN string_agg(prediction, ' ' ORDER BY turn, line_no) ELSE string_agg(prediction, ' ' ORDER BY turn DESC, line_no) END")} AS pred
    FROM rec GROUP BY conv_id)"""


def _tokens(t: str) -> str:
    return rf"regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}\p{{M}}_]+')"


def _bag(r: str, h: str) -> str:
    n = lambda bag: f"len(list_filter({bag}, lambda x: x = w))"
    return f"list_sum(list_transform(list_distinct(list_intersect({r}, {h})), lambda w: least({n(r)}, {n(h)})))"


def _f1(empty: str) -> str:
    return f"CASE WHEN {empty} THEN 1 WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END"


PAGE_SCORES = f"""{PAGES},
tokens AS (SELECT *, {_tokens("gt")} AS rt, {_tokens("pred")} AS ht FROM pages_),
bags AS (SELECT *, coalesce({_bag("rt", "ht")}, 0) AS o FROM tokens),
parts AS (SELECT *, o / greatest(1, len(ht)) AS p, o / greatest(1, len(rt)) AS q FROM bags),
page_scores AS (
    SELECT page_id, pred, length(gt) AS gt_len, length(pred) AS pred_len, length(pred) / greatest(1, length(gt)) AS length_ratio,
           {_lev("gt", "pred")} / greatest(1, length(gt)) AS cer, {_f1("len(rt) + len(ht) = 0")} AS bow_f1
    FROM parts)"""

_MANIFEST = f"""{RECORDS},
manifest AS (
    SELECT sample_id, 'first' AS profile, pos AS place FROM rec WHERE role = 'user'
    UNION ALL
    SELECT sample_id, CASE WHEN conv_id % 5 = 0 THEN '' ELSE 'later' END, pos + 1000000000000 FROM rec WHERE role = 'user')"""

_BOARD = f"""{SCORED},
board AS (
    SELECT language AS benchmark, degradation_profile AS model, count(*)::DOUBLE AS n, avg(cer) AS cer, avg(wer) AS wer, avg(exact_match) AS em
    FROM scored GROUP BY ALL)"""

_DRAW = "md5(concat_ws('|', '42', sample_id))"
_BIN = " + ".join(f"(score >= {k / 10})::INT" for k in range(1, 10))
_CALIBRATION = f"""{SCORED},
bins AS (
    SELECT {_BIN} AS bin, count(*) AS count, avg(exact_match) AS accuracy, avg(score) AS mean_confidence FROM scored GROUP BY ALL),
calibrated AS (SELECT *, abs(accuracy - mean_confidence) AS abs_diff, count / sum(count) OVER () AS weight FROM bins)"""
_CONFIDENCE = """count(*) AS count, round(avg(score), 6) AS mean_confidence, round(median(score), 6) AS median_confidence,
       round(stddev_pop(score), 6) AS std_confidence FROM scored GROUP BY ALL"""
_CER_BUCKET = """CASE WHEN cer <= 0 THEN 'cer_0_exact_match' WHEN cer <= 0.05 THEN 'cer_0_to_0.05' WHEN cer <= 0.10 THEN 'cer_0.05_to_0.10'
       WHEN cer <= 0.20 THEN 'cer_0.10_to_0.20' ELSE 'cer_above_0.20' END"""
_SHORT = "(trim(prediction) = '' OR length(prediction) < length(reference) * 0.7)"
_PERCENT = {"cer": "avg(cer) * 100", "wer": "avg(wer) * 100", "sr": "avg(exact_match) * 100", "empty_rate": "avg((hyp_n = '')::INT) * 100",
            "too_short_rate": "avg((length_ratio < 0.70)::INT) * 100", "too_long_rate": "avg((length_ratio > 1.30)::INT) * 100",
            "mean_length_ratio": "avg(length_ratio)", "mean_ref_length": "avg(ref_len)"}


def _percent(*names: str) -> str:
    return ", ".join(f"round({_PERCENT[n]}, 6) AS {n}" for n in names or _PERCENT)


_WITH_CHRF = f"{SCORED}, c AS ({_chrf(1.0, exact=True)}), full_scored AS (SELECT * FROM scored JOIN c USING (sample_id))"
_CHARS = "(SELECT unnest(string_split(text, '')) AS char FROM documents)"
_SLICES = ("language", "layout_type", "degradation_profile", "role")
_DIFF_N = _diff("ref_n", "hyp_n", "normed")
_DIFF_LOW = _diff("lower(ref_n)", "lower(hyp_n)", "normed")
_COUNTS = f"""{RECORDS},
letters AS (SELECT unnest(string_split('{R.RARE}', '')) AS char),
rare AS (
    SELECT char, length(lower(reference)) - length(replace(lower(reference), char, '')) AS g,
           length(lower(prediction)) - length(replace(lower(prediction), char, '')) AS p
    FROM rec, letters),
totals AS (SELECT char, sum(g)::BIGINT AS gt, sum(p)::BIGINT AS predicted, sum(least(g, p))::BIGINT AS correct FROM rare GROUP BY char)"""

SQL = {
    "cer_by_lang": f"WITH {SCORED} SELECT language, {_columns(['val_rec_count', 'val_rec_cer', 'val_rec_cer_micro', 'val_rec_exact_match', 'val_rec_length_ratio'])} FROM scored GROUP BY language",
    "metrics_overall": f"WITH {SCORED} SELECT {_columns()} FROM scored",
    "metrics_grouping_sets": f"""WITH {SCORED} SELECT 'overall' AS slice, 'all' AS value, {_columns()} FROM scored"""
    + "".join(f" UNION ALL SELECT '{s}', {s}, {_columns()} FROM scored GROUP BY {s}" for s in _SLICES),
    "metrics_chrf": f"""WITH {_WITH_CHRF} SELECT 'overall' AS slice, 'all' AS value, {_columns()}, round(avg(chrf), 6) AS val_rec_chrf FROM full_scored"""
    + "".join(f" UNION ALL SELECT '{s}', {s}, {_columns()}, round(avg(chrf), 6) FROM full_scored GROUP BY {s}" for s in _SLICES),
    "norm_text": f"SELECT doc_id, md5({_norm('text')}) AS digest, length({_norm('text')}) AS n_norm FROM documents",
    "length_buckets": f"""
        SELECT CASE WHEN n < 32 THEN 'short' WHEN n < 128 THEN 'medium' WHEN n < 512 THEN 'long' ELSE 'very_long' END AS bucket,
               CASE WHEN n < 50 THEN 'short' WHEN n <= 200 THEN 'medium' ELSE 'long' END AS bucket3, count(*) AS n
        FROM (SELECT length({_norm("text")}) AS n FROM documents) GROUP BY ALL""",
    "infer_language": f"""
        SELECT CASE WHEN regexp_matches(t, '[әғқұіһ]') THEN 'kazakh' WHEN regexp_matches(t, '[ңөү]') THEN 'kyrgyz_or_kazakh'
                    ELSE 'russian_or_other' END AS inferred,
               regexp_matches(t, '{RARE_CLASS}') AS has_rare,
               array_to_string(list_filter(string_split('{R.RARE}', ''), lambda c: contains(t, c)), '') AS present, count(*) AS n
        FROM (SELECT lower({_norm("text")}) AS t FROM documents) GROUP BY ALL""",
    "rare_char_cer": f"WITH {SCORED} SELECT sample_id, round(rare_char_cer, 6) AS rare_char_cer FROM scored",
    "rare_prf": f"""WITH {_COUNTS},
        s AS (SELECT sum(gt)::BIGINT AS gt_count, sum(predicted)::BIGINT AS predicted_count, sum(correct)::BIGINT AS correct_count FROM totals),
        pr AS (SELECT *, correct_count / predicted_count AS precision, correct_count / gt_count AS recall FROM s)
        SELECT gt_count, predicted_count, correct_count, round(precision, 6) AS precision, round(recall, 6) AS recall,
               round(2 * precision * recall / (precision + recall), 6) AS f1 FROM pr""",
    "rare_recall": f"WITH {_COUNTS} SELECT *, round(CASE WHEN gt > 0 THEN correct / gt ELSE 0 END, 6) AS recall FROM totals",
    "rare_confusion": f"""WITH {SCORED}, {_DIFF_LOW}
        SELECT rc AS ref_char, CASE WHEN hc = '' THEN '<missing>' ELSE hc END AS hyp_char, count(*) AS count
        FROM diff WHERE rc <> hc AND rc <> '' AND contains('{R.RARE}', rc) GROUP BY ALL""",
    "substitutions_top50": f"""WITH {SCORED}, {_DIFF_N}
        SELECT CASE WHEN rc = '' THEN '<inserted>' ELSE rc END AS ground_truth, CASE WHEN hc = '' THEN '<missing>' ELSE hc END AS predicted,
               count(*) AS count
        FROM diff WHERE rc <> hc GROUP BY ALL ORDER BY count DESC, ground_truth, predicted LIMIT 50""",
    "suffix_errors_top100": f"""WITH {SCORED},
        aligned AS (SELECT rw, hw, unnest(range(1, least(len(rw), len(hw)) + 1)) AS i FROM scored),
        pairs AS (SELECT rw[i] AS r, hw[i] AS h FROM aligned)
        SELECT right(r, 3) AS suffix, count(*) AS count FROM pairs WHERE r <> h AND length(r) >= 3
        GROUP BY ALL ORDER BY count DESC, suffix LIMIT 100""",
    "failure_taxonomy": f"""WITH {SCORED},
        modes AS (SELECT cer, CASE WHEN cer < 0.05 THEN 'CORRECT'
            WHEN regexp_matches(degradation_profile, 'stamp|official') THEN 'STAMP_INTERFERENCE'
            WHEN regexp_matches(degradation_profile, 'low|dpi|phone|photo') THEN 'LOW_DPI'
            WHEN regexp_matches(layout_type, 'table|transaction') THEN 'TABLE_BOUNDARY'
            WHEN regexp_matches(lower(reference), '[қңәүұ]') AND cer > 0.15 THEN 'MIXED_LANGUAGE'
            WHEN length(prediction) < greatest(5, length(reference) * 0.5) THEN 'FONT_ANOMALY' ELSE 'UNCLASSIFIED' END AS failure_mode FROM scored)
        SELECT failure_mode, count(*) AS count, round(avg(cer), 6) AS mean_cer FROM modes GROUP BY ALL""",
    "hardcases_a": f"""WITH {SCORED} SELECT sample_id, round(cer, 6) AS cer FROM scored
        WHERE cer > 0.25 OR (degradation_profile IN ('phone_photo', 'low_dpi_scan', 'old_paper') AND cer > 0.15)
           OR (layout_type IN ('tables_transactional', 'forms') AND cer > 0.20)""",
    "hardcases_b_reasons": f"""WITH {RECORDS},
        raw AS (SELECT *, {_lev("reference", "prediction")} / greatest(1, length(reference)) AS cer,
                       {_only_rare("reference")} AS rr, {_only_rare("prediction")} AS hr FROM rec),
        why AS (SELECT sample_id, concat_ws(',', CASE WHEN cer >= 0.10 THEN 'high_cer' END,
            CASE WHEN rr <> '' AND {_lev("rr", "hr")} / length(rr) >= 0.15 THEN 'rare_char_failure' END,
            CASE WHEN trim(prediction) = '' THEN 'empty_prediction'
                 WHEN length(prediction) < length(reference) * 0.7 THEN 'too_short_prediction' END,
            CASE WHEN regexp_matches(layout_type, 'table|form') THEN 'table_or_form' END) AS reasons FROM raw)
        SELECT * FROM why WHERE reasons <> ''""",
    "qualitative_top": f"""WITH {RECORDS},
        raw AS (SELECT *, {_lev("reference", "prediction")} / greatest(1, length(reference)) AS cer,
                       regexp_matches(reference, '{RARE_CLASS}') AS rare FROM rec),
        marked AS (SELECT *, rare AND len(list_filter(range(1, length(reference) + 1),
                       lambda i: contains('{R.RARE}', substr(reference, i, 1)) AND substr(reference, i, 1) <> substr(prediction, i, 1))) > 0 AS wrong
                   FROM raw),
        picked AS (
            (SELECT 'best_line_predictions' AS qualitative_group, sample_id, cer FROM marked ORDER BY cer, pos LIMIT 10)
            UNION ALL (SELECT 'worst_line_failures', sample_id, cer FROM marked ORDER BY cer DESC, pos LIMIT 10)
            UNION ALL (SELECT 'rare_character_successes', sample_id, cer FROM marked WHERE rare AND reference = prediction ORDER BY pos LIMIT 10)
            UNION ALL (SELECT 'rare_character_substitutions', sample_id, cer FROM marked WHERE wrong ORDER BY pos LIMIT 10)
            UNION ALL (SELECT 'empty_or_too_short_failures', sample_id, cer FROM marked WHERE {_SHORT} ORDER BY pos LIMIT 10))
        SELECT qualitative_group, sample_id, round(cer, 6) AS cer FROM picked""",
    "wer_words": f"WITH {SCORED} SELECT sample_id, round(wer, 6) AS wer FROM scored",
    "wer_legacy": f"""WITH {SCORED},
        joined AS (SELECT sample_id, rw, array_to_string(rw, chr(127)) AS r, array_to_string(hw, chr(127)) AS h FROM scored)
        SELECT sample_id, round({_lev("r", "h")} / greatest(1, len(rw)), 6) AS wer FROM joined""",
    "ned_similarity": f"WITH {SCORED} SELECT sample_id, round(1 - edits / greatest(1, length(ref_n), length(hyp_n)), 6) AS ned FROM scored",
    "chrf_b1": _chrf(1.0),
    "chrf_b2": _chrf(2.0),
    "bow_prf": f"""WITH {RECORDS},
        tokens AS (SELECT sample_id, {_tokens("reference")} AS rt, {_tokens("prediction")} AS ht FROM rec),
        bags AS (SELECT *, coalesce({_bag("rt", "ht")}, 0) AS o, len(rt) + len(ht) = 0 AS none FROM tokens),
        parts AS (SELECT *, o / greatest(1, len(ht)) AS p, o / greatest(1, len(rt)) AS q FROM bags)
        SELECT sample_id, round(CASE WHEN none THEN 1 ELSE p END, 6) AS precision, round(CASE WHEN none THEN 1 ELSE q END, 6) AS recall,
               round({_f1("none")}, 6) AS f1 FROM parts""",
    "page_error_types": f"""WITH {PAGE_SCORES}
        SELECT page_id, gt_len, pred_len, round(length_ratio, 6) AS length_ratio, round(cer, 6) AS cer, round(bow_f1, 6) AS bow_f1,
               CASE WHEN pred = '' THEN 'empty_prediction' WHEN length_ratio < 0.70 AND cer > 0.25 THEN 'detection_miss_or_too_short'
                    WHEN length_ratio > 1.30 AND cer > 0.25 THEN 'duplicate_or_noise_text' WHEN bow_f1 >= 0.75 AND cer >= 0.30 THEN 'order_issue'
                    WHEN bow_f1 < 0.50 AND length_ratio BETWEEN 0.70 AND 1.30 AND cer >= 0.30 THEN 'recognizer_or_bad_crop_failure'
                    WHEN cer < 0.15 THEN 'acceptable' ELSE 'mixed' END AS error_type
        FROM page_scores""",
    "gate": f"""WITH {_WITH_CHRF},
        s AS (SELECT language, avg(chrf) AS chrf, {", ".join(f"{e} AS {n.removeprefix('val_rec_')}" for n, e in _SUMMARY.items())} FROM full_scored GROUP BY language),
        r AS (SELECT *, concat_ws('; ', CASE WHEN cer > 0.10 THEN 'val_rec_cer exceeds max_cer' END,
            CASE WHEN rare_char_cer > 0.15 THEN 'val_rec_rare_char_cer exceeds max_rare_char_cer' END,
            CASE WHEN exact_match_short < 0.80 THEN 'val_rec_exact_match_short below min_exact_match_short' END,
            CASE WHEN empty_prediction_rate > 0.05 THEN 'val_rec_empty_prediction_rate exceeds max_empty_rate' END,
            CASE WHEN too_short_rate > 0.05 THEN 'val_rec_too_short_rate exceeds max_too_short_rate' END,
            CASE WHEN length_ratio < 0.70 OR length_ratio > 1.30 THEN 'val_rec_length_ratio outside configured range' END) AS fails,
            concat_ws('; ', CASE WHEN cer > 0.05 THEN 'val_rec_cer above strong_result_cer' END,
            CASE WHEN rare_char_cer > 0.08 THEN 'val_rec_rare_char_cer above strong_result_rare_char_cer' END,
            CASE WHEN chrf < 0.90 THEN 'val_rec_chrf below strong_result_chrf' END,
            CASE WHEN exact_match_short < 0.90 THEN 'val_rec_exact_match_short below strong_result_exact_match_short' END) AS warns FROM s)
        SELECT language, CASE WHEN cer > 0.25 THEN 'SMOKE_FAIL' WHEN fails <> '' THEN 'FAIL' WHEN warns <> '' THEN 'WARN' ELSE 'PASS' END AS status,
               NOT (cer > 0.25 OR fails <> '') AS promote,
               CASE WHEN cer > 0.25 THEN 'smoke fail: val_rec_cer exceeds smoke_fail_cer' WHEN fails <> '' THEN fails ELSE warns END AS reasons FROM r""",
    "charset": f"SELECT DISTINCT char FROM {_CHARS} WHERE char NOT IN (chr(10), chr(13), '')",
    "char_histogram": f"SELECT char, count(*) AS count FROM {_CHARS} WHERE char <> '' GROUP BY char",
    "dataset_audit": f"""
        SELECT 'rows' AS section, 'all' AS name, count(*) AS count FROM documents
        UNION ALL SELECT 'lang', coalesce(lang, 'unknown'), count(*) FROM documents GROUP BY ALL
        UNION ALL SELECT 'source', coalesce(source, 'unknown'), count(*) FROM documents GROUP BY ALL
        UNION ALL SELECT 'rare', l.char, count(c.char) FROM (SELECT unnest(string_split('{R.RARE}', '')) AS char) l LEFT JOIN {_CHARS} c USING (char) GROUP BY ALL
        UNION ALL SELECT 'distinct_chars', 'all', count(DISTINCT char) FROM {_CHARS} WHERE char <> ''""",
    "coverage": f"WITH {RECORDS} " + " UNION ALL ".join(f"SELECT '{s}' AS dimension, {s} AS value, count(*) AS count FROM rec GROUP BY {s}" for s in _SLICES),
    "invalid_charset": f"""WITH {RECORDS}
        SELECT language, round(avg(regexp_matches({_norm("prediction")}, '[^ -~]')::INT), 6) AS invalid_charset_rate FROM rec GROUP BY language""",
    "zone_lines_overlap": f"WITH {BOXES} SELECT zone_id, line_id, round(overlap, 6) AS overlap FROM placed",
    "zone_from_lines": f"WITH {BOXES} SELECT zone_id, md5(prediction) AS digest, line_ids, line_count FROM zone_texts",
    "page_reconstruct": f"""WITH {BOXES},
        z AS (SELECT *, {_norm("prediction")} AS t, round_even(zy1 / greatest(12, 0.5 * (zy2 - zy1)), 0) AS line FROM zone_texts)
        SELECT page_id, md5(coalesce(string_agg(t, chr(10) ORDER BY line, zy1, zx1, zone_id) FILTER (t <> ''), '')) AS digest, count(*) AS zone_count
        FROM z GROUP BY page_id""",
    "oracle_pages": f"""WITH {BOXES},
        z AS (SELECT *, zone_id NOT LIKE '%:1' AS has, {_norm("text")} AS t FROM zones)
        SELECT page_id, md5(coalesce(string_agg(t, chr(10) ORDER BY given IS NULL, coalesce(given, (zy1 + zy2) / 2),
                        CASE WHEN given IS NULL THEN zx1 + zx2 END, zone_id) FILTER (has AND t <> ''), '')) AS digest,
               count(*) AS zone_count, round(avg((NOT has)::INT), 6) AS failed_zone_rate
        FROM z GROUP BY page_id""",
    "geometric_order": f"""WITH {BOXES}
        SELECT line_id, round_even(y1 / greatest(12, 0.5 * (y2 - y1)), 0) AS line, y1, x1, round_even((y1 + y2) / 2 / ((y2 - y1) * 0.6), 0) AS simple_line
        FROM boxes""",
    "column_gap": f"""WITH {BOXES},
        c AS (SELECT page_id, line_id, (x1 + x2) / 2 AS cx FROM boxes),
        g AS (SELECT page_id, lead(cx) OVER w - cx AS gap, row_number() OVER w AS after FROM c WINDOW w AS (PARTITION BY page_id ORDER BY cx, line_id)),
        m AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY gap DESC, after) AS k FROM g WHERE gap IS NOT NULL)
        SELECT page_id, round(gap, 6) AS gap, after::INT AS after FROM m WHERE k = 1""",
    "page_partials": f"""WITH {SCORED} SELECT source_page_id AS page, count(*) AS crops, sum(edits)::BIGINT AS cer_num,
        sum(greatest(1, ref_len))::BIGINT AS cer_den, sum(exact_match) AS em_sum FROM scored GROUP BY ALL""",
    "bootstrap_ci": f"""WITH {SCORED},
        p AS (SELECT row_number() OVER (ORDER BY source_page_id) - 1 AS idx, count(*) AS crops, sum(edits) AS a, sum(greatest(1, ref_len)) AS d,
                     sum(exact_match) AS em FROM scored GROUP BY source_page_id),
        t AS (SELECT count(*) AS n FROM p),
        draws AS (SELECT b, ('0x' || substr(md5(concat_ws('|', '42', b, i)), 1, 8))::BIGINT % n AS idx
                  FROM t, range(200) r(b), range((SELECT n FROM t)) s(i)),
        each AS (SELECT b, sum(a) / sum(d) AS cer, sum(em) / sum(crops) AS em FROM draws JOIN p USING (idx) GROUP BY b),
        long AS (SELECT 'cer' AS metric, cer AS v FROM each UNION ALL SELECT 'exact_match', em FROM each)
        SELECT metric, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_pop(v), 6) AS std,
               round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi FROM long GROUP BY metric""",
    "page_partials_all": f"""WITH {_WITH_CHRF} SELECT source_page_id AS page, count(*) AS crops, sum(edits)::BIGINT AS cer_num,
        sum(greatest(1, ref_len))::BIGINT AS cer_den, round(sum(wer * greatest(1, len(rw))), 6) AS wer_num,
        sum(greatest(1, len(rw)))::BIGINT AS wer_den, sum(exact_match) AS em_sum, round(sum(chrf), 6) AS chrf_sum
        FROM full_scored GROUP BY ALL""",
    "bootstrap_ci_1000": f"""WITH {_WITH_CHRF},
        p AS (SELECT row_number() OVER (ORDER BY source_page_id) - 1 AS idx, count(*) AS crops, sum(edits) AS a, sum(greatest(1, ref_len)) AS d,
                     sum(wer * greatest(1, len(rw))) AS wa, sum(greatest(1, len(rw))) AS wd, sum(chrf) AS f,
                     sum(exact_match) AS em FROM full_scored GROUP BY source_page_id),
        t AS (SELECT count(*) AS n FROM p),
        draws AS (SELECT b, ('0x' || substr(md5(concat_ws('|', '42', b, i)), 1, 8))::BIGINT % n AS idx
                  FROM t, range(1000) r(b), range((SELECT n FROM t)) s(i)),
        each AS (SELECT b, sum(a) / sum(d) AS cer, sum(wa) / sum(wd) AS wer, sum(f) / sum(crops) AS chrf, sum(em) / sum(crops) AS exact_match
                 FROM draws JOIN p USING (idx) GROUP BY b),
        long AS (SELECT 'cer' AS metric, cer AS v FROM each UNION ALL SELECT 'wer', wer FROM each
                 UNION ALL SELECT 'chrf', chrf FROM each UNION ALL SELECT 'exact_match', exact_match FROM each)
        SELECT metric, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_pop(v), 6) AS std,
               round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi FROM long GROUP BY metric""",
    "wilson": f"""WITH {SCORED},
        c AS (SELECT language, sum(exact_match)::BIGINT AS k, count(*) AS n, 1.959963984540054::DOUBLE AS z FROM scored GROUP BY language),
        m AS (SELECT *, (k / n + z * z / (2 * n)) / (1 + z * z / n) AS centre,
                     z * sqrt((k / n * (1 - k / n) + z * z / (4 * n)) / n) / (1 + z * z / n) AS margin FROM c)
        SELECT language, k, n, round(greatest(0, centre - margin) * 100, 6) AS lo, round(least(1, centre + margin) * 100, 6) AS hi FROM m""",
    "confidence_buckets": f'WITH {SCORED} SELECT {_CER_BUCKET} AS "group", {_CONFIDENCE}',
    "confidence_by_outcome": f"WITH {SCORED} SELECT CASE WHEN exact_match = 1 THEN 'exact' ELSE 'erroneous' END AS \"group\", {_CONFIDENCE}",
    "auroc": f"""WITH {SCORED},
        r AS (SELECT 1 - exact_match AS y, rank() OVER (ORDER BY 1 - score) + (count(*) OVER (PARTITION BY 1 - score) - 1) / 2 AS rk FROM scored)
        SELECT round((sum(y * rk) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auroc FROM r""",
    "ece": f"WITH {_CALIBRATION} SELECT round(sum(weight * abs_diff), 6) AS ece FROM calibrated",
    "calibration_bins": f"""WITH {_CALIBRATION} SELECT bin::INT AS bin, count, round(accuracy, 6) AS accuracy, round(mean_confidence, 6) AS mean_confidence,
        round(abs_diff, 6) AS abs_diff, round(weight, 6) AS weight FROM calibrated""",
    "degradation_table": f"""WITH {SCORED} SELECT degradation_profile, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share,
        round(avg(cer) * 100 - 4.51, 6) AS cer_delta_pp, {_percent()} FROM scored GROUP BY degradation_profile""",
    "text_length_table": f"WITH {SCORED} SELECT bucket, count(*) AS n, {_percent('mean_ref_length', 'cer', 'sr', 'mean_length_ratio')} FROM scored GROUP BY bucket",
    "degradation_chrf": f"""WITH {_WITH_CHRF} SELECT degradation_profile, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share,
        round(avg(cer) * 100 - 4.51, 6) AS cer_delta_pp, {_percent()}, round(avg(chrf), 6) AS chrf FROM full_scored GROUP BY degradation_profile""",
    "text_length_chrf": f"""WITH {_WITH_CHRF} SELECT bucket, count(*) AS n, {_percent('mean_ref_length', 'cer', 'sr', 'mean_length_ratio')},
        round(avg(chrf), 6) AS chrf FROM full_scored GROUP BY bucket""",
    "join_verify": f"""WITH {_MANIFEST}, k AS (SELECT sample_id, count(*) AS c FROM manifest GROUP BY ALL)
        SELECT count(*) AS predictions, count(c) AS matched, count(*) - count(c) AS unmatched, (SELECT sum(c - 1)::BIGINT FROM k) AS duplicate_keys
        FROM rec LEFT JOIN k USING (sample_id)""",
    "dedupe_last": f"""WITH {_MANIFEST}, l AS (SELECT sample_id, arg_max(profile, place) AS p FROM manifest GROUP BY sample_id)
        SELECT sample_id, coalesce(nullif(p, ''), nullif(degradation_profile, ''), 'unknown') AS degradation_profile, p IS NOT NULL AS matched
        FROM rec LEFT JOIN l USING (sample_id)""",
    "unseen": f"WITH {_MANIFEST} SELECT sample_id FROM rec WHERE sample_id NOT IN (SELECT sample_id FROM manifest)",
    "stratified_round_robin": f"""WITH {RECORDS},
        t AS (SELECT *, row_number() OVER (PARTITION BY {", ".join(_SLICES)} ORDER BY {_DRAW}, sample_id) AS k FROM rec)
        SELECT sample_id, language, turn FROM t ORDER BY k, {", ".join(_SLICES)} LIMIT 200""",
    "rare_preferring_sample": f"""WITH {RECORDS},
        m AS (SELECT sample_id, regexp_matches(lower(reference), '{RARE_CLASS}') AS rare, {_DRAW} AS d FROM rec),
        k AS (SELECT *, row_number() OVER (PARTITION BY rare ORDER BY d, sample_id) AS n, count(*) FILTER (rare) OVER () AS rn,
                     count(*) FILTER (NOT rare) OVER () AS other FROM m),
        s AS (SELECT *, least(other, 120 - least(rn, 40)) AS take_other FROM k)
        SELECT sample_id FROM s WHERE n <= CASE WHEN rare THEN 120 - take_other ELSE take_other END""",
    "ntile_shards": f"""WITH {RECORDS}, t AS (SELECT pos, ntile(7) OVER (ORDER BY pos) - 1 AS shard FROM rec)
        SELECT shard, count(*) AS n, min(pos) AS lo, max(pos) AS hi FROM t GROUP BY shard""",
    "shard_merge": f"""WITH {RECORDS}, s AS (SELECT conv_id % 4 AS shard, count(*) AS c FROM rec GROUP BY ALL),
        e AS (SELECT *, c * 0.25::DOUBLE + shard AS elapsed FROM s)
        SELECT sum(c)::BIGINT AS count, max(elapsed) AS elapsed_sec, max(CASE WHEN shard > 1 THEN shard * 100 END) AS peak_memory,
               arg_max('backend' || shard, shard) AS backend, 'epoch_9' AS checkpoint, round_even(max(elapsed) / sum(c) * 1000, 3) AS latency_per_page_ms FROM e""",
    "leaderboard_best": f"""WITH {_BOARD}, r AS (SELECT *, row_number() OVER (PARTITION BY benchmark ORDER BY cer, model) AS k FROM board)
        SELECT benchmark, model, round(cer, 6) AS val_rec_cer, n AS val_rec_count FROM r WHERE k = 1""",
    "metric_deltas": f"""WITH {_BOARD}
        SELECT benchmark, round(c.cer - b.cer, 6) AS val_rec_cer_delta, round(c.wer - b.wer, 6) AS val_rec_wer_delta,
               round(c.em - b.em, 6) AS val_rec_exact_match_delta, round((b.cer - c.cer) / greatest(1e-12, b.cer), 6) AS cer_relative_reduction
        FROM board c JOIN board b USING (benchmark) WHERE c.model = 'clean' AND b.model = 'old_paper'""",
    "running_best": f"""WITH {_BOARD},
        r AS (SELECT *, cer < 0.6 AS promote, min(CASE WHEN cer < 0.6 THEN cer END) OVER
                  (PARTITION BY benchmark ORDER BY model ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM board)
        SELECT benchmark, model, round(best, 6) AS best_before, promote AND (best IS NULL OR cer < best) AS is_best FROM r""",
    "running_total": """
        WITH p AS (SELECT source AS phase, sum(length(text)) / 1000 AS size FROM documents GROUP BY source)
        SELECT phase, round(size, 6) AS size, round_even(sum(size) OVER (ORDER BY phase), 3) AS cumulative FROM p""",
    "json_crop_specs": """
        WITH l AS (SELECT concat_ws(':', conv_id, turn) AS page_id, unnest(string_split(text, chr(10))) AS t FROM conversations)
        SELECT page_id, 'line' AS crop_type, count(*) AS n, sum(length(t))::BIGINT AS chars FROM l WHERE trim(t) <> '' GROUP BY ALL
        UNION ALL
        SELECT concat_ws(':', conv_id, turn), CASE WHEN turn % 2 = 0 THEN 'table_cell' ELSE 'zone' END, count(*), sum(length(trim(text)))::BIGINT
        FROM conversations WHERE trim(text) <> '' GROUP BY ALL""",
    "status_upsert": r"""
        WITH m AS (SELECT source AS id, regexp_extract(source, '(\d+)', 1)::INT AS k, count(*) AS c FROM documents GROUP BY ALL)
        SELECT id, 100 - k AS pos, CASE WHEN k >= 6 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN k >= 6 THEN c * 2 ELSE c END AS n
        FROM m WHERE k < 14""",
    "simple_order": f"""WITH {BOXES}
        SELECT page_id, line_id AS box_id, row_number() OVER (PARTITION BY page_id ORDER BY
               round_even((y1 + y2) / 2 / ((y2 - y1) * 0.6), 0), (y1 + y2) / 2, (x1 + x2) / 2, line_id) - 1 AS position FROM boxes""",
}

from . import oracle_more  # noqa: E402  (it uses the pieces above)

SQL |= oracle_more.SQL
