"""DuckDB SQL for the queries of ``more``."""

from __future__ import annotations

from . import oracle as O

_SUMMARY = ["val_rec_count", "val_rec_cer", "val_rec_cer_micro", "val_rec_wer", "val_rec_exact_match"]
_BUCKET = "CASE WHEN length({0}) < 32 THEN 'short' WHEN length({0}) < 128 THEN 'medium' WHEN length({0}) < 512 THEN 'long' ELSE 'very_long' END"
_N = O._norm
_MANIFEST = f"""{O.RECORDS},
man AS (SELECT sample_id, CASE WHEN conv_id % 7 <> 0 THEN 'img/' || sample_id || '.png' END AS image_path, reference AS text,
               CASE WHEN turn % 5 <> 4 THEN language ELSE '' END AS lang FROM rec),
lacks AS (SELECT *, concat_ws(',', CASE WHEN image_path IS NULL THEN 'image_path' END, CASE WHEN text = '' THEN 'text' END,
                 CASE WHEN lang = '' THEN 'language' END) AS missing FROM man),
good AS (SELECT *, {_N("text")} AS t FROM lacks WHERE missing = '')"""
_BOARD = f"""{O.SCORED},
board AS (SELECT language AS benchmark, degradation_profile AS model, {O._columns(["val_rec_count", "val_rec_cer", "val_rec_wer", "val_rec_exact_match", "val_rec_rare_char_cer"])}
          FROM scored GROUP BY language, degradation_profile)"""
_LEGACY_RARE = "list_sum(list_transform(string_split('{r}', ''), lambda c: {f}))"
_COUNT = lambda t: f"(length(lower({t})) - length(replace(lower({t}), c, '')))"
_RARE_SUM = lambda f: f"list_sum(list_transform(string_split('{O.R.RARE}', ''), lambda c: {f}))"
_SIZES = """
files AS (SELECT coalesce(lang, 'none') AS id, CASE doc_id % 4 WHEN 0 THEN 'onnx' WHEN 1 THEN 'tar' WHEN 2 THEN 'md' ELSE 'parquet' END AS e,
                 CASE WHEN doc_id % 5 <> 0 THEN n_chars * 100000 END AS size FROM documents),
sized AS (SELECT id, count(*) AS file_count, count(size) AS known_size_file_count, coalesce(sum(size), 0)::BIGINT AS total_bytes,
                 round_even(coalesce(sum(size), 0) / 1073741824, 3) AS total_gb,
                 round_even(coalesce(sum(size) FILTER (e = 'onnx'), 0) / 1073741824, 3) AS weights_gb,
                 round_even(coalesce(sum(size) FILTER (e IN ('tar', 'parquet')), 0) / 1073741824, 3) AS data_gb FROM files GROUP BY id)"""

SQL = {
    "wer_page": f"""WITH {O.RECORDS}, t AS (SELECT sample_id, {O._tokens("reference")} AS r, {O._tokens("prediction")} AS h FROM rec)
        SELECT sample_id, round({O._word_lev("r", "h")} / greatest(1, len(r)), 6) AS wer FROM t""",
    "page_summary": f"""WITH {O.PAGE_SCORES},
        k AS (SELECT CASE WHEN pred = '' THEN 'empty_prediction' WHEN length_ratio < 0.70 AND cer > 0.25 THEN 'detection_miss_or_too_short'
                    WHEN length_ratio > 1.30 AND cer > 0.25 THEN 'duplicate_or_noise_text' WHEN bow_f1 >= 0.75 AND cer >= 0.30 THEN 'order_issue'
                    WHEN bow_f1 < 0.50 AND length_ratio BETWEEN 0.70 AND 1.30 AND cer >= 0.30 THEN 'recognizer_or_bad_crop_failure'
                    WHEN cer < 0.15 THEN 'acceptable' ELSE 'mixed' END AS kind, count(*) AS n FROM page_scores GROUP BY ALL)
        SELECT count(*) AS page_count, round(avg(cer), 6) AS mean_cer, round(median(cer), 6) AS median_cer, round(avg(bow_f1), 6) AS mean_word_bag_f1,
               round(avg(length_ratio), 6) AS mean_length_ratio, (SELECT string_agg(kind || ':' || n, ',' ORDER BY kind) FROM k) AS types FROM page_scores""",
    "char_ngrams": f"""WITH {O.RECORDS}, t AS (SELECT lower({_N("reference")}) AS t FROM rec), s AS (SELECT t, unnest([1, 3]) AS n FROM t),
        g AS (SELECT n, unnest(CASE WHEN length(t) = 0 THEN [] WHEN length(t) < n THEN [t]
                     ELSE list_transform(range(1, length(t) - n + 2), lambda i: substr(t, i, n)) END) AS gram FROM s)
        SELECT n, gram, count(*) AS count FROM g GROUP BY ALL""",
    "group_text": f"""WITH {O.RECORDS}, t AS (SELECT source_page_id AS page_id, pos, CASE WHEN line_no % 4 <> 3 THEN {_N("prediction")} ELSE '' END AS p FROM rec)
        SELECT page_id, md5(coalesce(string_agg(p, chr(10) ORDER BY pos) FILTER (p <> ''), '')) AS digest, count(*) AS crop_count FROM t GROUP BY page_id""",
    "model_statuses": f"""WITH {O.RECORDS}, c AS (SELECT DISTINCT lang AS id FROM documents WHERE lang IS NOT NULL),
        h AS (SELECT language AS id, count(*) AS n FROM rec WHERE language <> 'fr' GROUP BY ALL)
        SELECT id, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN 'completed' ELSE 'failed' END AS status FROM c LEFT JOIN h USING (id)""",
    "keep_first": f"WITH {O.RECORDS} SELECT language, layout_type, min(pos) AS pos, arg_min(sample_id, pos) AS sample_id FROM rec GROUP BY language, layout_type",
    "nested_samples": f"""WITH {O.RECORDS},
        a AS (SELECT sample_id, language, row_number() OVER (PARTITION BY language ORDER BY {O._DRAW}, sample_id) AS k FROM rec),
        l AS (SELECT sample_id, language FROM a ORDER BY k, language LIMIT 200),
        b AS (SELECT sample_id, language, row_number() OVER (PARTITION BY language ORDER BY {O._DRAW}, sample_id) AS k FROM l),
        s AS (SELECT sample_id, language FROM b ORDER BY k, language LIMIT 60)
        SELECT sample_id, language, 'large' AS sample FROM l UNION ALL SELECT sample_id, language, 'small' FROM s""",
    "latency_stats": f"""WITH {O.RECORDS}, t AS (SELECT (conv_id * 13 + turn * 7 + line_no) % 97 + 0.5::DOUBLE AS x FROM rec)
        SELECT round(avg(x), 6) AS mean, quantile_cont(x, 0.5) AS p50, round(quantile_cont(x, 0.95), 6) AS p95, min(x) AS min, max(x) AS max FROM t""",
    "export_gate": f"""WITH {O.SCORED} SELECT degradation_profile, 'PASS' AS status, round(avg(cer), 6) AS val_rec_cer FROM scored
        GROUP BY degradation_profile HAVING avg(cer) <= 0.45""",
    "evaluable_zones": f"""WITH {O.BOXES}, z AS (SELECT zone_id, text, split_part(zone_id, ':', 2)::INT AS turn FROM zones),
        k AS (SELECT zone_id, CASE turn % 4 WHEN 1 THEN 'figure' WHEN 2 THEN NULL WHEN 3 THEN 'table_cell' ELSE 'zone' END AS crop_type,
                     CASE WHEN turn % 5 = 0 THEN ' [stamp] ' ELSE text END AS t FROM z)
        SELECT zone_id, crop_type FROM k WHERE coalesce(crop_type, 'zone') IN ('zone', 'table_cell', 'field') AND NOT regexp_matches(trim(t), '^\\[[^\\]]+\\]$')""",
    "text_projections": r"""
        SELECT doc_id, 'set__' || source || '_' || printf('%06d', doc_id) AS page_id,
               CASE WHEN doc_id % 3 = 0 THEN 'a.tar::' || source || '.png' ELSE source END AS image,
               CASE WHEN doc_id % 2 <> 0 THEN coalesce(nullif(NULL, ''), nullif(lang, ''), 'unknown') ELSE coalesce(nullif(lang, ''), 'unknown') END AS filled,
               CASE WHEN doc_id % 4 < 2 THEN 'table_cell' WHEN contains(lower(coalesce(source, '')), 'cell') OR contains(lower(coalesce(source, '')), 'table') THEN 'table_cell' ELSE 'zone' END AS crop_type,
               CASE WHEN doc_id % 5 = 0 THEN true ELSE regexp_matches(trim(substr(text, 1, 200), ' '), '^\[[^\]]+\]$') END AS structural,
               length(text) - length(replace(text, 'e', '')) AS e_count,
               md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped,
               coalesce(regexp_matches(source, '(?s)^.*1$'), false) OR coalesce(regexp_matches(lang, '(?s)^[a-f].*$'), false)
                   OR coalesce(regexp_matches(lang, '(?s)^.*1$'), false) OR coalesce(regexp_matches(source, '(?s)^[a-f].*$'), false) AS matches,
               CASE WHEN doc_id % 2 = 0 THEN '/data/' || source ELSE 'own/' || source END AS place
        FROM documents""",
    "tagged_arrays": """
        WITH t AS (SELECT conv_id, turn, text, turn % 3 AS k FROM conversations)
        SELECT conv_id, md5(coalesce(arg_max(text, turn) FILTER (k = 0), '')) AS prompt, md5(coalesce(arg_max(text, turn) FILTER (k = 1), '')) AS reference,
               md5(coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (k <> 0 AND coalesce(text, '') <> ''), '')) AS page_reference
        FROM t GROUP BY conv_id""",
    "box_functions": f"""WITH {O.BOXES},
        c AS (SELECT line_id, x1, y1, x2, y2, greatest(0, floor(x1) - 2)::INT AS cx1, greatest(0, floor(y1) - 2)::INT AS cy1,
                     least(450, ceil(x2) + 2)::INT AS cx2, least(300, ceil(y2) + 2)::INT AS cy2 FROM boxes)
        SELECT line_id, greatest(1, x2 - x1) AS width, greatest(1, y2 - y1) AS height, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy,
               round(greatest(0, least(x2, 400) - greatest(x1, 50)) / least(greatest(1, x2 - x1), 350), 6) AS x_overlap,
               round(greatest(0, least(y2, 90) - greatest(y1, 40)) / least(greatest(1, y2 - y1), 50), 6) AS y_overlap,
               x2 AS made_x2, CASE WHEN x1 > 100 THEN y2 ELSE y1 END AS made_y2,
               CASE WHEN cx2 > cx1 AND cy2 > cy1 THEN cx1 END AS crop_x1, CASE WHEN cx2 > cx1 AND cy2 > cy1 THEN cx2 END AS crop_x2,
               CASE WHEN cx2 > cx1 AND cy2 > cy1 THEN cy2 END AS crop_y2 FROM c""",
    "manifest_checks": f"WITH {_MANIFEST} SELECT sample_id, missing FROM lacks WHERE missing <> ''",
    "manifest_files": f"WITH {_MANIFEST} SELECT sample_id, image_path, md5(t) AS digest, {_BUCKET.format('t')} AS text_length_bucket FROM good",
    "prediction_files": f"""WITH {O.RECORDS} SELECT sample_id, md5(prediction) AS digest, score, line_no * 1.5::DOUBLE AS latency_ms, language,
        'unknown' AS crop_type FROM rec""",
    "label_files": f"""WITH {_MANIFEST} SELECT sample_id, image_path, md5(t) AS digest, 'unknown' AS language, {_BUCKET.format('t')} AS text_length_bucket FROM good""",
    "csv_files": """SELECT conv_id, turn, md5('"' || text) AS digest FROM conversations WHERE role = 'user'""",
    "count_files": f"WITH {O.RECORDS} SELECT layout_type, count(*) AS count FROM rec GROUP BY layout_type",
    "metric_documents": f"""WITH {O.SCORED} SELECT language, {O._columns(["val_rec_cer", "val_rec_count"])},
        'epoch_' || (list_position({list(O.R.LANGUAGES)}, language) - 1) AS checkpoint FROM scored GROUP BY language""",
    "union_columns": f"""WITH {O.RECORDS} SELECT language, NULL AS layout_type, count(*) AS n, NULL::DOUBLE AS score FROM rec GROUP BY language
        UNION ALL SELECT NULL, layout_type, NULL, round(avg(score), 6) FROM rec GROUP BY layout_type""",
    "union_models": f"""WITH {O.RECORDS} SELECT sample_id, score, 'low' AS dataset, NULL::BOOLEAN AS best FROM rec WHERE score < 0.2
        UNION ALL SELECT sample_id, score, 'high', true FROM rec WHERE score > 0.9""",
    "union_shards": f"""WITH {O.RECORDS} SELECT sample_id, pos, 0 AS shard FROM rec WHERE pos % 3 = 1 UNION ALL SELECT sample_id, pos, 1 FROM rec WHERE pos % 3 = 0""",
    "leaderboard_file": f"WITH {_BOARD} SELECT *, 'completed' AS status, NULL::VARCHAR AS val_rec_chrf, NULL::VARCHAR AS error FROM board",
    "checkpoint_keys": """
        SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'epoch_' || doc_id || '.pth' WHEN 1 THEN 'latest.pth' ELSE 'best_' || doc_id END AS checkpoint,
               CASE doc_id % 3 WHEN 0 THEN doc_id WHEN 1 THEN 1000000000000 ELSE 100000000000 END AS key FROM documents""",
    "rename_metrics": f"""WITH {O.SCORED}, s AS (SELECT layout_type, avg(cer) AS cer, CASE WHEN layout_type <> 'forms' THEN avg(rare_char_cer) END AS rare
                          FROM scored GROUP BY layout_type)
        SELECT layout_type, round(cer, 6) AS cer, round(coalesce(rare, 0.25), 6) AS rare, 14.5::DOUBLE AS latency,
               CASE WHEN rare IS NULL THEN 'rare,latency' ELSE 'latency' END AS defaulted FROM s""",
    "echo_predictions": f"""WITH {O.RECORDS} SELECT count(*)::DOUBLE AS val_rec_count, 0.0::DOUBLE AS val_rec_cer, 0.0::DOUBLE AS val_rec_cer_micro,
        0.0::DOUBLE AS val_rec_wer, 1.0::DOUBLE AS val_rec_exact_match FROM rec""",
    "predict_batches": f"""WITH {O.RECORDS} SELECT sample_id AS image_url, md5(CASE WHEN sample_id LIKE '%:3' THEN '' ELSE reference || '!' END) AS digest,
        CASE WHEN sample_id LIKE '%:3' THEN 'ValueError: no such image' END AS error FROM rec WHERE language = 'en'""",
    "inference_summary": f"""WITH {O.RECORDS} SELECT count(*) AS count, round(sum(line_no + 0.25), 6)::DOUBLE AS elapsed_ms, round(avg(line_no + 0.25), 6) AS latency_per_row_ms,
        count(*) FILTER (turn % 4 = 0) AS failed FROM rec""",
    "oracle_summary": f"""WITH {O.BOXES},
        z AS (SELECT *, zone_id NOT LIKE '%:1' AS has, {_N("replace(text, 'a', 'o')")} AS t FROM zones),
        p AS (SELECT page_id, {_N("max(text)")} AS r, coalesce(string_agg(t, chr(10) ORDER BY given IS NULL, coalesce(given, (zy1 + zy2) / 2),
                     CASE WHEN given IS NULL THEN zx1 + zx2 END, zone_id) FILTER (has AND t <> ''), '') AS h, count(*) AS n, sum((NOT has)::INT) AS bad
              FROM z GROUP BY page_id),
        q AS (SELECT *, {_N("h")} AS hn FROM p)
        SELECT count(*) AS page_count, sum(n)::BIGINT AS crop_count, round(avg((r = hn)::INT), 6) AS exact_match,
               round(avg(length(hn) / greatest(1, length(r))), 6) AS length_ratio, round(avg((hn = '')::INT), 6) AS empty_prediction_rate,
               round(sum(bad) / sum(n), 6) AS failed_zone_rate FROM q""",
    "model_pages": f"""WITH {O.RECORDS},
        g AS (SELECT conv_id, source_page_id AS page_id, min(reference) AS gt, row_number() OVER (ORDER BY conv_id) - 1 AS k FROM rec GROUP BY conv_id, source_page_id),
        t AS (SELECT 'a' AS model, page_id, pos, {_N("prediction")} AS p FROM (SELECT source_page_id AS page_id, * FROM rec)
              UNION ALL SELECT 'b', source_page_id, pos, {_N("reference")} FROM rec WHERE turn = 0),
        l AS (SELECT page_id, model, string_agg(p, chr(10) ORDER BY pos) FILTER (p <> '') AS p FROM t GROUP BY ALL),
        m AS (SELECT page_id, gt, model FROM g, (SELECT unnest(['a', 'b']) AS model))
        SELECT page_id, model, 'pipeline_line' AS eval_mode, md5(gt) AS reference, md5(coalesce(p, '')) AS digest FROM m LEFT JOIN l USING (page_id, model)
        UNION ALL SELECT page_id, 'c', 'full_page', md5(gt), md5(CASE WHEN k < 5 THEN 'row ' || k ELSE 'page ' || page_id END) FROM g""",
    "detected_pages": f"""
        WITH w AS (SELECT conv_id AS page_id, string_split(coalesce(text, ''), ' ')[1:3] AS w FROM conversations WHERE turn = 0),
        u AS (SELECT page_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w), n AS (SELECT page_id, i, {_N("reverse(x)")} AS t FROM u)
        SELECT page_id, md5(coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (t <> ''), '')) AS digest, count(*) AS zone_count FROM n GROUP BY page_id""",
    "legacy_summary": f"""WITH {O.SCORED},
        c AS (SELECT *, {O._lev("array_to_string(rw, chr(127))", "array_to_string(hw, chr(127))")} / greatest(1, len(rw)) AS w,
                     1 - edits / greatest(1, length(ref_n), length(hyp_n)) AS ned, {_RARE_SUM(_COUNT("reference"))} AS g, {_RARE_SUM(_COUNT("prediction"))} AS p,
                     {_RARE_SUM(f"least({_COUNT('reference')}, {_COUNT('prediction')})")} AS b FROM scored)
        SELECT count(*) AS count, round(avg(cer), 6) AS cer, round(avg(w), 6) AS wer, round(avg(ned), 6) AS ned_similarity, round(avg(exact_match), 6) AS exact_match,
               round(avg(length_ratio), 6) AS length_ratio, sum(g)::BIGINT AS rare_char_gt_count, sum(p)::BIGINT AS rare_char_predicted_count,
               sum(b)::BIGINT AS rare_char_correct_count, round(avg(cer) FILTER (g > 0), 6) AS rare_char_cer, round(avg((hyp_n = '')::INT), 6) AS empty_prediction_rate,
               round(avg((length_ratio < 0.70)::INT), 6) AS too_short_rate, round(avg((length_ratio > 1.30)::INT), 6) AS too_long_rate FROM c""",
    "metrics_charset": f"""WITH {O.SCORED} SELECT {O._columns(_SUMMARY)}, round(avg(regexp_matches(hyp_n, '[^ -~]')::INT), 6) AS val_rec_invalid_charset_rate FROM scored""",
    "asset_list": """
        WITH a AS (
            SELECT 'a' || doc_id AS id, '/data/x' || doc_id AS local_dir, 'dataset' AS kind, NULL AS role, NULL AS status FROM documents WHERE doc_id % 3 = 0
            UNION ALL SELECT 'a' || doc_id, '/data/x' || doc_id, CASE WHEN doc_id % 4 = 0 THEN 'future_checkpoint' ELSE 'model' END,
                CASE WHEN doc_id % 4 = 0 THEN 'ours' END, CASE WHEN doc_id % 4 = 0 THEN 'pending_training' END FROM documents WHERE doc_id % 3 = 1 AND doc_id % 2 = 0
            UNION ALL SELECT 'a' || doc_id, '/data/x' || doc_id, 'external_benchmark', NULL, NULL FROM documents WHERE doc_id % 3 = 2)
        SELECT * FROM a WHERE id LIKE 'a1%' OR kind = 'dataset' OR role = 'ours'""",
    "asset_sizes": f"WITH {_SIZES} SELECT * FROM sized",
    "asset_statuses": """
        SELECT count(*) AS count, count(*) FILTER (doc_id % 2 = 0) AS metadata_ready, count(*) FILTER (doc_id % 3 = 0) AS weights_ready,
               count(*) FILTER (doc_id % 4 = 0) AS system_dependencies, count(*) FILTER (doc_id % 4 = 1) AS pending_training FROM documents""",
    "phase_plan": f"""WITH {_SIZES}, p AS (SELECT * FROM (VALUES ('p0', 0, ['en', 'xx']), ('p1', 1, ['de']), ('p2', 2, ['fr', 'es']), ('p3', 3, [])) v(phase, phase_pos, ids)),
        t AS (SELECT phase, phase_pos::BIGINT AS phase_pos, round_even(coalesce((SELECT sum(total_gb) FROM sized WHERE list_contains(ids, id)), 0), 3) AS estimated_gb FROM p)
        SELECT *, round_even(sum(estimated_gb) OVER (ORDER BY phase_pos), 3) AS cumulative FROM t""",
    "disk_fit": f"WITH {_SIZES}, t AS (SELECT sum(total_gb) AS total_gb FROM sized) SELECT round(total_gb, 6) AS total_gb, round(10000.0::DOUBLE - total_gb, 6) AS left_gb, 10000.0 - total_gb >= 5 AS fits FROM t",
    "fixed_size_sample": f"WITH {O.RECORDS} SELECT sample_id, pos FROM rec ORDER BY {O._DRAW}, sample_id LIMIT 50",
    "split_rows": f"WITH {O.RECORDS} SELECT sample_id, pos, row_number() OVER (ORDER BY pos) - 1 AS _index, 'validation' AS _split FROM rec ORDER BY pos LIMIT 100",
    "failure_table": f"""WITH {O.SCORED}
        SELECT sample_id AS id, printf('%.6f', cer) AS cer, CASE WHEN cer < 0.05 THEN 'CORRECT'
            WHEN regexp_matches(degradation_profile, 'stamp|official') THEN 'STAMP_INTERFERENCE'
            WHEN regexp_matches(degradation_profile, 'low|dpi|phone|photo') THEN 'LOW_DPI'
            WHEN regexp_matches(layout_type, 'table|transaction') THEN 'TABLE_BOUNDARY'
            WHEN regexp_matches(lower(reference), '[қңәүұ]') AND cer > 0.15 THEN 'MIXED_LANGUAGE'
            WHEN length(prediction) < greatest(5, length(reference) * 0.5) THEN 'FONT_ANOMALY' ELSE 'UNCLASSIFIED' END AS failure_mode FROM scored""",
    "bucket_table": f"""WITH {O.SCORED} SELECT bucket, count(*) AS n, list_position(['short', 'medium', 'long', 'very_long'], bucket) AS bucket_no FROM scored GROUP BY bucket""",
    "checkpoint_watch": f"""WITH {O.SCORED}, s AS (SELECT language, count(*)::DOUBLE AS n, avg(cer) AS cer, avg(exact_match) AS em FROM scored GROUP BY language)
        SELECT language AS checkpoint, n AS val_rec_count, round(cer, 6) AS val_rec_cer, round(em, 6) AS val_rec_exact_match, CASE WHEN cer > 0.25 THEN 'SMOKE_FAIL' WHEN cer > 0.10 THEN 'FAIL' END AS status FROM s""",
}
