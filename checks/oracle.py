"""Oracle SQL (DuckDB) per registered key; same column names as the Spark side."""

from __future__ import annotations

from checks.sqlparts import (ALL_PAIRS, PRED, PROMPTS, REC, RUNS, TEST_PAIRS, f1, ratio,
                             split_cte, suite_cte, suite_scores, tok, bigrams, lcs)

ORACLE: dict[str, str] = {}


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BASE = (REC, RUNS, PRED)
SPLIT = (*BASE, split_cte())

ORACLE["leaderboard"] = with_(*SPLIT, TEST_PAIRS, suite_cte("test_pairs", "run_id, subtask, doc_id")) + f"""
SELECT s.run_id, s.subtask, round(avg(rouge1), 4) AS rouge1, round(avg(rouge2), 4) AS rouge2,
       round(avg(rougeL), 4) AS rougeL, r.model
FROM (SELECT run_id, subtask, {suite_scores()} FROM suite) s LEFT JOIN runs r USING (run_id)
GROUP BY s.run_id, s.subtask, r.model"""

ORACLE["stratified_split"] = with_(*SPLIT) + "SELECT doc_id, lang, split FROM splitted"

ORACLE["seeded_order"] = with_(REC) + """
SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id::VARCHAR), doc_id) AS pos
FROM rec"""

ORACLE["split_counts"] = with_(*SPLIT) + "SELECT lang, split, count(*) AS n FROM splitted GROUP BY ALL"

ORACLE["merge_languages"] = with_(*SPLIT) + \
    "SELECT doc_id, lang, split FROM splitted WHERE split IN ('train', 'valid')"

ORACLE["split_leakage"] = with_(*SPLIT) + """
SELECT 'key_overlap' AS "check", (SELECT count(*) FROM (SELECT doc_id FROM splitted GROUP BY doc_id
                                   HAVING count(DISTINCT split) > 1)) AS value
UNION ALL SELECT 'missing', (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM splitted WHERE split IS NOT NULL))
UNION ALL SELECT 'text_leak', (SELECT count(*) FROM splitted t WHERE t.split = 'test'
   AND sha256(t.input) IN (SELECT sha256(input) FROM splitted WHERE split = 'train'))"""

ORACLE["pair_pred_ref"] = with_(*SPLIT, TEST_PAIRS) + \
    "SELECT run_id, doc_id, subtask, output, summary FROM test_pairs"

_LISTS = with_(*BASE) + """, l AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, summary FROM pred WHERE run_id = 1),
r AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS position, text AS output FROM conversations)
"""
ORACLE["pair_by_position"] = _LISTS + "SELECT position, summary, output FROM l JOIN r USING (position)"
ORACLE["pair_by_position_report"] = _LISTS + """, n AS (SELECT (SELECT count(*) FROM l) AS p, (SELECT count(*) FROM r) AS r)
SELECT 'predictions' AS "check", p AS value FROM n UNION ALL SELECT 'references', r FROM n
UNION ALL SELECT 'pairs', least(p, r) FROM n
UNION ALL SELECT 'unpaired_predictions', greatest(p - r, 0) FROM n
UNION ALL SELECT 'unpaired_references', greatest(r - p, 0) FROM n"""

_GROUPS = """WITH h AS (SELECT doc_id, text, sha256('42:' || coalesce(sha256(text), '')) AS h FROM documents),
g AS (SELECT h, sum(count(*)) OVER (ORDER BY h) - count(*) AS start FROM h GROUP BY h),
n AS (SELECT floor(count(*) * 0.8::DOUBLE) AS te, floor(count(*) * 0.8::DOUBLE) + floor(count(*) * 0.01::DOUBLE) AS ve FROM documents),
grouped AS (SELECT doc_id, text, CASE WHEN start < te THEN 'train' WHEN start < ve THEN 'valid' ELSE 'test' END AS split
            FROM h JOIN g USING (h), n)
"""
ORACLE["group_split"] = _GROUPS + "SELECT doc_id, split FROM grouped"
ORACLE["group_split_leakage"] = _GROUPS + """
SELECT 'key_overlap' AS "check", (SELECT count(*) FROM (SELECT doc_id FROM grouped GROUP BY doc_id HAVING count(DISTINCT split) > 1)) AS value
UNION ALL SELECT 'missing', (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM grouped))
UNION ALL SELECT 'text_leak', (SELECT count(*) FROM grouped WHERE split = 'test'
   AND text IN (SELECT text FROM grouped WHERE split = 'train'))"""

ORACLE["split_counts_totals"] = with_(*SPLIT) + """
SELECT lang, split, CAST(grouping(lang) + grouping(split) AS INT) AS level, count(*) AS n FROM splitted GROUP BY ROLLUP (lang, split)"""

ORACLE["run_model_lookup"] = with_(*BASE) + \
    "SELECT p.run_id, p.doc_id, r.model FROM pred p LEFT JOIN runs r USING (run_id)"

ORACLE["run_subtask_grid"] = with_(*SPLIT, TEST_PAIRS) + """
SELECT g.run_id, g.model, g.subtask, coalesce(c.n_records, 0) AS n_records FROM
  (SELECT run_id, model, unnest(['test_en', 'test_es', 'test_fr', 'test_pt']) AS subtask FROM runs) g
  LEFT JOIN (SELECT run_id, subtask, count(*) AS n_records FROM test_pairs GROUP BY ALL) c
  USING (run_id, subtask)"""

_T = with_(*BASE, ALL_PAIRS) + f""", tt AS (SELECT run_id, doc_id, {tok('summary')} AS tp, {tok('output')} AS tr FROM all_pairs)
"""


_MIXED = f"""WITH mixed AS (
  SELECT CAST(0 AS BIGINT) AS run_id, d.doc_id, d.text AS output,
         array_to_string(list_concat(list_reverse(string_split(o.text, '. ')),
                                     list_filter(string_split(d.text, '. '), lambda s, i: (i - 1) % 2 = 0)), '. ') AS summary
  FROM documents d JOIN documents o ON o.doc_id = xor(d.doc_id, 1)),
tt AS (SELECT run_id, doc_id, {tok('summary')} AS tp, {tok('output')} AS tr FROM mixed)
"""


def _overlap_query(n: int, source: str = _T) -> str:
    name = f"rouge{n}"
    grams_p = "tp" if n == 1 else bigrams("tp")
    grams_r = "tr" if n == 1 else bigrams("tr")
    return source + f""", g AS (SELECT run_id, doc_id, {grams_p} AS gp, {grams_r} AS gr FROM tt),
ov AS (SELECT run_id, doc_id, sum(least(cp, cr)) AS o FROM (
    SELECT run_id, doc_id, x, count(*) FILTER (WHERE side = 1) AS cp, count(*) FILTER (WHERE side = 2) AS cr
    FROM (SELECT run_id, doc_id, 1 AS side, unnest(gp) AS x FROM g
          UNION ALL SELECT run_id, doc_id, 2 AS side, unnest(gr) AS x FROM g) u GROUP BY ALL) c GROUP BY ALL)
SELECT g.run_id, g.doc_id,
       {ratio('coalesce(ov.o, 0)', 'len(g.gp)')} AS {name}_precision,
       {ratio('coalesce(ov.o, 0)', 'len(g.gr)')} AS {name}_recall,
       {f1('coalesce(ov.o, 0)', 'len(g.gp)', 'len(g.gr)')} AS {name}
FROM g LEFT JOIN ov USING (run_id, doc_id)"""


ORACLE["rouge1"] = _overlap_query(1)
ORACLE["rouge1_mixed_pairs"], ORACLE["rouge2_mixed_pairs"] = _overlap_query(1, _MIXED), _overlap_query(2, _MIXED)
ORACLE["rouge2"] = _overlap_query(2)

ORACLE["rougeL"] = _T + f"""
SELECT run_id, doc_id, {ratio('o', 'len(tp)')} AS rougeL_precision, {ratio('o', 'len(tr)')} AS rougeL_recall,
       {f1('o', 'len(tp)', 'len(tr)')} AS rougeL
FROM (SELECT *, {lcs('tp', 'tr')} AS o FROM tt) x"""

_SUITE_ALL = with_(*BASE, ALL_PAIRS, suite_cte("all_pairs", "run_id, doc_id"))

ORACLE["metric_suite_long"] = _SUITE_ALL + f"""
UNPIVOT (SELECT run_id, doc_id, {suite_scores()} FROM suite)
ON rouge1, rouge2, rougeL INTO NAME metric VALUE score"""

ORACLE["mean_scores"] = _SUITE_ALL + f"""
SELECT run_id, metric, round(avg(score), 4) AS score, count(*) AS n FROM (
  UNPIVOT (SELECT run_id, doc_id, {suite_scores()} FROM suite)
  ON rouge1, rouge2, rougeL INTO NAME metric VALUE score) GROUP BY ALL"""


# ------------------------------------------------------------------ P
from checks.sqlparts import EXTRACT, SUMMARIZE, poisson_case, prompt_sql, q  # noqa: E402
from corpusforge.config import RUN_MODELS  # noqa: E402

WS = r"[\t-\r\x{1c}-\x{1f}\x{85}\p{Z}]"

PREPARED = """prepared AS (
  SELECT doc_id, lang,
         CASE WHEN split IN ('train', 'valid') THEN substring(input, 1, 2560) ELSE input END AS input,
         CASE WHEN split IN ('train', 'valid') THEN substring(output, 1, 512) ELSE output END AS output,
         CASE WHEN split = 'test' THEN NULL ELSE rationale END AS rationale,
         NULL::VARCHAR AS rationale_prompt, split
  FROM splitted)"""

ORACLE["drop_column_strict"] = with_(REC) + "SELECT doc_id, lang, input, output, rationale_prompt FROM rec"

ORACLE["drop_by_split"] = with_(*SPLIT) + """
SELECT doc_id, split, CASE WHEN split = 'test' THEN NULL ELSE rationale END AS rationale,
       NULL::VARCHAR AS rationale_prompt FROM splitted"""

ORACLE["crop_fields"] = with_(*SPLIT) + """
SELECT doc_id, split,
       CASE WHEN split IN ('train', 'valid') THEN substring(input, 1, 2560) ELSE input END AS input,
       CASE WHEN split IN ('train', 'valid') THEN substring(output, 1, 512) ELSE output END AS output
FROM splitted"""

ORACLE["field_or_empty"] = with_(*SPLIT) + """
SELECT doc_id, split, (CASE WHEN split = 'test' THEN 0 ELSE length(rationale) END)::BIGINT AS n_chars FROM splitted"""

ORACLE["rename_task_fields"] = with_(REC) + "SELECT doc_id, rationale_prompt AS input, rationale AS output FROM rec"

ORACLE["summary_file_name"] = """
SELECT doc_id, filepath, string_split(string_split(filepath, '/')[-1], '.')[-2] || '_sum.txt' AS out_name
FROM (SELECT doc_id, 'casesum_test_' || lang || '/' || source || '.' || doc_id::VARCHAR || '.txt' AS filepath
      FROM documents)"""

ORACLE["subtask_lang"] = """
SELECT doc_id, subtask, string_split(subtask, '_')[-1] AS lang
FROM (SELECT doc_id, 'casesum_test_' || lang AS subtask FROM documents)"""

ORACLE["domain_violations"] = with_(*BASE) + f""", p AS (
  SELECT p.doc_id, p.run_id, 'test_' || d.lang AS subtask FROM pred p JOIN documents d USING (doc_id))
SELECT doc_id, run_id, 'run_id' AS field, run_id::VARCHAR AS value FROM p
  WHERE run_id IS NULL OR run_id NOT IN ({', '.join(str(k) for k in sorted(RUN_MODELS))})
UNION ALL
SELECT doc_id, run_id, 'subtask' AS field, subtask AS value FROM p
  WHERE subtask IS NULL OR subtask NOT IN ('test_en', 'test_es', 'test_fr', 'test_pt')"""

# ------------------------------------------------------------------ F
SANITIZE = f"trim(regexp_replace(text, '{WS}+', ' ', 'g'))"

ORACLE["sanitize_text"] = f"SELECT doc_id, {SANITIZE} AS clean FROM documents"

_TYPES = r"""WITH raw AS (
  SELECT lang, unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents),
tok AS (SELECT lang, lower(regexp_replace(regexp_replace(w, '^[^\p{L}\p{N}]+', ''), '[^\p{L}\p{N}.]+$', '')) AS w FROM raw),
typ AS (SELECT lang, ends_with(w, '.') AS dot, regexp_replace(w, '[.]+$', '') AS t FROM tok),
cnt AS (SELECT lang, CASE WHEN regexp_full_match(t, '[0-9]+') THEN '##number##' ELSE t END AS type,
               count(*) FILTER (dot) AS with_dot, count(*) FILTER (NOT dot) AS without_dot
        FROM typ WHERE t <> '' GROUP BY 1, 2),
tot AS (SELECT lang, sum(with_dot)::DOUBLE AS d, sum(with_dot + without_dot)::DOUBLE AS n FROM cnt GROUP BY lang)
"""
ORACLE["sentence_type_scores"] = _TYPES + """
SELECT cnt.lang, type, with_dot, without_dot,
       round(-2 * ((with_dot * ln(d / n) + without_dot * ln(greatest(1 - d / n, 1e-9::DOUBLE)))
                   - (with_dot * ln(0.99::DOUBLE) + without_dot * ln(0.01::DOUBLE)))
             * exp(-length(replace(type, '.', ''))) * (length(type) - length(replace(type, '.', '')) + 1)
             * pow(length(replace(type, '.', ''))::DOUBLE, -without_dot), 4) + 0.0::DOUBLE AS score
FROM cnt JOIN tot ON cnt.lang IS NOT DISTINCT FROM tot.lang WHERE with_dot > 0"""

ORACLE["sentence_lines"] = f"""
SELECT doc_id, regexp_replace({SANITIZE}, '([.!?]) +', '\\1' || chr(10), 'g') AS lines FROM documents"""

ORACLE["render_training_prompt"] = with_(REC) + f"""
SELECT doc_id, {prompt_sql(SUMMARIZE, 'input', 'output')} AS prompt,
       {prompt_sql(EXTRACT, 'input', 'rationale')} AS prompt_expl FROM rec"""

_LOC = with_(REC, PROMPTS) + f""", loc AS (
  SELECT r.doc_id, r.lang, r.input, coalesce(p.instruction, {SUMMARIZE}) AS instruction
  FROM rec r LEFT JOIN prompts p USING (lang))
"""

ORACLE["render_inference_prompt"] = _LOC + "SELECT doc_id, lang, instruction || ': ' || input AS prompt FROM loc"

ORACLE["localised_prompt"] = _LOC + "SELECT doc_id, lang, instruction FROM loc"

ORACLE["prompt_prefix"] = with_(REC) + f""", pr AS (SELECT doc_id, {prompt_sql(SUMMARIZE, 'input', 'output')} AS prompt FROM rec)
SELECT doc_id, CASE WHEN position('<|im_start|>assistant' IN prompt) > 0
  THEN substring(prompt, 1, position('<|im_start|>assistant' IN prompt) - 1) END AS prefix FROM pr"""

ORACLE["marker_in_text"] = "SELECT doc_id FROM documents WHERE position('<|im_start|>' IN text) > 0"

ORACLE["build_chat_request"] = _LOC + f"""
SELECT doc_id, to_json({{'model': {q(RUN_MODELS[1])}, 'messages': [{{'role': 'user', 'content': instruction || ': ' || input}}]}})::VARCHAR AS body
FROM loc"""

ORACLE["parse_chat_response"] = f"""
WITH r AS (
  SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN '{{}}'
    ELSE to_json({{'choices': [{{'message': {{'content': ' ' || d.text || ' ' || chr(10)}}}}]}})::VARCHAR END AS reply
  FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, regexp_replace(json_extract_string(reply, '$.choices[0].message.content'),
                              '^{WS}+|{WS}+$', '', 'g') AS content
FROM r WHERE json_extract_string(reply, '$.choices[0].message.content') IS NOT NULL"""

ORACLE["parse_chat_rejects"] = """
SELECT d.doc_id, '{}' AS reply FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1 OR d.text IS NULL"""

ORACLE["rouge_tokens"] = f"""
SELECT doc_id, array_to_string(t, ' ') AS tokens, len(t)::BIGINT AS n_tokens
FROM (SELECT doc_id, {tok('text')} AS t FROM documents)"""

# ------------------------------------------------------------------ A1/A2/W3/O3


def _len_stats(src: str, group: str, expr: str) -> str:
    return f"""
SELECT {group}, count(*) AS count, min(l) AS min, max(l) AS max, round(avg(l), 2) AS mean,
       (list_sort(list(l))[(count(*) - 1) // 2 + 1] + list_sort(list(l))[count(*) // 2 + 1]) / 2.0::DOUBLE AS median,
       list_sort(list(l))[floor(count(*) * 0.9::DOUBLE)::BIGINT + 1] AS percentile_90,
       list_sort(list(l))[floor(count(*) * 0.95::DOUBLE)::BIGINT + 1] AS percentile_95
FROM (SELECT {group}, length({expr})::BIGINT AS l FROM {src} WHERE {expr} IS NOT NULL) GROUP BY ALL"""


ORACLE["length_stats"] = with_(REC) + _len_stats("rec", "lang", "input")

ORACLE["length_report"] = with_(*SPLIT, PREPARED) + """, lr AS (
  SELECT CASE WHEN split = 'test' THEN 'test_' || lang ELSE split END AS dataset, "column", text
  FROM (UNPIVOT (SELECT split, lang, input, output, rationale FROM prepared)
        ON input, output, rationale INTO NAME "column" VALUE text))
""" + _len_stats("lr", 'dataset, "column"', "text")

ORACLE["length_report_totals"] = with_(*SPLIT, PREPARED) + """, lr AS (
  SELECT split, lang, 'input' AS "column", length(input)::BIGINT AS l FROM prepared
  UNION ALL SELECT split, lang, 'output', length(output) FROM prepared
  UNION ALL SELECT split, lang, 'rationale', length(rationale) FROM prepared),
levels AS (
  SELECT 0 AS level, * FROM lr UNION ALL SELECT 1, split, NULL, "column", l FROM lr UNION ALL SELECT 2, NULL, NULL, "column", l FROM lr)
SELECT level, split, lang, "column", count(l) AS count, min(l) AS min, max(l) AS max, round(avg(l), 2) AS mean,
       (list_sort(list(l) FILTER (l IS NOT NULL))[(count(l) - 1) // 2 + 1]
        + list_sort(list(l) FILTER (l IS NOT NULL))[count(l) // 2 + 1]) / 2.0::DOUBLE AS median,
       list_sort(list(l) FILTER (l IS NOT NULL))[floor(count(l) * 0.9::DOUBLE)::BIGINT + 1] AS percentile_90,
       list_sort(list(l) FILTER (l IS NOT NULL))[floor(count(l) * 0.95::DOUBLE)::BIGINT + 1] AS percentile_95,
       CASE WHEN count(l) = 0 THEN concat('No valid ', chr(39), "column", chr(39), ' fields found.') END AS message
FROM levels GROUP BY level, split, lang, "column" """

ORACLE["rank_percentile"] = """
SELECT lang, count(*) AS count,
       list_sort(list(l))[floor(count(*) * 0.9::DOUBLE)::BIGINT + 1] AS percentile_90,
       list_sort(list(l))[floor(count(*) * 0.95::DOUBLE)::BIGINT + 1] AS percentile_95
FROM (SELECT lang, length(text)::BIGINT AS l FROM documents) GROUP BY lang"""

ORACLE["longest_records"] = with_(*SPLIT, PREPARED) + """
SELECT split, doc_id, n_chars, rank FROM (
  SELECT split, doc_id, length(input)::BIGINT AS n_chars,
         row_number() OVER (PARTITION BY split ORDER BY length(input) DESC, doc_id) AS rank
  FROM prepared) WHERE rank <= 5"""

# ------------------------------------------------------------------ A5-A9, W4/W5, T7
ORACLE["rouge_avg_percent"] = _SUITE_ALL + f"""
SELECT run_id, round(r1 * 100, 4) AS rouge1, round(r2 * 100, 4) AS rouge2, round(rl * 100, 4) AS rougeL,
       round((r1 + r2 + rl) / 3.0::DOUBLE * 100, 4) AS rouge_avg
FROM (SELECT run_id, avg(rouge1) AS r1, avg(rouge2) AS r2, avg(rougeL) AS rl
      FROM (SELECT run_id, doc_id, {suite_scores()} FROM suite) GROUP BY run_id)"""

_LOSS = """losses AS (
  SELECT event_id AS step, value AS lp, value * 0.5 + 1 AS le FROM events)"""

ORACLE["combined_loss"] = with_(_LOSS) + """
SELECT step, round(lp * 0.8 + le * (1.0::DOUBLE - 0.8::DOUBLE), 6) AS loss, round(lp, 6) AS loss_pred,
       round(le, 6) AS loss_expl FROM losses"""

ORACLE["training_log_long"] = with_(_LOSS) + """
SELECT step, name, round(value, 6) AS value FROM (
  UNPIVOT (SELECT step, lp * 0.8 + le * (1.0::DOUBLE - 0.8::DOUBLE) AS "train/loss", lp AS "train/loss_pred",
                  le AS "train/loss_expl" FROM losses)
  ON "train/loss", "train/loss_pred", "train/loss_expl" INTO NAME name VALUE value)"""

ORACLE["token_accuracy"] = """
SELECT avg(hit) AS accuracy, sum(hit) FILTER (WHERE label <> -100) / count(*) FILTER (WHERE label <> -100) AS accuracy_ignore_index,
       count(*) AS positions
FROM (SELECT label, (list_position(embedding, list_max(embedding)) - 1 = label)::INTEGER AS hit FROM embeddings)"""

ORACLE["token_accuracy_shift"] = """
SELECT avg(hit) AS accuracy, sum(hit) FILTER (WHERE l <> -100) / count(*) FILTER (WHERE l <> -100) AS accuracy_ignore_index,
       count(*) AS positions
FROM (SELECT l, (a = l)::INTEGER AS hit FROM (
  SELECT list_position(embedding, list_max(embedding)) - 1 AS a,
         lead(label) OVER (PARTITION BY vec_id // 50 ORDER BY vec_id) AS l FROM embeddings) WHERE l IS NOT NULL)"""

ORACLE["training_log_full"] = with_(_LOSS) + """, c AS (SELECT step, lp * 0.8 + le * (1.0::DOUBLE - 0.8::DOUBLE) AS lo, lp, le FROM losses)
SELECT step, name, round(value, 6) AS value FROM (
  SELECT step, 'train/loss' AS name, lo AS value FROM c UNION ALL SELECT step, 'train/loss_pred', lp FROM c
  UNION ALL SELECT step, 'train/loss_expl', le FROM c
  UNION ALL SELECT step, 'train/pred_accuracy', lp - floor(lp) FROM c UNION ALL SELECT step, 'train/expl_accuracy', le - floor(le) FROM c
  UNION ALL SELECT event_id, 'learning_rate', 1e-5 / (event_id + 1) FROM events
  UNION ALL SELECT step, 'eval/loss', lo FROM c WHERE step % 250 = 0 UNION ALL SELECT step, 'eval/loss_pred', lp FROM c WHERE step % 250 = 0
  UNION ALL SELECT step, 'eval/loss_expl', le FROM c WHERE step % 250 = 0)"""

ORACLE["result_log_roundtrip"] = ORACLE["leaderboard"]

_EVALS = """evals AS (
  SELECT run, step, metric FROM (
    SELECT event_type AS run, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step,
           value AS metric FROM events)
  WHERE step >= 1 AND step % 250 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY metric DESC, step ASC) AS br,
         max(step) OVER (PARTITION BY run) AS last_step, count(*) OVER (PARTITION BY run) AS n_evals
  FROM evals)"""

ORACLE["best_checkpoint"] = with_(_EVALS) + \
    "SELECT run, step AS best_step, metric AS best_metric, n_evals FROM ranked WHERE br = 1"

ORACLE["retained_checkpoints"] = with_(_EVALS) + """
SELECT run, step, step = last_step AS is_last, br = 1 AS is_best FROM ranked WHERE br = 1 OR step = last_step"""

ORACLE["logits_argmax"] = """
SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS pred_id, label FROM embeddings"""


# ------------------------------------------------------------------ T
def pieces(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '(<\\|im_start\\|>|<\\|im_end\\|>|[a-z0-9]+)', 1)"


def prefix_sql(p: str) -> str:
    return (f"CASE WHEN position('<|im_start|>assistant' IN {p}) > 0 "
            f"THEN substring({p}, 1, position('<|im_start|>assistant' IN {p}) - 1) END")


MAXIN, MAXOUT = 3078, 762


def pad_sql(ids: str, n: int) -> str:
    return f"list_concat(({ids})[1:{n}], list_transform(range(greatest({n} - len({ids}), 0)), lambda x: 0))"


def mask_sql(ids: str, n: int) -> str:
    return (f"list_concat(list_transform(range(least(len({ids}), {n})), lambda x: 1), "
            f"list_transform(range(greatest({n} - len({ids}), 0)), lambda x: 0))")


def ids_str(x: str) -> str:
    return f"array_to_string({x}, ',')"


def _enc_ctes(task_instr: str = SUMMARIZE, answer: str = "output", name: str = "pc") -> str:
    return f"""{name}_pr AS (SELECT doc_id, lang, {prompt_sql(task_instr, 'input', answer)} AS prompt FROM rec),
{name} AS (SELECT doc_id, lang, {pieces('prompt')} AS p, len({pieces(prefix_sql('prompt'))}) AS prefix_len FROM {name}_pr)"""


VOCAB_ALL = """vocab AS (
  SELECT token, (row_number() OVER (ORDER BY n DESC, token) + 3)::BIGINT AS id, n FROM (
    SELECT token, count(*) AS n FROM (SELECT unnest(p) AS token FROM pc)
    WHERE token NOT IN ('<|im_start|>', '<|im_end|>') GROUP BY token))"""

VOCAB = """vocab AS (
  SELECT token, (row_number() OVER (ORDER BY n DESC, token) + 3)::BIGINT AS id, n FROM (
    SELECT token, count(*) AS n FROM (SELECT unnest(p) AS token FROM pc)
    WHERE token NOT IN ('<|im_start|>', '<|im_end|>') GROUP BY token)
  ORDER BY n DESC, token LIMIT 5000)"""


def enc_cte(src: str, name: str) -> str:
    return f"""{name} AS (
  SELECT s.doc_id, coalesce(e.ids, []::INTEGER[]) AS ids FROM {src} s LEFT JOIN (
    SELECT doc_id, list(coalesce(CASE WHEN tok = '<|im_start|>' THEN 2 WHEN tok = '<|im_end|>' THEN 3 END,
                                 v.id, 1)::INTEGER ORDER BY pos) AS ids
    FROM (SELECT doc_id, unnest(p) AS tok, generate_subscripts(p, 1) AS pos FROM {src}) t
    LEFT JOIN vocab v ON v.token = t.tok GROUP BY doc_id) e USING (doc_id))"""


_TOK = with_(REC, _enc_ctes(), VOCAB_ALL, enc_cte("pc", "enc")) + f""", padded AS (
  SELECT e.doc_id, pc.lang, pc.prefix_len, len(e.ids) AS n, {pad_sql('e.ids', MAXIN)} AS input_ids,
         {mask_sql('e.ids', MAXIN)} AS attention_mask
  FROM enc e JOIN pc USING (doc_id)),
labelled AS (
  SELECT *, list_transform(input_ids, lambda x, i: CASE WHEN i <= least(prefix_len, {MAXIN}) THEN -100 ELSE x END) AS labels
  FROM padded)
"""

ORACLE["build_vocabulary"] = with_(REC, _enc_ctes(), VOCAB) + "SELECT token, id, n FROM vocab"

ORACLE["encode_tokens"] = _TOK + f"SELECT doc_id, len(ids)::BIGINT AS n_ids, {ids_str('ids')} AS ids FROM enc"

ORACLE["pad_truncate"] = _TOK + \
    f"SELECT doc_id, {ids_str('input_ids')} AS input_ids, {ids_str('attention_mask')} AS attention_mask FROM padded"

ORACLE["mask_labels"] = _TOK + f"""
SELECT doc_id, {ids_str('labels')} AS labels_prompt,
       {ids_str('list_transform(input_ids, lambda x: -100)')} AS labels_as_written,
       {ids_str('list_transform(input_ids, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END)')} AS labels_full
FROM labelled"""

ORACLE["unmask_labels"] = _TOK + \
    f"SELECT doc_id, {ids_str('list_transform(labels, lambda x: CASE WHEN x = -100 THEN 0 ELSE x END)')} AS ids FROM labelled"

ORACLE["decode_tokens"] = _TOK + """, um AS (
  SELECT doc_id, list_transform(labels, lambda x: CASE WHEN x = -100 THEN 0 ELSE x END) AS u FROM labelled)
SELECT um.doc_id, coalesce(d.text, '') AS text FROM um LEFT JOIN (
  SELECT doc_id, string_agg(v.token, ' ' ORDER BY pos) AS text FROM (
    SELECT doc_id, unnest(u) AS id, generate_subscripts(u, 1) AS pos FROM um) t
  JOIN vocab v ON v.id = t.id WHERE t.id >= 4 GROUP BY doc_id) d USING (doc_id)"""

ORACLE["truncation_audit"] = with_(REC, _enc_ctes()) + f"""
SELECT lang, count(*) AS records, sum(ans)::BIGINT AS answer_tokens, sum(kept)::BIGINT AS kept_tokens,
       sum(ans - kept)::BIGINT AS lost_tokens, count(*) FILTER (WHERE kept < ans) AS truncated_records,
       count(*) FILTER (WHERE kept = 0 AND ans > 0) AS answer_fully_lost
FROM (SELECT lang, greatest(len(p) - prefix_len, 0) AS ans,
             greatest(least(len(p), {MAXIN}) - prefix_len, 0) AS kept FROM pc) GROUP BY lang"""

ORACLE["two_task_examples"] = with_(REC, _enc_ctes(), _enc_ctes(EXTRACT, "rationale", "px")) + f"""
SELECT doc_id, 'pred' AS task, len(p)::BIGINT AS n_tokens, prefix_len::BIGINT AS prefix_len,
       ({MAXIN} - least(prefix_len, {MAXIN}))::BIGINT AS n_label_tokens, least(len(p), {MAXIN})::BIGINT AS n_input_tokens
FROM pc
UNION ALL
SELECT doc_id, 'expl', len(p)::BIGINT, prefix_len::BIGINT, ({MAXIN} - least(prefix_len, {MAXIN}))::BIGINT,
       least(len(p), {MAXIN})::BIGINT FROM px"""

ORACLE["select_mode_columns"] = _TOK + f"""
SELECT doc_id, {ids_str('input_ids')} AS input_ids, {ids_str('attention_mask')} AS attention_mask,
       {ids_str('labels')} AS labels FROM labelled"""

ORACLE["mean_nonpad_len"] = with_(*BASE, ALL_PAIRS) + f"""
SELECT run_id, avg(least(len({pieces('summary')}), {MAXOUT})) AS mean_generated_len,
       avg(least(len({pieces('output')}), {MAXOUT})) AS mean_reference_len
FROM all_pairs GROUP BY run_id"""


# ------------------------------------------------------------------ S / J1 / I
CASES = "SELECT doc_id, lang, 'case_' || doc_id::VARCHAR || '.txt' AS filename, text FROM documents"
NORM = "regexp_replace(text, '\\r\\n?', chr(10), 'g')"

ORACLE["scan_json_records"] = with_(REC) + "SELECT doc_id, input, output, rationale, rationale_prompt FROM rec"
ORACLE["scan_manifest_lang"] = with_(REC) + "SELECT doc_id, lang FROM rec"
ORACLE["scan_text_folder"] = f"SELECT filename, {NORM} AS input FROM ({CASES})"
ORACLE["scan_text_folder_utf16"] = ORACLE["scan_text_folder"]
ORACLE["load_train_valid"] = with_(*SPLIT) + "SELECT doc_id, lang, split FROM splitted WHERE split IN ('train', 'valid')"
ORACLE["sink_splits_roundtrip"] = with_(*SPLIT) + "SELECT split, lang, count(*) AS n FROM splitted GROUP BY ALL"
ORACLE["scan_predictions"] = with_(*BASE) + """
SELECT p.doc_id, p.summary FROM pred p JOIN documents d USING (doc_id) WHERE d.lang = 'en' AND p.run_id = 2"""
ORACLE["sink_json_roundtrip"] = with_(REC) + "SELECT doc_id, lang, input, output, rationale FROM rec"
ORACLE["sink_submission_roundtrip"] = with_(*BASE) + """
SELECT p.run_id, d.lang, 'case_' || p.doc_id::VARCHAR || '_sum.txt' AS out_name, p.summary
FROM pred p JOIN documents d USING (doc_id)"""

DONE = "SELECT 'case_' || doc_id::VARCHAR || '_sum.txt' AS out_name FROM labels WHERE quality = 1"

ORACLE["resume_anti_join"] = f"""
SELECT doc_id, filename FROM ({CASES}) c
WHERE 'case_' || doc_id::VARCHAR || '_sum.txt' NOT IN ({DONE})"""

_ANN = f"substring({EXTRACT} || ': ' || input, 1, 256)"
ORACLE["annotate_records"] = with_(REC) + f"""
SELECT doc_id, {_ANN} AS rationale, {EXTRACT} || ': ' || input AS rationale_prompt FROM rec"""

ORACLE["annotate_records_concurrent"] = ORACLE["annotate_records"]

ORACLE["annotate_rejects"] = with_(REC) + f"""
SELECT doc_id, 'ValueError: prompt too long' AS error, 3::BIGINT AS attempts FROM rec
WHERE length({EXTRACT} || ': ' || input) > 20000"""

ORACLE["annotate_chain"] = with_(REC) + f"""
SELECT doc_id, r AS rationale, substring({SUMMARIZE} || ': ' || r, 1, 256) AS summary
FROM (SELECT doc_id, {_ANN} AS r FROM rec)"""

ORACLE["annotate_chain_rejects"] = with_(REC) + f"""
SELECT doc_id, 'rationale: ValueError: prompt too long' AS error, 3::BIGINT AS attempts FROM rec
WHERE length({EXTRACT} || ': ' || input) > 20000"""

ORACLE["predict_and_score"] = with_(*SPLIT, PROMPTS) + f""", said AS (
  SELECT r.run_id, 'test_' || s.lang AS subtask, s.doc_id, s.output,
         substring(coalesce(p.instruction, {SUMMARIZE}) || ': ' || s.input, 1, (256 * r.run_id)::INTEGER) AS summary
  FROM splitted s CROSS JOIN runs r LEFT JOIN prompts p ON p.lang = s.lang WHERE s.split = 'test'),
""" + suite_cte("said", "run_id, subtask, doc_id") + f"""
SELECT s.run_id, s.subtask, round(avg(rouge1), 4) AS rouge1, round(avg(rouge2), 4) AS rouge2, r.model
FROM (SELECT run_id, subtask, {suite_scores()} FROM suite) s LEFT JOIN runs r USING (run_id) GROUP BY s.run_id, s.subtask, r.model"""

ORACLE["reannotate"] = with_(REC) + f"""
SELECT doc_id, lang, input, output, {_ANN} AS rationale, {EXTRACT} || ': ' || input AS rationale_prompt FROM rec"""

ORACLE["summarise_resume"] = f"""
SELECT replace(filename, '.txt', '_sum.txt') AS out_name, substring({SUMMARIZE} || ': ' || {NORM}, 1, 256) AS summary
FROM ({CASES}) c WHERE lang = 'en' AND 'case_' || doc_id::VARCHAR || '_sum.txt' NOT IN ({DONE})"""


# ------------------------------------------------------------------ G / A10 / M5
ORACLE["stream_annotate"] = with_(REC) + f"SELECT doc_id, {_ANN} AS rationale FROM rec"
ORACLE["stream_dedup"] = "SELECT doc_id, lang FROM documents"
ORACLE["stream_leaderboard"] = with_(*SPLIT, TEST_PAIRS, suite_cte("test_pairs", "run_id, subtask, doc_id")) + f"""
SELECT run_id, subtask, round(avg(rouge1), 4) AS rouge1, round(avg(rouge2), 4) AS rouge2, round(avg(rougeL), 4) AS rougeL
FROM (SELECT run_id, subtask, {suite_scores()} FROM suite) GROUP BY ALL"""

_U = "('0x' || substr(md5('42:' || rep::VARCHAR || ':' || doc_id::VARCHAR), 1, 8))::UBIGINT::DOUBLE / 4294967296.0"
ORACLE["bootstrap_ci"] = with_(*BASE, ALL_PAIRS, suite_cte("all_pairs", "run_id, doc_id")) + f""", x AS (
  SELECT run_id, doc_id, {f1('o1', 'np1', 'nr1')} AS v FROM suite),
w AS (SELECT run_id, rep, sum({poisson_case(_U)} * v) / sum({poisson_case(_U)}) AS m
      FROM x CROSS JOIN range(100) t(rep) GROUP BY run_id, rep)
SELECT run_id, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.5), 6) AS mid,
       round(quantile_cont(m, 0.975), 6) AS high FROM w GROUP BY run_id"""

# equal vectors have equal cosines, so the cosine of two vector ids is worked out once
_TV = with_(*BASE, ALL_PAIRS) + f""", sides AS (
  SELECT run_id, doc_id, 'ref' AS side, {tok('output')} AS t FROM all_pairs
  UNION ALL SELECT run_id, doc_id, 'pred', {tok('summary')} FROM all_pairs),
tk AS (SELECT run_id, doc_id, side, unnest(t) AS token FROM sides),
tv AS (SELECT run_id, doc_id, side, (('0x' || substr(md5(token), 1, 8))::UBIGINT % (SELECT count(*) FROM embeddings))::BIGINT AS vec_id,
              count(*) AS n FROM tk GROUP BY ALL),
nv AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda a: a / CASE WHEN sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda b: b * b))) = 0
         THEN 1.0 ELSE sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda b: b * b))) END) AS u FROM embeddings),
cs AS (SELECT a.vec_id AS x, b.vec_id AS y, list_dot_product(a.u, b.u) AS s FROM nv a CROSS JOIN nv b),
tv2 AS (SELECT tv.* FROM tv JOIN embeddings e USING (vec_id)),
sims AS (SELECT p.run_id, p.doc_id, p.vec_id AS pv, r.vec_id AS rv, p.n AS pn, r.n AS rn, cs.s
         FROM tv2 p JOIN tv2 r ON p.run_id = r.run_id AND p.doc_id = r.doc_id AND p.side = 'pred' AND r.side = 'ref'
         JOIN cs ON cs.x = p.vec_id AND cs.y = r.vec_id),
pr AS (SELECT run_id, doc_id, sum(ms * pn) / sum(pn) AS prec FROM (SELECT run_id, doc_id, pv, pn, max(s) AS ms FROM sims GROUP BY ALL) GROUP BY ALL),
rc AS (SELECT run_id, doc_id, sum(ms * rn) / sum(rn) AS rec FROM (SELECT run_id, doc_id, rv, rn, max(s) AS ms FROM sims GROUP BY ALL) GROUP BY ALL),
keys AS (SELECT DISTINCT run_id, doc_id FROM tv2)
"""
ORACLE["greedy_embedding_match"] = _TV + """
SELECT k.run_id, k.doc_id, round(coalesce(pr.prec, 0.0), 4) AS bertscore_precision,
       round(coalesce(rc.rec, 0.0), 4) AS bertscore_recall,
       round(CASE WHEN coalesce(pr.prec, 0) + coalesce(rc.rec, 0) > 0
                  THEN 2 * coalesce(pr.prec, 0) * coalesce(rc.rec, 0) / (coalesce(pr.prec, 0) + coalesce(rc.rec, 0))
                  ELSE 0.0 END, 4) AS bertscore_f1
FROM keys k LEFT JOIN pr USING (run_id, doc_id) LEFT JOIN rc USING (run_id, doc_id)"""
