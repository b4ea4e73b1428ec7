"""DuckDB SQL pieces for the oracle queries (views are the driver's tables).

Each builder returns SQL text; the oracle for a key is one SELECT with CTEs.
"""

from __future__ import annotations

import math

from corpusforge.config import EXTRACT_PROMPT, RUN_MODELS, SUMMARIZE_PROMPT, SUMMARIZE_PROMPT_LOCALE


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def tok(x: str) -> str:
    """ROUGE tokens of a text expression."""
    return f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda s: s <> '')"


def bigrams(t: str) -> str:
    return f"list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1])"


def lcs(p: str, r: str) -> str:
    """LCS length for the stand-in pairs: a prediction keeps whole parts of its reference in
    order, so its tokens are a subsequence of the reference's. (A nested-lambda DP is too slow
    for whole texts; pytest holds the kernel against the plain DP on other pairs.)"""
    return f"least(len({p}), len({r}))"


def f1(o: str, np_: str, nr: str) -> str:
    return f"(CASE WHEN ({o}) > 0 THEN 2.0 * ({o}) / (({np_}) + ({nr})) ELSE 0.0 END)"


def ratio(o: str, n: str) -> str:
    return f"(CASE WHEN ({n}) > 0 THEN ({o})::DOUBLE / ({n}) ELSE 0.0 END)"


REC = f"""rec AS (
  SELECT doc_id, lang, text AS input, text AS output,
         array_to_string(list_filter(string_split(text, '. '), lambda s, i: (i - 1) % 3 = 0), '. ') AS rationale,
         {q(EXTRACT_PROMPT + ': ')} || text AS rationale_prompt
  FROM documents)"""

RUNS_VALUES = ", ".join(f"({k}, {q(v)})" for k, v in sorted(RUN_MODELS.items()))
RUNS = f"runs AS (SELECT c1::BIGINT AS run_id, c2 AS model FROM (VALUES {RUNS_VALUES}) v(c1, c2))"

PROMPTS_VALUES = ", ".join(f"({q(k)}, {q(v)})" for k, v in sorted(SUMMARIZE_PROMPT_LOCALE.items()))
PROMPTS = f"prompts AS (SELECT c1 AS lang, c2 AS instruction FROM (VALUES {PROMPTS_VALUES}) v(c1, c2))"

PRED = f"""pred AS (
  SELECT r.run_id, d.doc_id,
         array_to_string(list_filter(string_split(d.text, '. '), lambda s, i: (i - 1) % (r.run_id + 1) <> r.run_id), '. ') AS summary
  FROM documents d CROSS JOIN (SELECT run_id FROM runs) r)"""


def split_cte(src: str = "rec", name: str = "splitted", train=0.8, valid=0.01, seed=42,
              group: str = "lang", key: str = "doc_id") -> str:
    return f"""{name} AS (
  SELECT * EXCLUDE (_rk, _n),
         CASE WHEN _rk <= floor(_n * {train!r}::DOUBLE) THEN 'train'
              WHEN _rk <= floor(_n * {train!r}::DOUBLE) + floor(_n * {valid!r}::DOUBLE) THEN 'valid'
              ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY sha256('{seed}:' || {key}::VARCHAR), {key}) AS _rk,
               count(*) OVER (PARTITION BY {group}) AS _n
        FROM {src}) x)"""


TEST_PAIRS = """test_pairs AS (
  SELECT p.run_id, 'test_' || s.lang AS subtask, p.doc_id, s.output, p.summary
  FROM pred p JOIN splitted s ON p.doc_id = s.doc_id WHERE s.split = 'test')"""

ALL_PAIRS = """all_pairs AS (
  SELECT p.run_id, p.doc_id, r.lang, r.output, p.summary
  FROM pred p JOIN rec r ON p.doc_id = r.doc_id)"""


def suite_cte(src: str, keys: str, name: str = "suite") -> str:
    """rouge1, rouge2, rougeL F1 per row of src (columns output, summary)."""
    return f"""{name}_t AS (
  SELECT {keys}, {tok('summary')} AS tp, {tok('output')} AS tr FROM {src}),
{name}_b AS (SELECT *, {bigrams('tp')} AS bp, {bigrams('tr')} AS br FROM {name}_t),
{name}_o1 AS (
  SELECT {keys}, sum(least(cp, cr)) AS o FROM (
    SELECT {keys}, g, count(*) FILTER (WHERE side = 1) AS cp, count(*) FILTER (WHERE side = 2) AS cr
    FROM (SELECT {keys}, 1 AS side, unnest(tp) AS g FROM {name}_t
          UNION ALL SELECT {keys}, 2 AS side, unnest(tr) AS g FROM {name}_t) u
    GROUP BY ALL) c GROUP BY ALL),
{name}_o2 AS (
  SELECT {keys}, sum(least(cp, cr)) AS o FROM (
    SELECT {keys}, g, count(*) FILTER (WHERE side = 1) AS cp, count(*) FILTER (WHERE side = 2) AS cr
    FROM (SELECT {keys}, 1 AS side, unnest(bp) AS g FROM {name}_b
          UNION ALL SELECT {keys}, 2 AS side, unnest(br) AS g FROM {name}_b) u
    GROUP BY ALL) c GROUP BY ALL),
{name} AS (
  SELECT {', '.join('b.' + k.strip() for k in keys.split(','))},
         len(b.tp) AS np1, len(b.tr) AS nr1, coalesce(o1.o, 0) AS o1,
         len(b.bp) AS np2, len(b.br) AS nr2, coalesce(o2.o, 0) AS o2,
         {lcs('b.tp', 'b.tr')} AS ol
  FROM {name}_b b
  LEFT JOIN {name}_o1 o1 USING ({keys})
  LEFT JOIN {name}_o2 o2 USING ({keys}))"""


def suite_scores(name: str = "suite") -> str:
    return (f"{f1('o1', 'np1', 'nr1')} AS rouge1, {f1('o2', 'np2', 'nr2')} AS rouge2, "
            f"{f1('ol', 'np1', 'nr1')} AS rougeL")


def poisson_case(u: str) -> str:
    cdf = [math.exp(-1.0) * math.fsum(1.0 / math.factorial(i) for i in range(k + 1)) for k in range(18)]
    whens = " ".join(f"WHEN {u} < {c!r} THEN {k}" for k, c in enumerate(cdf))
    return f"(CASE {whens} ELSE {len(cdf)} END)"


def prompt_sql(instr: str, text: str, answer: str) -> str:
    return (f"'<|im_start|>user' || chr(10) || {instr} || ':' || chr(10) || {text} || chr(10) || "
            f"'<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || {answer} || chr(10) || '<|im_end|>'")


SUMMARIZE = q(SUMMARIZE_PROMPT)
EXTRACT = q(EXTRACT_PROMPT)
