"""The registered queries as SQL over the same tables, written independently of Spark."""

from __future__ import annotations

from kappaloom.fixed_values import INSTRUCTION_FORMATS, NA_TOKENS
from kappaloom.operators import prompts as p
from kappaloom.plans.queries import SYSTEMS

N_RUNS = 5


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(name: str, columns: str, rows) -> str:
    body = ", ".join(
        "(" + ", ".join(lit(v) if isinstance(v, str) else str(v) for v in row) + ")"
        for row in rows
    )
    return f"{name}({columns}) AS (VALUES {body})"


def query(*parts: str) -> str:
    """WITH RECURSIVE cte, cte, ... final select."""
    *ctes, final = parts
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + final


# ---------------------------------------------------------------- inputs

DOCS = """docs AS (
  SELECT CASE WHEN CAST(substr(source, 4) AS INT) % 2 = 0 THEN 'north' ELSE 'south' END AS dataset,
         doc_id AS item_id, text,
         CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French'
                   WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' END AS gold
  FROM documents)"""
TURNS = """turns AS (
  SELECT 'chat' AS dataset, conv_id * 1048576 + turn AS item_id, text,
         CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
                   WHEN 'system' THEN 'System' END AS gold
  FROM conversations)"""
CORPUS = "corpus AS (SELECT * FROM docs UNION ALL SELECT * FROM turns)"
ITEMS = (DOCS, TURNS, CORPUS)

# White space as Python understands it, and as a class of a regular expression.
SPACE = (
    r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def untidy(source: str) -> str:
    return f"""untidy AS (
  SELECT dataset, item_id,
         CASE item_id % 11 WHEN 0 THEN '' WHEN 1 THEN 'NA' WHEN 2 THEN '  '
              ELSE ' ' || chr(160) || text || chr(9) || chr(8195) || ' ' END AS text,
         CASE item_id % 7 WHEN 0 THEN 'null' WHEN 1 THEN '  '
              ELSE ' ' || gold || chr(10) END AS gold
  FROM {source}),
tidy AS (
  SELECT dataset, item_id, {strip('text')} AS text, {strip('gold')} AS gold FROM untidy
  WHERE text NOT IN ({', '.join(map(lit, NA_TOKENS))})
    AND gold NOT IN ({', '.join(map(lit, NA_TOKENS))})),
kept AS (SELECT * FROM tidy WHERE text <> '' AND gold <> '')"""


# ---------------------------------------------------------------- sampling

POOL = """pool AS (
  SELECT dataset, item_id, gold AS label,
         row_number() OVER (PARTITION BY dataset, gold
                            ORDER BY md5('42|' || CAST(item_id AS VARCHAR)), item_id) AS rank_in_label
  FROM corpus
  QUALIFY rank_in_label <= 2)"""


def examples(n: int) -> str:
    return f"""SELECT dataset, item_id, label,
    CASE WHEN count(*) OVER (PARTITION BY dataset) <= {n}
         THEN row_number() OVER (PARTITION BY dataset ORDER BY label, rank_in_label)
         ELSE row_number() OVER (PARTITION BY dataset ORDER BY rank_in_label, label) END AS pos
  FROM pool QUALIFY pos <= {n}"""


# ---------------------------------------------------------------- grid

AXES = (
    values("models", "model", [("common",), ("rare",)]),
    values("shots", "shot_type, k", [("zero_shot", 2), ("one_shot", 4), ("few_shot", 8)]),
    values("lengths", "length", [("short",), ("medium",), ("long",)]),
    values("contexts", "context_level, accent_weight",
           [("no_context", 0), ("some_context", 1), ("full_context", 3)]),
    """conditions AS (
  SELECT *, concat_ws('__', dataset, model, shot_type, length, context_level) AS exp_id
  FROM (VALUES ('north'), ('south'), ('chat')) d(dataset), models, shots, lengths, contexts)""",
)


def runs(n: int, where: str = "true") -> str:
    return f"""runs AS (
  SELECT *, r AS run_idx, exp_id || '__run' || CAST(r AS VARCHAR) AS run_id,
         CASE model WHEN 'common' THEN 0 ELSE 8 - k END + r AS first_rank
  FROM conditions, unnest(range({n})) t(r) WHERE {where})"""


# ---------------------------------------------------------------- rule annotator

LEXICON = (
    "lexicon AS (SELECT label, unnest(range(8)) AS rnk, unnest(string_split(words, ' ')) AS word "
    "FROM (VALUES ('English', 'the of and in is to that with', ''), "
    "('French', 'le de la et que qui des les', 'èêçœà'), "
    "('German', 'der die und zu in ist nicht ein', 'äöüß'), "
    "('Spanish', 'de la que el en los y con', 'ñ¿¡íóú')) l(label, words, letters))"
)
HITS = """tokens AS (
  SELECT item_id, tok, count(*) AS c
  FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS tok FROM docs)
  WHERE tok IN (SELECT word FROM lexicon) GROUP BY ALL),
hits AS (
  SELECT item_id, label, rnk, c, length(word) AS letters
  FROM tokens JOIN lexicon ON tok = word),
accents AS (
  SELECT item_id, label, length(regexp_replace(lower(text), '[^' || letters || ']', '', 'g')) AS c
  FROM docs, (VALUES ('French', 'èêçœà'), ('German', 'äöüß'), ('Spanish', 'ñ¿¡íóú'))
             a(label, letters))"""
BASIC = """scores AS (
  SELECT item_id, label, sum(c) AS score FROM hits WHERE rnk < 4 GROUP BY ALL),
basic AS (
  SELECT d.dataset, d.item_id, d.gold, d.text, s.label AS pred
  FROM docs d LEFT JOIN (
    SELECT * FROM scores
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, label) = 1) s
  USING (item_id))"""
RULES = (DOCS, *AXES, LEXICON, HITS)
PREDS = """evidence AS (
  SELECT r.run_id, h.item_id, h.label,
         sum(CASE r.length WHEN 'short' THEN 1 WHEN 'medium' THEN h.c ELSE h.c * h.letters END) AS s
  FROM hits h JOIN docs d USING (item_id) JOIN runs r ON r.dataset = d.dataset
  WHERE (h.rnk - r.first_rank + 16) % 8 < r.k GROUP BY ALL
  UNION ALL
  SELECT r.run_id, a.item_id, a.label, a.c * r.accent_weight
  FROM accents a JOIN docs d USING (item_id) JOIN runs r ON r.dataset = d.dataset),
totals AS (SELECT run_id, item_id, label, sum(s) AS score FROM evidence GROUP BY ALL),
winners AS (
  SELECT * FROM totals WHERE score > 0
  QUALIFY row_number() OVER (PARTITION BY run_id, item_id ORDER BY score DESC, label) = 1),
preds AS (
  SELECT r.*, d.item_id, d.gold, w.label AS pred
  FROM docs d JOIN runs r USING (dataset) LEFT JOIN winners w USING (run_id, item_id))"""


def predictions(n_runs: int, where: str = "true") -> tuple[str, ...]:
    return (*RULES, runs(n_runs, where), PREDS)


# ---------------------------------------------------------------- scoring


def metrics(source: str, keys: str, gold: str = "gold", pred: str = "pred") -> str:
    """CTEs ending in ``scored``: keys, items and the five unrounded metrics."""
    return f"""cells AS (
  SELECT {keys}, {gold} AS gold, coalesce({pred}, 'UNKNOWN') AS pred, count(*) AS n
  FROM {source} GROUP BY ALL),
sides AS (
  SELECT {keys}, gold AS label, n AS t, 0 AS p, CASE WHEN gold = pred THEN n ELSE 0 END AS tp
  FROM cells
  UNION ALL SELECT {keys}, pred, 0, n, 0 FROM cells),
classes AS (
  SELECT {keys}, label, sum(t) AS t, sum(p) AS p, sum(tp) AS tp FROM sides GROUP BY ALL),
sums AS (
  SELECT {keys}, sum(t) AS items, sum(tp) / sum(t) AS accuracy,
         sum(t * p) / (sum(t) * sum(t)) AS pe,
         avg(coalesce(tp / nullif(p, 0), 0)) AS precision,
         avg(coalesce(tp / nullif(t, 0), 0)) AS recall,
         avg(coalesce(2 * tp / nullif(t + p, 0), 0)) AS f1
  FROM classes GROUP BY ALL),
scored AS (
  SELECT {keys}, CAST(items AS BIGINT) AS items, accuracy, precision, recall, f1,
         (accuracy - pe) / nullif(1 - pe, 0) AS kappa
  FROM sums)"""


FIVE = "accuracy, precision, recall, f1, kappa"


def rounded(columns: str, places: int = 6) -> str:
    return ", ".join(f"round({c}, {places}) AS {c}" for c in columns.split(", "))


CODES = """used AS (
  SELECT exp_id, gold AS label FROM preds UNION SELECT exp_id, coalesce(pred, 'UNKNOWN') FROM preds
  UNION SELECT exp_id, 'UNKNOWN' FROM preds),
codes AS (
  SELECT exp_id, label, row_number() OVER (PARTITION BY exp_id ORDER BY label) - 1 AS code FROM used)"""
ICC = f"""{CODES},
rated AS (
  SELECT p.exp_id, p.item_id, p.run_idx, CAST(c.code AS DOUBLE) AS x
  FROM preds p JOIN codes c ON c.exp_id = p.exp_id AND c.label = coalesce(p.pred, 'UNKNOWN')),
grand AS (
  SELECT exp_id, avg(x) AS m, count(DISTINCT item_id) AS n, count(DISTINCT run_idx) AS k
  FROM rated GROUP BY ALL),
by_item AS (SELECT exp_id, item_id, avg(x) AS m FROM rated GROUP BY ALL),
by_run AS (SELECT exp_id, run_idx, avg(x) AS m FROM rated GROUP BY ALL),
squares AS (
  SELECT g.exp_id, g.n, g.k,
    (SELECT sum((x - g.m) ** 2) FROM rated r WHERE r.exp_id = g.exp_id) AS sst,
    (SELECT sum((i.m - g.m) ** 2) FROM by_item i WHERE i.exp_id = g.exp_id) * g.k AS ssr,
    (SELECT sum((u.m - g.m) ** 2) FROM by_run u WHERE u.exp_id = g.exp_id) * g.n AS ssc
  FROM grand g),
means AS (
  SELECT exp_id, n, k, ssr / (n - 1) AS msr, ssc / nullif(k - 1, 0) AS msc,
         (sst - ssr - ssc) / nullif((n - 1) * (k - 1), 0) AS mse
  FROM squares),
icc AS (
  SELECT exp_id, CAST(k AS BIGINT) AS runs,
         (msr - mse) / nullif(msr + (k - 1) * mse + k * (msc - mse) / n, 0) AS icc
  FROM means)"""
PER_RUN = metrics("preds", "exp_id, run_idx")
BEST = """best AS (
  SELECT *, run_idx AS best_run_idx FROM scored
  QUALIFY row_number() OVER (PARTITION BY exp_id
                             ORDER BY round(kappa, 9) DESC NULLS LAST, run_idx) = 1)"""
SUMMARY = f"""{PER_RUN}, {ICC}, {BEST},
spread AS (
  SELECT exp_id, CASE WHEN count(kappa) = count(*) THEN avg(kappa) END AS mean_kappa,
         CASE WHEN count(kappa) < count(*) THEN NULL WHEN count(*) = 1 THEN 0 ELSE stddev_samp(kappa) END AS std_kappa
  FROM scored GROUP BY ALL),
summary AS (
  SELECT exp_id, accuracy, precision, recall, f1, kappa, mean_kappa, std_kappa, icc
  FROM best JOIN spread USING (exp_id) JOIN icc USING (exp_id)),
metrics AS (
  SELECT dataset, model, shot_type, length, context_level,
         {rounded(FIVE + ', mean_kappa, std_kappa, icc', 9)}
  FROM summary JOIN conditions USING (exp_id))"""
FULL = (*predictions(N_RUNS), SUMMARY)

# ---------------------------------------------------------------- reports

NAMES = (
    values("dataset_names", "dataset, d_pos, d_name",
           [("north", 0, "North Archive"), ("south", 1, "South Archive")]),
    values("model_names", "model, m_pos, m_name",
           [("common", 0, "Common words"), ("rare", 1, "Rare words"),
            ("remote", 2, "Remote model")]),
    values("shot_names", "shot_type, s_name",
           [("zero_shot", "Zero-shot"), ("one_shot", "One-shot"), ("few_shot", "Few-shot")]),
    values("context_names", "context_level, c_name",
           [("no_context", "No Context"), ("some_context", "Some Context"),
            ("full_context", "Full Context")]),
)


def r3(expr: str, name: str) -> str:
    return f'round_even({expr}, 3) AS "{name}"'


def maxes(axis: str, pairs) -> str:
    return ", ".join(
        r3(f"max(CASE WHEN {axis} = '{value}' THEN kappa END)", name) for value, name in pairs)


BY_MODEL = maxes("model", [("common", "Common words"), ("rare", "Rare words"),
                           ("remote", "Remote model")])
BY_LENGTH = maxes("length", [("short", "Short"), ("medium", "Medium"), ("long", "Long")])
FOUR = [("accuracy", "Accuracy"), ("precision", "Precision"), ("recall", "Recall"), ("f1", "F1")]
TOP = """top AS (
  SELECT * FROM metrics
  QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY kappa DESC NULLS LAST,
    concat_ws('__', dataset, model, shot_type, length, context_level)) = 1)"""

FULL_METRICS = query(*FULL, *NAMES, f"""
  SELECT d_name AS dataset, s_name AS shot_type, m_name AS model,
         {', '.join(r3(f'max({c})', n) for c, n in FOUR)}
  FROM dataset_names CROSS JOIN shot_names CROSS JOIN model_names
  LEFT JOIN metrics USING (dataset, shot_type, model) GROUP BY ALL""")

# ---------------------------------------------------------------- prompts

CHARS_LABELS = """label_lists AS (
  SELECT dataset, string_agg(gold, ', ' ORDER BY gold) AS label_list
  FROM (SELECT DISTINCT dataset, gold FROM corpus) GROUP BY dataset)"""
BLOCKS = f"""picked AS (
  SELECT 'one_shot' AS shot_type, * FROM ({examples(1)})
  UNION ALL SELECT 'few_shot', * FROM ({examples(3)})),
blocks AS (
  SELECT dataset, shot_type,
    string_agg('[' || label || '] ' || {strip('text')}, chr(10) ORDER BY pos) AS compact,
    string_agg(CAST(pos AS VARCHAR) || ') folder ' || label || chr(10) || {strip('text')},
               chr(10) || chr(10) ORDER BY pos) AS numbered
  FROM picked JOIN corpus USING (dataset, item_id) GROUP BY ALL)"""


def named(text: str) -> str:
    """SQL expression for a template with the collection's name filled in."""
    return f"replace({lit(text)}, '{{system}}', system)"


TEMPLATES = (
    values("systems", "dataset, system, some_text, full_text",
           [(d, *v) for d, v in SYSTEMS.items()]),
    CHARS_LABELS,
    f"""pieces AS (
  SELECT c.*, system, label_list, compact || chr(10) || chr(10) AS compact,
         numbered || chr(10) || chr(10) AS numbered, c.shot_type = 'zero_shot' AS zero,
         CASE context_level WHEN 'some_context' THEN some_text
                            WHEN 'full_context' THEN full_text END AS about
  FROM conditions c JOIN systems USING (dataset) JOIN label_lists USING (dataset)
  LEFT JOIN blocks b ON b.dataset = c.dataset AND b.shot_type = c.shot_type),
templates AS (
  SELECT *, CASE length
    WHEN 'short' THEN CASE WHEN zero THEN {lit(p.SHORT_TASK)}
                           ELSE {lit(p.SHORT_TASK_EXAMPLES)} || compact END
    WHEN 'medium' THEN {named(p.MEDIUM_TASK)}
      || coalesce({lit(p.MEDIUM_CONTEXT)} || about || chr(10), '')
      || CASE WHEN zero THEN {lit(p.MEDIUM_HINT)} ELSE {lit(p.MEDIUM_EXAMPLES)} || compact END
    ELSE {named(p.LONG_OPENING)} || {lit(p.LONG_LABELS)} || label_list || chr(10) || chr(10)
      || {lit(p.LONG_GUIDELINES)}
      || coalesce({lit(p.LONG_CONTEXT)} || about || chr(10) || chr(10), '')
      || CASE WHEN zero THEN '' ELSE {lit(p.LONG_EXAMPLES)} || numbered END
      || {lit(p.LONG_TASK)} END || {lit(p.ITEM_OPEN)} AS prefix,
    CASE length WHEN 'short' THEN {lit(p.SHORT_CUE)} WHEN 'medium' THEN {lit(p.WORD_CUE)}
      ELSE CASE WHEN zero THEN {lit(p.LONG_STEPS_ZERO)} ELSE {lit(p.LONG_STEPS_EXAMPLES)} END
    END AS suffix
  FROM pieces),
prompts AS (
  SELECT t.*, item_id, prefix || {strip('text')} || suffix AS prompt
  FROM corpus JOIN templates t USING (dataset))""",
)
PROMPTS = (*ITEMS, POOL, BLOCKS, *AXES, *TEMPLATES)
# ---------------------------------------------------------------- extraction

RAW = """raws AS (
  SELECT dataset, item_id, CASE item_id % 8
    WHEN 0 THEN pred WHEN 1 THEN '  ' || upper(pred) || chr(10) WHEN 2 THEN '"' || pred || '".'
    WHEN 3 THEN 'The text "' || text || '" is ' || pred || ' prose.'
    WHEN 4 THEN pred || '_text' WHEN 5 THEN pred || 's' WHEN 6 THEN text
    ELSE '  ' || chr(9) || ' ' END AS raw
  FROM basic)"""
EDGE = "chr(34) || chr(39) || '`.,;:!?' || chr(10) || chr(13) || chr(9)"


def extraction(stages, labels="English French German Spanish".split()) -> str:
    """CTEs from ``raws`` to ``found``: item_id, pred, stage."""
    nothing = "CAST(NULL AS VARCHAR)"
    known = ", ".join(f"('{l}', {i})" for i, l in enumerate(labels))
    exact = f"(SELECT label FROM labels WHERE lower(label) = regexp_replace(lower(c), '[^a-z0-9]', '', 'g'))"
    longest = sorted(labels, key=len, reverse=True)
    scan = "CASE " + " ".join(
        rf"WHEN regexp_matches(c, '(?i)(^|[^\p{{L}}\p{{N}}_]){l}($|[^\p{{L}}\p{{N}}_])') THEN '{l}'"
        for l in longest) + " END"
    lower = ", ".join(f"'{l.lower()}'" for l in labels)
    token = (
        "(SELECT label FROM labels WHERE lower(label) = [lower(x) FOR x IN "
        f"regexp_extract_all(c, '[A-Za-z0-9]+') IF lower(x) IN ({lower})][1])"
    )
    fuzzy = ""
    fuzzy_join, fuzzy_pred = "", nothing
    if "fuzzy" in stages:
        fuzzy = f"""candidates AS (
  SELECT DISTINCT lower(substring(c, 1, 30)) AS cand FROM read
  WHERE c IS NOT NULL AND coalesce(by_exact, by_scan, by_token) IS NULL),
pairs AS (
  SELECT cand, label, ord, cand AS a, lower(label) AS b FROM candidates, labels),
parts AS (
  SELECT cand, label, ord, a, b, '' AS path, 0 AS matched FROM pairs
  UNION ALL
  SELECT cand, label, ord, side.a, side.b, path || side.mark, side.matched
  FROM (
    SELECT cand, label, ord, path, a, b, max({{'k': k, 'i': -i, 'j': -j}}) AS best
    FROM parts, range(1, 31) ra(i), range(1, 31) rb(j), range(1, 31) rk(k)
    WHERE i + k - 1 <= length(a) AND j + k - 1 <= length(b)
      AND substring(a, CAST(i AS INT), CAST(k AS INT)) = substring(b, CAST(j AS INT), CAST(k AS INT))
    GROUP BY ALL) m,
  LATERAL (VALUES
    ('l', substring(a, 1, CAST(-best.i - 1 AS INT)), substring(b, 1, CAST(-best.j - 1 AS INT)), best.k),
    ('r', substring(a, CAST(-best.i + best.k AS INT)), substring(b, CAST(-best.j + best.k AS INT)), 0)
  ) side(mark, a, b, matched)),
alike AS (
  SELECT cand, label, ord, 2.0::DOUBLE * sum(matched) / (length(cand) + length(label)) AS ratio
  FROM parts GROUP BY cand, label, ord),
closest AS (
  SELECT cand, label FROM alike WHERE ratio >= 0.8
  QUALIFY row_number() OVER (PARTITION BY cand ORDER BY ratio DESC, ord) = 1),
"""
        fuzzy_join = (
            "LEFT JOIN closest f ON f.cand = lower(substring(c, 1, 30)) "
            "AND coalesce(by_exact, by_scan, by_token) IS NULL"
        )
        fuzzy_pred = "f.label"
    return f"""labels(label, ord) AS (VALUES {known}),
cleaned AS (
  SELECT *, CASE WHEN {strip('raw')} <> '' THEN
    regexp_replace(trim({strip('raw')}, {EDGE}), '{SPACE}+', ' ', 'g') END AS c
  FROM raws),
read AS (
  SELECT *, {exact if 'exact' in stages else nothing} AS by_exact,
         {scan if 'scan' in stages else nothing} AS by_scan,
         {token if 'token' in stages else nothing} AS by_token
  FROM cleaned),
{fuzzy}found AS (
  SELECT dataset, item_id, coalesce(by_exact, by_scan, by_token, {fuzzy_pred}) AS pred,
         CASE WHEN c IS NULL THEN 'empty' WHEN by_exact IS NOT NULL THEN 'exact'
              WHEN by_scan IS NOT NULL THEN 'scan' WHEN by_token IS NOT NULL THEN 'token'
              WHEN {fuzzy_pred} IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS stage
  FROM read {fuzzy_join})"""


def extract_query(*stages: str) -> str:
    return query(DOCS, LEXICON, HITS, BASIC, RAW, extraction(stages),
                 "SELECT item_id, pred, stage FROM found")


ALL_STAGES = ("exact", "scan", "token", "fuzzy")
LLAMA_HEAD, LLAMA_TAIL = INSTRUCTION_FORMATS["llama2"]
STORED = """stored AS (
  SELECT run_id, shot_type, item_id, gold, 'Label: ' || pred AS raw, pred,
         CASE WHEN pred IS NULL THEN 'empty' ELSE 'scan' END AS stage FROM preds)"""
STORED_RUNS = (*predictions(N_RUNS), STORED)
ALL_RUNS = predictions(N_RUNS)
RESUME = """wanted AS (SELECT dataset, model, run_id, item_id FROM docs JOIN runs USING (dataset)),
saved AS (
  SELECT run_id, item_id, CASE WHEN model = 'rare' AND toxic = 1 THEN 'timeout' END AS error
  FROM wanted LEFT JOIN labels ON doc_id = item_id
  WHERE model = 'common' OR toxic IS NOT NULL),
todo AS (
  SELECT run_id, item_id FROM wanted
  EXCEPT SELECT run_id, item_id FROM saved WHERE error IS NULL)"""


RESUMED = (DOCS, *AXES, runs(N_RUNS, "dataset <> 'chat'"), RESUME)


def part_query(read: int, misspelt: str) -> str:
    """Parts by the way they are named; the first ``read`` of them have a label."""
    return f"""
        SELECT p_partkey AS item_id,
               CASE WHEN p_partkey % 6 < {read} THEN p_name || ' no ' || p_partkey END AS pred,
               CASE p_partkey % 6 WHEN 0 THEN 'exact' WHEN 1 THEN 'exact' WHEN 2 THEN 'scan' WHEN 3 THEN 'token'
                                  WHEN 4 THEN {misspelt} ELSE 'empty' END AS stage
        FROM part"""


ORACLES = {
    "clean_items": query(*ITEMS, untidy("corpus"), """
        SELECT dataset, item_id, gold, md5(text) AS text_md5, length(text) AS chars FROM kept"""),
    "label_vocabulary": query(*ITEMS, """
        SELECT dataset, gold AS label,
               row_number() OVER (PARTITION BY dataset ORDER BY gold) - 1 AS label_ord
        FROM (SELECT DISTINCT dataset, gold FROM corpus)"""),
    "stratified_pool": query(*ITEMS, POOL, "SELECT * FROM pool"),
    "stratified_pool_large": query(*ITEMS, POOL.replace("<= 2)", "<= 5000)"), "SELECT * FROM pool"),
    "test_split": query(*ITEMS, POOL, """
        SELECT dataset, item_id, gold FROM corpus c
        WHERE NOT EXISTS (SELECT 1 FROM pool p
                          WHERE p.dataset = c.dataset AND p.item_id = c.item_id)"""),
    "uniform_sample": query(*ITEMS, """
        SELECT dataset, item_id, gold FROM corpus
        QUALIFY row_number() OVER (PARTITION BY dataset
          ORDER BY md5('42|' || CAST(item_id AS VARCHAR)), item_id) <= 100"""),
    "round_robin_examples": query(*ITEMS, POOL, f"""
        SELECT 3 AS wanted, * FROM ({examples(3)})
        UNION ALL SELECT 50, * FROM ({examples(50)})"""),
    "condition_grid": query(*ITEMS, *AXES, """
        SELECT dataset, item_id, exp_id FROM corpus JOIN conditions USING (dataset)"""),
    "condition_filter": query(*ITEMS, *AXES, """
        SELECT dataset, item_id, exp_id FROM corpus JOIN conditions USING (dataset)
        WHERE dataset IN ('chat', 'south') AND model = 'rare'
          AND shot_type IN ('few_shot', 'zero_shot') AND length = 'long'
          AND context_level IN ('no_context', 'full_context')"""),
    "experiment_ids": query(*ITEMS, *AXES, runs(3), """
        SELECT exp_id, run_id, count(*) AS items FROM corpus JOIN runs USING (dataset)
        GROUP BY ALL"""),
    "parse_experiment_ids": query("""ids AS (
        SELECT string_split(concat_ws('__', source, lang, 'q' || quality, 't' || toxic, 'whole',
                 CASE WHEN toxic = 1 THEN 'run0' END), '__') AS part
        FROM documents LEFT JOIN labels USING (doc_id))""", """
        SELECT part[1] AS dataset, part[2] AS model, part[3] AS shot_type, part[4] AS length,
               part[5] AS context_level, count(*) AS ids
        FROM ids WHERE len(part) >= 5 GROUP BY ALL"""),
    "example_blocks": query(*ITEMS, POOL, BLOCKS, """
        SELECT dataset, shot_type, md5(compact) AS compact_md5, md5(numbered) AS numbered_md5
        FROM blocks"""),
    "build_prompts": query(*PROMPTS, """
        SELECT item_id, exp_id, md5(prompt) AS prompt_md5, length(prompt) AS chars
        FROM prompts WHERE model = 'common'"""),
    "prompts_by_condition": query(*PROMPTS, """
        SELECT dataset, item_id, count(*) AS conditions,
          md5(string_agg(concat_ws('|', shot_type, length, context_level), chr(10)
              ORDER BY concat_ws('|', shot_type, length, context_level))) AS keys_md5,
          md5(max(CASE WHEN shot_type = 'few_shot' AND length = 'long'
                        AND context_level = 'full_context' THEN prompt END)) AS longest_md5
        FROM prompts WHERE model = 'common' GROUP BY ALL"""),
    "prompt_dedup_counts": query(*PROMPTS, """
        SELECT dataset, count(*) AS prompts, count(DISTINCT prompt) AS distinct_prompts
        FROM prompts WHERE model = 'common' GROUP BY ALL"""),
    "prompt_dedup": query(DOCS, *AXES, LEXICON, HITS, BASIC, """
        SELECT exp_id, item_id, pred || '.' AS raw FROM basic JOIN conditions USING (dataset)
        WHERE model = 'common'"""),
    "annotate_rules": query(*predictions(1), "SELECT exp_id, item_id, gold, pred FROM preds"),
    "annotate_runs": query(*ALL_RUNS, "SELECT exp_id, run_idx, item_id, pred FROM preds"),
    "annotate_batch": query(DOCS, *AXES, LEXICON, HITS, BASIC, """late_totals AS (
          SELECT item_id, label, sum(s) AS s FROM (
            SELECT item_id, label, c AS s FROM hits WHERE rnk >= 4
            UNION ALL SELECT item_id, label, c FROM accents) GROUP BY ALL),
        late AS (
          SELECT * FROM late_totals WHERE s > 0
          QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY s DESC, label) = 1)""", """
        SELECT exp_id, item_id, CASE model WHEN 'common' THEN b.pred || '.' ELSE l.label END AS raw, 1 AS attempts
        FROM basic b JOIN conditions USING (dataset) LEFT JOIN late l USING (item_id)"""),
    "annotate_retry": query(DOCS, LEXICON, HITS, BASIC, """rated AS (
          SELECT doc_id AS item_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY ALL),
        asked AS (
          SELECT item_id, pred, model, most, CASE WHEN toxic = 1 THEN 9 WHEN quality = 0 THEN 2 ELSE 0 END AS fails
          FROM basic LEFT JOIN rated USING (item_id), (VALUES ('common', 5), ('rare', 2)) m(model, most))""", """
        SELECT model, item_id, CASE WHEN fails < most THEN pred || '.' END AS raw,
               least(fails + 1, most)::BIGINT AS attempts,
               CASE WHEN fails >= most THEN 'TransientError: busy' END AS error
        FROM asked"""),
    "model_responses": query(DOCS, f"""
        SELECT item_id,
          md5({lit(LLAMA_HEAD.replace('{system}', 'Answer briefly.'))} || text || {lit(LLAMA_TAIL)})
            AS wrapped_md5,
          CASE WHEN item_id % 5 <> 0 THEN gold END AS answer
        FROM docs"""),
    "extract_exact": extract_query("exact"),
    "extract_scan": extract_query("scan"),
    "extract_token": extract_query("token"),
    "extract_fuzzy": extract_query("fuzzy"),
    "extract_label": extract_query(*ALL_STAGES),
    "extract_codebooks": query(*ITEMS, """
        SELECT dataset, item_id, gold AS pred, 'scan' AS stage FROM corpus"""),
    "extract_large_vocabulary": """
        SELECT p_partkey AS item_id, p_type || ' ' || p_name AS pred, 'scan' AS stage FROM part""",
    "extract_by_table": extract_query(*ALL_STAGES),
    "extract_part_table": part_query(4, "'none'"),
    # One letter in front: the label itself is the nearest, no other has all its letters in so few.
    "extract_part_fuzzy": part_query(5, "'fuzzy'"),
    "extract_stage_audit": query(DOCS, LEXICON, HITS, BASIC, RAW, extraction(ALL_STAGES), """
        SELECT dataset, stage, count(*) AS answers FROM found GROUP BY ALL"""),
    "align_predictions": query(DOCS, LEXICON, HITS, BASIC, """
        SELECT item_id, pred, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS gold
        FROM basic JOIN labels ON doc_id = item_id"""),
    "alignment_audit": """
        SELECT CASE WHEN d.doc_id IS NULL THEN 'prediction_only'
                    WHEN l.doc_id IS NULL THEN 'gold_only' ELSE 'matched' END AS status,
               count(*) AS items
        FROM documents d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id
        GROUP BY ALL""",
    "confusion_counts": query(*predictions(1), metrics("preds", "exp_id"),
                              "SELECT exp_id, gold, pred, n FROM cells"),
    "agreement_basic": query(DOCS, LEXICON, HITS, BASIC, metrics("basic", "dataset"),
                             f"SELECT dataset, items, {rounded(FIVE)} FROM scored"),
    "agreement_metrics": query(*predictions(1), metrics("preds", "exp_id"),
                               f"SELECT exp_id, items, {rounded(FIVE)} FROM scored"),
    "per_label_accuracy": query(DOCS, LEXICON, HITS, BASIC, """
        SELECT dataset, gold AS label, count(*) AS total,
               count(*) FILTER (gold = pred) AS correct,
               round(count(*) FILTER (gold = pred) / count(*), 6) AS accuracy
        FROM basic GROUP BY ALL"""),
    "rater_agreement": query(DOCS, """raters AS (
          SELECT dataset, CAST(quality AS VARCHAR) AS a, CAST(1 - toxic AS VARCHAR) AS b
          FROM labels JOIN docs ON item_id = doc_id)""", metrics("raters", "dataset", "a", "b"),
          f"SELECT dataset, items, {rounded('accuracy, kappa')} FROM scored"),
    "run_metrics": query(*ALL_RUNS, PER_RUN,
                         f"SELECT exp_id, run_idx, items, {rounded(FIVE)} FROM scored"),
    "run_consistency": query(*predictions(N_RUNS), PER_RUN, f"""
        SELECT exp_id, round(CASE WHEN count(kappa) = count(*) THEN avg(kappa) END, 6) AS mean_kappa,
               round(CASE WHEN count(kappa) = count(*) THEN stddev_samp(kappa) END, 6) AS std_kappa,
               {', '.join(f'round(max(CASE WHEN run_idx = {r} THEN kappa END), 6) AS kappa_run{r}'
                          for r in range(N_RUNS))}
        FROM scored GROUP BY ALL"""),
    "undefined_consistency": query(*predictions(N_RUNS, "model = 'common'"), """agreed AS (
          SELECT gold AS kind, gold, run_idx, CASE WHEN run_idx > 2 THEN gold ELSE pred END AS pred FROM preds
          UNION ALL
          SELECT 'all', gold, run_idx, CASE WHEN run_idx > 2 THEN gold ELSE pred END FROM preds)""",
        metrics("agreed", "kind, run_idx"), """
        SELECT kind, round(CASE WHEN count(kappa) = count(*) THEN avg(kappa) END, 6) AS mean_kappa,
               round(CASE WHEN count(kappa) = count(*) THEN stddev_samp(kappa) END, 6) AS std_kappa
        FROM scored GROUP BY kind"""),
    "label_codes": query(*ALL_RUNS, CODES, "SELECT * FROM codes"),
    "icc_two_way": query(*predictions(N_RUNS), ICC,
                         "SELECT exp_id, runs, round(icc, 6) AS icc FROM icc"),
    "best_run": query(*predictions(N_RUNS), PER_RUN, BEST,
                      f"SELECT exp_id, best_run_idx, items, {rounded(FIVE)} FROM best"),
    "condition_summary": query(*FULL, f"""
        SELECT exp_id, {rounded(FIVE + ', mean_kappa, std_kappa, icc')} FROM summary"""),
    "merged_summary": query(*FULL, f"""
        SELECT exp_id, {rounded(FIVE + ', mean_kappa, std_kappa, icc')} FROM summary"""),
    "report_by_shot": query(*FULL, *NAMES, f"""
        SELECT d_name AS dataset, s_name AS shot_type, {BY_MODEL}
        FROM dataset_names CROSS JOIN shot_names LEFT JOIN metrics USING (dataset, shot_type) GROUP BY ALL"""),
    "report_by_length": query(*FULL, f"""
        SELECT dataset, model, {BY_LENGTH} FROM metrics GROUP BY ALL"""),
    "report_consistency": query(*FULL, *NAMES, f"""
        SELECT d_name AS dataset, m_name AS model, {r3('std_kappa', 'SD')}, {r3('icc', 'ICC')}
        FROM dataset_names CROSS JOIN model_names LEFT JOIN (
          SELECT * FROM metrics WHERE length = 'long' AND context_level = 'full_context'
            AND shot_type = 'few_shot') USING (dataset, model)"""),
    "report_by_context": query(*FULL, *NAMES, f"""
        SELECT d_name AS dataset, c_name AS context_level, {BY_MODEL}
        FROM dataset_names CROSS JOIN context_names LEFT JOIN metrics USING (dataset, context_level)
        GROUP BY ALL"""),
    "report_full_metrics": FULL_METRICS,
    "report_full_metrics_best": query(
        *FULL, *NAMES, TOP.format(keys="dataset, shot_type, model"), f"""
        SELECT d_name AS dataset, s_name AS shot_type, m_name AS model,
               {', '.join(r3(c, n) for c, n in FOUR)}
        FROM dataset_names CROSS JOIN shot_names CROSS JOIN model_names
        LEFT JOIN top USING (dataset, shot_type, model)"""),
    "report_any_layout": query(*FULL, NAMES[2], """all_datasets(dataset, d_name) AS (VALUES
          ('north', 'north'), ('south', 'south'), ('lms', 'Library Management'), ('smart', 'Smart Home')),
        all_models(model, m_name) AS (VALUES ('common', 'common'), ('rare', 'rare'),
          ('llama2', 'LLaMA-2'), ('mistral', 'Mistral'), ('gpt4', 'GPT-4'))""", f"""
        SELECT d_name AS dataset, s_name AS shot_type, m_name AS model,
               {', '.join(r3(f'max({c})', n) for c, n in FOUR)}
        FROM all_datasets CROSS JOIN shot_names CROSS JOIN all_models
        LEFT JOIN metrics USING (dataset, shot_type, model) GROUP BY ALL"""),
    "report_best": query(*FULL, *NAMES, TOP.format(keys="dataset, model"), f"""
        SELECT d_name AS dataset, m_name AS model, shot_type, length, context_level,
               {r3('kappa', 'kappa')}
        FROM top JOIN dataset_names USING (dataset) JOIN model_names USING (model)
        WHERE kappa IS NOT NULL"""),
    "report_shot_comparison": query(*FULL, *NAMES, f"""
        SELECT d_name AS dataset, m_name AS model, s_name AS shot_type,
               {', '.join(r3(c, c) for c in ('kappa', 'accuracy', 'precision', 'recall', 'f1'))}
        FROM metrics JOIN dataset_names USING (dataset) JOIN model_names USING (model)
        JOIN shot_names USING (shot_type)
        WHERE length = 'long' AND context_level = 'full_context'"""),
    "report_shot_by_length": query(*FULL, *NAMES, f"""
        SELECT d_name AS dataset, m_name AS model, s_name AS shot_type, {BY_LENGTH}
        FROM metrics JOIN dataset_names USING (dataset) JOIN model_names USING (model)
        JOIN shot_names USING (shot_type)
        WHERE context_level = 'full_context' GROUP BY ALL"""),
    "skip_done": query(*RESUMED, "SELECT DISTINCT run_id FROM todo"),
    "resume_items": query(*RESUMED, "SELECT run_id, item_id FROM todo"),
    "resumed_experiment": query(*ITEMS, POOL, LEXICON, HITS, BASIC, """
        SELECT dataset, item_id, 54 AS answers, pred FROM basic
        WHERE item_id NOT IN (SELECT item_id FROM pool WHERE dataset <> 'chat')"""),
    "csv_roundtrip": query(DOCS, untidy("docs"), f"""cells AS (
          SELECT CASE WHEN text NOT IN ({', '.join(map(lit, NA_TOKENS))}) THEN text END AS text,
                 CASE WHEN gold NOT IN ({', '.join(map(lit, NA_TOKENS))}) THEN gold END AS gold
          FROM untidy),
        contents AS (
          SELECT *, sha256(concat_ws('|', coalesce('t' || text, '-'), coalesce('l' || gold, '-'))) AS content FROM cells),
        copies AS (SELECT *, row_number() OVER (PARTITION BY content) AS copy FROM contents)""", f"""
        SELECT 'docs' AS dataset, ('0x' || substr(md5(content || '|' || CAST(copy AS VARCHAR)), 1, 15))::BIGINT AS item_id,
               {strip('gold')} AS gold, md5({strip('text')}) AS text_md5
        FROM copies WHERE {strip('text')} <> '' AND {strip('gold')} <> ''"""),
    "prediction_table": query(*STORED_RUNS, """
        SELECT run_id, item_id, gold, raw, pred, stage FROM stored WHERE shot_type = 'one_shot'"""),
    "compacted_predictions": query(*predictions(1), STORED, """
        SELECT run_id, item_id, gold, raw, pred FROM stored"""),
    "run_json_roundtrip": query(*STORED_RUNS, """
        SELECT run_id, item_id, gold, raw, pred FROM stored"""),
    "metrics_json_roundtrip": query(*FULL, f"""
        SELECT dataset, model, shot_type, length, context_level,
               {rounded(FIVE + ', mean_kappa, std_kappa, icc')}
        FROM summary JOIN conditions USING (exp_id)"""),
    "report_csv": FULL_METRICS,
    "stream_annotate": query(DOCS, *AXES, LEXICON, HITS, BASIC, """
        SELECT dataset, item_id, exp_id, gold, pred || '.' AS raw, pred,
               CASE WHEN pred IS NULL THEN 'empty' ELSE 'exact' END AS stage
        FROM basic JOIN conditions USING (dataset)"""),
    "stream_requests": query(*PROMPTS, """
        SELECT dataset, count(DISTINCT model || '|' || prompt) AS requests FROM prompts
        WHERE dataset <> 'chat' GROUP BY ALL"""),
    "run_elapsed": query(*STORED_RUNS, """
        SELECT run_id, sum(item_id % 7 * 0.25::DOUBLE) AS elapsed_seconds FROM stored GROUP BY ALL"""),
}
