"""SQL (DuckDB) with the results of those queries that SQL can express on whole tables."""

from __future__ import annotations

from kappaloom.llm import secret_scan as secrets

OP1 = """
WITH vec AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM vec q JOIN vec c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""

OP2 = r"""
WITH doc AS (
  SELECT doc_id, [w FOR w IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF w <> ''] AS ws
  FROM documents
), win AS (
  SELECT doc_id, p, list_slice(ws, p, p + 19) AS content
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM doc WHERE len(ws) >= 20)
), firsts AS (
  SELECT content, min({'d': doc_id, 'p': p}) AS f FROM win GROUP BY content
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p
  FROM win JOIN firsts USING (content) WHERE f < {'d': doc_id, 'p': p}
), removed AS (
  SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
), kept AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed,
    [w FOR w, i IN ws IF ps IS NULL OR NOT list_contains(ps, i)] AS k
  FROM doc LEFT JOIN removed USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256
FROM kept
"""

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _hits(kind: int, pattern: str) -> str:
    """Places of all matches: what lies between them and they themselves add up."""
    return f"""SELECT rid, {kind} AS kind, token, length(token) AS n,
      sum(length(gap) + length(token)) OVER (PARTITION BY rid ORDER BY i) AS "end"
    FROM (SELECT rid, unnest(pieces[:len(tokens)]) AS gap, unnest(tokens) AS token, unnest(range(len(tokens))) AS i
      FROM (SELECT rid, string_split_regex(t, {_quoted(pattern)}) AS pieces,
              regexp_extract_all(t, {_quoted(pattern)}, 0) AS tokens FROM doc))"""


def _tail(z: str) -> str:
    x = f"least(greatest({z}, -12.0::DOUBLE), 12.0::DOUBLE)"
    return f"(1 / (1 + exp(1.5976::DOUBLE * {x} + 0.07056::DOUBLE * {x} * {x} * {x})))"


_ALPHABET = " ".join(f"WHEN regexp_matches(token, {_quoted(p)}) THEN {_quoted(a)}" for p, a in secrets.ENCODINGS)
_EVEN = " ".join(f"WHEN regexp_matches(token, {_quoted(p)}) THEN {e}" for (p, _), e in zip(secrets.ENCODINGS, secrets.EVEN))

OP3 = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), hit AS (
  {_hits(0, secrets.ASSIGN)}
  UNION ALL {_hits(1, secrets.ACCESS)}
  UNION ALL {_hits(2, secrets.HEX)}
  UNION ALL {_hits(3, "[A-Za-z0-9+/_-]{20,}")}
), span AS (
  SELECT rid, kind, ("end" - n)::BIGINT AS start, "end"::BIGINT AS "end", token, n FROM hit
  WHERE CASE kind WHEN 0 THEN length(regexp_extract(token, {_quoted(secrets.ASSIGN)}, 2)) >= {secrets.ASSIGN_LEAST}
    ELSE true END
), run AS (
  SELECT * FROM (SELECT *,
    max("end") FILTER (kind < 3) OVER (PARTITION BY rid ORDER BY start, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    min(start) FILTER (kind < 3) OVER (PARTITION BY rid ORDER BY start, kind ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after
    FROM span)
  WHERE kind = 3 AND coalesce(before <= start, true) AND coalesce(after >= "end", true) AND regexp_matches(token, '[A-Za-z]')
), symbols AS (
  SELECT *, length(alphabet)::DOUBLE AS a, [instr(alphabet, c) - 1 FOR c IN string_split(token, '')] AS v
  FROM (SELECT *, CASE {_ALPHABET} END AS alphabet, CASE {_EVEN} END AS even,
    [instr({_quoted(secrets.SYMBOLS)}, c) FOR c IN string_split(token, '')] AS s,
    [{secrets.KIND_OF}[x] FOR x IN s] AS k FROM run)
), sums AS (
  SELECT *, [CASE WHEN 2 * x >= a THEN 1 ELSE 0 END FOR x IN v] AS high,
    list_sum([len([y FOR y IN v IF y = d]) ** 2 FOR d IN list_distinct(v)]) AS squares,
    list_sum(v) AS s1, list_sum([x * x FOR x IN v]) AS s2,
    list_sum([v[i] * v[i % n + 1] FOR i IN range(1, n + 1)]) AS lag
  FROM symbols
), moments AS (
  SELECT *, list_sum(high) AS n1, list_sum([abs(high[i] - high[i + 1]) FOR i IN range(1, n)]) AS changes,
    2.0::DOUBLE * n1 * (n - n1) / n + 1 AS mu, (mu - 1) * (mu - 2) / (n - 1) AS spread, n * s2 - s1 * s1 AS den,
    {secrets.FIRST}[k[1] + 1] + list_sum([{secrets.WITHIN}[x] FOR x IN s])
      + list_sum([{secrets.NEXT}[4 * k[i] + k[i + 1] + 1] FOR i IN range(1, n)]) AS cost
  FROM sums
), scores AS (
  SELECT *, (a / n * squares - n - (a - 1)) / sqrt(2 * (a - 1) * (n - 1) / n) AS z_chi,
    CASE WHEN spread > 0 THEN abs(changes + 1 - mu) / sqrt(spread) ELSE sqrt(n) END AS z_runs,
    CASE WHEN den > 0 THEN abs((n * lag - s1 * s1) / den + 1.0::DOUBLE / (n - 1)) * (n - 1) * sqrt(n - 2) / n ELSE sqrt(n) END AS z_serial
  FROM moments
), levels AS (
  SELECT *, least(1.0::DOUBLE, 3 * least({_tail("z_chi")}, 2 * {_tail("z_runs")}, 2 * {_tail("z_serial")})) AS p_random,
    pow(2.0::DOUBLE, -greatest(cost - n * even, 0) / {secrets.PER_BIT}.0::DOUBLE) AS p_text
  FROM scores
), one AS (
  SELECT DISTINCT token, n, p_text FROM levels
), size AS (
  SELECT count(*) AS m, sum(n) AS len FROM one
), binned AS (
  SELECT token, CASE WHEN w > 0 THEN least(greatest(floor(-log2(w) * {secrets.PER_POWER}), 0), {secrets.BINS - 1}) ELSE {secrets.BINS - 1} END AS bin
  FROM (SELECT token, p_text * len::DOUBLE / (n * m::DOUBLE) AS w FROM one CROSS JOIN size)
), cut AS (
  SELECT min(b) AS b FROM (
    SELECT b, count(*) AS found FROM range({secrets.BINS}) r(b) JOIN binned ON bin >= b GROUP BY b) CROSS JOIN size
  WHERE m * pow(2.0::DOUBLE, -b / {secrets.PER_POWER}.0::DOUBLE) <= {secrets.FALSE_DISCOVERIES}::DOUBLE * found
), found AS (
  SELECT rid, kind, start, "end" FROM span WHERE kind < 3
  UNION ALL
  SELECT rid, kind, start, "end" FROM levels JOIN binned USING (token) JOIN cut ON bin >= b
  WHERE p_random >= {secrets.RANDOM_LEVEL}::DOUBLE
), said AS (
  SELECT *, {list(secrets.KINDS)}[kind + 1] || ':' || start || ':' || "end" AS s FROM found
), listed AS (
  SELECT rid, {", ".join(f"count(*) FILTER (kind = {k}) AS n_{name}" for k, name in enumerate(secrets.KINDS))},
    string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(s, ',' ORDER BY start, kind) AS spans
  FROM said GROUP BY rid
)
SELECT doc_id, {", ".join(f"coalesce(n_{name}, 0) AS n_{name}" for name in secrets.KINDS)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM doc LEFT JOIN listed USING (rid)
"""

OP4 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### :' || chr(10) || '</turn>' || chr(10))
    + length(regexp_replace(role, '([\\#<:\n])', '\\\1', 'g'))
    + length(regexp_replace(text, '([\\#<])', '\\\1', 'g')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

# Every window that shares a shingle with an item, by its exact similarity; items have 5 words
# and more, a text can be shorter than an item.
LEAKS = r"""
doc AS (
  SELECT doc_id, [w FOR w IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF w <> ''] AS ws FROM docs
), item AS (
  SELECT item_id, [w FOR w IN string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF w <> ''] AS ws FROM benchmark
), item_shingle AS (
  SELECT item_id, s, count(*) AS n FROM (
    SELECT item_id, unnest([list_slice(ws, p, p + 4) FOR p IN range(1, len(ws) - 3)]) AS s FROM item)
  GROUP BY item_id, s
), doc_shingle AS (
  SELECT doc_id, len(ws) AS n_doc, p, list_slice(ws, p, p + 4) AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS p FROM doc)
), hit AS (
  SELECT doc_id, item_id, p, s, n, n_doc, least(len(ws), n_doc) AS len, len(ws) - 4 AS n_item
  FROM doc_shingle JOIN item_shingle USING (s) JOIN item USING (item_id)
), win AS (
  SELECT DISTINCT doc_id, item_id, len, n_item,
    unnest(range(greatest(1, p - len + 5), least(p, n_doc - len + 1) + 1)) AS w FROM hit
), common AS (
  SELECT doc_id, item_id, w, len, any_value(n_item) AS n_item, sum(least(seen, n)) AS m FROM (
    SELECT win.doc_id, win.item_id, w, win.len, win.n_item, s, count(*) AS seen, any_value(n) AS n
    FROM win JOIN hit ON hit.doc_id = win.doc_id AND hit.item_id = win.item_id AND p BETWEEN w AND w + win.len - 5
    GROUP BY win.doc_id, win.item_id, w, win.len, win.n_item, s)
  GROUP BY doc_id, item_id, w, len
), scored AS (
  SELECT *, m::DOUBLE / (n_item + len - 4 - m)::DOUBLE AS similarity FROM common
), leaks AS (
  SELECT doc_id, item_id, similarity, (w - 1)::BIGINT AS start, len::BIGINT AS n_words FROM scored WHERE similarity >= 0.8
  QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, w) = 1
)
"""

OP5 = "WITH docs AS (SELECT doc_id, text FROM documents), " + LEAKS + "SELECT * FROM leaks"

# Rows of ``docs`` (doc_id, source, size) mixed; the order within a source is one window here.
MIX = r"""
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    sum(floor(size * 1000 / (size + 200))::BIGINT * size)::BIGINT AS merits
  FROM docs GROUP BY source
), weighted AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM sources
), ordered AS (
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(3 * source_size) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped_before,
    sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_from
  FROM weighted
), level AS (
  SELECT total - capped_before AS words, weight_from AS weights, source_size * 3 * weight_from < weight * (total - capped_before) AS above,
    source_size::DOUBLE / weight AS ratio, source
  FROM ordered
), solved AS (
  SELECT words, weights FROM level WHERE NOT above ORDER BY ratio, source NULLS LAST LIMIT 1
), targets AS (
  SELECT source, source_size, merits,
    CASE WHEN source_size * 3 * weights < weight * words THEN (source_size * 3)::DOUBLE
      ELSE words::DOUBLE * weight / weights::DOUBLE END AS target
  FROM weighted CROSS JOIN solved
), shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets
), wants AS (
  SELECT *, target - whole * source_size AS wanted,
    CASE WHEN source_size > 0 THEN (target - whole * source_size) / source_size ELSE 0 END AS share,
    CASE WHEN source_size > 0 THEN merits::DOUBLE / source_size ELSE 0 END AS mean_merit
  FROM shares
), chances AS (
  SELECT d.doc_id, d.size, w.*,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u,
    share + 0.5::DOUBLE * least(share, 1 - share) * ((floor(size * 1000 / (size + 200)) - mean_merit) / 1000) AS chance
  FROM docs d JOIN wants w ON d.source IS NOT DISTINCT FROM w.source
), ranks AS (
  SELECT *, CASE WHEN share > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS rank FROM chances
), places AS (
  SELECT *, rank / (1 + rank) AS place FROM ranks
), sums AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM places
), mixed AS (
  SELECT doc_id, size, source_size, target, whole + CASE WHEN place IS NULL THEN 0 WHEN upto <= wanted THEN 1
      WHEN upto - size < wanted AND upto - wanted <= wanted - (upto - size) THEN 1 ELSE 0 END AS copies
  FROM sums
)
"""

OP7 = r"""
WITH docs AS (
  SELECT doc_id, source, len([w FOR w IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF w <> ''])::BIGINT AS size
  FROM documents
), """ + MIX + """
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies::BIGINT AS copies FROM mixed
"""

OP11 = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
  SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM doc
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common c USING (key) GROUP BY r
"""

_CRC_STEP = "CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END"
OP12 = f"""
WITH RECURSIVE crc(i, k, v) AS (
  SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, {_CRC_STEP} FROM crc WHERE k < 8
), crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM crc WHERE k = 8
), turn AS (
  SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t, turn
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(t ORDER BY turn NULLS FIRST, t) AS ts FROM turn GROUP BY conv_id
), planned AS (
  SELECT o.conv_id, o.ts, b.ts AS lent, xor(list_reduce(
      list_prepend(4294967295::BIGINT, [ord(c)::BIGINT FOR c IN string_split(o.conv_id::VARCHAR, '')]),
      lambda x, y: xor(x >> 8, crc_table.t[xor(x & 255, y) + 1])), 4294967295) % 6 AS h
  FROM own o CROSS JOIN crc_table LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100
), conv AS (
  SELECT conv_id, list_concat(coalesce(lent[:h], []), ts[h + 1:]) AS ts FROM planned
), member AS (
  SELECT conv_id, len(ts) AS n, unnest(range(len(ts) + 1)) AS depth, ts FROM conv
), placed AS (
  SELECT conv_id, n, depth, ts[:depth] AS path, ts[:depth - 1] AS above FROM member
), node AS (
  SELECT depth, path, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM placed GROUP BY depth, path
), child AS (
  SELECT depth - 1 AS depth, above AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL
), full_node AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children FROM node n LEFT JOIN child c USING (depth, path)
), up AS (
  SELECT unnest(range(depth + 1)) AS d, path, n_children, n_convs,
    CASE WHEN depth > 0 THEN (n_convs - 1) * length(path[depth].text) ELSE 0 END AS saved FROM full_node
), subtree AS (
  SELECT d AS depth, path[:d] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved
  FROM up GROUP BY ALL
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves,
  s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM full_node n JOIN subtree s USING (depth, path)
LEFT JOIN node p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = n.above
"""

ORACLES: dict[str, str] = {
    "op1_topk_search": OP1,
    "op2_substring_dedup": OP2,
    "op3_secret_scan": OP3,
    "op4_chat_format": OP4,
    "op5_decontaminate": OP5,
    "op7_mix_sources": OP7,
    "op11_line_dedup": OP11,
    "op12_prefix_trie": OP12,
}
