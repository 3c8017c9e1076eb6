"""DuckDB SQL for the queries of this package that SQL can express, written from the contracts.

Not here: placement by XXH64 and a filled table, token ids and counts, fuzzy matching, fingerprints.
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWERED = _LOWER.format("coalesce(text, '')")
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_NORMAL = rf"list_filter(regexp_split_to_array({_LOWERED}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

OP1 = f"""
WITH l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
k AS (SELECT doc_id, pos, line, trim({_LOWER.format('line')}, {_BLANKS}) AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, coalesce(k.doc_id > f.first, false) AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""

OP2 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT g.doc_id, unnest([i, i + 1, i + 2]) AS p FROM g JOIN (SELECT doc_id, s FROM g GROUP BY ALL HAVING count(*) > 1) x ON g.doc_id = x.doc_id AND g.s = x.s) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: trim(x, {_BLANKS}) <> '') AS lines FROM d),
m AS (SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (n_words > 1000000)::BIGINT + 8 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::BIGINT
  + 16 * (10 * n_symbols > n_words)::BIGINT + 32 * (n_dup_lines > 3 AND 10 * n_dup_lines > 3 * n_lines)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 59) = 0 AS kept, fail_bits FROM b"""


def _spans(kind: int, pattern: str, keep: str = "true") -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return rf"""SELECT doc_id, {kind} AS k, v, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS s FROM (
      SELECT *, unnest(range(1, len(found) + 1)) AS i, unnest(found) AS v, unnest(g2) AS value FROM (SELECT doc_id, regexp_extract_all(t, {p}) AS found, regexp_extract_all(t, {p}, {2 if kind == 0 else 0}) AS g2, regexp_split_to_array(t, {p}) AS gaps FROM d WHERE regexp_matches(t, {p}))) WHERE {keep}"""


OP6 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS ({_spans(0, '''(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)''', 'length(value) >= 12')}
  UNION ALL {_spans(1, 'AKIA[A-Z0-9]{14,}')} UNION ALL {_spans(2, '[0-9a-f]{16,}')}),
c AS ({_spans(3, '[A-Za-z0-9+/_=-]{20,}')}),
f AS (SELECT *, CASE WHEN hex THEN bare ELSE rest END AS x FROM (SELECT *, regexp_matches(bare, '^(?:[0-9a-f]+|[0-9A-F]+)$') AND length(bare) >= 20 AS hex
  FROM (SELECT *, regexp_replace(v, '^=+', '') AS rest, regexp_replace(v, '^[_=+/-]+', '') AS bare FROM c))),
e AS (SELECT doc_id, k, v, s FROM f WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = f.doc_id AND b.s < f.s + length(f.v) AND f.s < b.s + length(b.v)) AND length(x) >= 20
  AND NOT regexp_matches(x, '(?i)example|placeholder|your[_-]?(api)?[_-]?key|x{{6,}}|abcdefgh|0123456789|qwerty') AND NOT regexp_matches(x, '^[A-Za-z]+$|^[0-9]+$|^[_=+/-]+$') AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]')
  AND list_max(list_transform(range(1, length(x) - 18), lambda i: log2(20) - list_sum(list_transform(list_distinct(string_split(substr(x, i, 20), '')), lambda ch: (20 - length(replace(substr(x, i, 20), ch, ''))) * log2(20 - length(replace(substr(x, i, 20), ch, ''))))) / 20))
    >= CASE WHEN hex THEN 3.0 ELSE 3.6 END),
a AS (SELECT doc_id, k, s, ['assign', 'access', 'hex', 'entropy'][k + 1] || ':' || s || ':' || (s + length(v)) AS x FROM (SELECT * FROM b UNION ALL SELECT * FROM e))
SELECT doc_id, count(k) FILTER (k = 0) AS n_assign, count(k) FILTER (k = 1) AS n_access, count(k) FILTER (k = 2) AS n_hex,
  sha256(coalesce(string_agg(x, ',' ORDER BY s, k) FILTER (k < 3), '')) AS base_sha256, coalesce(string_agg(x, ',' ORDER BY s, k), '') AS spans FROM d LEFT JOIN a USING (doc_id) GROUP BY doc_id"""

OP7 = f"""
WITH d AS (SELECT doc_id, {_NORMAL} AS w FROM documents), b AS (SELECT item_id, {_NORMAL} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id::VARCHAR AS item, array_to_string(w[i:i + 9], ' ') AS x, len(w[i:i + 9]) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
g AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT g.doc_id, g.i, g.n, item FROM g JOIN win ON win.x = g.x AND win.n = g.n),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)"""

_ESC = r"length({0}) * 2 - length(regexp_replace({0}, '[\\<>]', '', 'g'))"
OP9 = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({_ESC.format('text')} + CASE WHEN before IS DISTINCT FROM role THEN 7 + {_ESC.format('role')} + 8 ELSE 5 END)::BIGINT AS formatted_chars FROM o GROUP BY conv_id"""

_POLICIES = {("base", 1): {"few_words": 1, "repeated_windows": 2}, ("default", 2): {"few_words": 1, "repeated_windows": 2, "odd_word_length": 8, "symbols": 16, "repeated_lines": 32}}
ABLATIONS = f"WITH book AS ({OP2}) " + " UNION ALL ".join(
    f"SELECT '{policy}' AS policy, {version} AS version, '{rule}' AS rule, count(*) AS n_docs, count(*) FILTER (fail_bits & {sum(rules.values())} = 0) AS n_kept, count(*) FILTER (fail_bits & {bit} <> 0) AS n_failed, count(*) FILTER (fail_bits & {sum(rules.values())} = {bit}) AS n_only_this FROM book"
    for (policy, version), rules in _POLICIES.items() for rule, bit in rules.items()
)

SQL: dict[str, str] = {"quality_ablations": ABLATIONS, "op1_line_dedup": OP1, "op2_quality_rules": OP2, "op6_secret_scans": OP6, "op7_decontamination": OP7, "op9_chat_formatting": OP9}
