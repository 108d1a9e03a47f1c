"""SQL that must give the same rows as the corpus queries, for those that SQL can express."""

from __future__ import annotations

from .cascade import STOP_WORDS
from .urls import BASE_RULES, PATTERN_RULES, regex_of

_A_Z, _a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"words AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SUBSTRING = f"""
WITH {_WORDS},
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words)),
first AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (k) WHERE f < doc_id)),
place AS (SELECT doc_id, p, w[p] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM words)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM place ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

JACCARD = f"""
WITH RECURSIVE {_WORDS},
gram AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
),
size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
both_in AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM gram a JOIN gram b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM both_in p JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 5 * p.n >= 4 * (x.n + y.n - p.n)
),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
low AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a),
links AS (SELECT a AS doc_id, count(*) AS n FROM edge GROUP BY a)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(n, 0) AS n_links,
  CASE WHEN len(w) = 0 THEN d.doc_id ELSE min(d.doc_id) OVER (PARTITION BY array_to_string(w, ' ')) END AS copy_id
FROM words d LEFT JOIN low USING (doc_id) LEFT JOIN links USING (doc_id)
"""

QUALITY_RULES = rf"""
WITH {_WORDS},
tri AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
again AS (SELECT doc_id, k FROM tri GROUP BY doc_id, k HAVING count(*) > 1),
inside AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM tri JOIN again USING (doc_id, k)) GROUP BY doc_id),
fact AS (
  SELECT doc_id, text, w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(inside.n, 0) AS n_repeat_words
  FROM words LEFT JOIN inside USING (doc_id)
),
base AS (
  SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM fact
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 3 * n_words OR word_chars > 12 * n_words OR 100 * n_symbols > 10 * n_words
    OR 100 * n_dup_lines > 40 * len(lines)
    OR 100 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)$'))) > 30 * len(lines)
    OR 100 * len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) > 90 * len(lines)
    OR 100 * len(regexp_extract_all(text, '[A-Za-z\x{{80}}-\x{{10FFFF}}]')) < 80 * word_chars
    OR 100 * len(regexp_extract_all(text, '[A-Z]')) > 30 * word_chars
    OR len(list_intersect(list_distinct(w), [{", ".join(map(quoted, STOP_WORDS))}])) < 2) AS kept
FROM base
"""

DECONTAMINATION = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_A_Z}', '{_a_z}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_A_Z}', '{_a_z}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
phrase AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM items WHERE len(w) > 0)
),
win AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM phrase))
),
met AS (SELECT doc_id, i, n, item_id FROM win JOIN phrase USING (n, k)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def _url_filters() -> str:
    base = sorted(BASE_RULES, key=lambda r: (-len(r[1]), r[1]))
    fits = lambda r: f"(host = '{r.split('/')[0]}' OR ends_with(host, '.{r.split('/')[0]}')) AND starts_with(path, '{r[r.index('/'):]}')"
    pick = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{value(v, r)}'" for v, r in base) + " END"
    said = lambda ps: "CASE " + " ".join(f"WHEN regexp_matches(low, {quoted(regex_of(p))}) THEN {quoted(p)}" for p in ps) + " END"
    allow, block = [p for p in PATTERN_RULES if p.startswith("@@")], [p for p in PATTERN_RULES if not p.startswith("@@")]
    return rf"""
WITH cut AS (
  SELECT page_id, translate(url, '{_A_Z}', '{_a_z}') AS low,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_A_Z}', '{_a_z}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
),
based AS (SELECT *, {pick(lambda v, r: r)} AS rule, {pick(lambda v, r: v)} AS base_verdict, {said(allow)} AS allowed, {said(block)} AS blocked FROM cut)
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN coalesce(allowed, blocked) END AS pattern,
  CASE WHEN rule IS NOT NULL THEN base_verdict WHEN allowed IS NULL AND blocked IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM based
"""


URL_FILTERS = _url_filters()

FILTER_AUDIT = rf"""
WITH fact AS (
  SELECT d.doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
),
failing AS (
  SELECT part, good, toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t),
    regexp_matches(t, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY t)] AS f
  FROM fact
),
digits AS (SELECT unnest(range(1, 6)) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM digits a, digits b, digits c, digits d, digits e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
),
cell AS (SELECT part, f, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM failing GROUP BY part, f),
step AS (
  SELECT part, o, s AS step, n, good, toxic, f[o[s]] AS fails, len(list_filter(o[:s - 1], lambda x: f[x])) > 0 AS gone, len(list_filter(f, lambda x: x)) AS n_fails
  FROM cell, orders, (SELECT unnest(range(1, 6)) AS s)
),
told AS (
  SELECT part, array_to_string(list_transform(o, lambda x: substr('ABCDE', CAST(x AS INTEGER), 1)), '') AS filter_order, CAST(step AS INTEGER) AS step,
    CAST(sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN fails AND n_fails = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM step GROUP BY ALL
)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley FROM told
"""


def _crc_steps() -> str:
    """Remainders of the 256 bytes by the reflected polynomial of CRC-32, as a SQL list."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    return f"[{', '.join(map(str, table))}]"


SPELLING = rf"""
WITH RECURSIVE run AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_A_Z}', '{_a_z}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents
),
typed AS (SELECT doc_id, r, count(*) AS n, hex(encode(doc_id || ':' || r)) AS hex FROM run GROUP BY doc_id, r),
steps AS (SELECT {_crc_steps()} AS t),
summed AS (
  SELECT doc_id, r, typed.n, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, CAST(length(hex) / 2 AS BIGINT)), lambda k: CAST('0x' || substr(hex, CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS h
  FROM typed, steps
),
counted AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n FROM summed
),
word AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM counted WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word)),
pair AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN word b ON a.d = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN word b ON a.d = b.word
),
ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS k FROM pair),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
  FROM word w LEFT JOIN ranked r ON r.word = w.word AND k = 1
),
walk(word, here) AS (SELECT word, word FROM formed UNION ALL SELECT v.word, f.form FROM walk v JOIN formed f ON f.word = v.here WHERE f.form IS NOT NULL),
root AS (SELECT v.word, v.here AS root FROM walk v JOIN formed f ON f.word = v.here WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN root USING (word)
"""
