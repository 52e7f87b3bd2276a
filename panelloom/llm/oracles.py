"""DuckDB SQL for the queries that SQL can express: plain joins over all rows, without hashes, seeds or sweeps."""
from __future__ import annotations

from .decontaminate import EQUAL, EQUAL_SHARE, LEAST_WORDS, WINDOW
from .licenses import PHRASES, TEMPLATES, THRESHOLD, window_class
from .urlrules import RULES

A_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
BLANKS = "' ' || chr(9) || chr(13)"


def _cut(text: str) -> str:
    return f"list_filter(regexp_split_to_array(translate({text}, {A_Z}), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


#: The rule alone, without seeds: all equal words of a document and an item, counted along each diagonal.
OP1 = f"""
WITH items AS (SELECT item_id, w, len(w) AS n, least(len(w), {WINDOW}) AS width, CASE WHEN len(w) >= {WINDOW} THEN {EQUAL} ELSE ceil(len(w) * {EQUAL_SHARE}) END AS need
               FROM (SELECT DISTINCT item_id, {_cut("text")} AS w FROM benchmark) WHERE len(w) >= {LEAST_WORDS}),
item_words AS (SELECT item_id, n, width, need, unnest(w) AS word, unnest(range(n)) AS q FROM items),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM (SELECT doc_id, {_cut("text")} AS w FROM documents)),
same AS (SELECT doc_id, item_id, n, width, need, p - q AS s, q FROM words JOIN item_words USING (word)),
near AS (SELECT doc_id, item_id, s FROM same GROUP BY ALL HAVING count(*) >= min(need)),
counted AS (SELECT doc_id, item_id, n, width, need, s, q, CASE WHEN q <= n - width
              THEN count(*) OVER (PARTITION BY doc_id, item_id, s ORDER BY q RANGE BETWEEN CURRENT ROW AND {WINDOW} - 1 FOLLOWING)
              ELSE count(*) FILTER (q >= n - width) OVER (PARTITION BY doc_id, item_id, s) END AS equal
            FROM same JOIN near USING (doc_id, item_id, s))
SELECT doc_id, item_id, max(equal) AS equal_words, max(n) AS item_words, min(greatest(s + q, 0)) AS first_word
FROM counted WHERE equal >= need GROUP BY doc_id, item_id
"""

OP2 = f"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i
               FROM documents WHERE text IS NOT NULL),
filled AS (SELECT doc_id, i, trim(line, {BLANKS}) AS x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k
           FROM lines WHERE trim(line, {BLANKS}) <> ''),
threes AS (SELECT a.doc_id, a.i AS i0, b.i AS i1, c.i AS i2, row_number() OVER (PARTITION BY a.x, b.x, c.x ORDER BY a.doc_id, a.i) AS turn
           FROM filled a JOIN filled b ON a.doc_id = b.doc_id AND b.k = a.k + 1 JOIN filled c ON a.doc_id = c.doc_id AND c.k = a.k + 2),
gone AS (SELECT DISTINCT doc_id, unnest([i0, i1, i2]) AS i FROM threes WHERE turn > 1),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS body FROM lines WHERE (doc_id, i) NOT IN (SELECT (doc_id, i) FROM gone) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM filled GROUP BY doc_id),
r AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n_lines, 0) AS n_lines, coalesce(r.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN coalesce(k.body, '') END AS clean_text
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id)
"""

_WORDS = "list_filter(regexp_split_to_array(translate({0}, " + A_Z + "), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


def _places(phrase: str) -> str:
    tokens = phrase.split()
    same = " AND ".join(f"w[i + {k + 1}] = '{t}'" for k, t in enumerate(tokens))
    return f"list_filter(range(len(w) - {len(tokens) - 1}), lambda i: {same})"


OP4 = f"""
WITH cut AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
base AS (SELECT doc_id, len(w) AS n_words, {", ".join(f"{_places(p)} AS p{i}" for i, (p, _) in enumerate(PHRASES))} FROM cut),
places AS (SELECT doc_id, n_words, list_concat(list_concat(p0, p1), p2) AS p,
             list_sort(list_filter([{", ".join(f"CASE WHEN len(p{i}) > 0 THEN '{label}' END" for i, (_, label) in enumerate(PHRASES))}], lambda x: x IS NOT NULL)) AS b
           FROM base),
templates AS (SELECT label, list_distinct(string_split(t, ' ')) AS tokens, c, must, without
              FROM (VALUES {", ".join(f"('{label}', '{t}', {window_class(t)}, {must}::VARCHAR[], {without}::VARCHAR[])" for label, t, must, without in TEMPLATES)}) v(label, t, c, must, without)),
starts AS (SELECT doc_id, w, c, unnest(range(0, len(w), CAST(pow(2, c) AS BIGINT))) AS s FROM cut, (SELECT DISTINCT c FROM templates) WHERE len(w) > 0),
found AS (SELECT doc_id, c, s, label, len(list_intersect(tokens, lw)) AS held, len(tokens) AS n
          FROM (SELECT doc_id, c, s, w[s + 1:s + CAST(pow(2, c + 1) AS BIGINT)] AS lw FROM starts) JOIN templates USING (c)
          WHERE len(list_intersect(tokens, lw)) >= ceil({THRESHOLD} * len(tokens) - 1e-9) AND list_has_all(lw, must) AND NOT list_has_any(lw, without)),
more AS (SELECT doc_id, list(DISTINCT label) AS l, max(held / n) AS s, count(DISTINCT (c, s)) AS n_blocks FROM found GROUP BY doc_id)
SELECT doc_id, n_words, len(p) AS n_base, list_min(p) AS first_word, list_max(p) AS last_word, array_to_string(b, ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(b, coalesce(l, [])))), ',') AS labels,
       CASE WHEN len(p) > 0 THEN 1.0 ELSE coalesce(s, 0.0) END::DOUBLE AS score, coalesce(n_blocks, 0) AS n_blocks
FROM places LEFT JOIN more USING (doc_id)
"""

OP10 = f"""
WITH rules AS (SELECT * FROM (VALUES {", ".join(str(r) for r in RULES)}) v(says, rule_host, rule_path)),
cut AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), {A_Z}), '') AS host,
          coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
best AS (SELECT page_id, rule_host || rule_path AS rule, says, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS turn
         FROM cut JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT cut.page_id, host, path, rule, coalesce(says, CASE WHEN host = '' THEN 'block' ELSE 'allow' END) AS verdict
FROM cut LEFT JOIN (SELECT * FROM best WHERE turn = 1) b ON cut.page_id = b.page_id
"""

SQL = {"op1_spaced_seeds": OP1, "op2_line_windows": OP2, "op4_license_scan": OP4, "op10_url_rules": OP10}
