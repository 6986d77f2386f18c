"""DuckDB SQL for the queries that SQL can express, written from the contracts and not from the operators."""

from __future__ import annotations

import re

from .licenses import CONTAINMENT, PHRASES, RUN, TEMPLATES, template_words
from .secrets import KINDS, MAX_DOCS, MAX_OWNERS, MIN_VALUE, OWNED

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
    p AS (SELECT doc_id, r, len(w) AS n, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word, w FROM d),
    h AS (SELECT doc_id, r, n, j, word, CASE WHEN j + 49 <= n THEN array_to_string(w[j:j + 49], ' ') END AS s FROM p),
    m AS (SELECT *, s IS NOT NULL AND min(doc_id) OVER (PARTITION BY s) < doc_id AS hit FROM h),
    c AS (SELECT *, bool_or(hit) OVER (PARTITION BY r ORDER BY j ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m)
    SELECT d.doc_id, CAST(len(any_value(d.w)) AS BIGINT) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY j) FILTER (NOT gone), '')) AS kept_sha256
    FROM d LEFT JOIN c ON c.r = d.r GROUP BY d.r, d.doc_id"""

OP3 = f"""WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [w[i:i + 2] FOR i IN range(1, len(w) - 1)] WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM d),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.m AS component_id, d.doc_id = c.m AS kept FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1) c USING (doc_id)"""


def _op5() -> str:
    parts = []
    for k, (name, pattern) in enumerate([*KINDS.items(), ("owned", OWNED)]):
        p, group = pattern.replace("'", "''"), 2 if name == "assign" else 0
        parts.append(f"""SELECT r, doc_id, source, {k} AS kind, unnest(range(1, len(h) + 1)) AS i, h, g, v FROM (SELECT *, regexp_extract_all(t, '{p}') AS h, regexp_split_to_array(t, '{p}') AS g, regexp_extract_all(t, '{p}', {group}) AS v FROM d)""")
    size = "coalesce(list_sum([length(y) FOR y IN {}]), 0)"
    names = ", ".join(f"'{n}'" for n in (*KINDS, "owned"))
    text = f"concat(([{names}])[kind + 1], ':', a, ':', b)"
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, source, coalesce(text, '') AS t FROM documents), m AS ({" UNION ALL ".join(parts)}),
    x AS (SELECT r, doc_id, source, kind, v[i] AS v, CAST({size.format("g[1:i]")} + {size.format("h[1:i - 1]")} AS BIGINT) AS a, length(h[i]) AS len FROM m),
    e AS (SELECT *, a + len AS b FROM x WHERE (kind > 0 OR length(v) >= {MIN_VALUE}) AND (kind < {len(KINDS)} OR (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')))),
    o AS (SELECT v, count(DISTINCT coalesce(source, chr(0))) AS owners, count(DISTINCT [coalesce(source, chr(0)), coalesce(CAST(doc_id AS VARCHAR), 'row ' || r)]) AS docs FROM e GROUP BY 1),
    f AS (SELECT e.*, owners <= {MAX_OWNERS} AND docs <= {MAX_DOCS} AS live FROM e JOIN o ON e.v = o.v),
    k AS (SELECT *, kind < {len(KINDS)} OR (live AND NOT EXISTS (SELECT 1 FROM f q WHERE q.r = f.r AND q.kind < {len(KINDS)} AND q.a <= f.a AND f.b <= q.b)) AS shown FROM f)
    SELECT d.doc_id, {", ".join(f"count(*) FILTER (kind = {j}) AS n_{n}" for j, n in enumerate(KINDS))},
    sha256(coalesce(string_agg({text}, ',' ORDER BY a, kind) FILTER (kind < {len(KINDS)}), '')) AS base_sha256, coalesce(string_agg({text}, ',' ORDER BY a, kind) FILTER (shown), '') AS spans,
    count(*) FILTER (kind < {len(KINDS)} AND live) AS n_live FROM d LEFT JOIN k ON k.r = d.r GROUP BY d.r, d.doc_id"""


def _op9() -> str:
    places = []
    for phrase, label in PHRASES.items():
        words = phrase.split()
        same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
        places.append(f"SELECT r, '{label}' AS label, unnest([i - 1 FOR i IN range(1, len(w) - {len(words) - 2}) IF {same}]) AS place FROM d")
    rows = []
    for label, text in TEMPLATES:
        words = template_words(text)
        quoted = ", ".join("'" + w + "'" for w in words)
        rows.append(f"SELECT '{label}' AS label, [{quoted}] AS tw, {RUN} * {len(re.findall('[0-9a-z]+', text.lower()))} AS run")
    split = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_LOWER.format("coalesce(text, '')")} AS t, {split.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
    b AS ({" UNION ALL ".join(places)}), base AS (SELECT r, count(*) AS n, min(place) AS lo, max(place) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY 1),
    tpl AS ({" UNION ALL ".join(rows)}),
    whole AS (SELECT r, label, tw, run, w FROM d CROSS JOIN tpl WHERE len(list_intersect(tw, w)) >= {CONTAINMENT} * len(tw) - 1e-9),
    runs AS (SELECT r, label, len(tw) AS size, list_max([len(list_intersect(tw, w[i:i + run - 1])) FOR i IN range(1, len(w) + 1) IF list_contains(tw, w[i])]) AS n FROM whole),
    c AS (SELECT r, label, n / size AS score FROM runs WHERE n >= {CONTAINMENT} * size - 1e-9),
    every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM b UNION ALL SELECT r, label FROM c) GROUP BY 1), best AS (SELECT r, max(score) AS score FROM c GROUP BY 1)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels, CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0) END AS score
    FROM d LEFT JOIN base USING (r) LEFT JOIN every USING (r) LEFT JOIN best USING (r)"""


OP5, OP9 = _op5(), _op9()

OP11 = rf"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
    d AS (SELECT r, doc_id, unnest(t) AS term FROM w), n AS (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n FROM w WHERE len(t) > 0),
    s AS (SELECT count(*) AS docs, CAST(coalesce(sum(n), 0) AS BIGINT) AS total FROM n),
    i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    tf AS (SELECT r, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM i) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    wt AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS wt FROM df, s),
    m AS (SELECT r, doc_id, 50 + (50 * n * docs) // total AS m FROM n, s),
    x AS (SELECT item_id, doc_id, r, CAST(sum(wt * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM i JOIN tf USING (term) JOIN wt USING (term) JOIN m USING (r) GROUP BY 1, 2, 3),
    k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 50"""

OP12 = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
    l AS (SELECT doc_id, r, unnest(range(1, len(x) + 1)) AS j, unnest(x) AS line FROM d),
    k AS (SELECT *, {_LOWER.format("trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))")} AS key FROM l),
    f AS (SELECT key, min(doc_id) AS least FROM k WHERE length(key) >= 10 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2),
    g AS (SELECT k.*, coalesce(k.doc_id > f.least, false) AS gone FROM k LEFT JOIN f USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY j) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY r, doc_id"""

OP13 = """WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
    p AS (SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM s WHERE same) WHERE k <= 5),
    n AS (SELECT p.a, p.b, p.score AS positive_score, s.b AS negative, s.score, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS k
        FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
    SELECT a AS anchor_id, b AS positive_id, CAST(k AS INTEGER) AS rank, negative AS negative_id, positive_score, score AS negative_score FROM n WHERE k <= 5"""
