"""SQL for DuckDB that gives the rows of the queries that it can express."""

from __future__ import annotations

import math

from hemolens.llm.common import LOWER, UPPER
from hemolens.llm.secrets import ALLOWED, CANDIDATE, CLASSES, ENTROPY, PATTERNS

WORDS = r"list_filter(regexp_split_to_array(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS win FROM s),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE n > 1),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
l AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.p) FILTER (WHERE c.p IS NULL) AS kept, count(c.p) AS n_removed
      FROM t LEFT JOIN c ON t.doc_id = c.doc_id AND t.p = c.p GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN l ON d.doc_id = l.doc_id"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(f"translate(text, '{UPPER}', '{LOWER}')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS g FROM d),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
t AS MATERIALIZED (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY ALL"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _located(name: str, kind: int, pattern: str, group: int, least: int) -> str:
    """Spans of one kind: match starts are the lengths of what lies between and of earlier matches."""
    p = _quoted(pattern)
    return f"""{name} AS (SELECT doc_id, {kind} AS kind, unnest(list_transform(range(1, len(h) + 1), lambda i: {{
      'a': list_sum(list_transform(b[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: len(x))), 0),
      'm': h[i], 'g': len(q[i])}})) AS s
    FROM (SELECT doc_id, regexp_extract_all(t, {p}, 0) AS h, regexp_extract_all(t, {p}, {group}) AS q, regexp_split_to_array(t, {p}) AS b FROM d)),
  {name}_ok AS (SELECT doc_id, kind, CAST(s.a AS BIGINT) AS a, CAST(s.a AS BIGINT) + len(s.m) AS z, s.m AS m FROM {name} WHERE s.g >= {least})"""


def _most() -> str:
    rules = [f"WHEN regexp_matches(m, {_quoted(p)}) THEN {w * (math.log2(w) - b) + 1e-9!r}::DOUBLE" for p, w, b in CLASSES.values()]
    return f"CASE {' '.join(rules)} END"


_KINDS = ", ".join(_located(n, k, p, g, least) for k, (n, (p, g, least)) in enumerate(PATTERNS.items()))
_ALLOWED = " OR ".join(f"regexp_matches(m, {_quoted(p)})" for p in ALLOWED)
_NAMES = "['" + "', '".join([*PATTERNS, ENTROPY]) + "']"
_TEXT = f"string_agg({_NAMES}[kind + 1] || ':' || a || ':' || z, ',' ORDER BY a, kind, z)"
SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {_KINDS},
{_located("cand", len(PATTERNS), CANDIDATE, 0, 0)},
mixed AS (SELECT *, {_most()} AS most FROM cand_ok WHERE regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND NOT ({_ALLOWED})),
win AS (SELECT *, unnest(range(0, len(m) - 19)) AS i FROM mixed),
dense AS (SELECT *, list_sum(list_transform(map_values(list_aggregate(string_split(substr(m, i + 1, 20), ''), 'histogram')), lambda c: c * log2(c))) AS total FROM win),
ent AS (SELECT doc_id, kind, a + min(i) AS a, a + max(i) + 20 AS z FROM dense WHERE total <= most GROUP BY doc_id, kind, dense.a, m),
base AS ({" UNION ALL ".join(f"SELECT doc_id, kind, a, z FROM {n}_ok" for n in PATTERNS)}),
b AS (SELECT doc_id, {_TEXT} AS s, {", ".join(f"count(*) FILTER (WHERE kind = {k}) AS n_{n}" for k, n in enumerate(PATTERNS))} FROM base GROUP BY 1),
e AS (SELECT doc_id, {_TEXT} AS s FROM (SELECT * FROM base UNION ALL SELECT * FROM ent) GROUP BY 1)
SELECT d.doc_id, {", ".join(f"coalesce(n_{n}, 0) AS n_{n}" for n in PATTERNS)}, sha256(coalesce(b.s, '')) AS base_sha256, coalesce(e.s, '') AS spans
FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN e ON e.doc_id = d.doc_id"""

COPIES = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM d"""

NEGATIVES = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c)))),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 5"""

ORACLES = {"op4_jaccard_join": JACCARD, "op9_secret_scans": SECRETS, "op10_substring_dedup": SUBSTRINGS, "op12_hard_negatives": NEGATIVES, "op13_exact_dedup": COPIES}
