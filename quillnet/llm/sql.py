"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from quillnet.llm.licenses import PHRASES, TEMPLATES
from quillnet.llm.urls import LOWER, RULES, UPPER, VARIABLE

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP1 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM benchmark WHERE item_id IS NOT NULL),
g AS (
  SELECT DISTINCT item_id::VARCHAR AS item, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
),
ks AS (SELECT DISTINCT k FROM g),
p AS (SELECT r, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS p
      FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT p.r, p.i, p.k, g.item FROM p JOIN g USING (k, p)),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM h) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

_T = ", ".join(f"({i}, '{label}', '{t}')" for i, (label, t) in enumerate(TEMPLATES))
_P = ", ".join(f"('{label}', '{p}')" for p, label in PHRASES.items())

OP4 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, text, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
ph AS (SELECT label, regexp_extract_all({_LOWER}, {_WORD}) AS q FROM (VALUES {_P}) v(label, text)),
pl AS (
  SELECT r, label, i FROM (SELECT r, w, label, q, unnest(range(1, len(w) - len(q) + 2)) AS i FROM d, ph WHERE list_contains(w, q[1]))
  WHERE list_slice(w, i, i + len(q) - 1) = q
),
base AS (SELECT r, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word FROM pl GROUP BY r),
t AS (SELECT id, label, w, list_distinct(w) AS s, len(w) + ceil(len(w) / 10.0) AS width, ceil(0.9::DOUBLE * len(list_distinct(w)) - 1e-9::DOUBLE) AS need
      FROM (SELECT id, label, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM (VALUES {_T}) v(id, label, text))),
o AS MATERIALIZED (SELECT r, id, i, x FROM (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS i FROM d) JOIN (SELECT id, unnest(s) AS x FROM t) USING (x)
      WHERE (r, id) IN (SELECT (r, id) FROM d, t WHERE len(list_intersect(d.w, s)) >= need)),
at_end AS (SELECT e.r, e.id, e.i, b.x, max(b.i) AS m FROM o e JOIN t USING (id) JOIN o b ON b.r = e.r AND b.id = e.id AND b.i BETWEEN e.i - width + 1 AND e.i GROUP BY ALL),
m AS MATERIALIZED (SELECT r, id, label, s, a, z, n / len(s)::DOUBLE AS c
      FROM (SELECT r, id, i AS z, min(m) AS a, count(*) AS n FROM at_end GROUP BY ALL) JOIN t USING (id) WHERE n >= need),
met AS (SELECT * FROM m WHERE NOT EXISTS (
      SELECT 1 FROM m o WHERE o.r = m.r AND o.a <= m.z AND o.z >= m.a AND o.c >= m.c AND len(o.s) > len(m.s) AND list_has_all(o.s, m.s))),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (b) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
      FROM (SELECT r, label, true AS b FROM pl UNION ALL SELECT r, label, false FROM met) GROUP BY r),
sc AS (SELECT r, max(c) AS c FROM met GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN l USING (r) LEFT JOIN sc USING (r)
"""

_SETS = rf"""
w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM {{docs}}),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS id, doc_id AS to_id FROM w UNION SELECT reach.id, e.b FROM reach JOIN e ON reach.to_id = e.a),
comp AS (SELECT id, min(to_id) AS component_id FROM reach GROUP BY id)
"""

OP6 = rf"""
WITH RECURSIVE {_SETS.format(docs="documents")}
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, t.class_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id
FROM s JOIN comp ON s.doc_id = comp.id
LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) n ON n.a = s.doc_id
JOIN (SELECT d.doc_id, CASE WHEN len(s.s) = 0 THEN d.doc_id ELSE min(d.doc_id) OVER (PARTITION BY text, len(s.s) = 0) END AS class_id
      FROM documents d JOIN s USING (doc_id)) t ON t.doc_id = s.doc_id
"""

OP10 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
f AS MATERIALIZED (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS MATERIALIZED (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM f),
g AS MATERIALIZED (SELECT * FROM q WHERE n > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93::DOUBLE),
reach AS (SELECT vec_id AS id, vec_id AS to_id FROM v UNION SELECT reach.id, l.b FROM reach JOIN l ON reach.to_id = l.a),
comp AS (SELECT id, min(to_id) AS component_id FROM reach GROUP BY id)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN comp ON v.vec_id = comp.id LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = v.vec_id
"""

ORACLES = {
    "op1_decontamination": OP1,
    "op4_licenses": OP4,
    "op6_jaccard": OP6,
    "op10_embeddings": OP10,
}

OP11 = r"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS MATERIALIZED (SELECT r, i, g FROM (SELECT r, i, array_to_string(list_slice(w, i, i + 34), ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35))),
rep AS (SELECT g FROM p GROUP BY g HAVING count(*) > 1),
hit AS MATERIALIZED (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM p JOIN rep USING (g)),
gone AS (SELECT r, count(*) AS n FROM hit GROUP BY r),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY j) AS kept FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d) ANTI JOIN hit USING (r, j) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""
ORACLES["op11_substrings"] = OP11

OP13 = r"""
WITH RECURSIVE b AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS k FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(k) + 1), lambda i: ascii(k[i])::BIGINT)),
        lambda c, x: list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)),
        4294967295::BIGINT) % 20 AS h FROM b),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
        CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
o AS MATERIALIZED (SELECT coalesce('=' || conv_id::VARCHAR, '') AS c, *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
m AS MATERIALIZED (SELECT c, i, turn, role, text, role[1] AS a, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
        row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, lag(role[1]) OVER (PARTITION BY c ORDER BY i) AS before FROM o),
f AS MATERIALIZED (SELECT *, blank OR again AS gone, NOT blank AND NOT again AND cut AS open FROM m),
n AS (SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
        count(*) FILTER (open) AS truncated, count(*) FILTER (before IS NOT NULL AND before || a NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY c),
chain AS (SELECT * FROM (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'), (1, 2, 3, 'I'), (3, 2, 3, 'I'), (2, 3, 3, 'I'), (0, 3, 6, 'II'), (1, 3, 6, 'II')) v(s, t, cost, letters)),
step AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)) v(s, a, t)),
turn_to AS (SELECT * FROM (VALUES (0, 2), (1, 2), (3, 2), (2, 3)) v(s, t)),
edit AS MATERIALIZED (
  SELECT c, i, s.s, s.s AS t, 4 AS cost, 'D' AS letter FROM f, (SELECT DISTINCT s FROM chain) s
  UNION ALL SELECT c, i, s, t, CASE WHEN open THEN 3 ELSE 0 END, 'K' FROM f JOIN step USING (a) WHERE NOT gone
  UNION ALL SELECT c, i, s, t, CASE WHEN open THEN 6 ELSE 3 END, 'R' FROM f, turn_to WHERE NOT gone),
walk AS (
  SELECT c, 0::BIGINT AS i, t AS s, {'cost': cost::BIGINT, 'audit': letters} AS best FROM (SELECT DISTINCT c FROM f) z, chain WHERE s = 0
  UNION ALL
  SELECT w.c, w.i + 1, k.t, min({'cost': w.best.cost + e.cost + k.cost, 'audit': w.best.audit || e.letter || k.letters})
  FROM walk w JOIN edit e ON e.c = w.c AND e.i = w.i + 1 AND e.s = w.s JOIN chain k ON k.s = e.t GROUP BY w.c, w.i, k.t),
won AS (SELECT c, min(best) AS best FROM walk JOIN n USING (c) WHERE walk.i = n.n AND s IN (0, 3) GROUP BY c),
letter AS (SELECT c, p, x, count(*) FILTER (x <> 'I') OVER (PARTITION BY c ORDER BY p) AS i, count(*) FILTER (x <> 'D') OVER (PARTITION BY c ORDER BY p) - 1 AS said,
        count(*) FILTER (x <> 'D') OVER (PARTITION BY c) % 2 AS shape
        FROM (SELECT c, best.audit AS audit, unnest(range(1, len(best.audit) + 1)) AS p, audit[p] AS x FROM won)),
line AS (SELECT l.c, p, CASE WHEN x = 'K' THEN role WHEN (said - shape) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE text END AS line
        FROM letter l LEFT JOIN f ON f.c = l.c AND f.i = l.i WHERE x <> 'D'),
told AS (SELECT c, string_agg(line, chr(10) ORDER BY p) AS told FROM line GROUP BY c)
SELECT q.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(told, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('=' || conv_id::VARCHAR, '') AS c FROM conversations) q LEFT JOIN n USING (c) LEFT JOIN won USING (c) LEFT JOIN told USING (c)
"""
ORACLES["op13_conversations"] = OP13

_RULES = ", ".join(f"('{r.text}', '{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)



def _level(k: int) -> str:
    """Level k of the tree: rare children become *, and children whose blocked shares do not differ become one branch."""
    return f"""
c{k} AS (SELECT host, t, segs[{k}] AS c, sum(n) AS n, sum(l) AS l, sum(b) AS b FROM r{k - 1} WHERE len(segs) >= {k} GROUP BY ALL),
g{k} AS MATERIALIZED (SELECT *, CASE WHEN count(*) OVER w > 10 AND n * 10 < sum(n) OVER w THEN '*' ELSE c END AS g FROM c{k} WINDOW w AS (PARTITION BY host, t)),
s{k} AS (SELECT host, t, g, sum(l) AS l, sum(b) AS b, CASE WHEN sum(l) > 0 THEN sum(b) / sum(l)::DOUBLE END AS p FROM g{k} GROUP BY ALL),
o{k} AS (SELECT *, lag(l) OVER w AS l0, lag(p) OVER w AS p0, (lag(b) OVER w + b) / nullif(lag(l) OVER w + l, 0)::DOUBLE AS q FROM s{k}
         WINDOW w AS (PARTITION BY host, t ORDER BY p NULLS FIRST, g)),
u{k} AS (SELECT *, sum(CASE WHEN l > 0 AND (coalesce(l0, 0) = 0 OR abs(p - p0) > 1.96::DOUBLE * sqrt(q * (1 - q) * (1.0::DOUBLE / l0 + 1.0::DOUBLE / l))) THEN 1 ELSE 0 END)
         OVER (PARTITION BY host, t ORDER BY p NULLS FIRST, g) AS branch FROM o{k}),
m{k} AS (SELECT host, t, branch, CASE WHEN count(*) = 1 THEN min(g) ELSE '{{' || string_agg(g, '|' ORDER BY g) || '}}' END AS name, sum(l) AS bl, sum(b) AS bb
         FROM u{k} GROUP BY ALL),
r{k} AS MATERIALIZED (
  SELECT r.host, segs, r.n, r.l, r.b, r.t || '/' || name AS t, list_append(chain, {{'l': bl::DOUBLE, 'b': bb::DOUBLE}}) AS chain
  FROM r{k - 1} r JOIN g{k} ON r.host = g{k}.host AND r.t = g{k}.t AND segs[{k}] = c JOIN u{k} ON u{k}.host = r.host AND u{k}.t = r.t AND u{k}.g = g{k}.g
  JOIN m{k} ON m{k}.host = r.host AND m{k}.t = r.t AND m{k}.branch = u{k}.branch WHERE len(segs) >= {k}
  UNION ALL SELECT * FROM r{k - 1} WHERE len(segs) < {k})"""


def op8_sql(levels: int) -> str:
    """The whole of op8 for paths of at most so many segments; the operator goes as deep as the paths do."""
    return rf"""
WITH x AS (SELECT page_id, url, row_number() OVER () AS r, coalesce(position('://' IN url), 0) AS i FROM pages),
y AS (SELECT page_id, r, CASE WHEN i > 0 THEN url[i + 3:] ELSE '' END AS rest FROM x),
p AS (SELECT page_id, r, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM y),
f AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM p, (VALUES {_RULES}) q(rule, h, pre, v)
      WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY r),
d AS MATERIALIZED (SELECT p.*, rule, v, list_transform(string_split(path[2:], '/'), lambda s: regexp_replace(s, '{VARIABLE}', '*')) AS segs FROM p LEFT JOIN f USING (r)),
r0 AS MATERIALIZED (
  SELECT host, segs, count(*) AS n, count(rule) AS l, count(*) FILTER (v = 'block') AS b, '' AS t, []::STRUCT(l DOUBLE, b DOUBLE)[] AS chain FROM d GROUP BY host, segs),
{",".join(_level(k) for k in range(1, levels + 1))},
z AS (SELECT *, CASE WHEN len(string_split(host, '.')) > 1 THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE host END AS site FROM r{levels}),
pa AS (SELECT coalesce(sum(b) / nullif(sum(l), 0)::DOUBLE, 0) AS p FROM z),
ps AS (SELECT site, (sum(b) + (SELECT p FROM pa) * 10) / (sum(l) + 10.0::DOUBLE) AS p FROM z GROUP BY site),
ph AS (SELECT host, (sum(b) + any_value(p) * 10) / (sum(l) + 10.0::DOUBLE) AS p FROM z JOIN ps USING (site) GROUP BY host),
lf AS (SELECT host, t, any_value(p) AS p, any_value(chain[:-2]) AS chain, sum(l) AS l, sum(b) AS b FROM z JOIN ph USING (host) GROUP BY host, t),
pu AS (SELECT host, t, (b + list_reduce(list_prepend({{'l': 0.0::DOUBLE, 'b': p}}, chain), lambda a, s: {{'l': 0.0::DOUBLE, 'b': (s.b + a.b * 10) / (s.l + 10.0::DOUBLE)}}).b * 10) / (l + 10.0::DOUBLE) AS purity FROM lf),
tp AS (SELECT z.host, segs, purity FROM z JOIN pu USING (host, t))
SELECT page_id, d.host, path, rule, coalesce(v, CASE WHEN purity >= 0.8::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict
FROM d JOIN tp ON d.host = tp.host AND d.segs = tp.segs
"""


OP8 = op8_sql(8)
ORACLES["op8_urls"] = OP8
