"""SQL for DuckDB that gives the same rows as the queries, where SQL can express them."""

from __future__ import annotations

from tidemark.llm.url_filter import RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_VALUES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)

URLS = f"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
r(verdict, rh, rp) AS (VALUES {_VALUES})
SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule, coalesce(arg_max(verdict, length(rh || rp)), 'allow') AS verdict
FROM h LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id, host, path
"""

_ASSIGN = """(?i:(password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _kind(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    return (f"SELECT doc_id, '{kind}' AS kind, {order} AS ord, {least} AS least, regexp_split_to_array(t, '{pattern}') AS p, "
            f"regexp_extract_all(t, '{pattern}') AS w, regexp_extract_all(t, '{pattern}', {group}) AS g FROM d")


SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({_kind('assign', 0, _ASSIGN, 2, 12)} UNION ALL {_kind('access', 1, 'AKIA[A-Z0-9]+', 0, 18)} UNION ALL {_kind('hex', 2, '[0-9a-f]{{16,}}'.replace('{{', '{').replace('}}', '}'), 0, 16)}),
s AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM m),
f AS (SELECT doc_id, kind, ord, list_sum(list_transform(p[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0)::BIGINT AS st,
  length(w[i]) AS n, length(g[i]) AS gl, least FROM s),
k AS (SELECT doc_id, kind, ord, st, kind || ':' || st || ':' || (st + n) AS span FROM f WHERE gl >= least),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(span, ',' ORDER BY st, ord) AS spans FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""


SUBSTRINGS = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM g),
r AS (SELECT doc_id, i FROM x QUALIFY count(*) OVER (PARTITION BY s) > 1),
c AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 35)))) AS gone FROM r GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
 sha256(array_to_string(list_filter(w, lambda v, k: gone IS NULL OR NOT list_contains(gone, k)), ' ')) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)
"""


NEAR_COPIES = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
x AS (SELECT doc_id, unnest(g) AS h FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS top FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.top = e.a),
m AS (SELECT doc_id, min(top) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, component_id = doc_id AS kept FROM n JOIN m USING (doc_id)
"""

VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
g AS MATERIALIZED (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.9 ELSE false END),
r AS (SELECT vec_id, vec_id AS top FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.top = l.a),
m AS (SELECT vec_id, min(top) AS component_id FROM r GROUP BY vec_id),
k AS (SELECT a AS vec_id, count(*)::BIGINT AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, component_id = vec_id AS kept FROM m LEFT JOIN k USING (vec_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_embedding_dedup": VECTORS, "op5_secret_scan": SECRETS, "op6_substring_dedup": SUBSTRINGS, "op8_url_filter": URLS, "op9_minhash_dedup": NEAR_COPIES}
