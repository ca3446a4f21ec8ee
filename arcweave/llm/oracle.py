"""DuckDB SQL for the contract queries that SQL can express over whole tables."""

from __future__ import annotations

from .secrets import RULES

_BLANK = r"[\x20\x09-\x0D]+"
_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '" + _BLANK + "'), lambda x: x <> '')"


def _secret(rank: int, r) -> str:
    p = "'" + r.pattern.replace("'", "''") + "'"
    size = lambda e: f"list_transform({e}, lambda s: length(s))"
    return f"SELECT doc_id, n, '{r.kind}' AS kind, {rank} AS rank, {r.least} AS least, {size(f'string_split_regex(x, {p})')} AS b, {size(f'regexp_extract_all(x, {p}, 0)')} AS m, {size(f'regexp_extract_all(x, {p}, {r.group})')} AS j FROM t WHERE regexp_matches(x, {p})"


_BASE = "list_filter(s, lambda q: q.kind IN ('assign', 'access', 'hex'))"
_TEXT = "list_aggregate(list_transform({0}, lambda q: q.kind || ':' || q.a || ':' || q.e), 'string_agg', ',')"
_COUNT = "CAST(len(list_filter(s, lambda q: q.kind = '{0}')) AS BIGINT) AS n_{0}"
SECRETS = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x, row_number() OVER () AS n FROM documents),
k AS ({' UNION ALL '.join(_secret(i, r) for i, r in enumerate(RULES))}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k),
f AS (SELECT n, kind, rank, CAST(list_sum(b[1:i]) + coalesce(list_sum(m[1:i - 1]), 0) AS BIGINT) AS a, m[i] AS z FROM i WHERE j[i] >= least),
g AS (SELECT n, list({{'a': a, 'rank': rank, 'e': a + z, 'kind': kind}} ORDER BY a, rank) AS s FROM f GROUP BY 1),
d AS (SELECT doc_id, coalesce(s, []) AS s FROM t LEFT JOIN g USING (n))
SELECT doc_id, {_COUNT.format('assign')}, {_COUNT.format('access')}, {_COUNT.format('hex')}, sha256(coalesce({_TEXT.format(_BASE)}, '')) AS base_sha256, coalesce({_TEXT.format('s')}, '') AS spans FROM d"""

TOPK = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.e, d.e) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20"""

PASSAGES = f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
own AS (SELECT h, min(doc_id) AS o FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM win JOIN own USING (h) WHERE o < doc_id),
wd AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS k FROM w),
kept AS (SELECT wd.doc_id, count(gone.k) AS n_removed, string_agg(x, ' ' ORDER BY wd.k) FILTER (gone.k IS NULL) AS t FROM wd LEFT JOIN gone USING (doc_id, k) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '{_BLANK}'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sha256(array_to_string(ws[i:i + 3], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
u AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r(v, c) AS (SELECT x, x FROM u UNION SELECT r.v, u.y FROM r JOIN u ON u.x = r.c),
c AS (SELECT v AS doc_id, min(c) AS c FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""

ORACLE_SQL = {"op5_secret_scan": SECRETS, "op7_ngram_jaccard_join": JACCARD, "op8_exact_topk": TOPK, "op9_substring_dedup": PASSAGES}
