"""DuckDB SQL for the operators that SQL can express, from their contracts alone."""

from __future__ import annotations

from .secrets import BASE, LEAST_VALUE, RULES

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"'[^\x20\x09-\x0D]+'"

OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, {LOWER.format("coalesce(text, '')")} AS t FROM documents
), g AS (
  SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""

# Pairs that share one of the rarest fifth of their shingles are counted in full: a link shares one of those.
OP1_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, {WORDS}) AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS g FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), f AS (
  SELECT g, count(*) AS c FROM s GROUP BY g
), o AS (
  SELECT doc_id, g, n, row_number() OVER (PARTITION BY doc_id ORDER BY c, g) AS r FROM s JOIN f USING (g) JOIN n USING (doc_id)
), p AS (
  SELECT * FROM o WHERE 5 * (n - r + 1) >= 4 * n
), c AS (
  SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb
  FROM p x JOIN p y ON x.g = y.g AND x.doc_id < y.doc_id AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)
), l AS (
  SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.g = x.g
  GROUP BY a, b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*))
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach AS (
  SELECT doc_id, doc_id AS low FROM documents
  UNION
  SELECT e.b, reach.low FROM reach JOIN e ON e.a = reach.doc_id WHERE reach.low < e.b
), m AS (
  SELECT doc_id, min(low) AS low FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.low AS component_id, m.low = d.doc_id AS kept
FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""

#: Bare upper-case base32 of a hexadecimal SHA-1 x: eight letters for each ten digits.
BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(x, {10 * block + 1}, 10))::BIGINT >> {shift}) & 31) + 1 AS INTEGER), 1)"
    for block in range(4)
    for shift in range(35, -1, -5)
)
OP6_SQL = f"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages
), f AS (
  SELECT x, min(page_id) AS first FROM p GROUP BY x
)
SELECT page_id, payload_bytes, {BASE32} AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM p JOIN f USING (x)
"""

OP7_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents
), t AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d
), v AS (
  SELECT r, j, word, count(*) OVER a AS n, md5(string_agg(word, ' ') OVER a) AS h FROM t
  WINDOW a AS (PARTITION BY r ORDER BY j ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)
), z AS (
  SELECT r, j FROM v WHERE n = 35 AND h IN (SELECT h FROM v WHERE n = 35 GROUP BY h HAVING count(*) > 1)
), g AS (
  SELECT DISTINCT r, j + k AS j FROM z, range(35) q(k)
), k AS (
  SELECT t.r, count(*) AS kept, string_agg(word, ' ' ORDER BY t.j) AS text FROM t ANTI JOIN g USING (r, j) GROUP BY t.r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""


def _spans(number: int, kind: str) -> str:
    """Spans of one rule: what lies between the matches gives their places."""
    pattern, least = RULES[kind]
    p = pattern.replace("'", "''")
    test = f"length(m) >= {least}"
    if kind == "assign":
        head, value = p[: p.rindex("[")], p[p.rindex("[") :]
        test = f"length(regexp_extract(m, '{head}({value})', 1)) >= {LEAST_VALUE}"
    return f"""
  SELECT r, {number} AS o, '{kind}' AS kind, s, s + length(m) AS e FROM (
    SELECT r, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i:
      list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))) AS s
    FROM (SELECT r, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS ps FROM d) WHERE len(ms) > 0
  ) WHERE {test}"""


OP10_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), f AS ({" UNION ALL ".join(_spans(k, kind) for k, kind in enumerate(RULES))}
), g AS (
  SELECT r, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
    string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, o) FILTER (o < {len(BASE)}) AS base,
    string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, o) AS spans
  FROM f GROUP BY r
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_minhash": OP1_SQL,
    "op6_warc": OP6_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op10_secrets": OP10_SQL,
}
