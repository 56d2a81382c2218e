"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

SQL: dict[str, str] = {}

_CANONICAL = r"""
  SELECT page_id,
         CASE WHEN instr(u, '://') > 0 THEN
           translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
         ELSE '' END AS host,
         CASE WHEN instr(u, '://') > 0 THEN
           regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*')
         ELSE '' END AS path
  FROM (SELECT page_id, coalesce(url, '') AS u,
               substr(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3) AS rest FROM pages)
"""

SQL["op1_url_filter"] = f"""
WITH urls AS ({_CANONICAL}),
rules(action, rule, name, prefix) AS (VALUES
  ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
  ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
listed AS (SELECT host, path FROM urls WHERE host <> '' GROUP BY ALL HAVING count(*) >= 2),
found AS (
  SELECT u.*, r.rule, r.action, l.host IS NOT NULL AS is_listed,
         row_number() OVER (PARTITION BY u.rid ORDER BY length(r.rule) DESC NULLS LAST) AS k
  FROM (SELECT *, row_number() OVER () AS rid FROM urls) u
  LEFT JOIN rules r ON (u.host = r.name OR ends_with(u.host, '.' || r.name)) AND starts_with(u.path, r.prefix)
  LEFT JOIN listed l ON l.host = u.host AND l.path = u.path)
SELECT page_id, host, path, rule,
       coalesce(action, CASE WHEN is_listed THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN action IS NULL THEN is_listed END AS listed
FROM found WHERE k = 1
"""

#: Words and word hashes are not needed: windows are compared as lists of words.
SQL["op4_substring_dedup"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT rid, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
  FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 34)) AS i FROM docs WHERE len(w) >= 35)),
twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT rid, unnest(generate_series(i, i + 34)) AS i
  FROM win WHERE h IN (SELECT h FROM twice)),
kept AS (
  SELECT rid, list(word ORDER BY i) AS w FROM (
    SELECT rid, unnest(generate_series(1, len(w))) AS i, unnest(w) AS word FROM docs) x
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.rid = x.rid AND g.i = x.i) GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(len(k.w), 0))::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(k.w, ' '), '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (rid)
"""

SQL["op11_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([1 FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS k FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.other AS positive_id, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
       AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
  WHERE p.k <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

#: The failing filters of a document as one mask; all orders against the counts of masks.
SQL["op12_filter_audit"] = r"""
WITH lab AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
firsts AS (SELECT coalesce(text, '') AS text, min(doc_id) AS first FROM documents GROUP BY 1),
d AS (
  SELECT coalesce(source, '') AS part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, t, w,
         doc_id > first AS repeated
  FROM (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)
  JOIN firsts ON firsts.text = t LEFT JOIN lab USING (doc_id)),
m AS (
  SELECT part, good, toxic,
         (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(repeated, false)::INT AS mask
  FROM d),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (
  SELECT part, filter_order, step, any_value(bit) AS bit,
         sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM r
"""
