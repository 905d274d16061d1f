"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from cohortkit.llm.secrets import ACCESS, ASSIGN, GENERIC, HEX

MIXING = r"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':42') AS h
  FROM documents),
s AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY skey) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS wt,
             CAST(source_size AS DOUBLE) * 2 AS most FROM s),
c AS (SELECT *, most / wt AS fill,
             (CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE)
              - coalesce(sum(most) OVER (ORDER BY most / wt, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(wt) OVER (ORDER BY most / wt, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS cand FROM w),
l AS (SELECT *, max(CASE WHEN cand <= fill THEN cand END) OVER () AS lev FROM c),
r AS (SELECT skey, source_size, least(most, coalesce(lev * wt, most)) AS target,
             CAST(('0x' || substr(md5('42:' || skey), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS u FROM l),
k AS (SELECT d.doc_id, d.size, d.skey, row_number() OVER (
        PARTITION BY d.skey ORDER BY length(bin(d.size)) * 8 + (d.size >> greatest(length(bin(d.size)) - 3, 0)), d.h, d.doc_id, d.size) AS k
      FROM d)
SELECT k.doc_id, k.size, r.source_size, r.target,
       k.size * CAST(least(floor(k.k * CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END + u)
                           - floor((k.k - 1) * CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END + u), 2) AS BIGINT) AS taken
FROM k JOIN r USING (skey)
"""


def _kind(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, source, '{kind}' AS kind, {rank} AS rnk, e - length(w) AS s, e, e - length(v) AS vs, v FROM (
    SELECT doc_id, source, w, v,
           sum(length(p) + length(w)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e
    FROM (SELECT doc_id, source, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w, unnest(vs) AS v,
                 unnest(ps[1:len(ws)]) AS p
          FROM (SELECT doc_id, source, string_split_regex(text, '{p}') AS ps, regexp_extract_all(text, '{p}', 0) AS ws,
                       regexp_extract_all(text, '{p}', {group}) AS vs
                FROM documents WHERE regexp_matches(text, '{p}'))))
  WHERE length(v) >= {least}"""


_RANDOM = "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= 8"

SECRETS = f"""
WITH m AS ({" UNION ALL ".join([
    _kind("assign", 0, ASSIGN, 2, 6), _kind("access", 1, ACCESS, 0, 20), _kind("hex", 2, HEX, 0, 24),
    _kind("generic", 3, GENERIC, 0, 20)])}),
f AS (SELECT * FROM m WHERE kind <> 'generic' OR ({_RANDOM})),
-- exact copies are one repository, owned by the least of their sources; a NULL source is an owner too
p AS (SELECT v, md5(d.text) AS th, min(CASE WHEN f.source IS NULL THEN '1' ELSE '0' || f.source END) AS owner
      FROM f JOIN documents d USING (doc_id) GROUP BY ALL),
o AS (SELECT v, count(*) AS repos, count(DISTINCT owner) AS owners FROM p GROUP BY v),
a AS (SELECT doc_id, rnk, kind, s, e FROM f WHERE kind <> 'generic'
      UNION ALL
      SELECT DISTINCT doc_id, CASE WHEN owners > 1 OR repos > 3 THEN 5 ELSE 4 END,
             CASE WHEN owners > 1 OR repos > 3 THEN 'example' ELSE 'live' END, vs, e
      FROM f JOIN o USING (v) WHERE {_RANDOM}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rnk, e) FILTER (rnk < 3) AS base,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rnk, e) AS spans,
             count(*) FILTER (kind = 'live') AS n_live, count(*) FILTER (kind = 'example') AS n_example
      FROM a GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM documents d LEFT JOIN g USING (doc_id)
"""

COVER = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
           FROM documents),
w AS (SELECT r, unnest(range(1, len(ws) - 33)) AS i, ws FROM d WHERE len(ws) >= 35),
h AS (SELECT r, i, count(*) OVER (PARTITION BY array_to_string(ws[i:i + 34], ' ')) > 1 AS again FROM w),
t AS (SELECT r, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d),
g AS (SELECT t.r, t.i, word, coalesce(bool_or(again) OVER (
        PARTITION BY t.r ORDER BY t.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), false) AS gone
      FROM t LEFT JOIN h ON t.r = h.r AND t.i = h.i),
k AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
      FROM g GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""

LEXICAL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
q AS (SELECT row_number() OVER () AS no, item_id, regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
      FROM (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark)),
c AS (SELECT CAST(count(*) FILTER (len(ts) > 0) AS BIGINT) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d),
p AS (SELECT r, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, c),
k AS (SELECT no, t, CAST(count(*) AS BIGINT) AS times FROM (SELECT no, unnest(ts) AS t FROM q) GROUP BY no, t),
m AS (SELECT r, doc_id, 25 + (75 * CAST(len(ts) AS BIGINT) * n_docs) // n_terms AS m FROM d, c),
s AS (SELECT no, p.r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM k JOIN p USING (t) JOIN w USING (t) JOIN m ON m.r = p.r GROUP BY no, p.r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT no, doc_id, score, row_number() OVER (PARTITION BY no ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM s JOIN m USING (r) WHERE score > 0) JOIN q USING (no) WHERE rank <= 10
"""

COLLOCATIONS = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
g AS (SELECT lang, m, ws[i:i + m - 1] AS ws
      FROM (SELECT lang, m, ws, unnest(range(1, len(ws) - m + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS m))),
f AS (SELECT lang, m, ws, CAST(count(*) AS HUGEINT) AS a FROM g GROUP BY lang, m, ws),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE m > 1 AND a >= 30),
k AS (SELECT lang, m, ws, a, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.ws, k.a, k.k, x.a AS l, y.a AS r, (2000000 * k.a) // (x.a + y.a) AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.ws = k.ws[1:k.k] JOIN f y ON y.lang = k.lang AND y.ws = k.ws[k.k + 1:k.m]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
i AS (SELECT lang, ws[j:j + u - 1] AS ws, max(a) AS a
      FROM (SELECT lang, ws, m, a, u, unnest(range(1, m - u + 2)) AS j FROM c, (SELECT unnest([2, 3]) AS u) WHERE u < m)
      GROUP BY ALL),
t AS (SELECT b.lang, array_to_string(b.ws, ' ') AS phrase, b.a, l, r, score
      FROM b LEFT JOIN i ON i.lang = b.lang AND i.ws = b.ws WHERE i.a IS NULL OR 100 * i.a < 80 * b.a)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM t) JOIN n USING (lang)
WHERE rank <= 2000
"""

ORACLE = {"op8_secrets": SECRETS, "op10_mixing": MIXING, "op11_lexical_search": LEXICAL, "op12_cover_dedup": COVER,
          "op13_collocations": COLLOCATIONS}
