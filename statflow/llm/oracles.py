"""DuckDB SQL for the operators that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"

OP5 = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM s
), k AS (
  SELECT *, cap * CASE w WHEN 5 THEN 2 WHEN 2 THEN 5 ELSE 10 END AS key FROM w
), c AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT)
            - CAST(coalesce(sum(cap) OVER (ORDER BY key, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest_words,
         CAST(sum(w) OVER (ORDER BY key, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest_w
  FROM k
), f AS (SELECT *, rest_words * w > cap * rest_w AS capped FROM c),
l AS (SELECT rest_words AS lw, rest_w AS lr FROM f WHERE NOT capped ORDER BY key, rank LIMIT 1),
t AS (
  SELECT f.source, f.source_size,
         CASE WHEN capped OR lw IS NULL THEN CAST(cap AS DOUBLE) ELSE CAST(lw AS DOUBLE) * CAST(w AS DOUBLE) / CAST(lr AS DOUBLE) END AS target
  FROM f LEFT JOIN l ON true
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         CAST(('0x' || substr(md5('42:' || d.doc_id), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       size * (CAST(floor(rate) AS BIGINT) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM r
"""

_LEDGER = rf"""
d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), wins AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
  FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 3)
), rep AS (
  SELECT rid, i FROM wins JOIN (SELECT rid, win FROM wins GROUP BY rid, win HAVING count(*) > 1) USING (rid, win)
), cov AS (
  SELECT rid, count(DISTINCT i + o) AS n FROM rep, (VALUES (0), (1), (2)) AS v(o) GROUP BY rid
), lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines
  FROM d LEFT JOIN cov USING (rid) LEFT JOIN lines USING (rid)
), led AS (
  SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END
    + CASE WHEN n_words > 1000000 THEN 64 ELSE 0 END AS BIGINT) AS fail_mask
  FROM m
)"""

OP6 = f"""WITH {_LEDGER}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_mask & 3 <> 0 AS base_failed, fail_mask & 63 = 0 AS kept, fail_mask
FROM led"""

ABLATION = f"""WITH {_LEDGER},
p(policy, mask) AS (VALUES ('v1', 3), ('v2', 31), ('v3', 63)),
r(rule, bit) AS (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('short_words', 8), ('long_words', 16), ('duplicate_lines', 32))
SELECT policy, rule, count(*) AS n_docs, CAST(sum(CASE WHEN fail_mask & mask = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_kept,
       CAST(sum(CASE WHEN fail_mask & mask & bit <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_failed,
       CAST(sum(CASE WHEN fail_mask & mask = bit THEN 1 ELSE 0 END) AS BIGINT) AS n_only
FROM led, p, r WHERE mask & bit <> 0 GROUP BY policy, rule"""


_HOST = r"regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.+$', '')"

OP1 = rf"""
WITH c AS (
  SELECT row_number() OVER () AS rid, page_id, url, {_HOST} AS host, CAST(19723 + page_id * 7919 % 366 AS INTEGER) AS fetched_at,
         list_filter(string_split(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS path
  FROM pages
), h AS (
  SELECT host, md5(host) AS d, 19723 + CAST('0x' || substr(md5(host), 2, 2) AS INTEGER) AS day
  FROM (SELECT DISTINCT host FROM c WHERE host <> '') WHERE substr(md5(host), 1, 1) < '6'
), e(key, n, rule, action, day_at) AS (
  VALUES ('domain:spam-farm.example.org', 21, 'block', 'add', 19723), ('domain:example.net', 11, 'allow', 'add', 19800), ('domain:example.net', 11, 'allow', 'remove', 20000)
  UNION ALL SELECT 'host:' || host, length(host), 'block', 'add', day FROM h
  UNION ALL SELECT 'host:' || host, length(host), 'block', 'remove', day + 60 FROM h WHERE substr(d, 4, 1) < '8'
  UNION ALL SELECT 'host:' || host, length(host), 'block', 'add', day + 120 FROM h WHERE substr(d, 5, 1) < '4'
  UNION ALL SELECT 'prefix:' || host || '/en', length(host) + 3, 'allow', 'add', day + 30 FROM h WHERE substr(d, 6, 1) < '4'
), i AS (
  SELECT key, n, rule, action, day_at AS since, lead(day_at) OVER (PARTITION BY key, rule ORDER BY day_at, action DESC) AS until FROM e
), labels AS (SELECT rid, host, string_split(host, '.') AS p, path FROM c WHERE host <> ''),
k AS (
  SELECT rid, 'host:' || host AS key FROM labels
  UNION ALL SELECT rid, 'domain:' || array_to_string(p[j:], '.') FROM (SELECT rid, p, unnest(generate_series(1, len(p))) AS j FROM labels)
  UNION ALL SELECT rid, 'prefix:' || host || '/' || array_to_string(path[:j], '/') FROM (SELECT rid, host, path, unnest(generate_series(1, len(path))) AS j FROM labels)
), m AS (
  SELECT c.rid, i.key, i.rule, i.since,
         row_number() OVER (PARTITION BY c.rid ORDER BY i.n DESC, i.rule = 'block' DESC, i.key DESC, i.since DESC) AS best
  FROM c JOIN k USING (rid) JOIN i USING (key) WHERE action = 'add' AND since <= fetched_at AND (until IS NULL OR fetched_at < until)
)
SELECT page_id, url, fetched_at, host, coalesce(m.key, '') AS matched, CAST(coalesce(m.since, -1) AS INTEGER) AS since, coalesce(m.rule <> 'block', true) AS kept
FROM c LEFT JOIN m ON m.rid = c.rid AND m.best = 1
"""
