"""DuckDB SQL for the operators that SQL can express."""

LINE_DEDUP = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (
  SELECT r, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM texts),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key
  HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 10)
SELECT any_value(k.doc_id) AS doc_id, count(*) AS n_lines, count(s.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE s.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN shared s ON k.key = s.key
GROUP BY r"""

# DuckDB has no crc32: eight shifts give its table, and a fold over the bytes the checksum.
SPELLING = r"""
WITH RECURSIVE bits AS (
  SELECT i AS b, i::BIGINT AS c, 0 AS step FROM range(256) t(i)
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE step = 8),
runs AS (
  SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS w FROM documents)),
counted AS (
  SELECT doc_id, w, count(*) AS n,
         list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)), '..'), lambda x: ('0x' || x)::BIGINT) AS l
  FROM runs WHERE length(w) >= 5 GROUP BY doc_id, w),
hashed AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, l), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295) AS h
  FROM counted, crc),
words AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
holes AS (
  SELECT DISTINCT word, n, left(word, p::INT) || substr(word, p::INT + 2) AS rest, p
  FROM (SELECT word, n, unnest(range(length(word))) AS p FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n FROM holes a JOIN holes b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word),
near AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, encode(near)) AS near, max(n) AS near_n FROM pairs GROUP BY word),
judged AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN near USING (word)),
chain AS (
  SELECT word, word AS at, form AS next FROM judged
  UNION ALL
  SELECT c.word, j.word, j.form FROM chain c JOIN judged j ON c.next = j.word)
SELECT j.word, j.form, c.at AS root, j.n, j.n_near, j.form_n FROM judged j JOIN chain c ON c.word = j.word AND c.next IS NULL"""

# Forward over the turns: of every state the cheapest (then smallest) audit so far, with its repaired lines. Up to three
# inserts stand before an edit.
REPAIR = r"""
WITH RECURSIVE bits AS (
  SELECT i AS b, i::BIGINT AS c, 0 AS step FROM range(256) t(i)
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE step = 8),
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda x: ('0x' || x)::BIGINT) AS l
  FROM conversations),
hashed AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, l), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295) % 20 AS hit
  FROM raw, crc),
damaged AS (
  SELECT conv_id, turn, role AS role0, text AS text0, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hashed, range(2) again(k) WHERE hit <> 0 AND (k = 0 OR hit = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role0), encode(text0)) AS pos,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ending,
         CASE WHEN left(role, 1) = 's' THEN 1 WHEN left(role, 1) = 'u' THEN 2 WHEN left(role, 1) = 'a' THEN 3 ELSE 0 END AS r
  FROM damaged),
faults AS (
  SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                 WHEN right(ending, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(r) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM placed),
ins(s, to_s, cost, letters, lines) AS (VALUES
  (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
  (0, 2, 2, 'I', 'user:' || chr(10)), (1, 2, 2, 'I', 'user:' || chr(10)), (2, 3, 2, 'I', 'assistant:' || chr(10)), (3, 2, 2, 'I', 'user:' || chr(10)),
  (0, 3, 4, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 3, 4, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
  (2, 2, 4, 'II', 'assistant:' || chr(10) || 'user:' || chr(10)), (3, 3, 4, 'II', 'user:' || chr(10) || 'assistant:' || chr(10))),
steps AS (
  SELECT f.conv_id, f.pos, i.s, e.to_s, i.cost + e.cost AS cost, i.letters || e.letter AS letters, i.lines || e.line AS lines
  FROM faults f, ins i, LATERAL (
    SELECT 'D' AS letter, 3 AS cost, i.to_s AS to_s, '' AS line
    UNION ALL SELECT 'K', (fault = 'truncated')::INT, r, role || ':' || text || chr(10)
      WHERE fault NOT IN ('blank', 'duplicate') AND (r = 1 AND i.to_s = 0 OR r = 2 AND i.to_s <> 2 OR r = 3 AND i.to_s = 2)
    UNION ALL SELECT 'R', 2 + (fault = 'truncated')::INT, CASE WHEN i.to_s = 2 THEN 3 ELSE 2 END,
                     CASE WHEN i.to_s = 2 THEN 'assistant' ELSE 'user' END || ':' || text || chr(10)
      WHERE fault NOT IN ('blank', 'duplicate')) e),
best AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS pos, 0 AS s, 0 AS cost, '' AS audit, '' AS lines FROM conversations
  UNION ALL
  SELECT conv_id, pos, s, cost, audit, lines FROM (
    SELECT b.conv_id, t.pos, t.to_s AS s, b.cost + t.cost AS cost, b.audit || t.letters AS audit, b.lines || t.lines AS lines,
           row_number() OVER (PARTITION BY b.conv_id, t.to_s ORDER BY b.cost + t.cost, b.audit || t.letters) AS n
    FROM best b JOIN steps t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.pos = b.pos + 1 AND t.s = b.s)
  WHERE n = 1),
closed AS (
  SELECT b.conv_id, b.cost + i.cost AS cost, b.audit || i.letters AS audit, b.lines || i.lines AS lines,
         row_number() OVER (PARTITION BY b.conv_id ORDER BY b.pos DESC, b.cost + i.cost, b.audit || i.letters) AS n
  FROM best b JOIN ins i ON i.s = b.s WHERE i.to_s IN (0, 3)),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND NOT (before = 1 AND r = 2 OR before = 2 AND r = 3 OR before = 3 AND r = 2)) AS illegal
  FROM faults GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, cost::BIGINT AS cost, audit, sha256(CASE WHEN lines = '' THEN '' ELSE left(lines, length(lines) - 1) END) AS repaired_sha256
FROM closed c LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id WHERE c.n = 1"""
