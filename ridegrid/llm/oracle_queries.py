"""DuckDB SQL of text operators whose results SQL can express."""

from __future__ import annotations

# The CRC-32 table from its rule, as one list.
_CRC = """
crc_steps AS (
  SELECT i AS n, i AS v, 0 AS k FROM range(256) AS r(i)
  UNION ALL
  SELECT n, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM crc_steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY n) AS t FROM crc_steps WHERE k = 8)"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, over the table ``crc``."""
    return (
        f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), "
        "lambda c: CAST(ord(c) AS BIGINT))), lambda c, b: xor(c // 256, t[CAST(xor(c, b) % 256 AS INT) + 1])), 4294967295)")


PERIODIC_RUNS = "WITH RECURSIVE" + _CRC + f""",
d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         {_crc32("CAST(doc_id AS VARCHAR)")} AS h
  FROM documents, crc),
e AS (SELECT rid, doc_id, w, len(w) AS n, h, h // 10 AS g FROM d),
f AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM e),
words AS (
  SELECT rid, i, w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS word
  FROM (SELECT rid, w, a, 1 + (n - a) // (3 + g % 8) AS p, unnest(range(n)) AS i FROM f)),
pairs AS (
  SELECT x.rid, y.i - x.i AS q, x.i AS i FROM words x JOIN words y ON x.rid = y.rid AND x.word = y.word AND x.i < y.i),
stretches AS (
  SELECT rid, q, min(i) AS s, count(*) + q AS l
  FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS grp FROM pairs)
  GROUP BY rid, q, grp HAVING count(*) >= greatest(q, 12 - q)),
runs AS (SELECT rid, s, l, min(q) AS q FROM stretches GROUP BY rid, s, l),
best AS (
  SELECT rid, count(*) AS n_runs, arg_min({{'s': s, 'l': l, 'q': q}}, (-l, s, q)) AS b,
         sha256(string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q)) AS runs_sha256
  FROM runs GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (
  SELECT rid, sha256(string_agg(word, ' ' ORDER BY i)) AS collapsed_sha256 FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(b.s AS BIGINT) AS start, CAST(b.l AS BIGINT) AS length,
       CAST(b.q AS BIGINT) AS period, CAST(1000 * b.l // b.q AS BIGINT) AS exponent_milli,
       coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
FROM f LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)
"""

CONVERSATION_REPAIR = "WITH RECURSIVE" + _CRC + f""",
plain AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS harm
  FROM conversations, crc),
harmed AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
         CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN harm = 3 THEN 2 ELSE 1 END)) AS rep
  FROM plain WHERE harm <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i,
         count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS a, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM harmed),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM placed),
r AS (
  SELECT *, CASE WHEN body = '' THEN 1 WHEN again THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         lag(a) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM seen),
s AS (
  SELECT conv_id, n, i, role, text, a, fault, fault IN (1, 2) AS must, CASE WHEN fault = 3 THEN 1 ELSE 0 END AS t FROM r),
-- cheapest costs to the end before row i, from the states: nothing, s, u, a
h AS (
  SELECT conv_id, n + 1 AS i, [0, 4, 2, 0] AS c FROM s WHERE i = 1
  UNION ALL
  SELECT conv_id, i, [least(g[1], 2 + g[3], 4 + g[4]), least(g[2], 2 + g[3], 4 + g[4]), least(g[3], 2 + g[4]), least(g[4], 2 + g[3])]
  FROM (
    SELECT s.conv_id, s.i, [
      least(3 + c[1], CASE WHEN must THEN 99999999 ELSE t + least(2 + c[3], CASE a WHEN 's' THEN c[2] WHEN 'u' THEN c[3] ELSE 99999999 END) END),
      least(3 + c[2], CASE WHEN must THEN 99999999 ELSE t + c[3] + CASE a WHEN 'u' THEN 0 ELSE 2 END END),
      least(3 + c[3], CASE WHEN must THEN 99999999 ELSE t + c[4] + CASE a WHEN 'a' THEN 0 ELSE 2 END END),
      least(3 + c[4], CASE WHEN must THEN 99999999 ELSE t + c[3] + CASE a WHEN 'u' THEN 0 ELSE 2 END END)] AS g
    FROM h JOIN s ON s.conv_id IS NOT DISTINCT FROM h.conv_id AND s.i = h.i - 1)),
-- ASCII-least edits: one step each; state 1 to 4
walk AS (
  SELECT conv_id, n, 1 AS i, 1 AS st, '' AS audit, CAST([] AS VARCHAR[]) AS lines, false AS done FROM s WHERE i = 1
  UNION ALL
  SELECT conv_id, n, CASE WHEN op IN ('D', 'K', 'R') THEN i + 1 ELSE i END,
         CASE op WHEN 'D' THEN st WHEN '' THEN st WHEN 'K' THEN CASE a WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END ELSE nx END,
         audit || op,
         CASE op WHEN 'D' THEN lines WHEN '' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
           ELSE list_append(lines, CASE nx WHEN 3 THEN 'user' ELSE 'assistant' END || ':' || CASE op WHEN 'R' THEN text ELSE '' END) END,
         op = ''
  FROM (
    SELECT w.*, s.a, s.role, s.text, CASE w.st WHEN 3 THEN 4 ELSE 3 END AS nx,
           CASE WHEN w.i > w.n THEN CASE WHEN w.st IN (1, 4) THEN '' ELSE 'I' END
             WHEN 3 + z.c[st] = h.c[st] THEN 'D'
             WHEN 2 + h.c[CASE w.st WHEN 3 THEN 4 ELSE 3 END] = h.c[st] THEN 'I'
             WHEN NOT must AND CASE WHEN st = 1 AND a = 's' THEN t + z.c[2] WHEN st <> 3 AND a = 'u' THEN t + z.c[3]
               WHEN st = 3 AND a = 'a' THEN t + z.c[4] END = h.c[st] THEN 'K'
             ELSE 'R' END AS op
    FROM walk w LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i
    LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM w.conv_id AND h.i = w.i
    LEFT JOIN h z ON z.conv_id IS NOT DISTINCT FROM w.conv_id AND z.i = w.i + 1
    WHERE NOT w.done)),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1) AS blank,
         count_if(fault = 2) AS duplicate, count_if(fault = 3) AS truncated,
         count_if(before IS NOT NULL AND before || a NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(h.c[1], 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM o.conv_id AND h.i = 1
LEFT JOIN walk ON walk.conv_id IS NOT DISTINCT FROM o.conv_id AND walk.done
"""
