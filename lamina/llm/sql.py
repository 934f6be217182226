"""SQL for DuckDB of the queries that SQL can express."""

from __future__ import annotations

#: op12. Components are small there, so inner products are exact in double precision.
HARD_NEGATIVES = """
WITH used AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM used a JOIN used b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) <= 10
"""

#: op13, for tables whose turns are distinct within a conversation. b: costs from the states nothing, s, u and a before a turn.
CONVERSATION_REPAIR = r"""
WITH RECURSIVE drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)),
             lambda c, b: list_reduce(CAST(range(8) AS BIGINT[]), lambda d, k: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END, xor(c, b)), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS fault
  FROM conversations
), copied AS (
  SELECT conv_id, turn, fault, role, text, unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy FROM drawn WHERE fault <> 0
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
  FROM copied
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged
), judged AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS earlier, count(*) OVER (PARTITION BY conv_id) AS n,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM placed
), coded AS (
  SELECT *, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS t FROM judged
), facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM coded GROUP BY conv_id
), backward AS (
  SELECT conv_id, n + 1 AS i, [0, 4, 2, 0] AS b, CAST(NULL AS INTEGER[]) AS a FROM facts
  UNION ALL
  SELECT conv_id, i, [least(r[1], 2 + r[3], 4 + r[4]), least(r[2], 2 + r[3], 4 + r[4]), least(r[3], 2 + r[4]), least(r[4], 2 + r[3])], a
  FROM (
    SELECT c.conv_id, c.i, v.b AS a, [
      least(3 + v.b[1], CASE WHEN NOT must AND initial = 's' THEN t + v.b[2] WHEN NOT must AND initial = 'u' THEN t + v.b[3] END, CASE WHEN NOT must THEN 2 + t + v.b[3] END),
      least(3 + v.b[2], CASE WHEN NOT must AND initial = 'u' THEN t + v.b[3] END, CASE WHEN NOT must THEN 2 + t + v.b[3] END),
      least(3 + v.b[3], CASE WHEN NOT must AND initial = 'a' THEN t + v.b[4] END, CASE WHEN NOT must THEN 2 + t + v.b[4] END),
      least(3 + v.b[4], CASE WHEN NOT must AND initial = 'u' THEN t + v.b[3] END, CASE WHEN NOT must THEN 2 + t + v.b[3] END)] AS r
    FROM backward v JOIN coded c ON c.conv_id IS NOT DISTINCT FROM v.conv_id AND c.i = v.i - 1
  )
), steps AS (
  SELECT v.conv_id, v.i, v.b, v.a, c.role, c.text, c.must, c.t,
         [CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 END, CASE initial WHEN 'u' THEN 2 END, CASE initial WHEN 'a' THEN 3 END, CASE initial WHEN 'u' THEN 2 END] AS kept
  FROM backward v LEFT JOIN coded c ON c.conv_id IS NOT DISTINCT FROM v.conv_id AND c.i = v.i
), traced AS (
  SELECT conv_id, CAST(1 AS BIGINT) AS i, 0 AS s, '' AS audit, CAST([] AS VARCHAR[]) AS lines, 0 AS cost FROM facts
  UNION ALL
  SELECT conv_id, CASE letter WHEN 'I' THEN i ELSE i + 1 END, CASE letter WHEN 'D' THEN s WHEN 'K' THEN kept[s + 1] ELSE [2, 2, 3, 2][s + 1] END, audit || letter,
         CASE letter WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
              ELSE list_append(lines, CASE s WHEN 2 THEN 'assistant' ELSE 'user' END || ':' || CASE letter WHEN 'R' THEN text ELSE '' END) END,
         cost + CASE letter WHEN 'D' THEN 3 WHEN 'I' THEN 2 WHEN 'K' THEN t ELSE 2 + t END
  FROM (
    SELECT d.*, p.role, p.text, p.t, p.kept,
           CASE WHEN p.a IS NOT NULL AND 3 + p.a[s + 1] = p.b[s + 1] THEN 'D'
                WHEN 2 + p.b[[2, 2, 3, 2][s + 1] + 1] = p.b[s + 1] THEN 'I'
                WHEN NOT p.must AND p.t + p.a[p.kept[s + 1] + 1] = p.b[s + 1] THEN 'K' ELSE 'R' END AS letter
    FROM traced d JOIN steps p ON p.conv_id IS NOT DISTINCT FROM d.conv_id AND p.i = d.i
    WHERE p.a IS NOT NULL OR s IN (1, 2)
  )
), ended AS (
  SELECT conv_id, arg_max(audit, len(audit)) AS audit, arg_max(lines, len(audit)) AS lines, arg_max(cost, len(audit)) AS cost FROM traced GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
