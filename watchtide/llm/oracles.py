"""DuckDB SQL for the operators whose results SQL can state."""

SQL: dict[str, str] = {}

# formatted_chars: header, then per turn 17 characters of marks; the quoting conversation is escaped: three marks more per text.
SQL["op9_chat_formatting"] = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), flagged AS (
  SELECT *, bool_or(contains(role || ' ' || text, '<s>') OR contains(role || ' ' || text, '</s>') OR contains(role || ' ' || text, '[INST]') OR contains(role || ' ' || text, '[/INST]')) OVER (PARTITION BY conv_id) AS hard FROM given
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (5 + sum(17 + length(role) + length(text) + CASE WHEN hard THEN length(regexp_replace(role || text, '[^<\[\\]', '', 'g')) ELSE 0 END))::BIGINT AS formatted_chars
FROM flagged GROUP BY conv_id
"""

SQL["op4_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(range(len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS k FROM bw
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN win ON dw.n = win.n AND dw.k = win.k
), covered AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SQL["op1_lattice_near_duplicates"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
), g AS (
  SELECT *, list_inner_product(e, e) AS n FROM v WHERE len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / sqrt(a.n * b.n) >= 0.98
), r AS (
  SELECT vec_id AS x, vec_id AS m FROM embeddings UNION SELECT l.y, r.m FROM r JOIN l ON l.x = r.x
)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.x = e.vec_id) AS n_links, min(r.m) AS component_id, min(r.m) = e.vec_id AS kept
FROM embeddings e JOIN r ON r.x = e.vec_id GROUP BY e.vec_id
"""

SQL["op13_filter_audit"] = r"""
WITH given AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), told AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), masked AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(g.doc_id > min(g.doc_id) OVER (PARTITION BY t), false)::INT AS m
  FROM given g LEFT JOIN told ON g.doc_id = told.doc_id
), cells AS (
  SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masked GROUP BY part, m
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
  SELECT [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits, a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, k AS step, bits[k] AS bit, coalesce(list_sum(bits[1 : k - 1]), 0)::INT AS before FROM orders, (SELECT unnest(range(1, 6)) AS k)
), counted AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (m & (before | bit) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (m & before = 0 AND m & bit <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (m & before <> 0 AND m & bit <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (m = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (m & before = 0 AND m & bit <> 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (m & before = 0 AND m & bit <> 0), 0) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""

# Whole strings of edits are compared here, from the last row to the first; the second recursion reads the least one and writes the rows.
SQL["op12_conversation_repair"] = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b)
), named AS (
  SELECT *, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS bytes FROM conversations
), hurt AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS h
  FROM named, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS time
  FROM hurt WHERE h <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text)) AS i,
    CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS x FROM damaged
), judged AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut, lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS left_x
  FROM placed
), rows_of AS (
  SELECT conv_id, turn, role, text, i, x, blank, again AND NOT blank AS again, cut AND NOT blank AND NOT again AS cut, blank OR again AS doomed,
    CASE WHEN cut THEN 3 ELSE 0 END AS t, left_x IS NOT NULL AND left_x || x NOT IN ('su', 'ua', 'au') AS illegal
  FROM judged
), told AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM rows_of GROUP BY conv_id
), back AS (
  SELECT conv_id, n AS i, {'c': 0, 's': ''} AS w0, {'c': 6, 's': 'II'} AS w1, {'c': 3, 's': 'I'} AS w2, {'c': 0, 's': ''} AS w3 FROM told
  UNION ALL
  SELECT conv_id, i,
    list_sort([b0, {'c': 3 + b2.c, 's': 'I' || b2.s}, {'c': 6 + b3.c, 's': 'II' || b3.s}])[1], list_sort([b1, {'c': 3 + b2.c, 's': 'I' || b2.s}, {'c': 6 + b3.c, 's': 'II' || b3.s}])[1],
    list_sort([b2, {'c': 3 + b3.c, 's': 'I' || b3.s}])[1], list_sort([b3, {'c': 3 + b2.c, 's': 'I' || b2.s}])[1]
  FROM (
    SELECT b.conv_id, b.i - 1 AS i,
      list_sort(list_concat([{'c': 4 + w0.c, 's': 'D' || w0.s}], CASE WHEN doomed THEN [] ELSE [{'c': 3 + t + w2.c, 's': 'R' || w2.s}] END, CASE WHEN NOT doomed AND x = 'u' THEN [{'c': t + w2.c, 's': 'K' || w2.s}] WHEN NOT doomed AND x = 's' THEN [{'c': t + w1.c, 's': 'K' || w1.s}] ELSE [] END))[1] AS b0,
      list_sort(list_concat([{'c': 4 + w1.c, 's': 'D' || w1.s}], CASE WHEN doomed THEN [] ELSE [{'c': 3 + t + w2.c, 's': 'R' || w2.s}] END, CASE WHEN NOT doomed AND x = 'u' THEN [{'c': t + w2.c, 's': 'K' || w2.s}] ELSE [] END))[1] AS b1,
      list_sort(list_concat([{'c': 4 + w2.c, 's': 'D' || w2.s}], CASE WHEN doomed THEN [] ELSE [{'c': 3 + t + w3.c, 's': 'R' || w3.s}] END, CASE WHEN NOT doomed AND x = 'a' THEN [{'c': t + w3.c, 's': 'K' || w3.s}] ELSE [] END))[1] AS b2,
      list_sort(list_concat([{'c': 4 + w3.c, 's': 'D' || w3.s}], CASE WHEN doomed THEN [] ELSE [{'c': 3 + t + w2.c, 's': 'R' || w2.s}] END, CASE WHEN NOT doomed AND x = 'u' THEN [{'c': t + w2.c, 's': 'K' || w2.s}] ELSE [] END))[1] AS b3
    FROM back b JOIN rows_of r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i
  )
), best AS (
  SELECT conv_id, w0.c AS cost, w0.s AS audit FROM back WHERE i = 0
), written AS (
  SELECT conv_id, audit, 1 AS k, 1 AS i, 0 AS q, []::VARCHAR[] AS out FROM best
  UNION ALL
  SELECT w.conv_id, audit, k + 1, CASE WHEN e = 'I' THEN w.i ELSE w.i + 1 END,
    CASE WHEN e = 'D' THEN q WHEN e = 'K' AND x = 's' THEN 1 WHEN q = 2 THEN 3 ELSE 2 END,
    CASE WHEN e = 'D' THEN out ELSE list_append(out, CASE WHEN e = 'K' THEN role WHEN q = 2 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END) END
  FROM (SELECT *, audit[k] AS e FROM written WHERE k <= length(audit)) w LEFT JOIN rows_of r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i
), final AS (
  SELECT conv_id, sha256(coalesce(array_to_string(out, chr(10)), '')) AS repaired_sha256 FROM written WHERE k = length(audit) + 1
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN final ON final.conv_id IS NOT DISTINCT FROM o.conv_id
"""
