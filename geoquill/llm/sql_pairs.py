"""Handwritten DuckDB SQL for range joins of embeddings and repair of conversations."""

from __future__ import annotations

#: All pairs of vectors of a label, those that link, and what is reached from each vector.
RANGES = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), u AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(a.e, lambda x: x * x))) * sqrt(list_sum(list_transform(b.e, lambda x: x * x)))) >= 0.93
), reach AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT b, root FROM reach JOIN links ON a = node),
c AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON node = vec_id LEFT JOIN n ON n.a = vec_id
"""


def turns_sql() -> str:
    """Damage by checksums byte by byte, faults by windows, and a recursion over turns that holds every repaired line."""
    table = []
    for i in range(256):  # the reflected polynomial, eight shifts
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    spaces = r"[ \t\n\x0B\f\r]"
    return rf"""
    WITH RECURSIVE t AS (SELECT {table}::BIGINT[] AS t), r AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS h FROM conversations
    ), k AS (
      SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) % 20 AS kind FROM r CROSS JOIN t
    ), d AS (
      SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0
    ), o AS (
      SELECT *, row_number() OVER c AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, lag(role[1]) OVER c AS before, regexp_replace(text, '{spaces}+$', '') AS seen
      FROM d WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
    ), f AS (
      SELECT conv_id, i, turn, role, text, seen = '' AS blank, seen <> '' AND again AS duplicate, seen <> '' AND NOT again AND seen[-1] NOT IN ('.', '!', '?') AS truncated,
        before IS NOT NULL AND before || role[1] NOT IN ('su', 'ua', 'au') AS illegal FROM o
    ), inserted(state, mid, price, piece, added) AS (VALUES
      (0, 0, 0, '', []), (0, 2, 3, 'I', ['user:']), (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 1, 0, '', []), (1, 2, 3, 'I', ['user:']), (1, 3, 6, 'II', ['user:', 'assistant:']),
      (2, 2, 0, '', []), (2, 3, 3, 'I', ['assistant:']), (2, 2, 6, 'II', ['assistant:', 'user:']), (3, 3, 0, '', []), (3, 2, 3, 'I', ['user:']), (3, 3, 6, 'II', ['user:', 'assistant:'])
    ), edits(mid, letter, fits, whole, next) AS (VALUES
      (0, 'D', '', '', 0), (1, 'D', '', '', 1), (2, 'D', '', '', 2), (3, 'D', '', '', 3), (0, 'K', 's', '', 1), (0, 'K', 'u', '', 2), (1, 'K', 'u', '', 2), (2, 'K', 'a', '', 3), (3, 'K', 'u', '', 2),
      (0, 'R', '', 'user', 2), (1, 'R', '', 'user', 2), (2, 'R', '', 'assistant', 3), (3, 'R', '', 'user', 2)
    ), step AS (
      SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM conversations
      UNION ALL
      SELECT conv_id, i, state, b.cost, b.audit, b.lines FROM (
        SELECT s.conv_id, s.i + 1 AS i, e.next AS state, min({{
          'cost': s.cost + n.price + CASE e.letter WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN f.truncated AND e.letter <> 'D' THEN 3 ELSE 0 END, 'audit': s.audit || n.piece || e.letter,
          'lines': s.lines || n.added || CASE e.letter WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [e.whole || ':' || f.text] END}}) AS b
        FROM step s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1 JOIN inserted n ON n.state = s.state JOIN edits e ON e.mid = n.mid
        WHERE e.letter = 'D' OR NOT (f.blank OR f.duplicate) AND (e.letter = 'R' OR e.fits = f.role[1])
        GROUP BY ALL)
    ), counts AS (
      SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(truncated) AS truncated, count_if(illegal) AS illegal FROM f GROUP BY conv_id
    ), last AS (
      SELECT s.conv_id, any_value(gaps) AS gaps, any_value(blank) AS blank, any_value(duplicate) AS duplicate, any_value(truncated) AS truncated, any_value(illegal) AS illegal,
        min({{'cost': s.cost + n.price, 'audit': s.audit || n.piece, 'lines': s.lines || n.added}}) AS b
      FROM step s LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM s.conv_id JOIN inserted n ON n.state = s.state AND (n.mid = 3 OR n.mid = 0) WHERE s.i = coalesce(c.n, 0) GROUP BY s.conv_id
    )
    SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
      b.cost::BIGINT AS cost, b.audit AS audit, sha256(array_to_string(b.lines, chr(10))) AS repaired_sha256 FROM last
    """


def oracle_sql() -> dict[str, str]:
    return {"op11_ranges": RANGES, "op12_turns": turns_sql()}
