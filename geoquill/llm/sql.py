"""Handwritten DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

from . import licenses
from .common import LOWER, UPPER

#: All pairs of queries and vectors, scored and ranked.
TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 10
"""

#: All pairs of documents that share a shingle, those that link, and what is reached from each document.
JACCARD = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w
), u AS (SELECT doc_id, unnest(s) AS x FROM s), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * shared >= 90 * (len(p.s) + len(q.s) - shared)
), reach AS (SELECT doc_id AS node, doc_id AS root FROM s UNION SELECT b, root FROM reach JOIN links ON a = node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(root) AS component_id FROM s JOIN reach ON node = s.doc_id GROUP BY s.doc_id, s.s
"""


#: Sources, their targets by water-filling, and each document's place in its source's order.
MIX = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), 'text ' || text, '')) AS digest FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS n FROM d GROUP BY source
), w AS (
  SELECT *, CASE n % 3 WHEN 0 THEN 5::DOUBLE WHEN 1 THEN 2 ELSE 1 END AS w, CASE n % 3 WHEN 0 THEN 0::DOUBLE WHEN 1 THEN 0.5 ELSE -0.5 END AS ramp, 2::DOUBLE * source_size AS cap FROM s
), o AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, n) AS r, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), f AS (SELECT min(r) AS r, arg_min(level, r) AS level FROM o WHERE level * w <= cap), t AS (
  SELECT o.source, source_size, ramp, CASE WHEN f.r IS NULL OR o.r < f.r THEN cap ELSE least(cap, f.level * w) END AS target FROM o CROSS JOIN f
), p AS (
  SELECT d.*, source_size, ramp, target, CAST(floor(target) AS BIGINT) AS whole, CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY digest, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, CAST(greatest(0, least(size, whole - start)) + greatest(0, least(size, whole - source_size - start)) AS BIGINT) AS taken, CASE WHEN size > 0 AND whole > start THEN CAST(start AS DOUBLE) / CAST(whole AS DOUBLE) END AS part FROM p
)
SELECT doc_id, size, source_size, target, taken, CASE WHEN abs(ramp) < 1e-9 THEN part ELSE (sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * part) - (1 - ramp)) / (2 * ramp) END AS position FROM q
"""


def shard_sql() -> str:
    """Checksums byte by byte; draws, boundaries, exact range sizes, and places within ranges."""
    table = []
    for i in range(256):  # the reflected polynomial, eight shifts
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    unit = lambda h: f"(CAST('0x' || substr({h}, 1, 12) AS BIGINT) / 281474976710656::DOUBLE)"
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""
    WITH c AS (SELECT {table}::BIGINT[] AS t), r AS (
      SELECT doc_id, CAST(coalesce(strlen(text), 0) + 16 AS BIGINT) AS size, hex(encode(text)) AS h, md5(coalesce(text, '')) AS digest, md5(coalesce(CAST(doc_id AS VARCHAR), 'text ' || text, '')) AS tie FROM documents
    ), k AS (
      SELECT doc_id, size, digest, tie, CAST('0x' || substr(digest, 1, 12) AS BIGINT) AS key, sum(size) OVER () AS total,
        CASE WHEN h IS NOT NULL THEN xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) END AS text_crc32
      FROM r CROSS JOIN c
    ), draws AS (
      SELECT key, sum(m) AS m FROM (SELECT key, CAST(floor(size * (40960::DOUBLE / greatest(1, total)) + {unit("md5(tie || 'draw')")}) AS BIGINT) AS m FROM k) WHERE m > 0 GROUP BY key
    ), e AS (SELECT key, m, sum(m) OVER (ORDER BY key) AS stop, sum(m) OVER () AS every FROM draws), x AS (
      SELECT key, floor(CAST(stop * 1280 AS DOUBLE) / every) - floor(CAST((stop - m) * 1280 AS DOUBLE) / every) AS x FROM e
    ), b AS (SELECT key AS b FROM x WHERE x > 0 UNION SELECT key + 1 FROM x WHERE x > 1), keys AS (SELECT DISTINCT key FROM k), g AS (
      SELECT key, (SELECT count(*) FROM b WHERE b.b <= keys.key) AS range FROM keys
    ), a AS (SELECT k.*, range FROM k JOIN g USING (key)), size_of AS (
      SELECT range, CASE WHEN sum(size) > 0.125::DOUBLE * (any_value(total) / 40::DOUBLE) THEN CAST(ceil(sum(size) * 32 / greatest(1::DOUBLE, any_value(total) / 40::DOUBLE)) AS BIGINT) ELSE 1 END AS parts, count(*) AS rows FROM a GROUP BY range
    ), u AS (
      SELECT a.*, CAST(floor({unit("tie")} * parts) AS BIGINT) AS part, CAST(floor({unit("substr(tie, 13, 12)")} * ceil(rows / CAST(parts AS DOUBLE) / 65536)) AS BIGINT) AS bucket FROM a JOIN size_of USING (range)
    ), ends AS (SELECT range, part, sum(size) AS bytes, count(*) AS rows, any_value(total) AS total FROM u GROUP BY range, part), placed AS (
      SELECT *, CAST(least(39, floor((coalesce(sum(bytes) OVER (ORDER BY range, part {before}), 0) + bytes / 2::DOUBLE) * 40 / CAST(greatest(1, total) AS DOUBLE))) AS INTEGER) AS shard FROM ends
    ), firsts AS (SELECT range, part, shard, coalesce(sum(rows) OVER (PARTITION BY shard ORDER BY range, part {before}), 0) AS first FROM placed)
    SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(first + row_number() OVER (PARTITION BY range, part ORDER BY bucket, digest, tie, size) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
    FROM u JOIN firsts USING (range, part)
    """


def license_sql() -> str:
    """Every place of every phrase, and every block of words against every template."""
    words = lambda t: "[" + ", ".join(f"'{w}'" for w in t) + "]"
    phrases = {k: p.split() for k, p in enumerate(licenses.PHRASES)}
    places = ", ".join(f"list_filter(range(0, len(w) - {len(p) - 1}), lambda i: w[i + 1:i + {len(p)}] = {words(p)}) AS p{k}" for k, p in phrases.items())
    every = "list_concat(" + ", ".join(["p0", "list_concat(p1, p2)"]) + ")"
    base = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(licenses.PHRASES.values()))
    known = licenses.prepared(licenses.TEMPLATES, 0.8)
    templates = ",\n      ".join(f"('{t.name}', '{t.label}', {words(t.words)}, {t.need}, {t.half}, {words(t.rivals)}::VARCHAR[])" for t in known)
    joined = lambda items: f"coalesce(array_to_string(list_sort(list_distinct(list_filter({items}, lambda x: x IS NOT NULL))), ','), '')"
    return f"""
    WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{licenses.TOKEN}') AS w FROM documents),
    t(name, label, t, need, half, rivals) AS (VALUES
      {templates}),
    b AS (SELECT doc_id, unnest(range(0, len(w), half)) AS i, w, name, label, t, need, half, rivals FROM w JOIN t ON len(list_intersect(t, w)) >= need),
    m AS (SELECT doc_id, i, half, name, label, rivals, len(t) AS total, len(list_intersect(t, w[i + 1:i + 2 * half])) AS held, need FROM b),
    m2 AS (SELECT *, held / total::DOUBLE AS share FROM m WHERE held >= need),
    f AS (SELECT doc_id, list(label) AS labels, max(share) AS share FROM m2 x WHERE NOT EXISTS (
      SELECT 1 FROM m2 y WHERE y.doc_id = x.doc_id AND y.i BETWEEN x.i - x.half AND x.i + x.half AND y.half = x.half AND list_contains(x.rivals, y.name) AND (y.held > x.held OR (y.held = x.held AND y.share > x.share))
    ) GROUP BY doc_id),
    c AS (SELECT *, {every} AS p, [{base}] AS base FROM (SELECT *, {places} FROM w))
    SELECT c.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, CAST(list_min(p) AS BIGINT) AS first_word, CAST(list_max(p) AS BIGINT) AS last_word,
      {joined("base")} AS base_labels, {joined("list_concat(base, coalesce(f.labels, []))")} AS labels,
      CAST(greatest(coalesce(f.share, 0), CASE WHEN len(p) > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS score FROM c LEFT JOIN f USING (doc_id)
    """


def oracle_sql() -> dict[str, str]:
    return {"op3_mix": MIX, "op5_jaccard": JACCARD, "op8_topk": TOP_K, "op9_shard": shard_sql(), "op10_licenses": license_sql()}
