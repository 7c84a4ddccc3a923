"""DuckDB SQL of the queries that SQL can express, over whole tables."""

from __future__ import annotations

from .sharding import BITS, SEED, SHARDS

#: CRC-32 by its table of 256 remainders, made from the polynomial.
CRC_TABLE = """crc_table AS MATERIALIZED (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i]::BIGINT[] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v
    FROM range(256) r(i)))"""
CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(range(octet_length(raw)), lambda i: ('0x' || substr(hex(raw), 2 * i + 1, 2))::BIGINT),
    lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295::BIGINT)"""


def _hash(parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {parts})), 1, {BITS // 4}))::BIGINT"


OP9 = f"""
WITH {CRC_TABLE},
d AS (
  SELECT doc_id, octet_length(raw) + 8 AS size, {CRC} AS text_crc32, source, {_hash(f"'{SEED}', doc_id")} AS dealt
  FROM (SELECT doc_id, encode(coalesce(text, '')) AS raw, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS source FROM documents), crc_table),
sources AS (SELECT source, count(*) AS n, {_hash(f"'{SEED}', source")} AS h FROM d GROUP BY source),
phases AS (
  SELECT source, n, (row_number() OVER (PARTITION BY n ORDER BY h, source) - 0.5)::DOUBLE / count(*) OVER (PARTITION BY n) AS phase FROM sources),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY dealt, doc_id NULLS FIRST, text_crc32, size) AS k FROM d JOIN phases USING (source)),
placed AS (
  SELECT *, row_number() OVER (ORDER BY (k - phase) / n, source) - 1 AS place, count(*) OVER () AS total FROM ranked),
cut AS (SELECT *, (place * {SHARDS}) // total AS s FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, s::INTEGER AS shard, place - (s * total + {SHARDS - 1}) // {SHARDS} AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP8 = rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM texts WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * c >= 80 * (s.n + t.n - c)),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.other = l.x)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""

#: Texts as hexadecimal figures: two per byte.
OP10 = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
strings AS (
  SELECT doc_id, s, substr(h, 2 * s + 1, 200) AS w FROM (SELECT doc_id, h, unnest(range(n - 99)) AS s FROM texts WHERE n >= 100)),
later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS k FROM strings) WHERE k > 1),
marked AS (
  SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM later),
runs AS (
  SELECT doc_id, min(s) AS a, max(s) + 100 AS b
  FROM (SELECT doc_id, s, sum(CASE WHEN before IS NULL OR s > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM marked) GROUP BY doc_id, run),
cut AS (
  SELECT doc_id, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends, sum(b - a) AS gone, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN spans IS NULL THEN h ELSE array_to_string(list_transform(range(spans + 1),
    lambda k: substr(h, 2 * (CASE WHEN k = 0 THEN 0 ELSE ends[k] END) + 1, 2 * ((CASE WHEN k = spans THEN n ELSE starts[k + 1] END) - (CASE WHEN k = 0 THEN 0 ELSE ends[k] END)))), '') END)) AS kept_sha256
FROM texts LEFT JOIN cut USING (doc_id)
"""
