"""DuckDB's SQL for the queries that SQL can express."""

from __future__ import annotations

import re

from . import decontaminate, line_dedup, secrets, sharding


def without_flags(pattern: str) -> str:
    """Either-case groups as classes, since other engines fold letters beyond ASCII."""
    def spelled(m: re.Match) -> str:
        return "(?:" + re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", m[1]) + ")"

    return re.sub(r"\(\?ai:([^)]*)\)", spelled, pattern)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def op1_sql() -> str:
    """Each rule's matches by splitting the text at them; positions are sums of lengths."""
    found = []
    for n, rule in enumerate(secrets.RULES):
        p = quoted(without_flags(secrets.search_pattern(rule)))
        found.append(f"""
SELECT r, {n} AS rule, {quoted(rule.kind)} AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
    'a': list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
    'n': length(m[i]), 'g': length(g[i])}})) AS x
FROM (SELECT r, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {rule.group}) AS g, string_split_regex(text, {p}) AS s FROM rows_)
WHERE len(m) > 0""")
    least = " ".join(f"WHEN {n} THEN {r.least}" for n, r in enumerate(secrets.RULES))
    base = ", ".join(str(n) for n, r in enumerate(secrets.RULES) if r.base)
    listed = "coalesce(string_agg(shown, ',' ORDER BY a, rule){}, '')"
    counts = ", ".join(f"count(*) FILTER (rule = {n}) AS n_{r.kind}" for n, r in enumerate(secrets.RULES) if r.base)
    return f"""
WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(found)}),
spans AS (
  SELECT r, rule, CAST(x.a AS BIGINT) AS a, kind || ':' || CAST(x.a AS BIGINT) || ':' || CAST(x.a + x.n AS BIGINT) AS shown
  FROM found WHERE x.g >= CASE rule {least} END
)
SELECT doc_id, {counts}, sha256({listed.format(f" FILTER (rule IN ({base}))")}) AS base_sha256, {listed.format("")} AS spans
FROM rows_ LEFT JOIN spans USING (r) GROUP BY r, doc_id"""


def crc_table() -> list[int]:
    """The byte table of CRC-32 with the reversed polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def op3_sql(shards: int = 8, seed: int = 7) -> str:
    """Whole-source windows; the checksum by folding the text's bytes."""
    table = f"CAST({crc_table()} AS BIGINT[])"
    return f"""
WITH bytes AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: CAST('0x' || p AS BIGINT)) AS b FROM documents
),
rows_ AS (
  SELECT doc_id, source, CAST(len(b) + 1 AS BIGINT) AS size,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, ({table})[(xor(c, x) & 255) + 1])), 4294967295) AS crc
  FROM bytes
),
keyed AS (
  SELECT *, CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || crc), 1, {sharding.KEY_DIGITS}) AS BIGINT) AS k FROM rows_
),
offsets AS (
  SELECT DISTINCT source, CAST(CAST('0x' || substr(md5('{seed}:source:' || coalesce('s' || source, 'n')), 1, {sharding.KEY_DIGITS}) AS BIGINT) AS DOUBLE) / {sharding.SPAN!r} AS o FROM rows_
),
ranked AS (
  SELECT k.*, (CAST(row_number() OVER (PARTITION BY k.source ORDER BY k, doc_id NULLS FIRST, crc, size) - 1 AS DOUBLE) + o)
    / CAST(count(*) OVER (PARTITION BY k.source) AS DOUBLE) AS f FROM keyed k JOIN offsets s ON k.source IS NOT DISTINCT FROM s.source
),
placed AS (
  SELECT *, row_number() OVER (ORDER BY f, k, doc_id NULLS FIRST, crc, size) - 1 AS n, count(*) OVER () AS total FROM ranked
)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, CAST(n * {shards} // total AS INTEGER) AS shard,
  CAST(n - ((n * {shards} // total) * total + {shards - 1}) // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source
FROM placed"""


def op5_sql(window: int = decontaminate.WINDOW_WORDS) -> str:
    """Every window of every document against every window of an item, by equality."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    split = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {split} AS w FROM documents),
items AS (SELECT DISTINCT item_id, {split} AS w FROM benchmark),
cuts AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {window - 1}) + 1)) AS k FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, least({window}, len(w)) AS n, array_to_string(w[k : k + least({window}, len(w)) - 1], ' ') AS s FROM cuts),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM docs, sizes WHERE len(w) >= n),
hits AS (SELECT r, item_id, k, p.n FROM (SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS s FROM places) p JOIN windows USING (n, s)),
covered AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS x FROM hits) GROUP BY r),
found AS (
  SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS listed
  FROM (SELECT DISTINCT r, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN found USING (r)"""


def op9_sql() -> str:
    """All pairs that share a shingle, and everything that each row reaches over links."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
shingles AS (
  SELECT DISTINCT r, s FROM (
    SELECT r, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM docs
  )
),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
pairs AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.r = x JOIN sizes q ON q.r = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached(r, id) AS (
  SELECT r, doc_id FROM docs UNION SELECT edges.y, reached.id FROM reached JOIN edges ON edges.x = reached.r
),
least AS (SELECT r, min(id) AS component_id FROM reached GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM docs JOIN least USING (r) LEFT JOIN sizes USING (r)"""


ORACLES = {"op1_secrets": op1_sql(), "op3_sharding": op3_sql(), "op5_decontaminate": op5_sql(), "op8_line_dedup": line_dedup.OP8_SQL, "op9_near_dedup": op9_sql()}
