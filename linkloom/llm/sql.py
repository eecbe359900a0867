"""The same results in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

from linkloom.llm.lookalike import character_map

P3 = """
WITH r AS (SELECT DISTINCT id, channel_id, start_at FROM recordings WHERE id IS NOT NULL),
s AS (SELECT DISTINCT pid, channel_id, CAST(epoch_ms(started_at) AS BIGINT) AS t FROM schedule_programs WHERE pid IS NOT NULL AND deleted = false),
c AS (SELECT DISTINCT channel_id, history_id FROM schedule_channels),
d AS (
  SELECT r.id, s.pid, abs(s.t - r.start_at) AS distance, row_number() OVER (PARTITION BY r.id ORDER BY abs(s.t - r.start_at), s.t, s.pid) AS k
  FROM r JOIN c ON r.channel_id = c.history_id JOIN s ON s.channel_id = c.channel_id AND abs(s.t - r.start_at) <= 300000)
"""


P6_TABLES = (("works", "id", "title"), ("episodes", "id", "title"), ("recordings", "id", "name"), ("schedule_programs", "pid", "subtitle"))


def p6_found_sql() -> str:
    """Texts taken apart, mapped and put together again; composition is DuckDB's own, and that of Hangul with it."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    mapped = ", ".join(f"({ord(a)}, {quoted(b)})" for a, b in sorted(character_map().items()) if not "\uac00" <= a <= "\ud7a3")
    values = " UNION ".join(f"SELECT '{t}' AS tbl, CAST({k} AS BIGINT) AS id, {c} AS text FROM {t} WHERE {c} IS NOT NULL" for t, k, c in P6_TABLES)
    return f"""
WITH m(code, parts) AS (VALUES {mapped}), v AS ({values}),
t AS (SELECT DISTINCT text FROM v),
c AS (SELECT text, i, substr(text, i, 1) AS ch FROM (SELECT text, unnest(range(1, length(text) + 1)) AS i FROM t)),
f AS (SELECT c.text, nfc_normalize(string_agg(coalesce(m.parts, c.ch), '' ORDER BY c.i)) AS form FROM c LEFT JOIN m ON m.code = unicode(c.ch) GROUP BY c.text),
s AS (SELECT v.tbl, v.id, v.text, f.form FROM v JOIN f ON f.text = v.text WHERE v.id IS NOT NULL AND NOT regexp_full_match(f.form, '\\s*'))
SELECT DISTINCT a.tbl, a.id AS id_a, b.id AS id_b FROM s a JOIN s b ON a.tbl = b.tbl AND a.form = b.form AND a.text <> b.text AND a.id < b.id"""


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": p6_found_sql(),
        "p3_found": P3 + "SELECT CAST(pid AS BIGINT) AS pid, id AS recording_id FROM d WHERE k = 1",
        "p3_nearest": P3 + "SELECT id AS left_id, CAST(pid AS BIGINT) AS right_id, CAST(distance AS BIGINT) AS distance FROM d WHERE k = 1",
        # every common tokenizer gives this outcome, so characters do as well
        "p8_found": """
WITH s AS (SELECT source, sum(length(text)) AS n FROM documents GROUP BY source), t AS (SELECT sum(length(text)) AS n FROM documents)
SELECT m.source FROM mix_targets m LEFT JOIN s ON s.source = m.source, t WHERE m.target_share * t.n > m.max_repeats * coalesce(s.n, 0)""",
    }
