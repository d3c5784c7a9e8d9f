"""DuckDB SQL for the queries that SQL can express, over the same Parquet tables."""

from __future__ import annotations

from fleetlens.llm import cleaning, mixing
from fleetlens.llm.check_sql_repair import repair_sql
from fleetlens.llm.check_sql_vectors import centroid_sql, near_sql

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '{WORD}')"


JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {words(f"translate(text, '{UPPER}', '{LOWER}')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS shingle FROM
    (SELECT doc_id, w, unnest(CASE WHEN len(w) >= 4 THEN range(1, len(w) - 2) WHEN len(w) > 0 THEN [1] ELSE [] END) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN ways l ON r.other = l.a),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)"""


def _said(text: str) -> str:
    return f"trim(lower(regexp_replace({text}, '[\\x20\\x09-\\x0D>]+', ' ', 'g')))"


def _quote(text: str, mark: str) -> str:
    return f"'{mark}' || replace({text}, chr(10), chr(10) || '{mark}')"


def _parts(table: str) -> str:
    """Of a turn: itself and its lines, as they are hashed."""
    return f"unnest(list_append(string_split({table}, chr(10)), {table}))"


# Turns quote the two before them, see quotations.as_mail; a message is its place (turn, null first) and the md5 of its mail.
QUOTATIONS = f"""
WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(text, '') AS text, count(*) AS n_rows FROM conversations GROUP BY ALL),
quotable AS (SELECT conv_id, turn, min(text) AS text FROM t WHERE turn IS NOT NULL GROUP BY ALL),
mails AS (SELECT t.*, l.text AS last, b.text AS last_but_one FROM t
  LEFT JOIN quotable l ON l.conv_id IS NOT DISTINCT FROM t.conv_id AND l.turn = t.turn - 1
  LEFT JOIN quotable b ON b.conv_id IS NOT DISTINCT FROM t.conv_id AND b.turn = t.turn - 2),
own AS (SELECT conv_id, n_rows, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, last, CASE WHEN last IS NOT NULL THEN last_but_one END AS last_but_one,
  {{'p': coalesce(CAST(turn AS BIGINT), -9223372036854775808), 'c': md5(CASE WHEN last IS NULL THEN '' ELSE 'On Monday the sender wrote:' || chr(10)
    || CASE WHEN last_but_one IS NULL THEN '' ELSE {_quote('last_but_one', '>> ')} || chr(10) END || {_quote('last', '> ')} || chr(10) || chr(10) END || text)}} AS spot FROM mails),
written AS (SELECT conv_id, said, min(spot) AS origin FROM (SELECT conv_id, spot, {_said('p')} AS said FROM (SELECT conv_id, spot, {_parts('text')} AS p FROM own))
  WHERE said <> '' GROUP BY ALL),
quoted AS (SELECT DISTINCT conv_id, spot, level, {_said('p')} AS said FROM (
  SELECT conv_id, spot, 1 AS level, {_parts('last')} AS p FROM own WHERE last IS NOT NULL
  UNION ALL SELECT conv_id, spot, 2, {_parts('last_but_one')} FROM own WHERE last_but_one IS NOT NULL)),
votes AS (SELECT q.conv_id, q.spot, w.origin, min(level) AS level, sum(length(q.said)) AS chars
  FROM quoted q JOIN written w ON q.conv_id IS NOT DISTINCT FROM w.conv_id AND q.said = w.said WHERE w.origin.p < q.spot.p AND q.said <> '' GROUP BY ALL),
parents AS (SELECT conv_id, spot, origin AS parent FROM votes
  QUALIFY row_number() OVER (PARTITION BY conv_id, spot ORDER BY level, chars DESC, origin DESC) = 1),
tree AS (SELECT conv_id, spot, spot AS root, CAST(0 AS BIGINT) AS depth FROM own o
    WHERE NOT EXISTS (SELECT 1 FROM parents p WHERE p.conv_id IS NOT DISTINCT FROM o.conv_id AND p.spot = o.spot)
  UNION ALL SELECT p.conv_id, p.spot, tree.root, tree.depth + 1 FROM tree JOIN parents p ON p.conv_id IS NOT DISTINCT FROM tree.conv_id AND p.parent = tree.spot)
SELECT o.conv_id, nullif(o.spot.p, -9223372036854775808) AS turn, o.spot.c AS copy, o.n_rows, nullif(p.parent.p, -9223372036854775808) AS parent_turn, p.parent.c AS parent_copy,
  nullif(tree.root.p, -9223372036854775808) AS root_turn, tree.root.c AS root_copy, depth,
  row_number() OVER (PARTITION BY o.conv_id, tree.root ORDER BY depth, o.spot) - 1 AS place, o.text
FROM tree JOIN own o ON o.conv_id IS NOT DISTINCT FROM tree.conv_id AND o.spot = tree.spot
  LEFT JOIN parents p ON p.conv_id IS NOT DISTINCT FROM o.conv_id AND p.spot = o.spot"""

LINE_FAILS = f"""(n > 2 AND NOT regexp_matches(line, '\\p{{Ll}}') AND regexp_matches(line, '\\p{{Lu}}[^\\p{{Ll}}]*\\p{{Lu}}[^\\p{{Ll}}]*\\p{{Lu}}'))
  OR (n >= {cleaning.MANY_WORDS} AND NOT ends_with(line, '.') AND NOT regexp_matches(line, '{cleaning.SENTENCE_END}'))
  OR (n <= {cleaning.BOILERPLATE_WORDS} AND regexp_matches(line, '{cleaning.BOILERPLATE}'))
  OR length(regexp_replace(line, '[^{cleaning.SYMBOLS}]', '', 'g')) * {cleaning.SYMBOLS_A_WORD[1]} > n * {cleaning.SYMBOLS_A_WORD[0]}
  OR len(regexp_extract_all(line, '{cleaning.SEPARATOR}')) * 5 > n
  OR (n >= {cleaning.MANY_WORDS} AND len(list_distinct(w)) * {cleaning.DISTINCT_SHARE[1]} < n * {cleaning.DISTINCT_SHARE[0]})"""

LINE_FIRST = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {words('text')} AS w FROM documents),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{cleaning.A_WORD}')) AS lines FROM d),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS seen FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, seen FROM windows GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM windows JOIN twice USING (doc_id, seen) CROSS JOIN range(3) AS r(k) GROUP BY doc_id),
judged AS (SELECT doc_id, length(line) AS chars, {LINE_FAILS} AS fails FROM
  (SELECT doc_id, line, {words('line')} AS w, len({words('line')}) AS n FROM (SELECT doc_id, unnest(lines) AS line FROM lines))),
loss AS (SELECT doc_id, sum(chars) AS chars, coalesce(sum(chars) FILTER (fails), 0) AS lost FROM judged GROUP BY doc_id),
counts AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^{cleaning.SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN lines USING (doc_id) LEFT JOIN covered c USING (doc_id)),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT base.*, NOT base_failed AND coalesce(lost * {cleaning.MOST_LOST[1]} <= chars * {cleaning.MOST_LOST[0]}, true) AS kept
FROM base LEFT JOIN loss USING (doc_id)"""

PARETO = f"""
WITH d AS (SELECT doc_id, source, CAST(len({words('text')}) AS BIGINT) AS size, md5(coalesce(text, '')) AS text_md5,
  CAST(greatest(strlen(coalesce(text, '')), 1) AS DOUBLE) / {float(mixing.ODDS_BYTES)}::DOUBLE AS odds FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [1.0, 2.0, 3.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source),
caps AS (SELECT *, source_size * {float(mixing.MOST_COPIES)}::DOUBLE AS cap FROM s),
levels AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM caps WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (SELECT source, source_size, CASE WHEN cap / weight <= level THEN cap ELSE weight * (arg_min(level, cap / weight) FILTER (cap / weight > level) OVER ()) END AS target FROM levels),
shares AS (SELECT *, floor(ratio) AS certain, ratio - floor(ratio) AS rest FROM
  (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM goals)),
ranked AS (SELECT *, CASE WHEN rest > 0 THEN u / (1 - u) / (rest / (1 - rest) * odds) END AS rank FROM (
  SELECT d.doc_id, d.source, d.size, d.odds, g.source_size, g.target, g.certain, g.rest,
    (CAST(('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || text_md5), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM d JOIN shares g ON d.source IS NOT DISTINCT FROM g.source)),
sums AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank) AS upto, sum(size) OVER (PARTITION BY source, rank) AS words FROM ranked)
SELECT doc_id, size, source_size, target, CAST((certain + CASE WHEN rank IS NOT NULL AND 2 * upto - words <= 2 * (rest * source_size) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM sums"""

SQL: dict[str, str] = {
    "op1_jaccard_join": JACCARD, "op4_quotations": QUOTATIONS, "op8_line_first": LINE_FIRST, "op10_pareto": PARETO,
    "op11_spherical_cells": near_sql(),
    "op12_heap_bounds": centroid_sql(),
    "op13_block_tables": repair_sql(),
}
