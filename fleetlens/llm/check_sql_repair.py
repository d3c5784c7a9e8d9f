"""SQL of the conversation repair: the plain recursion over turns, with whole audits carried along.

A value per state is ``cost (10 digits) audit chr(1) repaired turns``, so the least string is the cheapest, then the
ASCII-least audit.
"""

from __future__ import annotations

CRC32 = """
crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce([CAST(x AS UBIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, i: xor(c >> 1, CAST(3988292384 AS UBIGINT) * (c & CAST(1 AS UBIGINT))))) AS tbl
)"""


def _edit(state: str, letter: str, cost: str, line: str | None = None) -> str:
    """The state's string after one edit: cost, letter, and a repaired turn if the edit leaves one."""
    mark = f"strpos({state}, chr(1))"
    added = f"lpad(CAST(CAST(left({state}, 10) AS BIGINT) + {cost} AS VARCHAR), 10, '0')"
    audit = f"substr({state}, 11, {mark} - 11) || '{letter}'"
    kept = f"substr({state}, {mark})"
    # Turns are joined by newlines; the first one has none in front.
    turns = kept if line is None else f"{kept} || CASE WHEN length({kept}) > 1 THEN chr(10) ELSE '' END || {line}"
    return f"{added} || {audit} || {turns}"


def _step() -> str:
    gone = {x: _edit(x, "D", "2") for x in "esua"}
    kept = {x: f"CASE WHEN NOT gone AND {{}} THEN {_edit(x, 'K', 'cut', 'role || chr(58) || text')} END" for x in "esua"}
    reroled = {
        x: f"CASE WHEN NOT gone THEN {_edit(x, 'R', '1 + cut', repr(to) + ' || chr(58) || text')} END"
        for x, to in zip("esua", ("user", "user", "assistant", "user"))
    }
    s = f"least({gone['s']}, {kept['e'].format(S)})"
    u = f"least({gone['u']}, " + ", ".join(f"{kept[x].format(U)}, {reroled[x]}" for x in "esa") + ")"
    a = f"least({gone['a']}, {kept['u'].format(A)}, {reroled['u']})"
    return f"{gone['e']} AS e, {s} AS s, {u} AS u, {a} AS a"


S, U, A = "initial = 's'", "initial = 'u'", "initial = 'a'"


def repair_sql() -> str:
    user, assistant = "'user:'", "'assistant:'"
    inserted_u = f"least(u, {_edit('e', 'I', '5', user)}, {_edit('s', 'I', '5', user)}, {_edit('a', 'I', '5', user)})"
    inserted_a = f"least(a, {_edit('u', 'I', '5', assistant)})"
    mark = "strpos(best, chr(1))"
    return f"""
WITH RECURSIVE {CRC32}, keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), dealt AS (
  SELECT keyed.*, xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS UBIGINT))),
    lambda c, b: xor(c >> 8, tbl[CAST(xor(c, b) & 255 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) % 20 AS fault FROM keyed, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS again FROM dealt WHERE fault <> 0
), ordered AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS stripped,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS n FROM damaged
), repeats AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS prior FROM ordered
), faults AS (
  SELECT *, stripped = '' AS blank, stripped <> '' AND again AS duplicate,
    stripped <> '' AND NOT again AND right(stripped, 1) NOT IN ('.', '!', '?') AS truncated FROM repeats
), turns AS (
  SELECT conv_id, n, role, text, initial, blank OR duplicate AS gone, CASE WHEN truncated THEN 5 ELSE 0 END AS cut FROM faults
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (prior IS NOT NULL AND prior || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS last FROM faults GROUP BY conv_id
), walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, '0000000000' || chr(1) AS e, CAST(NULL AS VARCHAR) AS s, '0000000005I' || chr(1) || 'user:' AS u,
    '0000000010II' || chr(1) || 'user:' || chr(10) || 'assistant:' AS a FROM counts
  UNION ALL
  SELECT conv_id, n, e, s, u, {inserted_a} AS a FROM (
    SELECT conv_id, n, e, s, {inserted_u} AS u, a FROM (
      SELECT t.conv_id, t.n, {_step()} FROM walk w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.n + 1))
), ended AS (
  SELECT c.*, least(w.e, w.a) AS best FROM counts c JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.n = c.last
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(left(best, 10) AS BIGINT), 0) AS cost,
  coalesce(substr(best, 11, {mark} - 11), '') AS audit, sha256(coalesce(substr(best, {mark} + 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM o.conv_id"""
