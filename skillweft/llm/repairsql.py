"""SQL counterpart of the conversation repair: the least edit per state, carried from turn to turn."""

NONE, SYSTEM, USER, ASSISTANT = "p[1]", "p[2]", "p[3]", "p[4]"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _add(path: str, cost: str, letter: str, line: str = "''") -> str:
    """A path one edit longer: its cost, letters and lines."""
    return f"{{'c': {path}.c + ({cost}), 'a': {path}.a || '{letter}', 'x': {path}.x || {line}}}"


def _insert(path: str, *roles: str) -> str:
    for role in roles:
        path = f"({_add(path, '3', 'I', f'chr(10) || {chr(39)}{role}:{chr(39)}')})"
    return path


def _least(*paths: str) -> str:
    return f"list_min([{', '.join(paths)}])"


def _stay(path: str, role: str) -> str:
    """Kept if it has the role, else renamed; not for turns that must go."""
    kept = _add(path, "t.stays", "K", "chr(10) || t.role || ':' || t.text")
    named = _add(path, "t.stays + 3", "R", f"chr(10) || '{role}:' || t.text")
    return f"CASE WHEN t.initial = '{role[0]}' THEN {kept} ELSE {named} END"


# paths behind a turn, then with the insertions in front of the next one
_READY = ", ".join([
    NONE, SYSTEM,
    _least(USER, _insert(NONE, "user"), _insert(SYSTEM, "user"), _insert(ASSISTANT, "user")),
    _least(ASSISTANT, _insert(USER, "assistant"), _insert(NONE, "user", "assistant"), _insert(SYSTEM, "user", "assistant")),
])
_AFTER = ", ".join([
    _add(NONE, "4", "D"),
    _least(_add(SYSTEM, "4", "D"), _add(NONE, "t.stays + CASE WHEN t.initial = 's' THEN 0 ELSE 1000000 END", "K",
                                        "chr(10) || t.role || ':' || t.text")),
    _least(_add(USER, "4", "D"), *(_stay(path, "user") for path in (NONE, SYSTEM, ASSISTANT))),
    _least(_add(ASSISTANT, "4", "D"), _stay(USER, "assistant")),
])
_END = _least(NONE, ASSISTANT, _insert(USER, "assistant"), _insert(SYSTEM, "user", "assistant"))
_FAR = "{'c': 1000000::BIGINT, 'a': '', 'x': ''}"

CONVERSATION_REPAIR = rf"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations
), sums AS (
  SELECT *, xor(4294967295::BIGINT, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: xor(d >> 1, (d & 1) * 3988292384::BIGINT))
  )) % 20 AS h
  FROM raw
), damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
  FROM sums WHERE h <> 0
), placed AS (
  SELECT *, rtrim(text, {_SPACE}) AS shown, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS previous,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen
  FROM damaged
), judged AS (
  SELECT *, CASE WHEN shown = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate'
    WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS fault
  FROM placed
), told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal,
    list({{'initial': initial, 'role': role, 'text': text, 'stays': CASE fault WHEN 'fine' THEN 0
      WHEN 'truncated' THEN 3 ELSE 1000000 END}} ORDER BY i) AS turns
  FROM judged GROUP BY conv_id
), paths AS (
  SELECT * EXCLUDE turns, list_reduce(turns, lambda before, t: list_transform([before], lambda p: [{_READY}])[1:1]
      .list_transform(lambda p: [{_AFTER}])[1], [{{'c': 0::BIGINT, 'a': '', 'x': ''}}, {_FAR}, {_FAR}, {_FAR}]) AS p
  FROM told
), best AS (
  SELECT * EXCLUDE p, {_END} AS b FROM paths
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost,
  coalesce(b.a, '') AS audit, sha256(coalesce(substr(b.x, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best ON o.conv_id IS NOT DISTINCT FROM best.conv_id
"""
