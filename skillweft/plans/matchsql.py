"""Similarity scores and the matching cascade as SQL, for small tables: every pair is scored."""

from skillweft import dictionaries as d
from skillweft.plans import sqltext as q


def lcs(a: str, b: str) -> str:
    """Longest common subsequence of two lists of letters (at most 62), one bit per letter of ``a``."""
    masks = (f"list_transform({b}, lambda c: CAST(list_sum(list_transform(range(len({a})), lambda i: "
             f"CASE WHEN {a}[i + 1] = c THEN 1::BIGINT << CAST(i AS INTEGER) ELSE 0 END)) AS BIGINT))")
    full = f"((1::BIGINT << CAST(len({a}) AS INTEGER)) - 1)"
    rows = f"list_reduce(list_prepend({full}, {masks}), lambda r, m: ((r + (r & m)) | (r - (r & m))) & {full})"
    return f"(len({a}) - bit_count({rows}))"


def window(a: str, b: str) -> str:
    """Best ratio of the shorter list ``a`` with a window of ``b``; shorter windows stand at common ends."""
    spans = (f"list_concat(list_transform(range(len({b}) - len({a}) + 1), lambda i: {b}[i + 1:i + len({a})]), "
             f"list_transform(range(1, len({a})), lambda n: {b}[1:n]), "
             f"list_transform(range(1, len({a})), lambda n: {b}[len({b}) - n + 1:len({b})]))")
    return f"list_max(list_transform({spans}, lambda w: 200.0::DOUBLE * {lcs(a, 'w')} / (len({a}) + len(w))))"


_KEYS = f"unnest(list_distinct(list_filter([text, {q.synonym('text')}], lambda x: x IS NOT NULL))) AS key"


def direct(raw: str, known: str) -> str:
    """Equal texts and texts with one synonym: (text, id, known_text)."""
    return f"""
    SELECT text, arg_min(id, (CAST(known_text <> text AS INTEGER), id)) AS id,
           arg_min(known_text, (CAST(known_text <> text AS INTEGER), id)) AS known_text
    FROM (SELECT text, {_KEYS} FROM {raw})
    JOIN (SELECT key, min((CAST(key <> text AS INTEGER), id, text)) AS hit, hit[2] AS id, hit[3] AS known_text
          FROM (SELECT id, text, {_KEYS} FROM {known}) GROUP BY key) USING (key)
    GROUP BY text"""


def pairs(raw: str, known: str, rest_of: str = "r.text NOT IN (SELECT text FROM direct)") -> str:
    """Every pair of texts without a direct hit that can reach 85: (text, id, known_text, score)."""
    words = lambda c: f"list_sort(list_distinct(list_filter(string_split({c}, ' '), lambda w: w <> '')))"
    rest = lambda a, b: (
        f"coalesce(array_to_string(list_filter({a}, lambda w: NOT list_contains({b}, w)), ' '), '')"
    )
    return f"""
    SELECT text, id, known_text, CASE WHEN whole >= 85 THEN whole
        WHEN 200 * shared < 85 * (least(len(x), len(y)) + shared) THEN 0.0
        WHEN len(x) < len(y) THEN {window('x', 'y')} WHEN len(x) > len(y) THEN {window('y', 'x')}
        ELSE greatest({window('x', 'y')}, {window('y', 'x')}) END AS score
    FROM (SELECT *, CASE WHEN NOT (contains(text, ' ') OR contains(known_text, ' ')) THEN 200.0::DOUBLE * shared / (len(x) + len(y))
            WHEN common > 0 AND (only_x = '' OR only_y = '') THEN 100.0
            ELSE greatest(
                100.0::DOUBLE * (1 - (length(only_x) + length(only_y) - 2 * {lcs("string_split(only_x, '')", "string_split(only_y, '')")})::DOUBLE
                                     / (2 * (common + gap) + length(only_x) + length(only_y))),
                CASE WHEN common > 0 THEN 100.0::DOUBLE * (1 - (gap + length(only_x))::DOUBLE / (2 * common + gap + length(only_x))) ELSE 0 END,
                CASE WHEN common > 0 THEN 100.0::DOUBLE * (1 - (gap + length(only_y))::DOUBLE / (2 * common + gap + length(only_y))) ELSE 0 END)
            END AS whole
          FROM (SELECT *, {lcs('x', 'y')} AS shared, {rest('wx', 'wy')} AS only_x, {rest('wy', 'wx')} AS only_y,
                       length(coalesce(array_to_string(list_filter(wx, lambda w: list_contains(wy, w)), ' '), '')) AS common,
                       CASE WHEN len(list_filter(wx, lambda w: list_contains(wy, w))) > 0 THEN 1 ELSE 0 END AS gap
                FROM (SELECT r.text, k.id, k.text AS known_text, string_split(r.text, '') AS x, string_split(k.text, '') AS y,
                             {words('r.text')} AS wx, {words('k.text')} AS wy
                      FROM {raw} r, {known} k WHERE {rest_of}))
          WHERE contains(text, ' ') OR contains(known_text, ' ') OR 200 * shared >= 85 * (least(len(x), len(y)) + shared))"""


_NORM = q.normalize_skill
_TRIMMED = "lower(trim(skill))"

#: Steps that resolve ``asked(skill, skill_type)`` against ``known(id, name, normalized_name)``, given the
#: steps variants, idx, fixes and lookup; the last one is ``matched``.
CASCADE = {
    "names": f"""SELECT known_norm, max(id) AS known_id, arg_max(name, id) AS known_name
        FROM (SELECT id, name, {_NORM('normalized_name')} AS known_norm FROM known) GROUP BY known_norm""",
    "staged": f"""SELECT r.*, l.canonical AS c, l.canonical_type AS ct, nc.known_id AS c_id, nc.known_name AS c_name,
            ns.known_id AS s_id, ns.known_name AS s_name
        FROM (SELECT skill, skill_type, {_NORM('skill')} AS norm, {_NORM(q.synonym(_TRIMMED))} AS sn,
                     {_TRIMMED} IN ({", ".join(map(q.lit, d.GENERIC_TERMS))}) AS generic FROM (SELECT DISTINCT skill, skill_type FROM asked)) r
        LEFT JOIN lookup l ON l.norm = r.norm
        LEFT JOIN names nc ON l.canonical IS NOT NULL AND nc.known_norm = {_NORM('l.canonical')}
        LEFT JOIN names ns ON r.sn <> '' AND ns.known_norm = r.sn""",
    "raw": """SELECT DISTINCT norm AS text FROM staged
        WHERE NOT generic AND c_id IS NULL AND s_id IS NULL AND norm <> ''""",
    "vocab": "SELECT known_norm AS text, known_id AS id FROM names WHERE known_norm <> ''",
    "direct": direct("raw", "vocab"),
    "scored": pairs("raw", "vocab"),
    "fuzzy": """SELECT f.text, f.id, f.score, n.known_name FROM (
            SELECT text, id, 100.0::DOUBLE AS score FROM direct
            UNION ALL SELECT text, arg_max(id, (score, -id)), max(score) FROM scored WHERE score >= 85 GROUP BY text) f
        JOIN names n ON n.known_id = f.id""",
    "matched": f"""SELECT skill, skill_type, norm,
            CASE method WHEN 'canonical' THEN c_id WHEN 'synonym' THEN s_id WHEN 'fuzzy' THEN f_id END AS matched_id,
            CASE method WHEN 'canonical' THEN c_name WHEN 'synonym' THEN s_name WHEN 'fuzzy' THEN f_name END AS matched_skill,
            CASE WHEN method IN ('canonical', 'synonym') THEN 100.0::DOUBLE WHEN method = 'fuzzy' THEN score ELSE 0.0::DOUBLE END AS score,
            method,
            CASE method WHEN 'generic' THEN 'rejected' WHEN 'new' THEN 'insert_new' ELSE 'use_existing' END AS action,
            CASE WHEN method = 'new' THEN coalesce(detected, ct, skill_type) WHEN method <> 'generic' THEN coalesce(ct, skill_type) END AS final_type
        FROM (SELECT s.*, f.id AS f_id, f.known_name AS f_name, f.score,
                CASE WHEN generic THEN 'generic' WHEN c_id IS NOT NULL THEN 'canonical' WHEN s_id IS NOT NULL THEN 'synonym'
                     WHEN f.id IS NOT NULL THEN 'fuzzy' ELSE 'new' END AS method,
                CASE WHEN skill = '' OR generic THEN NULL WHEN {q.any_in(_TRIMMED, d.SOFT_SKILL_INDICATORS)} THEN 'soft_skill'
                     ELSE (SELECT arg_min(category, r) FROM idx WHERE idx.norm = s.norm) END AS detected
              FROM staged s LEFT JOIN fuzzy f ON f.text = s.norm)""",
}

#: After ``keyed`` (matched spellings with ``own`` name, ``key`` and ``ord``): new skills taken one after another.
LEADERS = {
    "unmatched": """SELECT key, arg_min({'t': final_type, 'n': own}, (ord, final_type, length(own), own)) AS f,
            row_number() OVER (ORDER BY min(ord), key) AS r
        FROM keyed WHERE action = 'insert_new' AND final_type IS NOT NULL GROUP BY key""",
    "fresh_texts": "SELECT key AS text, r AS id FROM unmatched WHERE key <> ''",
    "fresh_keys": f"SELECT id, {_KEYS} FROM fresh_texts",
    "near": f"""SELECT x.id AS later, y.id AS earlier, 100.0::DOUBLE AS score
        FROM fresh_keys x JOIN fresh_keys y ON x.key = y.key AND x.id > y.id
        UNION SELECT t.id, p.id, p.score FROM ({pairs('fresh_texts', 'fresh_texts', 'k.id < r.id')}) p
        JOIN fresh_texts t ON t.text = p.text WHERE p.score >= 85""",
    "chosen": """SELECT list_reduce(list({'r': r, 'near': near} ORDER BY r), lambda acc, x:
            CASE WHEN list_has_any(acc, x.near) THEN acc ELSE list_append(acc, x.r) END, []::BIGINT[]) AS leaders
        FROM (SELECT r, list(earlier) FILTER (earlier IS NOT NULL) AS near FROM unmatched LEFT JOIN near ON later = r GROUP BY r)""",
    "member": """SELECT key, coalesce(arg_max(earlier, (score, -earlier)), r) AS leader_r
        FROM unmatched CROSS JOIN chosen LEFT JOIN near ON later = r AND list_contains(leaders, earlier)
            AND NOT list_contains(leaders, r) GROUP BY key, r""",
    "added": """SELECT m.key, l.key AS leader, l.f.t AS skill_type, l.f.n AS name
        FROM member m JOIN unmatched l ON l.r = m.leader_r""",
}
