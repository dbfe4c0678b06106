"""Canonical names, matching, vocabulary merge, evaluation and candidate scoring."""

from pyspark.sql import functions as F

from skillweft import dictionaries as d
from skillweft.functions import replies as rp
from skillweft.functions.skills import normalize_skill
from skillweft.operators import fuzzy as fz
from skillweft.operators import matcher as mt
from skillweft.operators import resolve as rs
from skillweft.plans import matchsql as ms
from skillweft.plans import sqltext as q
from skillweft.plans.registry import query
from skillweft.plans.texts import turn_replies
from skillweft.roles import with_roles

TYPE = """CASE WHEN p_type IN ('STANDARD', 'ECONOMY') THEN 'tech_stack'
               WHEN p_type IN ('MEDIUM', 'PROMO') THEN 'technical_skill' ELSE 'soft_skill' END"""
# canonical form "Widget (red)" for three spellings of part names
VARIANTS = f"""SELECT category, canonical, variant, min(seq) AS seq FROM (
    SELECT {TYPE} AS category, p_partkey AS seq,
           upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2)
           || ' (' || split_part(p_name, ' ', 1) || ')' AS canonical,
           unnest([p_name, split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1), replace(p_name, ' ', '')]) AS variant
    FROM part) GROUP BY ALL"""


def variants(t):
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    kind = F.col("p_type")
    rows = t.table("part").select(
        F.when(kind.isin("STANDARD", "ECONOMY"), "tech_stack").when(kind.isin("MEDIUM", "PROMO"), "technical_skill")
        .otherwise("soft_skill").alias("category"),
        F.col("p_partkey").alias("seq"),
        F.concat(F.initcap(second), F.lit(" ("), first, F.lit(")")).alias("canonical"),
        F.explode(F.array("p_name", F.concat(second, F.lit(" "), first), F.replace("p_name", F.lit(" "), F.lit("")))).alias("variant"),
    )
    return rows.groupBy("category", "canonical", "variant").agg(F.min("seq").alias("seq"))


_INDEX = f"""SELECT {q.normalize_skill('variant')} AS norm, category, arg_min(canonical, seq) AS canonical,
    CASE category WHEN 'tech_stack' THEN 1 WHEN 'technical_skill' THEN 2 ELSE 3 END AS r FROM variants GROUP BY 1, 2, 4"""
_FIXES = "SELECT * FROM (VALUES " + ", ".join(f"({q.lit(k)}, {q.lit(v)})" for k, v in d.SPECIFIC_FIXES) + ") AS f(k, v)"


@query("canonicalize", with_roles(f"""
    SELECT id, name, skill_type, coalesce(hit, name) AS canonical, hit IS NOT NULL AS found
    FROM (SELECT s.*, coalesce((SELECT v FROM fixes WHERE k = lower(trim(s.name))),
              (SELECT canonical FROM idx WHERE norm = s.norm AND category = s.skill_type),
              (SELECT arg_min(canonical, r) FROM idx WHERE norm = s.norm)) AS hit
          FROM (SELECT *, {q.normalize_skill('name')} AS norm FROM skills) s)""",
    "skills", variants=VARIANTS, idx=_INDEX, fixes=_FIXES))
def canonicalize(t):
    return rs.with_canonical(t.skills.select("id", "name", "skill_type"), variants(t), "name", "skill_type")


_LOOKUP = f"""
    SELECT norm, arg_max(canonical, (rank, seq)) AS canonical, arg_max(canonical_type, (rank, seq)) AS canonical_type
    FROM (
        SELECT {q.normalize_skill('variant')} AS norm, canonical, category AS canonical_type,
               CASE category WHEN 'tech_stack' THEN 1 WHEN 'technical_skill' THEN 2 ELSE 3 END AS rank, seq FROM variants
        UNION ALL SELECT {q.normalize_skill('k')}, v, kind, 0, 0 FROM (
            SELECT k, v, CASE WHEN lower(trim(v)) IN ({", ".join(map(q.lit, d.GENERIC_TERMS))}) THEN NULL
                WHEN {q.any_in('lower(trim(v))', d.SOFT_SKILL_INDICATORS)} THEN 'soft_skill'
                ELSE (SELECT arg_min(category, r) FROM idx WHERE norm = {q.normalize_skill('v')}) END AS kind FROM fixes)
        WHERE kind IS NOT NULL) GROUP BY norm"""
STEPS = dict(variants=VARIANTS, idx=_INDEX, fixes=_FIXES, lookup=_LOOKUP)


@query("canonical_lookup", with_roles("SELECT * FROM lookup", **STEPS))
def canonical_lookup(t):
    return rs.canonical_lookup(variants(t))


@query("detect_types", with_roles(f"""
    SELECT id, name, CASE WHEN lower(trim(name)) IN ({", ".join(map(q.lit, d.GENERIC_TERMS))}) THEN 'GENERIC'
        WHEN {q.any_in('lower(trim(name))', d.SOFT_SKILL_INDICATORS)} THEN 'soft_skill'
        ELSE (SELECT arg_min(category, r) FROM idx WHERE norm = s.norm) END AS detected_type
    FROM (SELECT *, {q.normalize_skill('name')} AS norm FROM skills) s""",
    "skills", variants=VARIANTS, idx=_INDEX))
def detect_types(t):
    return rs.with_detected_type(t.skills.select("id", "name"), variants(t), "name")


def raw_skills(t):
    """Spellings that need resolving: brands before names, dropped letters, size words."""
    parts = t.table("part")
    forms = F.array(
        F.col("p_name"), F.concat_ws(" ", "p_name", F.lower("p_brand")), F.replace("p_name", F.lit("i"), F.lit("")),
        F.concat(F.col("p_name"), F.lit("s")), F.lower("p_type"), F.lit("cloud"),
    )
    return parts.select(F.explode(forms).alias("skill"), F.lit("tech_stack").alias("skill_type")).distinct()


_ASKED = """SELECT DISTINCT unnest([p_name, p_name || ' ' || lower(p_brand), replace(p_name, 'i', ''), p_name || 's',
    lower(p_type), 'cloud']) AS skill, 'tech_stack' AS skill_type FROM part"""


@query("match_skills", with_roles("SELECT * FROM matched", "skills", **STEPS, asked=_ASKED,
                                  known="SELECT id, name, normalized_name FROM skills", **ms.CASCADE))
def match_skills(t):
    return rs.match_skills(raw_skills(t), t.skills, variants(t))


@query("fuzzy_words", rf"""
    WITH raw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{q.WORD}+')) AS text FROM conversations),
    known AS (SELECT text, min(item_id * 100000 + place) AS id
              FROM (SELECT item_id, unnest(w) AS text, generate_subscripts(w, 1) - 1 AS place
                    FROM (SELECT item_id, regexp_extract_all(lower(text), '{q.WORD}+') AS w FROM benchmark)) GROUP BY text),
    direct AS ({ms.direct('raw', 'known')}), pairs AS ({ms.pairs('raw', 'known')})
    SELECT text, known_text, 100.0::DOUBLE AS score FROM direct
    UNION ALL SELECT text, arg_max(known_text, (score, -id)), max(score) FROM pairs WHERE score >= 85 GROUP BY text""")
def fuzzy_words(t):
    """Best benchmark word for every word of the conversations."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(\w+)"), F.lit(1))
    raw = t.texts("conversations").select(F.explode(words).alias("text")).distinct()
    known = t.table("benchmark").select("item_id", F.posexplode(words).alias("at", "text")).groupBy("text").agg(
        F.min(F.col("item_id") * 100000 + F.col("at")).alias("id")  # where a word stands first
    )
    return fz.best_known(raw, known).select("text", "known_text", "score")


def _vocabulary(t):
    """Brands with two-word names as skills, names in the other order as the vocabulary."""
    names = t.table("part").select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("text")).distinct()
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    entries = t.table("part").select(
        F.concat_ws(" ", F.lower("p_type"), second, first).alias("text")
    ).distinct()
    return names, entries


_SORTED = "list_sort(list_filter(string_split(text, ' '), lambda w: w <> ''))"
_VOCABULARY = f"""
    names AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS text FROM part),
    entries AS (SELECT DISTINCT lower(p_type) || ' ' || split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) AS text
                FROM part),
    matches AS (
        SELECT text, arg_max(entry, (score, entry_rank)) AS entry, max(score) AS score
        FROM (SELECT text, entry, entry_rank, 200.0::DOUBLE * {ms.lcs('x', 'y')} / (len(x) + len(y)) AS score
              FROM (SELECT text, string_split(array_to_string({_SORTED}, ' '), '') AS x FROM names),
                   (SELECT text AS entry, string_split(array_to_string({_SORTED}, ' '), '') AS y,
                           -row_number() OVER (ORDER BY text) AS entry_rank FROM entries))
        WHERE score >= {d.VOCABULARY_THRESHOLD} GROUP BY text)"""


@query("vocabulary_matches", f"WITH {_VOCABULARY} SELECT * FROM matches")
def vocabulary_matches(t):
    names, entries = _vocabulary(t)
    return fz.best_vocabulary(names, entries, d.VOCABULARY_THRESHOLD)


@query("vocabulary_scores", f"""
    WITH {_VOCABULARY},
    counts AS (SELECT (SELECT count(*) FROM matches) AS tp,
        (SELECT count(*) FROM names WHERE text NOT IN (SELECT text FROM matches)) AS fp,
        (SELECT count(*) FROM entries WHERE text NOT IN (SELECT entry FROM matches)) AS fn)
    SELECT tp, fp, fn, tp / (tp + fp) AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
           2 * tp / (2 * tp + fp + fn) AS f1 FROM counts""")
def vocabulary_scores(t):
    names, entries = _vocabulary(t)
    return fz.evaluate_vocabulary(fz.best_vocabulary(names, entries, d.VOCABULARY_THRESHOLD), names, entries)


@query("evaluate_exact", """
    WITH n AS (SELECT DISTINCT p_name AS text FROM part WHERE p_size > 10),
         v AS (SELECT DISTINCT p_name AS text FROM part WHERE p_size < 12)
    SELECT tp, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall,
           2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) AS f1
    FROM (SELECT count(*) FILTER (text IN (SELECT text FROM v)) AS tp,
                 count(*) FILTER (text NOT IN (SELECT text FROM v)) AS fp,
                 (SELECT count(*) FROM v WHERE text NOT IN (SELECT text FROM n)) AS fn FROM n)""")
def evaluate_exact(t):
    names = t.table("part").filter(F.col("p_size") > 10).select(F.col("p_name").alias("text")).distinct()
    entries = t.table("part").filter(F.col("p_size") < 12).select(F.col("p_name").alias("text")).distinct()
    matches = names.join(entries, "text").select("text", F.col("text").alias("entry"))
    return fz.evaluate_vocabulary(matches, names, entries)


_KEYED = f"SELECT *, {q.normalize_skill('name')} AS key FROM skills"
_SURVIVORS = """SELECT skill_type, key, arg_min(id, (length(name), id)) AS id, arg_min(name, (length(name), id)) AS name,
    count(*) AS members FROM keyed GROUP BY ALL"""
_RENAMED = f"""SELECT s.*, coalesce((SELECT v FROM fixes WHERE k = lower(trim(s.name))),
        (SELECT canonical FROM idx WHERE norm = s.key AND category = s.skill_type),
        (SELECT arg_min(canonical, r) FROM idx WHERE norm = s.key), s.name) AS canonical FROM survivors s"""
_MERGE = dict(variants=VARIANTS, idx=_INDEX, fixes=_FIXES, keyed=_KEYED, survivors=_SURVIVORS, renamed=_RENAMED)


@query("merge_vocab_skills", with_roles(f"""
    SELECT id, canonical AS name, CASE WHEN canonical <> name THEN {q.normalize_skill('canonical')} ELSE key END AS normalized_name,
           skill_type FROM renamed""", "skills", **_MERGE))
def merge_vocab_skills(t):
    return rs.merge_vocabulary(t.skills, t.job_skills, variants(t))["skills"]


@query("merge_vocab_links", with_roles("""
    SELECT DISTINCT js.job_id, s.id AS skill_id FROM job_skills js JOIN keyed k ON k.id = js.skill_id
    JOIN survivors s ON s.skill_type = k.skill_type AND s.key = k.key""", "skills", "job_skills",
    keyed=_KEYED, survivors=_SURVIVORS))
def merge_vocab_links(t):
    return rs.merge_vocabulary(t.skills, t.job_skills, variants(t))["links"]


@query("merge_vocab_summary", with_roles("""
    SELECT skill_type, CAST(sum(members) AS BIGINT) AS original, count(*) FILTER (canonical <> name) AS renamed,
           CAST(sum(members - 1) AS BIGINT) AS merged, count(*) AS final FROM renamed GROUP BY skill_type""",
    "skills", **_MERGE))
def merge_vocab_summary(t):
    return rs.merge_vocabulary(t.skills, t.job_skills, variants(t))["summary"]


@query("duplicate_names", with_roles("""
    SELECT k.id, k.name, f.first_name, k.key FROM keyed k
    JOIN (SELECT key, min(id) AS first_id, arg_min(name, id) AS first_name FROM keyed GROUP BY key) f
      ON f.key = k.key WHERE k.id <> f.first_id""", "skills", keyed=_KEYED))
def duplicate_names(t):
    return rs.duplicate_names(t.skills)


def _replies(t):
    return turn_replies(t).select("job_id", "job_description", rp.parse_reply(F.col("reply")).alias("skills"))


REPLY_ITEMS = (r"""
    WITH w AS (SELECT conv_id, turn, conv_id * 1000 + turn AS job_id, text,
                      list_filter(string_split_regex(lower(text), '[\s,.]+'), lambda x: x <> '') AS words FROM conversations),
         items AS (SELECT job_id, conv_id, turn, x, min(at_) AS place FROM (
             SELECT job_id, conv_id, turn, unnest(words) AS x, generate_subscripts(words, 1) AS at_ FROM w) GROUP BY ALL),
         typed AS (SELECT *, length(x) > 6 AS tool, NOT length(x) > 6 AND """ + q.any_in(
    "replace(x, '-', ' ')", d.SOFT_SKILL_PHRASES) + r""" AS soft FROM items)
    SELECT i.job_id, CASE WHEN tool THEN 'tech_stack' WHEN soft THEN 'soft_skill' ELSE 'technical_skill' END AS skill_type,
        x AS skill, place
    FROM typed i LEFT JOIN w b ON b.conv_id = i.conv_id AND b.turn = i.turn - 1
    WHERE length(x) >= 2 AND (soft OR regexp_matches(' ' || replace(lower(coalesce(b.text, '')), '-', ' ') || ' ',
          '[^a-z0-9]' || regexp_replace(trim(replace(x, '-', ' ')), '([^\p{L}\p{Nd} ])', '\\\1', 'g') || '[^a-z0-9]'))
    QUALIFY row_number() OVER (PARTITION BY i.job_id, 2, """ + q.normalize_skill("x") + r""" ORDER BY place) = 1""")


@query("reply_items", f"SELECT job_id, skill_type, skill FROM ({REPLY_ITEMS})")
def reply_items(t):
    return rs.reply_items(_replies(t)).select("job_id", "skill_type", "skill")


def _resolved(t):
    """Resolution of every reply against the benchmark's words: (known skills, results)."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(\w+)"), F.lit(1))
    known = t.table("benchmark").select("item_id", F.posexplode(words).alias("at", "name")).groupBy("name").agg(
        F.min(F.col("item_id") * 100000 + F.col("at")).alias("id")
    )
    skills = known.select(
        "id", "name", normalize_skill(F.col("name")).alias("normalized_name"), F.lit("tech_stack").alias("skill_type")
    )
    return skills, rs.resolve_replies(_replies(t), skills, variants(t))


# the name that a spelling would be stored by, in the order of the jobs, categories and lists
RESOLVED = f"""SELECT *, {q.normalize_skill('own')} AS key FROM (SELECT *, coalesce(
            (SELECT v FROM fixes WHERE k = lower(trim(m.skill))),
            (SELECT canonical FROM idx WHERE idx.norm = m.norm AND category = m.skill_type),
            (SELECT arg_min(canonical, r) FROM idx WHERE idx.norm = m.norm), m.norm) AS own,
            (SELECT a.ord FROM asked a WHERE a.skill = m.skill AND a.skill_type = m.skill_type) AS ord FROM matched m)"""
ASKED = f"""SELECT skill, skill_type, min({{'j': job_id, 'c': list_position({list(rs.CATEGORIES)}, skill_type), 'p': place}}) AS ord
        FROM asked_items GROUP BY skill, skill_type"""
_REPLY_STEPS = dict(
    **STEPS,
    known=rf"""SELECT name, min(item_id * 100000 + place) AS id, {q.normalize_skill('name')} AS normalized_name
        FROM (SELECT item_id, unnest(w) AS name, generate_subscripts(w, 1) - 1 AS place
              FROM (SELECT item_id, regexp_extract_all(lower(text), '{q.WORD}+') AS w FROM benchmark)) GROUP BY name""",
    items=REPLY_ITEMS,
    asked_items=f"""SELECT job_id, skill_type, place, coalesce((SELECT v FROM fixes WHERE k = lower(trim(i.skill))),
            (SELECT canonical FROM idx WHERE norm = i.norm AND category = i.skill_type),
            (SELECT arg_min(canonical, r) FROM idx WHERE norm = i.norm), i.skill) AS skill
        FROM (SELECT *, {q.normalize_skill('skill')} AS norm FROM items) i""",
    asked=ASKED,
    **ms.CASCADE,
    keyed=RESOLVED, **ms.LEADERS,
    same="SELECT normalized_name AS key, arg_min(name, id) AS name FROM known GROUP BY normalized_name",
)


@query("resolve_links", with_roles("""
    SELECT DISTINCT i.job_id, coalesce(k.matched_skill, s.name, a.name) AS name,
           CASE WHEN k.matched_skill IS NOT NULL THEN 'tech_stack' ELSE a.skill_type END AS skill_type
    FROM asked_items i JOIN keyed k ON k.skill = i.skill AND k.skill_type = i.skill_type
    LEFT JOIN added a ON k.action = 'insert_new' AND k.final_type IS NOT NULL AND a.key = k.key
    LEFT JOIN same s ON a.skill_type = 'tech_stack' AND s.key = a.leader
    WHERE coalesce(k.matched_skill, s.name, a.name) IS NOT NULL""", **_REPLY_STEPS))
def resolve_links(t):
    """The skills each job is linked to, by name, after resolving every reply against the known words."""
    known, found = _resolved(t)
    stored = known.select("id", "name", "skill_type").union(found["new_skills"].select("id", "name", "skill_type"))
    return found["links"].join(stored, F.col("skill_id") == F.col("id")).select("job_id", "name", "skill_type").distinct()


@query("resolve_lists", f"""
    WITH items AS ({REPLY_ITEMS}), fixes AS ({_FIXES}),
    named AS (SELECT job_id, skill_type, coalesce((SELECT v FROM fixes WHERE k = i.skill), skill) AS name FROM items i)
    SELECT job_id, """ + ", ".join(
    f"string_agg(DISTINCT name, ', ' ORDER BY name) FILTER (skill_type = '{c}') AS {c}" for c in rs.CATEGORIES
) + " FROM named GROUP BY job_id")
def resolve_lists(t):
    return _resolved(t)[1]["lists"]


# every nation asks for one of five titles, some for a kind of skill and a company size
_TITLES = [("Data Engineer", "data engineer"), ("Senior Machine Learning Engineer - Contract", "machine learning engineer"),
           ("high", "high"), ("Backend wizard", "backend wizard"), ("nothing at all", "nothing at all")]
_SIZES = ["", "51-200", "1-10"]
_KINDS = ["all", "tech_stack", "soft_skill", ""]


def targets(t):
    def one_of(values, number):
        return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))

    key = F.col("n_nationkey")
    return t.table("nation").select(
        key.alias("target_id"), one_of([title for title, _ in _TITLES], key).alias("title"),
        one_of(_SIZES, F.floor(key / 5)).alias("employee_size"), one_of(_KINDS, F.col("n_regionkey")).alias("skill_type"),
    )


def _list(values):
    return "[" + ", ".join(map(q.lit, values)) + "]"


_MATCH = dict(
    asked=f"""SELECT n_nationkey AS target_id, lower({_list([a for a, _ in _TITLES])}[n_nationkey % 5 + 1]) AS asked,
            {_list([c for _, c in _TITLES])}[n_nationkey % 5 + 1] AS clean,
            {_list(_SIZES)}[n_nationkey // 5 % 3 + 1] AS size, {_list(_KINDS)}[n_regionkey % 4 + 1] AS kind FROM nation""",
    staged="""SELECT a.target_id, p.id AS job_id, CASE
            WHEN contains(lower(p.job_title), asked) OR contains(lower(p.job_title), clean) THEN 1
            WHEN p.keyword_id = (SELECT min(id) FROM keywords WHERE contains(lower(keyword), asked)) THEN 2
            WHEN len(list_filter(string_split(clean, ' '), lambda w: length(w) > 2 AND contains(lower(p.job_title), w))) > 0
            THEN 3 END AS stage
        FROM asked a JOIN jobs p ON a.size = '' OR a.size = p.employee_size""",
    picked="SELECT * FROM (SELECT *, min(stage) OVER (PARTITION BY target_id) AS m FROM staged) WHERE stage = m",
    demand="""SELECT target_id, coalesce(nullif(normalized_name, ''), '?') AS norm, max(n) AS demand,
            arg_min(name, (length(name), name)) AS name,
            (SELECT count(*) FROM picked x WHERE x.target_id = y.target_id) AS total_jobs
        FROM (SELECT p.target_id, s.id, s.name, s.normalized_name, s.skill_type, count(*) AS n,
                     row_number() OVER (PARTITION BY p.target_id, s.skill_type ORDER BY count(*) DESC, s.name, s.id) AS r
              FROM picked p JOIN job_skills js ON js.job_id = p.job_id JOIN skills s ON s.id = js.skill_id
              JOIN asked a ON a.target_id = p.target_id AND (a.kind IN ('all', '') OR a.kind = s.skill_type)
              GROUP BY p.target_id, s.id, s.name, s.normalized_name, s.skill_type) y
        WHERE r <= 100 GROUP BY target_id, norm""",
    requests="SELECT c_custkey AS request_id, c_nationkey AS target_id FROM customer",
    have="""SELECT DISTINCT o.o_custkey AS request_id, lower(s.name) AS norm FROM orders o
            JOIN job_skills js ON js.job_id = o.o_orderkey JOIN skills s ON s.id = js.skill_id
            WHERE s.skill_type = 'tech_stack'""",
)


def _demand(t):
    return mt.demand(targets(t), t.jobs, t.keywords, t.job_skills, t.skills)


def _requests(t):
    """Every customer asks for one of the targets; their orders' parts are their skills."""
    requests = t.table("customer").select(
        F.col("c_custkey").alias("request_id"), F.col("c_nationkey").alias("target_id")
    )
    tools = t.skills.filter(F.col("skill_type") == "tech_stack").select(F.col("id").alias("skill_id"), "name")
    owned = t.postings.select(F.col("id").alias("job_id"), F.col("company_id").alias("request_id"))
    have = t.job_skills.join(tools, "skill_id").join(owned, "job_id").select("request_id", F.lower("name").alias("norm")).distinct()
    return requests, have


_MODEL = ("postings", "jobs", "keywords", "skills", "job_skills")


@query("match_demand", with_roles("SELECT * FROM demand", *_MODEL, **_MATCH))
def match_demand(t):
    return _demand(t)


@query("match_score", with_roles("""
    SELECT r.request_id, r.target_id,
           CASE WHEN w.weight > 0 THEN round(100.0::DOUBLE * coalesce(h.hit, 0) / w.weight) ELSE 0.0::DOUBLE END AS match_score,
           coalesce(h.matched, 0) AS matched, coalesce(w.skills, 0) - coalesce(h.matched, 0) AS missing,
           coalesce(w.total_jobs, 0) AS total_jobs
    FROM requests r LEFT JOIN (SELECT target_id, sum(demand) AS weight, count(*) AS skills, max(total_jobs) AS total_jobs
                               FROM demand GROUP BY target_id) w ON w.target_id = r.target_id
    LEFT JOIN (SELECT request_id, target_id, sum(demand) AS hit, count(*) AS matched
               FROM requests JOIN have USING (request_id) JOIN demand USING (target_id, norm) GROUP BY ALL) h
      ON h.request_id = r.request_id""", *_MODEL, **_MATCH))
def match_score(t):
    requests, have = _requests(t)
    return mt.match_scores(requests, _demand(t), have)


@query("match_details", with_roles("""
    SELECT r.request_id, r.target_id, d.norm, d.name, d.demand,
           round(100.0::DOUBLE * d.demand / d.total_jobs, 1) AS demand_pct,
           round(100.0::DOUBLE * d.demand / sum(d.demand) OVER (PARTITION BY r.request_id), 1) AS contribution,
           h.norm IS NOT NULL AS matched
    FROM requests r JOIN demand d USING (target_id) LEFT JOIN have h ON h.request_id = r.request_id AND h.norm = d.norm""",
    *_MODEL, **_MATCH))
def match_details(t):
    requests, have = _requests(t)
    return mt.match_details(requests, _demand(t), have)


@query("user_norms", f"""
    WITH variants AS ({VARIANTS}), idx AS ({_INDEX}), fixes AS ({_FIXES}),
    asked AS (SELECT DISTINCT p_partkey AS request_id, unnest([p_name, ' ' || upper(p_name), lower(p_type), ' ']) AS skill FROM part)
    SELECT DISTINCT request_id, {q.normalize_skill('coalesce(hit, skill)')} AS norm
    FROM (SELECT request_id, trim(skill) AS skill, coalesce((SELECT v FROM fixes WHERE k = lower(trim(a.skill))),
              (SELECT arg_min(canonical, r) FROM idx WHERE norm = {q.normalize_skill('trim(a.skill)')})) AS hit
          FROM asked a WHERE trim(skill) <> '')""")
def user_norms(t):
    asked = t.table("part").select(F.col("p_partkey").alias("request_id"), F.explode(F.array(
        "p_name", F.concat(F.lit(" "), F.upper("p_name")), F.lower("p_type"), F.lit(" "))).alias("skill"))
    return mt.user_norms(asked, variants(t))
