"""Titles, skills, lists, replies and locations."""

from pyspark.sql import functions as F

from skillweft import dictionaries as d
from skillweft.functions import replies as rp
from skillweft.functions import skills as sk
from skillweft.functions import sizes as sz
from skillweft.functions import text as tx
from skillweft.functions import titles as ti
from skillweft.operators import containment as ct
from skillweft.operators import places as pl
from skillweft.operators import rewrite as rw
from skillweft.operators import skilltext as st
from skillweft.operators.facets import Facets
from skillweft.operators.ordering import top_n
from skillweft.operators.titles import match_keyword, normalize_titles
from skillweft.plans import sqltext as q
from skillweft.plans.registry import query
from skillweft.roles import with_roles

LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents"


def lines(t):
    """Every line of every document."""
    return t.texts("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))


def keyword_table(t):
    return t.spark.createDataFrame(list(enumerate(d.JOB_KEYWORDS, 1)), "id INT, keyword STRING")


KEYWORDS = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {q.lit(k)})" for i, k in enumerate(d.JOB_KEYWORDS, 1)) + ") AS k(id, keyword)"


@query("normalize_lines", f"""
    SELECT doc_id, {q.normalize_skill('line')} AS key, count(*) AS cnt FROM ({LINES}) GROUP BY ALL""")
def normalize_lines(t):
    keyed = lines(t).select("doc_id", sk.normalize_skill(F.col("line")).alias("key"))
    return keyed.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("cnt"))


@query("normalize_skills", with_roles(
    f"SELECT id, name, {q.normalize_skill('name')} AS key FROM skills", "skills"))
def normalize_skills(t):
    return t.skills.select("id", "name", sk.normalize_skill(F.col("name")).alias("key"))


@query("light_keys", """
    SELECT doc_id, trim(regexp_replace(replace(lower(line), '-', ' '), '\\s+', ' ', 'g')) AS key,
           count(*) AS cnt FROM (""" + LINES + ") GROUP BY ALL")
def light_keys(t):
    keyed = lines(t).select("doc_id", sk.light_key(F.col("line")).alias("key"))
    return keyed.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("cnt"))


@query("classify_words", f"""
    SELECT word, CASE WHEN word IN ({", ".join(map(q.lit, d.GENERIC_TERMS))}) THEN 'GENERIC'
                      WHEN {q.any_in('word', d.SOFT_SKILL_INDICATORS)} THEN 'Soft Skill'
                      ELSE 'unknown' END AS label, count(*) AS cnt
    FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY ALL""")
def classify_words(t):
    words = t.texts("documents").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("word")
    )
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))
    return counted.select("word", sk.classify(F.col("word")).alias("label"), "cnt")


@query("synonym_words", """
    SELECT word, """ + q.synonym("word") + """ AS synonym
    FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations)""")
def synonym_words(t):
    words = t.texts("conversations").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("word")
    ).distinct()
    return words.select("word", sk.synonym(F.col("word")).alias("synonym"))


@query("clean_titles", with_roles(
    f"SELECT job_title, {q.clean_title('job_title')} AS title_clean, count(*) AS cnt FROM postings GROUP BY ALL",
    "postings"))
def clean_titles(t):
    return t.postings.groupBy("job_title").agg(F.count(F.lit(1)).alias("cnt")).select(
        "job_title", ti.clean_title(F.col("job_title")).alias("title_clean"), "cnt"
    )


_HAS = f"{q.any_in('lower(title_clean)', d.ROLE_TERMS)} AND NOT {q.any_in('lower(title_clean)', d.ROLE_EXCLUSIONS)}"
_EXCLUDED = "(" + " OR ".join(f"contains(' ' || lower(title_clean), {q.lit(' ' + w)})" for w in d.TITLE_REJECTS) + ")"


@query("target_roles", with_roles(
    f"SELECT id, title_clean FROM (SELECT id, {q.clean_title('job_title')} AS title_clean FROM postings) WHERE {_HAS}",
    "postings"))
def target_roles(t):
    rows = t.postings.select("id", ti.clean_title(F.col("job_title")).alias("title_clean"))
    return rows.filter(ti.is_target_role(F.col("title_clean")))


_MATCH = """SELECT c.title_clean, arg_min(k.id, (-length(k.keyword), k.id)) AS keyword_id,
                   arg_min(k.keyword, (-length(k.keyword), k.id)) AS matched_keyword
            FROM (SELECT DISTINCT title_clean FROM cleaned) c JOIN kw k
              ON len(list_filter(string_split(lower(k.keyword), ' '),
                     lambda w: NOT contains(lower(c.title_clean), w))) = 0 GROUP BY c.title_clean"""


@query("normalize_titles", with_roles(f"""
    SELECT c.id, c.job_title, c.title_clean,
           CASE WHEN NOT excluded THEN m.keyword_id END AS keyword_id_matched,
           CASE WHEN NOT excluded THEN m.matched_keyword END AS matched_keyword,
           CASE WHEN excluded THEN 'excluded' WHEN m.keyword_id IS NOT NULL THEN 'accepted'
                ELSE 'rejected' END AS title_status,
           CASE WHEN excluded THEN {q.lit(d.TITLE_REASON_EXCLUDED)}
                WHEN m.keyword_id IS NULL THEN {q.lit(d.TITLE_REASON_REJECTED)} END AS reason
    FROM (SELECT *, {_EXCLUDED} AS excluded FROM cleaned) c LEFT JOIN m USING (title_clean)""",
    "postings", kw=KEYWORDS,
    cleaned=f"SELECT id, job_title, {q.clean_title('job_title')} AS title_clean FROM postings", m=_MATCH))
def normalize_titles_query(t):
    return normalize_titles(t.postings.select("id", "job_title"), keyword_table(t))


@query("match_words_in_sentences", """
    SELECT l.line, arg_min(p.name, (-length(p.name), p.id, p.name)) AS matched_keyword,
           arg_min(p.id, (-length(p.name), p.id, p.name)) AS matched_id
    FROM (SELECT DISTINCT lower(line) AS line FROM (SELECT unnest(string_split(text, '. ')) AS line FROM conversations)) l
    LEFT JOIN (SELECT item_id AS id, w AS name FROM
               (SELECT item_id, unnest(string_split(lower(text), ' ')) AS w FROM benchmark) WHERE w <> '') p
      ON contains(l.line, p.name)
    GROUP BY l.line""")
def match_words_in_sentences(t):
    """Words of the benchmark texts as keywords, sentences as titles."""
    sentences = t.texts("conversations").select(
        F.explode(F.split("text", r"\. ")).alias("line")
    ).select(F.lower("line").alias("line")).distinct()
    words = t.table("benchmark").select(
        F.col("item_id").alias("id"), F.explode(F.split(F.lower("text"), " ")).alias("keyword")
    ).filter(F.col("keyword") != "").distinct()
    return match_keyword(sentences, words, "line").select("line", "matched_keyword", "matched_id")


@query("phrase_in_text", r"""
    SELECT conv_id, turn, arg_min(w.word, (-length(w.word), w.word)) AS phrase
    FROM (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(lower(text),
                 '[\p{L}\p{M}\p{Nd}\p{Pc}]+'))) AS word FROM conversations) c
    JOIN (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}\p{Pc}]+')) AS word
          FROM benchmark) w ON w.word = c.word
    GROUP BY ALL""")
def phrase_in_text(t):
    texts = t.texts("conversations").select("conv_id", "turn", F.lower("text").alias("text"))
    words = t.table("benchmark").select(F.explode(ct.words_of(F.lower("text"))).alias("phrase"))
    best = ct.longest_phrase(ct.whole_word_phrases(texts, words))
    return texts.join(best, "text").select("conv_id", "turn", "phrase")


@query("phrase_in_url", """
    SELECT p.url, w.word AS phrase FROM (SELECT DISTINCT url FROM pages) p
    JOIN (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark) w
      ON contains(p.url, w.word)""")
def phrase_in_url(t):
    texts = t.table("pages").select(F.col("url").alias("text"))
    words = t.table("benchmark").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("phrase")
    )
    return ct.contained_phrases(texts, words).select(F.col("text").alias("url"), "phrase")


def gazetteer(t):
    return t.table("nation").join(t.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.upper("n_name").alias("name"), F.upper("r_name").alias("province")
    )


_NOISE = "|".join(d.LOCATION_NOISE)
PLACE_STEPS = dict(
    gaz="SELECT upper(n_name) AS name, upper(r_name) AS province FROM nation JOIN region ON r_regionkey = n_regionkey",
    listed=rf"""SELECT raw, list_filter(list_transform(string_split_regex(c, '[,/]'), lambda x: trim(x)), lambda x: x <> '') AS parts
        FROM (SELECT raw, trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(raw,
              '\s*\(\d+\)\s*', ' ', 'g'), '(?i)\b({_NOISE})\b', '', 'g'), '\s+', ' ', 'g')),
              '^[,\s]+|[,\s]+$', '', 'g')) AS c
              FROM (SELECT DISTINCT location AS raw FROM jobs WHERE location <> ''))""",
    part=rf"""SELECT raw, pos, part, trim(regexp_replace(upper(part), '{d.PLACE_PREFIX_PATTERN}', '')) AS text
        FROM (SELECT raw, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM listed)
        WHERE upper(part) <> 'INDONESIA'""",
    resolved=r"""SELECT text, coalesce(
            (SELECT arg_min(name, (-length(name), name)) FROM gaz WHERE regexp_matches(t.text, '\b' || name || '\b')),
            (SELECT arg_min(province, (-length(province), province)) FROM gaz
             WHERE regexp_matches(t.text, '\b' || province || '\b'))) AS place
        FROM (SELECT DISTINCT text FROM part) t""",
    located=f"""SELECT l.raw, CASE WHEN f.place IS NOT NULL THEN {q.title_case('f.place')}
              WHEN len(parts) = 0 THEN 'other'
              WHEN len(list_filter(parts, lambda p: upper(p) = 'INDONESIA')) > 0 THEN 'Indonesia'
              ELSE {q.title_case('parts[1]')} END AS place
        FROM listed l LEFT JOIN (SELECT raw, arg_min(place, pos) AS place FROM part JOIN resolved USING (text)
                                 WHERE place IS NOT NULL GROUP BY raw) f USING (raw)""",
)
PLACED = "SELECT j.id, j.location, coalesce(x.place, 'other') AS place FROM jobs j LEFT JOIN located x ON x.raw = j.location"


@query("normalize_locations", with_roles(PLACED, "jobs", **PLACE_STEPS))
def normalize_locations(t):
    return pl.normalize_locations(t.jobs.select("id", "location"), gazetteer(t))


@query("location_types", with_roles("""
    SELECT place, CASE WHEN place = 'other' THEN 'other' WHEN place = 'Indonesia' THEN 'indonesia'
             WHEN upper(place) IN (SELECT province FROM gaz) THEN 'province'
             WHEN upper(place) IN (SELECT name FROM gaz) THEN 'city' ELSE 'other' END AS location_type,
           CASE WHEN place IN ('other', 'Indonesia') THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS confidence,
           (SELECT min(province) FROM gaz WHERE name = upper(place)) AS province, count(*) AS cnt
    FROM placed GROUP BY ALL""", "jobs", **PLACE_STEPS, placed=PLACED))
def location_types(t):
    placed = pl.normalize_locations(t.jobs.select("id", "location"), gazetteer(t))
    counts = placed.groupBy("place").agg(F.count(F.lit(1)).alias("cnt"))
    return pl.with_place_type(counts, gazetteer(t))


@query("location_top20", with_roles("""
    SELECT place, count(*) AS cnt FROM placed GROUP BY place ORDER BY cnt DESC, place LIMIT 20""",
    "jobs", **PLACE_STEPS, placed=PLACED))
def location_top20(t):
    placed = pl.normalize_locations(t.jobs.select("id", "location"), gazetteer(t))
    counts = placed.groupBy("place").agg(F.count(F.lit(1)).alias("cnt"))
    return top_n(counts, [F.desc("cnt"), F.asc("place")], 20)


_CHANGES = """SELECT a.id, a.location AS old_place, j.location AS raw_location, j.place AS new_place
    FROM job_analysis a JOIN placed j ON j.id = a.job_id
    WHERE j.location <> '' AND lower(trim(j.place)) <> lower(trim(coalesce(a.location, '')))"""


@query("location_repair_histogram", with_roles("""
    SELECT raw_location, coalesce(old_place, 'NULL') AS old_place, new_place, count(*) AS cnt
    FROM changes GROUP BY ALL""", "jobs", "job_analysis", **PLACE_STEPS, placed=PLACED, changes=_CHANGES))
def location_repair_histogram(t):
    return pl.change_histogram(pl.changed_places(t.job_analysis, t.jobs, gazetteer(t)))


@query("location_repair_apply", with_roles("""
    SELECT a.id, coalesce(c.new_place, a.location) AS location
    FROM job_analysis a LEFT JOIN changes c ON c.id = a.id""",
    "jobs", "job_analysis", **PLACE_STEPS, placed=PLACED, changes=_CHANGES))
def location_repair_apply(t):
    changes = pl.changed_places(t.job_analysis, t.jobs, gazetteer(t))
    fresh = changes.select("id", F.col("new_place").alias("location"))
    return rw.update_by_key(t.job_analysis.select("id", "location"), fresh, "id", "location")


@query("short_places", with_roles(f"""
    SELECT raw, CASE WHEN {q.any_in('lower(raw)', d.SHORT_REMOTE)} THEN 'Remote'
             ELSE coalesce(CASE WHEN trim(split_part(lower(raw), ',', 1)) IN ({", ".join(map(q.lit, d.SHORT_CITIES))})
                  THEN {q.pick("trim(split_part(lower(raw), ',', 1))", d.SHORT_PLACES, 'equal')} END,
                  {q.pick('lower(raw)', d.SHORT_PLACES)}, 'Other') END AS place
    FROM (SELECT DISTINCT location AS raw FROM jobs WHERE location <> '')""", "jobs"))
def short_places(t):
    raw = t.jobs.filter(F.col("location") != "").select(F.col("location").alias("raw")).distinct()
    return raw.select("raw", pl.short_place(F.col("raw")).alias("place"))


@query("strip_counts", with_roles(r"""
    SELECT DISTINCT location, regexp_replace(location, '\s*\(\d+\)\s*$', '') AS place FROM jobs""", "jobs"))
def strip_counts(t):
    return t.jobs.select("location", tx.strip_count(F.col("location")).alias("place")).distinct()


_SCALAR = """SELECT id, CASE WHEN starts_with(technical_skill, '[')
        THEN CAST(translate(technical_skill, '''', '"') AS JSON)::VARCHAR[] ELSE [technical_skill] END AS items
    FROM job_analysis WHERE location = 'NATION_4'"""


@query("tokens_json_or_scalar", with_roles("""
    SELECT row_number() OVER (ORDER BY cnt DESC, token) AS rank, token, cnt, total_jobs,
           CASE WHEN total_jobs > 0 THEN round(100.0::DOUBLE * cnt / total_jobs, 1) ELSE 0.0::DOUBLE END AS percentage
    FROM (SELECT trim(x) AS token, count(*) AS cnt, (SELECT count(*) FROM parsed) AS total_jobs
          FROM (SELECT unnest(items) AS x FROM parsed) WHERE trim(x) <> ''
          GROUP BY 1 ORDER BY cnt DESC, token LIMIT 20)""", "job_analysis", parsed=_SCALAR))
def tokens_json_or_scalar(t):
    return st.top_tokens(t.job_analysis, "technical_skill", Facets.of(location="NATION_4"), 20)


def _delimited(column: str) -> str:
    return f"""SELECT '{column}' AS skill_type, unnest(CASE WHEN starts_with({column}, '[')
        THEN CAST(translate({column}, '''', '"') AS JSON)::VARCHAR[]
        ELSE list_transform(string_split({column}, ','), lambda x: trim(x)) END) AS token
        FROM job_analysis WHERE {column} <> '' AND year(posted_date) = 1998"""


_TOKENS = " UNION ALL ".join(map(_delimited, ["tech_stack", "technical_skill", "soft_skill"]))


@query("tokens_delimited", with_roles("""
    SELECT skill_type, total, round(100.0::DOUBLE * total / sum(total) OVER (PARTITION BY rank), 1) AS percentage,
           rank, name, cnt
    FROM (SELECT * FROM counted c JOIN (SELECT skill_type, CAST(sum(cnt) AS BIGINT) AS total FROM counted
          GROUP BY skill_type) USING (skill_type)) WHERE rank <= 3""", "job_analysis",
    counted=f"""SELECT skill_type, token AS name, count(*) AS cnt,
                row_number() OVER (PARTITION BY skill_type ORDER BY count(*) DESC, token) AS rank
                FROM ({_TOKENS}) WHERE length(token) > 1 GROUP BY skill_type, token"""))
def tokens_delimited(t):
    return st.token_distribution(t.job_analysis, t.skill_types, Facets.of(year=1998), 3)


@query("tokens_delimited_one_type", with_roles("""
    SELECT rank, name, cnt, round(100.0::DOUBLE * cnt / total, 1) AS percentage
    FROM (SELECT name, cnt, row_number() OVER (ORDER BY cnt DESC, name) AS rank, sum(cnt) OVER () AS total
          FROM (SELECT token AS name, count(*) AS cnt FROM tokens
                WHERE skill_type = 'soft_skill' AND length(token) > 1 GROUP BY token)) WHERE rank <= 10""",
    "job_analysis", tokens=_TOKENS))
def tokens_delimited_one_type(t):
    return st.token_ranking(t.job_analysis, "soft_skill", Facets.of(year=1998), 10)


@query("keep_first_words", """
    SELECT conv_id, turn, list_filter(w, lambda x, i: x <> '' AND list_position(k, trim(replace(lower(x), '-', ' '))) = i)
           AS words
    FROM (SELECT conv_id, turn, string_split(text, ' ') AS w,
                 list_transform(string_split(text, ' '), lambda x: trim(replace(lower(x), '-', ' '))) AS k
          FROM (SELECT conv_id, turn, replace(text, chr(10), ' ') AS text FROM conversations))""")
def keep_first_words(t):
    rows = t.texts("conversations").select(
        "conv_id", "turn", F.split(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), " ").alias("w")
    )
    return rows.select("conv_id", "turn", sk.dedup_keep_first(F.col("w")).alias("words"))


def turn_replies(t):
    """Words of a turn as a fenced JSON reply, the text of the turn before as the source text."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[\s,.]+"), lambda w: w != ""))
    body = F.to_json(F.struct(
        F.filter(words, lambda w: F.length(w) > 6).alias("tech_stack"),
        F.filter(words, lambda w: F.length(w) <= 6).alias("technical_skill"),
    ))
    rows = t.texts("conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("job_id"), "conv_id", "turn", "text",
        F.concat(F.lit("```json\nresult: "), body, F.lit("\n```")).alias("reply"),
    )
    before = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("job_description"))
    return rows.join(before, ["conv_id", "turn"], "left").drop("text")


_WORDS = r"""SELECT conv_id * 1000 + turn AS job_id, conv_id, turn, text,
    list_filter(string_split_regex(lower(text), '[\s,.]+'), lambda w: w <> '') AS words FROM conversations"""


@query("reply_parsed", with_roles("""
    SELECT job_id, len(list_filter(list_distinct(words), lambda w: length(w) > 6)) AS tools,
           len(list_filter(list_distinct(words), lambda w: length(w) <= 6)) AS technical, 0 AS soft
    FROM w""", w=_WORDS))
def reply_parsed(t):
    parsed = turn_replies(t).select("job_id", rp.parse_reply(F.col("reply")).alias("s"))
    return parsed.select(
        "job_id", F.size("s.tech_stack").cast("bigint").alias("tools"),
        F.size("s.technical_skill").cast("bigint").alias("technical"), F.size("s.soft_skill").alias("soft"),
    )


@query("grounded_items", with_roles(r"""
    SELECT w.job_id, CASE WHEN length(x) > 6 THEN 'tech_stack' ELSE 'technical_skill' END AS skill_type, x AS skill
    FROM (SELECT job_id, conv_id, turn, unnest(list_distinct(words)) AS x FROM w) w
    JOIN w b ON b.conv_id = w.conv_id AND b.turn = w.turn - 1
    WHERE regexp_matches(' ' || replace(lower(b.text), '-', ' ') || ' ',
          '[^a-z0-9]' || regexp_replace(trim(replace(x, '-', ' ')), '([^\p{L}\p{Nd} ])', '\\\1', 'g') || '[^a-z0-9]')""",
    w=_WORDS))
def grounded_items(t):
    replies = turn_replies(t).filter(F.col("job_description").isNotNull())
    parsed = replies.select("job_id", "job_description", rp.parse_reply(F.col("reply")).alias("s"))
    kept = parsed.select("job_id", sk.keep_grounded(F.col("s"), F.col("job_description")).alias("s"))
    lists = F.explode(F.array(*[
        F.struct(F.lit(c).alias("skill_type"), F.col("s")[c].alias("items"))
        for c in ("tech_stack", "technical_skill", "soft_skill")
    ]))
    return kept.select("job_id", lists.alias("l")).select("job_id", "l.skill_type", F.explode("l.items").alias("skill"))


@query("batch_replies", """
    SELECT event_id AS job_id, event_id // 10 AS batch_id,
           CASE event_id % 3 WHEN 0 THEN [event_type] ELSE [] END AS tech_stack,
           CASE event_id % 3 WHEN 1 THEN [props] ELSE [] END AS soft_skill FROM events""")
def batch_replies(t):
    events = t.table("events").select(
        F.col("event_id").alias("job_id"), F.floor(F.col("event_id") / 10).alias("batch_id"), "event_type", "props"
    )
    body = F.when(F.col("job_id") % 3 == 0, F.to_json(F.struct(F.array("event_type").alias("tech_stack")))) \
        .when(F.col("job_id") % 3 == 1, F.to_json(F.struct(F.array("props").alias("soft_skill"))))
    # a reply covers at most ten jobs
    replies = events.groupBy("batch_id").agg(F.collect_list(F.when(
        body.isNotNull(), F.concat(F.lit('"'), "job_id", F.lit('": '), body))).alias("entries")).select(
        "batch_id", F.concat(F.lit("Answer: {"), F.array_join("entries", ", "), F.lit("} end")).alias("reply"))
    out = rp.parse_batch_reply(events.select("job_id", "batch_id"), replies)
    return out.select("job_id", "batch_id", "skills.tech_stack", "skills.soft_skill")


@query("valid_keywords", """
    SELECT doc_id, trim(line) AS keyword, length(trim(line)) BETWEEN 1 AND 100 AS accepted
    FROM (""" + LINES + ")")
def valid_keywords(t):
    return rw.valid_keywords(lines(t).withColumnRenamed("line", "keyword"))


@query("durations", """
    SELECT event_id, CASE WHEN s < 60 THEN CAST(floor(s) AS INT) || 's'
        WHEN s < 3600 THEN CAST(floor(s / 60) AS INT) || 'm ' || CAST(floor(s) AS INT) % 60 || 's'
        ELSE CAST(floor(s / 3600) AS INT) || 'h ' || CAST(floor((CAST(floor(s) AS INT) % 3600) / 60) AS INT) || 'm' END AS label
    FROM (SELECT event_id, value * 60 AS s FROM events)""")
def durations(t):
    return t.table("events").select("event_id", tx.format_duration(F.col("value") * 60).alias("label"))


@query("local_times", """
    SELECT event_id, strftime(ts + INTERVAL 7 HOUR, '%Y-%m-%dT%H:%M:%S') AS local_time FROM events""")
def local_times(t):
    at = tx.fixed_offset_time(F.col("ts").cast("timestamp"))
    return t.table("events").select("event_id", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("local_time"))


@query("iso_dates", """
    SELECT event_id, CASE WHEN event_id % 5 = 0 THEN DATE '2000-01-01' ELSE CAST(ts AS DATE) END AS posted_date
    FROM events""")
def iso_dates(t):
    written = F.when(F.col("event_id") % 5 == 0, F.lit("yesterday")).when(
        F.col("event_id") % 5 == 1, F.date_format("ts", "yyyy-MM-dd")
    ).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    return t.table("events").select(
        "event_id", tx.iso_date_or(written, F.lit("2000-01-01").cast("date")).alias("posted_date")
    )


_LABELS = "CASE WHEN n < 0 THEN NULL " + " ".join(
    f"WHEN n <= {hi} THEN '{label}'" if hi else f"ELSE '{label}'" for _, hi, label in d.SIZE_RANGES) + " END"


@query("size_bucket", f"""
    SELECT c_custkey, {_LABELS} AS label FROM (SELECT c_custkey, CAST(floor(2 * c_acctbal) AS BIGINT) AS n FROM customer)""")
def size_bucket(t):
    return t.table("customer").select("c_custkey", sz.size_label(F.floor(2 * F.col("c_acctbal"))).alias("label"))


_COMMA = "CASE WHEN n <= 0 THEN NULL " + " ".join(
    f"WHEN n <= {hi} THEN '{c}'" if hi else f"ELSE '{c}'"
    for (_, hi, _), c in zip(d.SIZE_RANGES, d.SIZE_LABELS_COMMA, strict=True)) + " END"


@query("size_from_text", f"""
    SELECT c_custkey, {_COMMA} AS label FROM (SELECT c_custkey,
        CASE WHEN c_acctbal < 0 THEN CAST(floor(-c_acctbal) AS BIGINT) ELSE CAST(floor(c_acctbal) AS BIGINT) END AS n FROM customer)""")
def size_from_text(t):
    n = F.floor(F.abs("c_acctbal"))
    wording = F.when(F.col("c_custkey") % 3 == 0, F.format_string("Acme has %d employees today", n)).when(
        F.col("c_custkey") % 3 == 1, F.concat(F.lit("Company size: "), F.format_number(n, 0))
    ).otherwise(F.concat(F.lit("A team of "), F.regexp_replace(F.format_number(n, 0), ",", "."), F.lit(" total employees")))
    return t.table("customer").select("c_custkey", sz.size_from_text(wording).alias("label"))


@query("size_dimension_join", f"""
    SELECT c_custkey, label, ord FROM (SELECT c_custkey, {_LABELS} AS label,
        CASE {" ".join(f"WHEN n <= {hi} THEN {i}" if hi else f"ELSE {i}" for i, (_, hi, _) in enumerate(d.SIZE_RANGES, 1))} END AS ord
        FROM (SELECT c_custkey, CAST(floor(2 * abs(c_acctbal)) AS BIGINT) AS n FROM customer))""")
def size_dimension_join(t):
    rows = t.table("customer").select("c_custkey", sz.size_label(F.floor(2 * F.abs("c_acctbal"))).alias("label"))
    return rows.join(sz.size_dimension(t.spark).select("label", "ord"), "label").select("c_custkey", "label", "ord")
