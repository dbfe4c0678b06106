"""Streaming jobs run over the given tables until everything available is processed."""

from pyspark.sql import functions as F

from skillweft import dictionaries as d
from skillweft.plans import matchsql as ms
from skillweft.plans import sqltext as q
from skillweft.plans.registry import query
from skillweft.plans.resolution import ASKED, RESOLVED, STEPS
from skillweft.plans.texts import KEYWORDS
from skillweft.plans.writes import CARDS, run_events
from skillweft.roles import with_roles
from skillweft.session import fresh_folder
from skillweft.streaming import cache, feeds, skill_counts, workqueue

ROUNDS, PARTS = 4, 4


def _folders(t, label):
    base = fresh_folder(t.spark, label)
    return f"{base}/table", f"{base}/checkpoint"


def event_feed(t):
    return feeds.read_feed(t.spark, t.folder, "events.parquet")


@query("stream_ingest_feed", """
    SELECT user_id || '-' || event_type AS link, arg_min(event_id, (ts, event_id)) AS event_id
    FROM events WHERE user_id || '-' || event_type NOT IN (SELECT c_custkey || '-view' FROM customer WHERE c_mktsegment = 'BUILDING')
    GROUP BY 1""")
def stream_ingest_feed(t):
    """A re-polled feed: the first row of every link that is not known."""
    path, checkpoint = _folders(t, "ingest-feed")
    rows = event_feed(t).select(F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("link"), "ts", "event_id")
    known = t.table("customer").filter(F.col("c_mktsegment") == "BUILDING").select(
        F.concat(F.col("c_custkey").cast("string"), F.lit("-view")).alias("link")
    )
    feeds.ingest_feed(feeds.unseen(rows, known, "link"), path, checkpoint, "link", F.struct("ts", "event_id"))
    return t.spark.read.parquet(path).select("link", "event_id")


@query("stream_resume", """
    SELECT link, arg_min(event_id, (part, ts, event_id)) AS event_id
    FROM (SELECT user_id || '-' || event_type AS link, ts, event_id, event_id % 2 AS part FROM events) GROUP BY link""")
def stream_resume(t):
    """A feed that arrives in two parts; the job ends after the first and goes on at the second."""
    path, checkpoint = _folders(t, "resume")
    feed = f"{path}-feed"
    rows = t.table("events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("link"), "ts", "event_id"
    )
    for part in (0, 1):
        rows.filter(F.col("event_id") % 2 == part).write.mode("append").parquet(feed)
        arrived = feeds.read_feed(t.spark, feed)
        feeds.ingest_feed(arrived, path, checkpoint, "link", F.struct("ts", "event_id"))
    return t.spark.read.parquet(path).select("link", "event_id")


@query("stream_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(t):
    path, checkpoint = _folders(t, "first-seen")
    rows = event_feed(t).withColumn("ts", F.col("ts").cast("timestamp"))
    firsts = feeds.first_seen(rows, ["user_id", "event_type"], "ts", "60 days")
    feeds.run_available(firsts, checkpoint, feeds.batch_writer(path))
    return t.spark.read.parquet(path).select("user_id", "event_type")


@query("stream_queue", f"""
    SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'pending' ELSE 'completed' END AS status,
           CAST(CASE WHEN event_type = 'error' THEN {ROUNDS} WHEN event_id % 50 = 7 THEN greatest(2, event_id % 3 + 1)
                ELSE event_id % 3 + 1 END AS INT) AS attempts
    FROM events""")
def stream_queue(t):
    """Events as queued jobs over several rounds: errors never succeed, others fail up to twice, some claims die."""
    path, checkpoint = _folders(t, "queue")
    jobs = event_feed(t).select(F.col("event_id").alias("id"), "event_type")

    def work(handed):
        answered = handed.filter((F.col("attempt") > 1) | (F.col("id") % 50 != 7))
        return answered.select("id", ((F.col("event_type") != "error") & (F.col("attempt") > F.col("id") % 3)).alias("ok"))

    for _ in range(ROUNDS):
        workqueue.run_queue(jobs, work, path, checkpoint, lease_seconds=0, fold_after=3)
    return workqueue.queue_state(t.spark, t.table("events").select(F.col("event_id").alias("id")), path)


@query("stream_run_counts", """
    SELECT user_id AS run_id, count(*) AS events, count(*) FILTER (event_type = 'purchase') AS completed,
           count(*) FILTER (event_type = 'signup') AS skipped, count(*) FILTER (event_type = 'error') AS errors,
           CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS duplicates
    FROM events GROUP BY user_id""")
def stream_run_counts(t):
    path, checkpoint = _folders(t, "run-counts")

    class Feed:
        """Run events read as a stream."""

        def table(self, name):
            return event_feed(t)

    outcomes = {"complete": "completed", "skip": "skipped", "error": "errors"}
    feeds.keep_current(feeds.run_counts(run_events(Feed()), outcomes), path, checkpoint, ["run_id"], fold_after=1)
    return feeds.latest_rows(t.spark, path, ["run_id"])


@query("stream_month_counts", """
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, o_orderpriority AS keyword, count(*) AS cnt
    FROM orders GROUP BY ALL""")
def stream_month_counts(t):
    """Monthly counts kept current as orders arrive; the delay covers the whole history."""
    path, checkpoint = _folders(t, "month-counts")
    rows = feeds.read_feed(t.spark, t.folder, "orders.parquet").select(
        F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderpriority").alias("keyword")
    )
    feeds.keep_current(
        feeds.month_counts(rows, "at", ["keyword"], "7300 days"), path, checkpoint, ["month_start", "keyword"], fold_after=1
    )
    return feeds.latest_rows(t.spark, path, ["month_start", "keyword"]).withColumn(
        "month_start", F.to_date("month_start")
    )


_FOUND = "list_extract([" + ", ".join(f"'{label}'" for _, _, label in d.SIZE_RANGES) + "], 1 + CAST(floor(value) AS BIGINT) % 9)"


@query("stream_cache", f"""
    WITH RECURSIVE r AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS id, ts, {_FOUND} AS size FROM events),
    ok AS (SELECT * FROM r WHERE size IS NOT NULL),
    f(key, got) AS (SELECT key, min({{'ts': ts, 'id': id}}) FROM ok GROUP BY key
        UNION ALL SELECT key, nxt FROM (SELECT f.key, (SELECT min({{'ts': ok.ts, 'id': ok.id}}) FROM ok
            WHERE ok.key = f.key AND ok.ts >= f.got.ts + INTERVAL 5 DAY) AS nxt FROM f) WHERE nxt IS NOT NULL),
    m AS (SELECT r.*, f.got.ts AS fetched FROM r LEFT JOIN f ON f.key = r.key AND f.got.id = r.id),
    w AS (SELECT *, last_value(fetched IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, id) AS since,
            last_value(CASE WHEN fetched IS NOT NULL THEN size END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, id) AS kept
          FROM m)
    SELECT key, id, ts, CASE WHEN coalesce(ts < since + INTERVAL 5 DAY, false) THEN kept ELSE size END AS size,
           fetched IS NULL AND coalesce(ts < since + INTERVAL 5 DAY, false) AS hit
    FROM w""")
def stream_cache(t):
    """Requests in four parts by time; a ninth of the fetches finds nothing useful and is not kept."""
    path, checkpoint = _folders(t, "cache")
    labels = [label for _, _, label in d.SIZE_RANGES]
    found = F.get(F.array(*map(F.lit, labels)), (F.floor("value").cast("bigint") % 9).cast("int"))
    rows = t.table("events").select(
        F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), "ts", found.alias("size"))
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    for part in range(PARTS):
        low, high = (first + (last - first) * k / PARTS for k in (part, part + 1))
        slot = (F.col("ts") >= F.lit(low)) & ((F.col("ts") < F.lit(high)) | F.lit(part + 1 == PARTS))
        rows.filter(slot).write.mode("append").parquet(f"{path}-feed")
        cache.run_cache(feeds.read_feed(t.spark, f"{path}-feed"), path, checkpoint, labels, days=5)
    return t.spark.read.parquet(f"{path}/answers").select("key", "id", "ts", "size", "hit")


@query("stream_skill_counts", with_roles("""
    SELECT CAST(date_trunc('month', posted_date) AS DATE) AS month_start, skill_type, count(*) AS cnt
    FROM job_skills l JOIN postings p ON p.id = l.job_id JOIN skills s ON s.id = l.skill_id
    WHERE p.id % 11 <> 0 AND (p.id % 13 <> 0 OR s.id % 2 = 0) GROUP BY ALL""", "postings", "skills", "job_skills"))
def stream_skill_counts(t):
    """Links before and after their jobs, then jobs that go and jobs that are analysed again."""
    path, checkpoint = _folders(t, "skill-counts")
    none = {"posted_date": F.lit(None).cast("date"), "skill_id": F.lit(None).cast("bigint"), "skill_type": F.lit(None).cast("string")}
    typed = t.job_skills.join(t.skills.select(F.col("id").alias("skill_id"), "skill_type"), "skill_id")

    def change(rows, name, version=0, **columns):
        return rows.select("job_id", F.lit(version).alias("version"), F.lit(name).alias("change"),
                           *[F.col(c).alias(c) if c in columns else empty.alias(c) for c, empty in none.items()])

    # every part of the feed has the same types
    jobs = t.postings.select(F.col("id").alias("job_id"), F.col("posted_date").cast("date").alias("posted_date"))
    links = change(typed, "link", skill_id=True, skill_type=True)
    early = (F.col("job_id") + F.col("skill_id")) % 2 == 0
    again = jobs.filter(F.col("job_id") % 13 == 0)
    arrivals = [
        links.filter(early), change(jobs, "job", posted_date=True), links.filter(~early),
        change(jobs.filter(F.col("job_id") % 11 == 0), "delete", 2).unionByName(change(again, "clear")).unionByName(
            links.filter((F.col("job_id") % 13 == 0) & (F.col("skill_id") % 2 == 0)).withColumn("version", F.lit(1))),
    ]
    for rows in arrivals:
        rows.write.mode("append").parquet(f"{path}-feed")
        skill_counts.run_skill_counts(feeds.read_feed(t.spark, f"{path}-feed"), path, checkpoint, fold_after=3)
    return skill_counts.skill_totals(t.spark, path)


def run_chain(t, arrived, known, path, checkpoint):
    """The chained ingest over a stream of order keys (``page_id``)."""
    from skillweft.functions.replies import SKILL_LISTS
    from skillweft.plans.resolution import variants
    from skillweft.plans.texts import keyword_table
    from skillweft.plans.writes import list_pages
    from skillweft.streaming.jobs import run_ingest_chain

    pages = arrived.join(list_pages(t), "page_id")
    # a job's reply names its first part, which the description mentions
    named = t.job_skills.groupBy("job_id").agg(F.min("skill_id").alias("id")).join(t.skills.select("id", "name"), "id")
    skills = F.from_json(F.to_json(F.struct(F.array("name").alias("tech_stack"))), SKILL_LISTS)
    replies = named.join(t.postings.select(F.col("id").alias("job_id"), "link"), "job_id").select(
        "link", skills.alias("skills"), F.concat(F.lit("We use "), "name", F.when(F.col("job_id") % 10 == 0, "").otherwise(
            " here and in every other team")).alias("job_description")  # every tenth is too short
    )
    sizes = t.companies.filter(F.col("employee_size").isNotNull()).select(
        F.coalesce("company", F.lit("")).alias("company"), F.lit(None).cast("string").alias("company_url"), "employee_size"
    )
    run_ingest_chain(pages, keyword_table(t), sizes, replies, known, variants(t), path, checkpoint,
                     F.lit("2000-01-01").cast("date"))


_CHAIN = dict(
    **STEPS, c=CARDS, kw=KEYWORDS,
    fresh=f"""SELECT link, title_clean AS job_title, company, id,
            coalesce((SELECT arg_min(k.id, (-length(k.keyword), k.id)) FROM kw k
                      WHERE len(list_filter(string_split(lower(k.keyword), ' '), lambda w: NOT contains(lower(title_clean), w))) = 0),
                     keyword_id) AS keyword_id,
            (SELECT max(employee_size) FROM companies x WHERE coalesce(x.company, '') = c.company) AS employee_size
        FROM (SELECT *, {q.clean_title('job_title')} AS title_clean FROM c) c
        WHERE {q.any_in('lower(title_clean)', d.ROLE_TERMS)} AND NOT {q.any_in('lower(title_clean)', d.ROLE_EXCLUSIONS)}""",
    items=f"""SELECT f.link AS job_id, 'tech_stack' AS skill_type, 0 AS place, s.name AS skill, {q.normalize_skill('s.name')} AS norm
        FROM fresh f JOIN (SELECT job_id, min(skill_id) AS skill_id FROM job_skills GROUP BY job_id) n ON n.job_id = f.id
        JOIN skills s ON s.id = n.skill_id WHERE f.id % 10 <> 0""",
    asked_items="""SELECT job_id, skill_type, place, coalesce((SELECT v FROM fixes WHERE k = lower(trim(i.skill))),
            (SELECT canonical FROM idx WHERE idx.norm = i.norm AND category = i.skill_type),
            (SELECT arg_min(canonical, r) FROM idx WHERE idx.norm = i.norm), i.skill) AS skill FROM items i""",
    asked=ASKED,
    known="SELECT id, name, normalized_name, skill_type FROM skills",
    **ms.CASCADE,
    keyed=RESOLVED, **ms.LEADERS,
    same="SELECT normalized_name AS key, skill_type, arg_min(name, id) AS name FROM known GROUP BY ALL",
)


@query("stream_ingest_chain", with_roles("""
    SELECT f.link, f.job_title, f.company, f.keyword_id, f.employee_size, l.skill
    FROM fresh f LEFT JOIN (
        SELECT DISTINCT i.job_id AS link, coalesce(k.matched_skill, s.name, a.name) AS skill
        FROM asked_items i JOIN keyed k ON k.skill = i.skill AND k.skill_type = i.skill_type
        LEFT JOIN added a ON k.action = 'insert_new' AND k.final_type IS NOT NULL AND a.key = k.key
        LEFT JOIN same s ON s.key = a.leader AND s.skill_type = a.skill_type
        WHERE coalesce(k.matched_skill, s.name, a.name) IS NOT NULL) l USING (link)""",
    "jobs", "companies", "skills", "job_skills", **_CHAIN))
def stream_ingest_chain(t):
    """Postings, sizes and skill links of orders that arrive as a stream; skills by name."""
    path, checkpoint = _folders(t, "chain")
    arrived = feeds.read_feed(t.spark, t.folder, "orders.parquet").select(F.col("o_orderkey").alias("page_id"))
    run_chain(t, arrived, t.skills, path, checkpoint)
    stored = t.skills.select("id", "name").union(t.spark.read.parquet(f"{path}/skills").select("id", "name"))
    links = t.spark.read.parquet(f"{path}/links").join(stored, F.col("skill_id") == F.col("id")).select(
        F.col("job_id").alias("link"), F.col("name").alias("skill")
    )
    jobs = t.spark.read.parquet(f"{path}/jobs").select("link", "job_title", "company", "keyword_id", "employee_size")
    return jobs.join(links, "link", "left")
