"""Streams in several micro-batches give the batch result and continue where they ended."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skillweft.streaming import cache, feeds, skill_counts, workqueue

START = dt.datetime(2024, 1, 1)


def events(spark, n=60):
    rows = [(i, START + dt.timedelta(days=i), f"link{i % 7}", "ab"[i % 2]) for i in range(n)]
    return spark.createDataFrame(rows, "id int, at timestamp, link string, kind string")


def write_files(df, folder, files):
    """Files in time order, one micro-batch each."""
    span = 60 // files
    for f in range(files):
        df.filter((F.col("id") >= f * span) & (F.col("id") < (f + 1) * span)).coalesce(1).write.mode("append").parquet(folder)


def test_month_counts_equal_the_batch(spark, tmp_path):
    df = events(spark)
    write_files(df, str(tmp_path / "in"), 4)
    stream = feeds.read_feed(spark, str(tmp_path / "in"), files_per_batch=1)
    feeds.keep_current(feeds.month_counts(stream, "at", ["kind"], "90 days"), str(tmp_path / "t"), str(tmp_path / "c"))
    got = feeds.latest_rows(spark, str(tmp_path / "t"), ["month_start", "kind"])
    want = df.groupBy(F.date_trunc("month", "at").alias("month_start"), "kind").agg(F.count(F.lit(1)).alias("cnt"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert spark.read.parquet(str(tmp_path / "t")).select("batch").distinct().count() == 4


def test_folded_counts_equal_the_batch(spark, tmp_path):
    df = events(spark)
    folder, table = str(tmp_path / "in"), str(tmp_path / "t")
    for part in range(3):  # a run of its own for each part; folded after the first and the second
        df.filter(F.col("id") % 3 == part).coalesce(1).write.mode("append").parquet(folder)
        stream = feeds.read_feed(spark, folder)
        feeds.keep_current(feeds.month_counts(stream, "at", ["kind"], "900 days"), table, str(tmp_path / "c"),
                           ["month_start", "kind"], fold_after=1 if part < 2 else 50)
    assert [p.name for p in sorted((tmp_path / "t_folded").glob("upto=*"))]
    got = {(r.month_start, r.kind): r.cnt for r in feeds.latest_rows(spark, table, ["month_start", "kind"]).collect()}
    want = df.groupBy(F.date_trunc("month", "at").alias("m"), "kind").count().collect()
    assert got == {(r.m, r.kind): r["count"] for r in want}


def test_feed_is_deduplicated_and_resumes(spark, tmp_path):
    df = events(spark)
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "t", "c"))
    write_files(df.filter("id < 30"), source, 2)
    run = lambda: feeds.ingest_feed(
        feeds.read_feed(spark, source, files_per_batch=1), table, checkpoint, "link", F.struct("at", "id"))
    run()
    first = {r.link: r.id for r in spark.read.parquet(table).collect()}
    assert first == {f"link{i}": i for i in range(7)}
    spark.createDataFrame([(99, START, "new", "a"), (98, START, "link3", "a")], df.schema).write.mode("append").parquet(source)
    run()
    assert {r.link: r.id for r in spark.read.parquet(table).collect()} == {**first, "new": 99}
    run()
    assert spark.read.parquet(table).count() == 8


def test_ingest_reads_nothing_of_the_table(spark, tmp_path):
    """Known keys are state: with the written table gone, later batches still know them."""
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "t", "c"))
    write_files(events(spark), source, 4)
    run = lambda: feeds.ingest_feed(
        feeds.read_feed(spark, source, files_per_batch=1), table, checkpoint, "link", F.struct("at", "id"))
    run()
    kept = tmp_path / "elsewhere"
    (tmp_path / "t").rename(kept)
    spark.createDataFrame([(99, START, "new", "a"), (98, START, "link3", "a")], events(spark, 1).schema).write.mode(
        "append").parquet(source)
    run()
    assert [(r.link, r.id) for r in spark.read.parquet(table).collect()] == [("new", 99)]
    assert spark.read.parquet(str(kept)).count() == 7


def queue_case(spark, tmp_path, n=12):
    df = events(spark, n)
    df.write.parquet(str(tmp_path / "in"))
    stream = lambda: feeds.read_feed(spark, str(tmp_path / "in")).select("id", "kind")
    extra = df.select("id").union(spark.createDataFrame([(77,)], "id int"))
    state = lambda: {
        r.id: (r.status, r.attempts) for r in workqueue.queue_state(spark, extra, str(tmp_path / "t")).collect()}
    return stream, state, str(tmp_path / "t"), str(tmp_path / "c")


def test_queue_hands_failures_out_again(spark, tmp_path):
    """Even ids succeed at once, odd ones at the third attempt; nothing is handed out after that."""
    stream, state, table, checkpoint = queue_case(spark, tmp_path)
    handed = []

    def work(rows):
        handed.append({(r.id, r.attempt) for r in rows.collect()})
        return rows.select("id", ((F.col("kind") == "a") | (F.col("attempt") == 3)).alias("ok"))

    run = lambda: workqueue.run_queue(stream(), work, table, checkpoint, fold_after=2)
    run()
    assert state() == {**{i: ("completed" if i % 2 == 0 else "pending", 1) for i in range(12)}, 77: ("pending", 0)}
    for _ in range(4):
        run()
    assert state() == {**{i: ("completed", 3 if i % 2 else 1) for i in range(12)}, 77: ("pending", 0)}
    assert sorted(x for seen in handed for x in seen) == sorted(
        {(i, 1) for i in range(12)} | {(i, a) for i in range(1, 12, 2) for a in (2, 3)})


def test_dead_claims_return_after_their_lease(spark, tmp_path):
    stream, state, table, checkpoint = queue_case(spark, tmp_path, 4)
    nobody = lambda rows: rows.select("id", F.lit(True).alias("ok")).limit(0)
    all_well = lambda rows: rows.select("id", F.lit(True).alias("ok"))
    workqueue.run_queue(stream(), nobody, table, checkpoint, lease_seconds=3600)
    assert state() == {**{i: ("in_progress", 1) for i in range(4)}, 77: ("pending", 0)}
    more = events(spark, 6).filter("id >= 4")
    more.write.mode("append").parquet(str(tmp_path / "in"))
    workqueue.run_queue(stream(), all_well, table, checkpoint, lease_seconds=3600)
    assert {i: s for i, (s, _) in state().items() if i < 4} == dict.fromkeys(range(4), "in_progress")  # the lease holds
    later = F.current_timestamp() + F.expr("INTERVAL 2 HOURS")
    events(spark, 8).filter("id >= 6").write.mode("append").parquet(str(tmp_path / "in"))
    workqueue.run_queue(stream(), all_well, table, checkpoint, lease_seconds=3600, clock=later)
    assert {i: s for i, s in state().items() if i < 4} == dict.fromkeys(range(4), ("completed", 2))


def test_a_repeated_queue_batch_hands_out_the_same(spark, tmp_path):
    stream, state, table, checkpoint = queue_case(spark, tmp_path)
    work = lambda rows: rows.select("id", (F.col("kind") == "a").alias("ok"))
    workqueue.run_queue(stream(), work, table, checkpoint)
    first = state()
    last = max(int(f.name) for f in (tmp_path / "c" / "commits").iterdir() if f.name.isdigit())
    for file in (tmp_path / "c" / "commits").glob(f"*{last}*"):
        file.unlink()
    workqueue.run_queue(stream(), work, table, checkpoint)
    assert {i: s for i, s in state().items() if i % 2 == 0} == {i: s for i, s in first.items() if i % 2 == 0}
    taken = spark.read.parquet(f"{table}/taken")
    assert taken.groupBy("id", "attempt").count().filter("count > 1").isEmpty()


def test_cache_over_batches(spark, tmp_path):
    """Hits for 30 days after a useful fetch; what is not valid is answered but not kept."""
    asked = [("k", 0, "a"), ("k", 1, "b"), ("k", 29, "a"), ("k", 30, "b"), ("k", 31, "a"), ("k", 59, "a"), ("k", 60, "?"),
             ("k", 61, "a"), ("k", 62, "b"), ("other", 62, None), ("other", 62, "b"), ("other", 63, "a")]
    rows = [(i, k, START + dt.timedelta(days=day), size) for i, (k, day, size) in enumerate(asked)]
    df = spark.createDataFrame(rows, "id int, key string, ts timestamp_ntz, size string")
    for low in (0, 3, 6, 9):
        df.filter(F.col("id").between(low, low + 2)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        stream = feeds.read_feed(spark, str(tmp_path / "in"), files_per_batch=1)
        cache.run_cache(stream, str(tmp_path / "t"), str(tmp_path / "c"), ["a", "b"], days=30)
    got = {r.id: (r.size, r.hit) for r in spark.read.parquet(str(tmp_path / "t/answers")).collect()}
    assert got == {0: ("a", False), 1: ("a", True), 2: ("a", True), 3: ("b", False), 4: ("b", True), 5: ("b", True),
                   6: ("?", False), 7: ("a", False), 8: ("a", True), 9: (None, False), 10: ("b", False), 11: ("b", True)}


def test_cache_jobs_do_not_grow_with_lives(spark, tmp_path):
    """One job a batch, whether its keys are fetched once or fifty times."""
    tracker, counts = spark.sparkContext.statusTracker(), []
    for days in (1, 400):
        rows = [(i, "k", START + dt.timedelta(days=i), "a") for i in range(50)]
        df = spark.createDataFrame(rows, "id int, key string, ts timestamp_ntz, size string")
        folder = tmp_path / str(days)
        df.coalesce(1).write.parquet(str(folder / "in"))
        query = cache.run_cache(feeds.read_feed(spark, str(folder / "in")), str(folder / "t"), str(folder / "c"), ["a"], days=days)
        counts.append(len(tracker.getJobIdsForGroup(str(query.runId))))
        assert spark.read.parquet(str(folder / "t/answers")).filter("not hit").count() == (50 if days == 1 else 1)
    assert counts[0] == counts[1]


def test_expired_entries_leave_the_state(spark, tmp_path):
    schema = "id int, key string, ts timestamp_ntz, size string"
    for i in range(4):
        rows = [(i, f"k{i}", START + dt.timedelta(days=100 * i), "a")]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = cache.run_cache(feeds.read_feed(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c"), ["a"])
    assert query.lastProgress.stateOperators[0].numRowsTotal == 1


def test_skill_totals_equal_a_recount(spark, tmp_path):
    """Late links, moved and deleted jobs, repeated links, analysing again, over random batches."""
    rng = random.Random(3)
    changes, table, links = [], {}, {}
    for version in range(600):
        job, skill = rng.randrange(25), rng.randrange(12)
        kind = ("tech_stack", "soft_skill")[skill % 2]
        name = rng.choices(["job", "link", "unlink", "clear", "delete"], [3, 9, 2, 1, 1])[0]
        day = None
        if name == "job":
            day = None if rng.random() < 0.1 else dt.date(2024, rng.randrange(1, 13), rng.randrange(1, 28))
            table[job] = day
        elif name == "link":
            links[job, skill] = kind
        elif name == "unlink":
            links.pop((job, skill), None)
        else:
            links = {k: v for k, v in links.items() if k[0] != job}
            if name == "delete":
                table.pop(job, None)
        changes.append((job, version, name, day, skill, kind))
    schema = "job_id bigint, version int, change string, posted_date date, skill_id bigint, skill_type string"
    for low in range(0, 600, 150):
        spark.createDataFrame(changes[low : low + 150], schema).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = feeds.read_feed(spark, str(tmp_path / "in"))
        skill_counts.run_skill_counts(stream, str(tmp_path / "t"), str(tmp_path / "c"), fold_after=2)
    got = {(r.month_start, r.skill_type): r.cnt for r in skill_counts.skill_totals(spark, str(tmp_path / "t")).collect()}
    want = Counter(
        (table[job].replace(day=1), kind) for (job, _), kind in links.items() if table.get(job) is not None)
    assert got == dict(want) and len(want) > 5


def test_chain_keeps_skill_ids_over_batches(spark, tmp_path):
    """Three micro-batches, the last one repeated: every link's id stands once in the stored skills."""
    from skillweft.plans.streams import run_chain
    from skillweft.roles import Roles

    t = Roles(spark, "/root/testdata/sf0.001")
    feed, path, checkpoint = (str(tmp_path / n) for n in ("feed", "table", "checkpoint"))
    orders = t.table("orders").select(F.col("o_orderkey").alias("page_id"))
    orders.repartitionByRange(3, "page_id").write.parquet(feed)
    known = t.skills.limit(0)

    def run():
        arrived = feeds.read_feed(spark, feed, files_per_batch=1)
        run_chain(t, arrived, known, path, checkpoint)
        skills = spark.read.parquet(f"{path}/skills")
        links = spark.read.parquet(f"{path}/links")
        ids = [r.id for r in skills.collect()]
        assert len(ids) == len(set(ids)) and {r.skill_id for r in links.collect()} <= set(ids)
        names = [(r.normalized_name, r.skill_type) for r in skills.collect()]
        assert len(names) == len(set(names))
        analysed = {r.link for r in spark.read.parquet(f"{path}/analysis").collect()}
        assert analysed == {r.job_id for r in links.collect()}
        by_name = links.join(skills, links["skill_id"] == skills["id"])
        return sorted((r.job_id, r.name) for r in by_name.collect()), {r.batch for r in links.collect()}

    first, batches = run()
    assert first and batches == {0, 1, 2}
    for file in (tmp_path / "checkpoint" / "commits").glob("*2*"):
        file.unlink()  # as if the driver was lost before the batch was committed
    assert run() == (first, batches)


def test_keys_are_stepped_in_buckets(spark, tmp_path):
    """The number of steps is that of the buckets, not of the keys; null keys have their own."""
    from skillweft.streaming.keyed import keep_buckets, stack

    feed, path, checkpoint = (str(tmp_path / x) for x in ("feed", "table", "checkpoint"))

    def step(rows, kept, _):
        import pandas as pd

        every = stack(kept, rows)
        return pd.DataFrame({"steps": [1], "held": [len(every)]}), every

    for part in range(2):
        keys = F.when(F.col("id") % 10 != 0, F.col("id") + 2 ** 60)
        spark.range(part * 500, part * 500 + 500).select(keys.alias("key")).write.mode("append").parquet(feed)
        arrived = feeds.read_feed(spark, feed)
        feeds.run_available(
            keep_buckets(arrived, "key", step, "steps bigint, held bigint", "key bigint", buckets=2),
            checkpoint, feeds.batch_writer(path))
    by_batch = spark.read.parquet(path).groupBy("batch").agg(F.sum("steps"), F.sum("held")).orderBy("batch").collect()
    assert [tuple(r)[1:] for r in by_batch] == [(3, 500), (3, 1000)]


def test_skill_counts_take_orders_with_a_time_of_day(spark, tmp_path):
    """The dates of orders may be stored as timestamps; all parts of the feed have one type."""
    from skillweft.plans.streams import stream_skill_counts
    from skillweft.roles import Roles

    folder = str(tmp_path)
    spark.range(1, 10).select(
        F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit("F").alias("o_orderstatus"),
        F.lit("1-URGENT").alias("o_orderpriority"), F.lit("2020-01-15 10:00:00").cast("timestamp_ntz").alias("o_orderdate"),
    ).write.parquet(f"{folder}/orders.parquet")
    spark.range(1, 10).select(F.col("id").alias("l_orderkey"), F.lit(4).cast("bigint").alias("l_partkey")).write.parquet(
        f"{folder}/lineitem.parquet")
    spark.createDataFrame([(4, "red widget", "PROMO")], "p_partkey bigint, p_name string, p_type string").write.parquet(
        f"{folder}/part.parquet")
    found = stream_skill_counts(Roles(spark, folder)).collect()
    assert [(str(r.month_start), r.skill_type, r.cnt) for r in found] == [("2020-01-01", "technical_skill", 9)]


def test_a_step_of_skill_counts_holds_few_jobs(spark, tmp_path):
    """Jobs and links lie in many buckets, and the state stores share one bounded memory."""
    jobs = spark.range(3000).select(F.col("id").alias("job_id"), F.lit(0).alias("version"))
    links = jobs.select("*", F.lit("link").alias("change"), F.lit(None).cast("date").alias("posted_date"),
                        (F.col("job_id") % 7).alias("skill_id"), F.lit("soft_skill").alias("skill_type"))
    dated = jobs.select("*", F.lit("job").alias("change"), F.lit(dt.date(2024, 1, 9)).alias("posted_date"),
                        F.lit(None).cast("bigint").alias("skill_id"), F.lit(None).cast("string").alias("skill_type"))
    feed, table = str(tmp_path / "in"), str(tmp_path / "t")
    links.union(dated).write.parquet(feed)
    query = skill_counts.run_skill_counts(feeds.read_feed(spark, feed), table, str(tmp_path / "c"))
    assert query.lastProgress.stateOperators[0].numRowsTotal > 1500
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage") == "true"
    assert [tuple(r) for r in skill_counts.skill_totals(spark, table).collect()] == [(dt.date(2024, 1, 1), "soft_skill", 3000)]


def test_skill_totals_with_nulls_and_text_keys(spark, tmp_path):
    """Null types are a type, unknown changes and null jobs count nowhere, a null version comes last."""
    day, later = dt.date(2024, 1, 9), dt.date(2024, 5, 2)
    parts = [
        [("a", 1, "job", day, None, None), ("a", 2, "link", None, 1, None), ("a", 3, "link", None, 2, "x"),
         ("b", 1, "link", None, 1, "x"), (None, 1, "job", day, None, None), (None, 1, "link", None, 1, "x"),
         ("c", 1, "job", None, None, None), ("c", 1, "link", None, 1, "x"), ("a", 9, "other", later, None, "x")],
        [("a", None, "job", later, None, None), ("a", 5, "job", day, None, None), ("a", 6, "link", None, 2, "y"),
         ("b", 1, "job", day, None, None), ("b", 2, None, later, None, None), ("c", 2, "job", later, None, None)],
        [("b", 2, "clear", None, None, None), ("b", 3, "link", None, 4, None), ("c", 1, "unlink", None, 1, None)],
    ]
    totals = []
    for rows in parts:
        df = spark.createDataFrame(rows, "job_id string, version int, change string, posted_date date, skill_id int, skill_type string")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        skill_counts.run_skill_counts(feeds.read_feed(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c"))
        found = skill_counts.skill_totals(spark, str(tmp_path / "t")).collect()
        totals.append({(r.month_start.month, r.skill_type): r.cnt for r in found})
    assert totals == [{(1, None): 1, (1, "x"): 1}, {(5, None): 1, (5, "y"): 1, (1, "x"): 1, (5, "x"): 1},
                      {(5, None): 1, (5, "y"): 1, (1, None): 1}]


def test_a_checkpoint_keeps_its_number_of_buckets(spark, tmp_path):
    from skillweft.streaming.keyed import keep_buckets, stack

    feed, path, checkpoint = (str(tmp_path / x) for x in ("feed", "table", "checkpoint"))
    step = lambda rows, kept, _: (rows, stack(kept, rows))
    for buckets in (2, 3):
        spark.range(50).select(F.col("id").alias("key")).write.mode("append").parquet(feed)
        stream = keep_buckets(feeds.read_feed(spark, feed), "key", step, "key bigint", "key bigint", buckets=buckets)
        if buckets == 2:
            feeds.run_available(stream, checkpoint, feeds.batch_writer(path))
            continue
        with pytest.raises(Exception, match="in 2 buckets, not 3"):
            feeds.run_available(stream, checkpoint, feeds.batch_writer(path))
