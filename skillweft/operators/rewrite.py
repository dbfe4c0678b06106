"""Inserts, updates and deletes as whole-table rewrites.

Each function returns the new table; the caller writes it to a new path.
Keyed updates first reduce the incoming rows to one per key, so a key that
repeats cannot multiply table rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def append_absent(table: DataFrame, incoming: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """New rows whose key is neither in the table nor earlier among the new rows."""
    # stored keys go first: the rows that are left lie by key already when the first one is picked
    new = incoming.join(table.select(key), key, "left_anti").select(*incoming.columns)
    if order is None:
        return new.dropDuplicates([key])
    whole = F.min_by(F.struct(*incoming.columns), order).alias("r")
    return new.groupBy(F.col(key).alias("_k")).agg(whole).select("r.*")


def seed(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Table plus the seed rows that it lacks; running it again changes nothing."""
    return table.unionByName(append_absent(table, rows, key), allowMissingColumns=True)


def one_per_key(rows: DataFrame, key: str) -> DataFrame:
    """One row per key: the largest by its other columns in their order, NULL being the smallest."""
    others = [c for c in rows.columns if c != key]
    if not others:
        return rows.distinct()
    return rows.groupBy(key).agg(F.max(F.struct(*others)).alias("_r")).select(key, "_r.*").select(*rows.columns)


def upsert(
    table: DataFrame, incoming: DataFrame, key: str, always: list[str], if_present: list[str] = (),
) -> DataFrame:
    """Insert new keys and update known ones.

    Columns in ``always`` take the incoming value even when NULL, columns in
    ``if_present`` only a non-blank one; other columns keep the stored value and
    are inserted for new keys.  Of incoming rows with one key the largest counts.
    """
    renamed = one_per_key(incoming, key).select(*[F.col(c).alias(f"_new_{c}") for c in incoming.columns])
    both = table.withColumn("_old", F.lit(True)).join(
        renamed.withColumn("_hit", F.lit(True)), F.col(key) == F.col(f"_new_{key}"), "full_outer"
    )
    known, hit = F.col("_old").isNotNull(), F.col("_hit").isNotNull()
    columns = []
    for c in table.columns:
        old = F.col(c)
        if c not in incoming.columns:
            columns.append(old)
            continue
        new = F.col(f"_new_{c}")
        if c in if_present:
            changed = F.when(F.coalesce(new.cast("string"), F.lit("")) != "", new).otherwise(old)
        elif c in always:
            changed = new
        else:
            changed = old
        columns.append(F.when(~known, new).when(hit, changed).otherwise(old).alias(c))
    return both.select(*columns)


def upsert_analysis(table: DataFrame, incoming: DataFrame) -> DataFrame:
    """Wide row per job: known jobs change place, lists, time and model; others are inserted."""
    changing = ["location", "tech_stack", "technical_skill", "soft_skill", "extracted_at", "ai_model"]
    return upsert(table, incoming, "job_id", [c for c in changing if c in table.columns])


def update_by_key(
    table: DataFrame, values: DataFrame, key: str, column: str, only_null: bool = False,
    null_safe: str | None = None,
) -> DataFrame:
    """Set one column from (key[, null_safe], column) rows; ``only_null`` leaves filled cells alone."""
    keys = [key, *([null_safe] if null_safe else [])]
    # on repeated keys the largest value wins, so the result does not depend on row order
    latest = values.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max(column).alias("_value"))
    test = F.col(key) == F.col(f"_{key}")
    if null_safe:
        test = test & F.col(null_safe).eqNullSafe(F.col(f"_{null_safe}"))
    joined = table.join(latest, test, "left")
    new = F.coalesce(F.col(column), F.col("_value")) if only_null else F.coalesce(F.col("_value"), F.col(column))
    return joined.select(*[new.alias(column) if c == column else F.col(c) for c in table.columns])


def count_updates(table: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Dry run: rows that an update by key would touch, per key."""
    return (
        table.join(values.select(key).distinct(), key, "left_semi")
        .groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    )


def patch(table: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Partial update: only the non-NULL cells of a patch are applied, of several patches the largest cell."""
    cells = [F.max(c).alias(f"_p_{c}") for c in patches.columns if c != key]
    renamed = patches.groupBy(F.col(key).alias(f"_p_{key}")).agg(*cells) if cells else patches.select(
        F.col(key).alias(f"_p_{key}")).distinct()
    joined = table.join(renamed, F.col(key) == F.col(f"_p_{key}"), "left")
    given = set(patches.columns) - {key}
    return joined.select(*[
        F.coalesce(F.col(f"_p_{c}"), F.col(c)).alias(c) if c in given else F.col(c) for c in table.columns
    ])


def delete_keys(table: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose column is not among the keys (a one-column table)."""
    gone = keys.select(F.col(keys.columns[0]).alias("_k"))
    return table.join(gone, F.col(column) == F.col("_k"), "left_anti")


def delete_jobs(tables: dict[str, DataFrame], keys: DataFrame) -> dict[str, DataFrame]:
    """Delete jobs with their links and analysed rows."""
    return {
        "jobs": delete_keys(tables["jobs"], keys, "id"),
        "job_skills": delete_keys(tables["job_skills"], keys, "job_id"),
        "job_analysis": delete_keys(tables["job_analysis"], keys, "job_id"),
    }


def delete_skills(tables: dict[str, DataFrame], keys: DataFrame) -> dict[str, DataFrame]:
    return {
        "skills": delete_keys(tables["skills"], keys, "id"),
        "job_skills": delete_keys(tables["job_skills"], keys, "skill_id"),
    }


def delete_keywords(tables: dict[str, DataFrame], keys: DataFrame) -> dict[str, DataFrame]:
    """Delete keywords, their jobs and everything that hangs on those jobs."""
    gone = keys.select(F.col(keys.columns[0]).alias("_k"))
    jobs = tables["jobs"].join(gone, F.col("keyword_id") == F.col("_k"), "left_semi").select("id")
    return {"keywords": delete_keys(tables["keywords"], keys, "id"), **delete_jobs(tables, jobs)}


def valid_keywords(df: DataFrame, column: str = "keyword", longest: int = 100) -> DataFrame:
    """Trimmed keyword and whether it is acceptable (1 to ``longest`` letters)."""
    trimmed = F.trim(column)
    fine = F.coalesce(F.length(trimmed).between(1, longest), F.lit(False))
    return df.withColumn(column, trimmed).withColumn("accepted", fine)


def reconcile(before: DataFrame, added: DataFrame, after: DataFrame) -> DataFrame:
    """Row counts before, added and after a write, and whether they add up."""
    n = lambda df: df.agg(F.count(F.lit(1)).alias("n")).scalar()
    row = before.sparkSession.range(1).select(
        n(before).alias("before"), n(added).alias("added"), n(after).alias("after")
    )
    return row.withColumn("balanced", F.col("before") + F.col("added") == F.col("after"))
