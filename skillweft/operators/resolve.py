"""Skill resolution: canonical names, matching against known skills, vocabulary merge.

The canonical dictionary is an input table ``variants`` with
(category, canonical, variant, seq): ``category`` is a skill type name and
``seq`` the order of the entries.  Known skills are (id, name, normalized_name,
skill_type).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skillweft.dictionaries import FUZZY_THRESHOLD, SPECIFIC_FIXES
from skillweft.functions.skills import (
    is_generic, is_soft_skill, keep_grounded, normalize_skill, reclassify, specific_fix,
    synonym,
)
from skillweft.functions.similarity import skill_score_udf
from skillweft.operators.fuzzy import best_known, candidates
from skillweft.operators.leaders import lead
from skillweft.operators.ordering import number_all
from skillweft.session import cut_lineage

# order in which the categories are searched
CATEGORIES = ["tech_stack", "technical_skill", "soft_skill"]


def _category_rank() -> Column:
    return F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))


def canonical_index(variants: DataFrame) -> DataFrame:
    """One row per normalised variant: first canonical name of every category."""
    keyed = variants.withColumn("index_norm", normalize_skill(F.col("variant")))
    return keyed.groupBy("index_norm").agg(*[
        F.min_by(F.when(F.col("category") == c, F.col("canonical")),
                 F.when(F.col("category") == c, F.col("seq"))).alias(f"in_{c}")
        for c in CATEGORIES
    ])


def with_canonical(df: DataFrame, variants: DataFrame, skill: str = "skill",
                   skill_type: str | None = "skill_type", norm: str | None = None) -> DataFrame:
    """Add (canonical, found): spelling fix, else the given type's entry, else any type's first.

    ``norm`` names the column of normalised skills, where there is one.
    """
    index = canonical_index(variants)
    rows = df.withColumn("_norm", F.col(norm) if norm else normalize_skill(F.col(skill)))
    joined = rows.join(index, F.col("_norm") == F.col("index_norm"), "left")
    own = F.lit(None).cast("string")
    if skill_type:
        own = F.coalesce(*[F.when(F.col(skill_type) == c, F.col(f"in_{c}")) for c in CATEGORIES])
    hit = F.coalesce(specific_fix(F.col(skill)), own, *[F.col(f"in_{c}") for c in CATEGORIES])
    return joined.select(
        *df.columns, F.coalesce(hit, F.col(skill)).alias("canonical"), hit.isNotNull().alias("found")
    )


def with_detected_type(df: DataFrame, variants: DataFrame, skill: str = "skill") -> DataFrame:
    """Add detected_type: fix, generic, soft wording, then dictionary; NULL when unknown."""
    names = variants.groupBy(F.col("canonical").alias("_canonical")).agg(
        F.min_by("category", _category_rank()).alias("_fix_type")
    )
    index = canonical_index(variants)
    rows = df.withColumn("_norm", normalize_skill(F.col(skill))).withColumn("_fix", specific_fix(F.col(skill)))
    joined = rows.join(names, F.col("_fix") == F.col("_canonical"), "left").join(
        index, F.col("_norm") == F.col("index_norm"), "left"
    )
    by_index = F.coalesce(*[F.when(F.col(f"in_{c}").isNotNull(), F.lit(c)) for c in CATEGORIES])
    kind = (
        F.when(F.coalesce(F.col(skill), F.lit("")) == "", None)
        .when(F.col("_fix_type").isNotNull(), F.col("_fix_type"))
        .when(is_generic(F.col(skill)), "GENERIC")
        .when(is_soft_skill(F.col(skill)), "soft_skill")
        .otherwise(by_index)
    )
    return joined.select(*df.columns, kind.alias("detected_type"))


def canonical_lookup(variants: DataFrame) -> DataFrame:
    """(norm, canonical, canonical_type): later entries replace earlier ones, fixes come first."""
    spark = variants.sparkSession
    entries = variants.select(
        normalize_skill(F.col("variant")).alias("norm"), "canonical", F.col("category").alias("canonical_type"),
        _category_rank().alias("rank"), "seq",
    )
    fixes = spark.createDataFrame(
        [(k, v, i) for i, (k, v) in enumerate(SPECIFIC_FIXES)], "variant STRING, skill STRING, seq INT"
    )
    typed = with_detected_type(fixes, variants).filter(
        F.col("detected_type").isNotNull() & (F.col("detected_type") != "GENERIC")
    ).select(
        normalize_skill(F.col("variant")).alias("norm"), F.col("skill").alias("canonical"),
        F.col("detected_type").alias("canonical_type"), F.lit(0).cast("bigint").alias("rank"),
        F.col("seq").cast("bigint").alias("seq"),
    )
    everything = entries.select(
        "norm", "canonical", "canonical_type", F.col("rank").cast("bigint").alias("rank"),
        F.col("seq").cast("bigint").alias("seq"),
    ).union(typed)
    last = F.max_by(F.struct("canonical", "canonical_type"), F.struct("rank", "seq"))
    return everything.groupBy("norm").agg(last.alias("e")).select(
        "norm", F.col("e.canonical").alias("canonical"), F.col("e.canonical_type").alias("canonical_type")
    )


def known_by_norm(known: DataFrame) -> DataFrame:
    """One known skill per normalised name; the highest id replaces the others."""
    keyed = known.withColumn("known_norm", normalize_skill(F.col("normalized_name")))
    return keyed.groupBy("known_norm").agg(
        F.max_by(F.struct("id", "name"), "id").alias("k")
    ).select("known_norm", F.col("k.id").alias("known_id"), F.col("k.name").alias("known_name"))


def match_skills(raw: DataFrame, known: DataFrame, variants: DataFrame,
                 threshold: int = FUZZY_THRESHOLD) -> DataFrame:
    """Resolve distinct (skill, skill_type) against the known skills.

    Stages: generic (rejected), canonical, synonym, fuzzy, new.  All rows are
    resolved against the same snapshot of known skills.  Result columns:
    skill, skill_type, norm, matched_id, matched_skill, score, method, action,
    final_type.
    """
    # the distinct spellings and the known names feed several joins: compute each once
    rows = cut_lineage(
        raw.select("skill", "skill_type").distinct().withColumn("norm", normalize_skill(F.col("skill")))
    )
    lookup = canonical_lookup(variants).select(
        F.col("norm").alias("_n"), F.col("canonical").alias("_c"), F.col("canonical_type").alias("_ct")
    )
    names = cut_lineage(known_by_norm(known))

    def named(prefix: str) -> DataFrame:
        return names.select(*[F.col(c).alias(f"{prefix}_{c}") for c in names.columns])

    rows = rows.withColumn("generic", is_generic(F.col("skill")))
    staged = (
        rows.join(lookup, F.col("norm") == F.col("_n"), "left")
        .withColumn("_cn", normalize_skill(F.col("_c")))
        .withColumn("_sn", normalize_skill(synonym(F.col("skill"))))
        .join(named("c"), F.when(F.col("_c").isNotNull(), F.col("_cn")) == F.col("c_known_norm"), "left")
        .join(named("s"), F.when(F.col("_sn") != "", F.col("_sn")) == F.col("s_known_norm"), "left")
    )
    staged = cut_lineage(staged)
    settled = F.col("generic") | F.col("c_known_id").isNotNull() | F.col("s_known_id").isNotNull()
    open_texts = staged.filter(~settled).select(F.col("norm").alias("text"))
    fuzzy = best_known(
        open_texts, names.select(F.col("known_id").alias("id"), F.col("known_norm").alias("text")), threshold
    ).join(names.select(F.col("known_id").alias("_fid"), F.col("known_name").alias("f_name")),
           F.col("known_id") == F.col("_fid")).select(
        F.col("text").alias("_ft"), F.col("known_id").alias("f_id"), "f_name", F.col("score").alias("f_score")
    )
    typed = with_detected_type(staged.join(fuzzy, F.col("norm") == F.col("_ft"), "left"), variants)
    stage = (
        F.when(F.col("generic"), "generic").when(F.col("c_known_id").isNotNull(), "canonical")
        .when(F.col("s_known_id").isNotNull(), "synonym").when(F.col("f_id").isNotNull(), "fuzzy")
        .otherwise("new")
    )
    at = typed.withColumn("method", stage)
    kind = F.coalesce("_ct", "skill_type")
    detected = F.nullif(F.col("detected_type"), F.lit("GENERIC"))
    method = F.col("method")
    return at.select(
        "skill", "skill_type", "norm",
        F.when(method == "canonical", F.col("c_known_id")).when(method == "synonym", F.col("s_known_id"))
        .when(method == "fuzzy", F.col("f_id")).alias("matched_id"),
        F.when(method == "canonical", F.col("c_known_name")).when(method == "synonym", F.col("s_known_name"))
        .when(method == "fuzzy", F.col("f_name")).alias("matched_skill"),
        F.when(method.isin("canonical", "synonym"), 100.0).when(method == "fuzzy", F.col("f_score"))
        .otherwise(0.0).alias("score"),
        "method",
        F.when(method == "generic", "rejected").when(method == "new", "insert_new")
        .otherwise("use_existing").alias("action"),
        F.when(method == "new", F.coalesce(detected, kind)).when(method != "generic", kind).alias("final_type"),
    )


def fresh_names(matches: DataFrame, variants: DataFrame) -> DataFrame:
    """Unmatched skills under the name they would be stored by: one row per key, with its first occurrence.

    ``matches`` may have a column ``seq`` that orders the spellings.
    """
    seq = F.col("seq") if "seq" in matches.columns else F.lit(0)
    fresh = with_canonical(
        matches.withColumn("seq", seq).filter(F.col("action") == "insert_new").filter(F.col("final_type").isNotNull()),
        variants, "skill", "skill_type",
    ).withColumn("name", F.when(F.col("found"), F.col("canonical")).otherwise(F.col("norm")))
    first = F.min(F.struct("seq", F.col("final_type").alias("skill_type"), F.length("name").alias("n"), "name")).alias("f")
    keyed = fresh.groupBy(normalize_skill(F.col("name")).alias("key")).agg(first)
    return keyed.select("key", "f.seq", "f.skill_type", "f.name")


def merge_spellings(fresh: DataFrame, threshold: int = FUZZY_THRESHOLD) -> DataFrame:
    """Near spellings of one batch, resolved as if one after another.

    Takes the rows of :func:`fresh_names`; a name joins the earlier new skill it resembles
    most (``threshold`` at least, equal texts and shared synonyms fully) or becomes one.
    Columns: ``key``, and of the skill it belongs to ``leader``, ``name``, ``skill_type``.
    """
    rows = cut_lineage(number_all(fresh, [F.col("seq").asc_nulls_first(), F.asc("key")], "rank"))
    nodes = rows.select(F.col("key").alias("node"), "rank")
    texts = rows.filter(F.col("key") != "").select(F.col("key").alias("text"))
    near = candidates(texts, texts, threshold).filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    placed = near.join(nodes.select(F.col("node").alias("a"), F.col("rank").alias("_a")), "a").join(
        nodes.select(F.col("node").alias("b"), F.col("rank").alias("_b")), "b")
    later = F.col("_a") > F.col("_b")
    pairs = placed.select(
        F.when(later, F.col("a")).otherwise(F.col("b")).alias("later"),
        F.when(later, F.col("b")).otherwise(F.col("a")).alias("earlier"),
    ).withColumn("score", skill_score_udf(float(threshold))("later", "earlier")).filter(F.col("score") >= threshold)
    groups = texts.select(F.col("text").alias("node"), F.explode(F.array_distinct(F.array_compact(
        F.array("text", synonym(F.col("text")))))).alias("key"))
    joined = lead(nodes, cut_lineage(pairs), groups)
    stored = rows.select(F.col("key").alias("leader"), "name", "skill_type")
    return joined.join(stored, "leader").select(F.col("node").alias("key"), "leader", "name", "skill_type")


def new_skills(spellings: DataFrame, known: DataFrame) -> DataFrame:
    """Rows to append for unmatched skills, one per leader of :func:`merge_spellings`: ids continued."""
    led = spellings.filter(F.col("key") == F.col("leader")).select(
        "name", F.col("leader").alias("normalized_name"), "skill_type")
    merged = led.join(known.select("normalized_name", "skill_type"), ["normalized_name", "skill_type"], "left_anti")
    last = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).scalar()
    numbered = number_all(merged, [F.asc("normalized_name"), F.asc("skill_type")], "_no")
    return numbered.select((last + F.col("_no")).alias("id"), "name", "normalized_name", "skill_type")


def reply_items(replies: DataFrame) -> DataFrame:
    """(job_id, skill_type, pos, skill) from parsed replies, after reclassifying and grounding.

    ``replies`` has (job_id, skills, job_description).  Entries shorter than two
    letters go, and so do later entries of a list with the same key.
    """
    return _normalised_items(replies).drop("norm")


def _normalised_items(replies: DataFrame) -> DataFrame:
    """:func:`reply_items` with the key ``norm`` of every entry."""
    checked = replies.select(
        "job_id", keep_grounded(reclassify(F.col("skills")), F.col("job_description")).alias("s")
    )
    parts = F.explode(F.array(*[
        F.struct(F.lit(c).alias("skill_type"), F.col("s")[c].alias("items")) for c in CATEGORIES
    ]))
    items = checked.select("job_id", parts.alias("p")).select(
        "job_id", "p.skill_type", F.posexplode("p.items").alias("pos", "skill")
    ).filter(F.length("skill") >= 2).withColumn("norm", normalize_skill(F.col("skill")))
    first = Window.partitionBy("job_id", "skill_type", "norm").orderBy("pos")
    return items.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") == 1).drop("_r")


def resolve_replies(replies: DataFrame, known: DataFrame, variants: DataFrame) -> dict[str, DataFrame]:
    """Parsed replies -> skills to append, (job, skill) links and canonical lists per job.

    New spellings count in the order of the jobs, the categories and the lists.
    """
    # both feed many joins: read and normalised once
    variants, known = cut_lineage(variants), cut_lineage(known.select("id", "name", "normalized_name", "skill_type"))
    items = cut_lineage(with_canonical(_normalised_items(replies), variants, norm="norm").drop("norm", "found"))
    place = F.struct("job_id", F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("skill_type")), "pos")
    asked = items.groupBy(F.col("canonical").alias("skill"), "skill_type").agg(F.min(place).alias("seq"))
    asked = cut_lineage(asked)
    matches = cut_lineage(match_skills(asked, known, variants).join(asked, ["skill", "skill_type"]))
    spellings = cut_lineage(merge_spellings(fresh_names(matches, variants)))
    added = cut_lineage(new_skills(spellings, known))
    final = with_canonical(matches, variants, "skill", "skill_type").withColumn(
        "_key", normalize_skill(F.when(F.col("found"), F.col("canonical")).otherwise(F.col("norm")))
    )
    every = known.select("id", "normalized_name", "skill_type").union(
        added.select("id", "normalized_name", "skill_type")
    ).groupBy(F.col("normalized_name").alias("leader"), F.col("skill_type").alias("_type")).agg(F.min("id").alias("new_id"))
    stored = spellings.select(F.col("key").alias("_key"), "leader", F.col("skill_type").alias("_type")).join(
        every, ["leader", "_type"])
    open_one = F.when((F.col("action") == "insert_new") & F.col("final_type").isNotNull(), F.col("_key"))
    ids = final.withColumn("_key", open_one).join(stored, "_key", "left").select(
        "skill", "skill_type", F.coalesce("matched_id", "new_id").alias("skill_id"))
    links = items.select("job_id", F.col("canonical").alias("skill"), "skill_type").join(
        ids.filter(F.col("skill_id").isNotNull()), ["skill", "skill_type"]
    ).select("job_id", "skill_id").distinct()
    # the items of one job come from one reply row, so these lists stay as small as the reply
    lists = items.groupBy("job_id").agg(*[
        F.nullif(F.array_join(F.array_sort(F.collect_set(
            F.when(F.col("skill_type") == c, F.col("canonical")))), ", "), F.lit("")).alias(c)
        for c in CATEGORIES
    ])
    return {"matches": matches.drop("seq"), "new_skills": added, "links": links, "lists": lists}


def merge_vocabulary(skills: DataFrame, links: DataFrame, variants: DataFrame) -> dict[str, DataFrame]:
    """Merge skills of a type with the same key: shortest name survives and is renamed to its
    canonical form; links move to the survivor and duplicates go."""
    keyed = skills.withColumn("key", normalize_skill(F.col("name")))
    survivors = keyed.groupBy("skill_type", "key").agg(
        F.min_by(F.struct("id", "name"), F.struct(F.length("name"), F.col("id"))).alias("s"),
        F.count(F.lit(1)).alias("members"),
    ).select("skill_type", "key", F.col("s.id").alias("id"), F.col("s.name").alias("name"), "members")
    renamed = with_canonical(survivors, variants, "name", "skill_type")
    change = F.col("found") & (F.col("canonical") != F.col("name"))
    merged = renamed.select(
        "id", F.when(change, F.col("canonical")).otherwise(F.col("name")).alias("name"),
        F.when(change, normalize_skill(F.col("canonical"))).otherwise(F.col("key")).alias("normalized_name"),
        "skill_type", "members", change.alias("renamed"),
    )
    moves = keyed.select(F.col("id").alias("skill_id"), "skill_type", "key").join(
        survivors.select("skill_type", "key", F.col("id").alias("survivor_id")), ["skill_type", "key"]
    ).select("skill_id", "survivor_id")
    # duplicates collapse inside each task before the rows are shuffled
    moved = links.join(moves, "skill_id").select("job_id", F.col("survivor_id").alias("skill_id")).distinct()
    summary = merged.groupBy("skill_type").agg(
        F.sum("members").alias("original"),
        F.count_if("renamed").alias("renamed"),
        F.sum(F.col("members") - 1).alias("merged"),
        F.count(F.lit(1)).alias("final"),
    )
    return {"skills": merged.drop("members", "renamed"), "links": moved, "summary": summary, "moves": moves}


def duplicate_names(skills: DataFrame) -> DataFrame:
    """Skills whose key was seen before, with the first name seen."""
    keyed = skills.withColumn("key", normalize_skill(F.col("name")))
    first = keyed.groupBy("key").agg(
        F.min_by("name", "id").alias("first_name"), F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")
    ).filter(F.col("n") > 1)
    return keyed.join(first, "key").filter(F.col("id") != F.col("first_id")).select(
        "id", "name", "first_name", "key"
    )
