"""Location clean-up against a gazetteer given as a table (name, province), upper case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skillweft.dictionaries import (
    CITY_ALIASES, LOCATION_COUNTRY, LOCATION_NOISE, PLACE_PREFIX_PATTERN,
    PLACE_SECOND_PREFIX_PATTERN, PROVINCE_ALIASES, SHORT_CITIES, SHORT_PLACES, SHORT_REMOTE,
)
from skillweft.functions.text import alternation, first_contained, one_of_pairs, squeeze, strip, title_case
from skillweft.operators.containment import longest_phrase, whole_word_phrases
from skillweft.session import cut_lineage


def short_place(location: Column) -> Column:
    """City, else province or country, else 'Other', from the short vocabulary."""
    text = F.lower(location)
    city = strip(F.split(text, ",")[0])
    return F.when(F.coalesce(location, F.lit("")) == "", "Other").otherwise(F.coalesce(
        F.when(text.rlike(alternation(SHORT_REMOTE)), F.lit("Remote")),
        F.when(city.isin(*SHORT_CITIES), one_of_pairs(city, SHORT_PLACES)),
        first_contained(text, SHORT_PLACES),
        F.lit("Other"),
    ))


def remove_noise(location: Column) -> Column:
    text = F.regexp_replace(location, r"\s*\(\d+\)\s*", " ")
    text = F.regexp_replace(text, rf"(?iU)\b(?:{alternation(LOCATION_NOISE)})\b", "")
    text = strip(F.regexp_replace(text, r"(?U)\s+", " "))
    return strip(F.regexp_replace(text, r"^[,\s]+|[,\s]+$", ""))


def location_parts(location: Column) -> Column:
    """Blank-free parts between commas and slashes."""
    parts = F.transform(F.split(remove_noise(location), "[,/]"), strip)
    return F.filter(parts, lambda p: p != "")


def resolve_parts(parts: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Distinct upper-case parts -> place name (city before province), NULL when unknown."""
    cities = gazetteer.select(F.col("name").alias("phrase")).distinct()
    provinces = gazetteer.select(F.col("province").alias("phrase")).distinct()
    second = strip(F.regexp_replace("text", PLACE_SECOND_PREFIX_PATTERN, ""))
    rows = cut_lineage(parts.select("text").distinct().withColumn("second", second))
    direct = (
        rows.join(cities.select(F.col("phrase").alias("c1")), F.col("text") == F.col("c1"), "left")
        .join(cities.select(F.col("phrase").alias("c2")), F.col("second") == F.col("c2"), "left")
        .withColumn("place", F.coalesce(
            "c1", "c2", one_of_pairs(F.col("text"), CITY_ALIASES), one_of_pairs(F.col("second"), CITY_ALIASES)
        ))
    )
    open_texts = direct.filter(F.col("place").isNull()).select("text")
    in_city = longest_phrase(whole_word_phrases(open_texts, cities)).withColumnRenamed("phrase", "w1")
    in_province = longest_phrase(whole_word_phrases(open_texts, provinces)).withColumnRenamed("phrase", "w2")
    # a province equal to the text is also the longest province inside it
    return direct.join(in_city, "text", "left").join(in_province, "text", "left").select(
        "text",
        F.coalesce("place", "w1", one_of_pairs(F.col("text"), PROVINCE_ALIASES), "w2").alias("place"),
    )


def normalize_locations(df: DataFrame, gazetteer: DataFrame, column: str = "location",
                        name: str = "place") -> DataFrame:
    """Add the normalised location.

    The first part that names a city or province wins; else the country, else
    the first part, else 'other'.  Work is done once per distinct raw text.
    """
    raw = df.select(F.col(column).alias("raw")).filter(F.col("raw") != "").distinct()
    listed = cut_lineage(raw.select("raw", location_parts(F.col("raw")).alias("parts")))
    part = F.col("part")
    exploded = listed.select("raw", F.posexplode("parts").alias("pos", "part")).filter(
        F.upper("part") != LOCATION_COUNTRY.upper()
    ).withColumn("text", strip(F.regexp_replace(F.upper(part), PLACE_PREFIX_PATTERN, "")))
    known = resolve_parts(exploded, gazetteer)
    found = (
        exploded.join(known, "text").filter(F.col("place").isNotNull())
        .groupBy("raw").agg(F.min_by("place", "pos").alias("place"))
    )
    has_country = F.exists("parts", lambda p: F.upper(p) == LOCATION_COUNTRY.upper())
    resolved = listed.join(found, "raw", "left").select(
        "raw",
        F.when(F.col("place").isNotNull(), title_case(F.col("place")))
        .when(F.size("parts") == 0, "other")
        .when(has_country, LOCATION_COUNTRY)
        .otherwise(title_case(F.get("parts", F.lit(0)))).alias(name),
    )
    return df.join(resolved, F.col(column) == F.col("raw"), "left").drop("raw").withColumn(
        name, F.coalesce(name, F.lit("other"))
    )


def with_place_type(df: DataFrame, gazetteer: DataFrame, place: str = "place") -> DataFrame:
    """Add location_type, confidence and the province of a city."""
    cities = gazetteer.groupBy(F.col("name").alias("_city")).agg(F.min("province").alias("_province"))
    provinces = gazetteer.select(F.col("province").alias("_p")).distinct()
    upper = F.upper(F.col(place))
    rows = df.join(cities, upper == F.col("_city"), "left").join(provinces, upper == F.col("_p"), "left")
    vague = F.col(place).isin("other", LOCATION_COUNTRY)
    kind = (
        F.when(F.col(place) == "other", "other").when(F.col(place) == LOCATION_COUNTRY, "indonesia")
        .when(F.col("_p").isNotNull(), "province").when(F.col("_city").isNotNull(), "city")
        .otherwise("other")
    )
    return rows.select(
        *df.columns, kind.alias("location_type"),
        F.when(vague, 0.5).otherwise(1.0).alias("confidence"),
        F.col("_province").alias("province"),
    )


def changed_places(analysis: DataFrame, jobs: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Analysed rows whose stored location differs (without case) from the raw one normalised again."""
    raw = jobs.filter(F.col("location") != "").select(
        F.col("id").alias("job_id"), F.col("location").alias("raw_location")
    )
    rows = analysis.select("id", "job_id", F.col("location").alias("old_place")).join(raw, "job_id")
    fresh = normalize_locations(rows, gazetteer, "raw_location", "new_place")
    old = F.lower(F.trim(F.coalesce("old_place", F.lit(""))))
    return fresh.filter(F.lower(F.trim("new_place")) != old)


def change_histogram(changes: DataFrame) -> DataFrame:
    return changes.groupBy(
        "raw_location", F.coalesce("old_place", F.lit("NULL")).alias("old_place"), "new_place"
    ).agg(F.count(F.lit(1)).alias("cnt"))
