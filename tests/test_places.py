"""Location clean-up on known pairs."""

import pytest
from pyspark.sql import functions as F

from skillweft.operators import places as pl

GAZETTEER = [
    ("JAKARTA", "DKI JAKARTA"), ("JAKARTA BARAT", "DKI JAKARTA"), ("JAKARTA TIMUR", "DKI JAKARTA"),
    ("JAKARTA SELATAN", "DKI JAKARTA"), ("JAKARTA UTARA", "DKI JAKARTA"), ("JAKARTA PUSAT", "DKI JAKARTA"),
    ("BANDUNG", "JAWA BARAT"), ("BANDUNG BARAT", "JAWA BARAT"), ("BEKASI", "JAWA BARAT"), ("DEPOK", "JAWA BARAT"),
    ("BOGOR", "JAWA BARAT"), ("CIMAHI", "JAWA BARAT"), ("CIREBON", "JAWA BARAT"), ("YOGYAKARTA", "DI YOGYAKARTA"),
    ("SURABAYA", "JAWA TIMUR"), ("MALANG", "JAWA TIMUR"), ("TANGERANG", "BANTEN"), ("TANGERANG SELATAN", "BANTEN"),
    ("PURBALINGGA", "JAWA TENGAH"), ("LANDAK", "KALIMANTAN BARAT"), ("DENPASAR", "BALI"), ("SABANG", "ACEH"),
    ("TOLI-TOLI", "SULAWESI TENGAH"),
]
# fixed values: known pairs of raw and normalised places
PAIRS = [
    ("Jakarta", "Jakarta"), ("Jakarta Selatan", "Jakarta Selatan"), ("DKI Jakarta", "Jakarta"),
    ("Jakarta, Indonesia", "Jakarta"), ("Jakarta Selatan, DKI Jakarta", "Jakarta Selatan"),
    ("Kota Bandung", "Bandung"), ("Bandung, West Java", "Bandung"), ("Kabupaten Bandung", "Bandung"),
    ("Yogyakarta", "Yogyakarta"), ("Tangerang", "Tangerang"), ("West Java", "Jawa Barat"),
    ("Central Java", "Jawa Tengah"), ("East Java", "Jawa Timur"), ("Bali", "Bali"), ("Aceh", "Aceh"),
    ("Indonesia", "Indonesia"), ("Remote, Indonesia", "Indonesia"), ("Remote", "other"), ("WFH", "other"),
    ("Jakarta (415)", "Jakarta"), ("Jakarta, Remote", "Jakarta"), ("Bandung, WFH", "Bandung"),
    ("Singapore", "Singapore"), ("Tokyo", "Tokyo"), ("", "other"), (None, "other"),
    ("Cilandak, Jakarta, Indonesia", "Jakarta"), ("Cilandak, Jakarta Selatan", "Jakarta Selatan"),
    ("Cilandak", "Cilandak"), ("West Jakarta", "Jakarta Barat"), ("Central Jakarta", "Jakarta Pusat"),
    ("West Jakarta, Jakarta, Indonesia", "Jakarta Barat"), ("Malang, East Java, Indonesia", "Malang"),
    ("Purbalingga, Central Java, Indonesia", "Purbalingga"), ("South Tangerang", "Tangerang Selatan"),
    ("West Bandung", "Bandung Barat"), ("toli-toli / hybrid", "Toli-Toli"), (" , ", "other"),
]


@pytest.fixture(scope="module")
def placed(spark):
    gazetteer = spark.createDataFrame(GAZETTEER, "name string, province string")
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(PAIRS)], "i int, location string, want string")
    out = pl.with_place_type(pl.normalize_locations(rows, gazetteer), gazetteer)
    return {r.i: r for r in out.collect()}


def test_known_pairs(placed):
    assert len(placed) == len(PAIRS)
    assert [(r.location, r.place) for r in placed.values() if r.place != r.want] == []


def test_types(placed):
    by_text = {r.location: r for r in placed.values()}
    assert (by_text["Jakarta"].location_type, by_text["Jakarta"].confidence) == ("city", 1.0)
    assert by_text["West Java"].location_type == "province"
    assert (by_text["Remote"].location_type, by_text["Remote"].confidence) == ("other", 0.5)
    assert (by_text["Indonesia"].location_type, by_text["Indonesia"].confidence) == ("indonesia", 0.5)
    assert by_text["West Jakarta"].province == "DKI JAKARTA"


def test_normalising_again_changes_nothing(spark, placed):
    gazetteer = spark.createDataFrame(GAZETTEER, "name string, province string")
    once = spark.createDataFrame(
        sorted({(r.place,) for r in placed.values() if r.place not in ("other", "Indonesia")}), "location string")
    again = pl.normalize_locations(once, gazetteer)
    assert again.filter(F.col("place") != F.col("location")).count() == 0


@pytest.mark.parametrize("text, want", [
    ("Surabaya, East Java, Indonesia", "Surabaya"), ("Work from home - Bandung", "Remote"),
    ("Medan, Sumatera Utara", "Medan"), ("Kudus, Jawa Tengah", "Jawa Tengah"), ("Unknown", "Other"), (None, "Other"),
])
def test_short_vocabulary(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(pl.short_place(F.col("t")).alias("p")).first()
    assert row.p == want
