"""Registered queries against their SQL on the smallest data set."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
FOLDER = "/root/testdata/sf0.001"
NAMES = ["top_by_type", "top_skills_fanout", "distribution_nested", "month_spine", "facet_counts", "cooccurrence_ego",
         "normalize_locations", "canonicalize", "merge_vocab_links", "match_score", "extract_links", "ingest_postings",
         "upsert", "stream_cache"]

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")


def load(path):
    spec = importlib.util.spec_from_file_location(path.stem, path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.fixture(scope="module")
def entry():
    return load(ROOT / "__spark_entry__.py")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def test_every_sql_has_a_query(entry):
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark, entry):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, entry, db, name):
    rows_of = load(ROOT / "tools" / "compare_oracle.py").rows_of
    df = entry.queries()[name](spark, FOLDER)
    cursor = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows_of(columns, cursor.fetchall())
    assert got
