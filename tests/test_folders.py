"""Keyed folders: the same rows as a whole rewrite, and files left alone."""

from pathlib import Path

import pytest

from skillweft.operators import rewrite as rw
from skillweft.sources.folders import KeyedFolders


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def by_folder(path):
    found = {}
    for name, at in files(path).items():
        found.setdefault(int(name.split("/")[0].split("=")[1]), set()).add((name, at))
    return found


@pytest.fixture
def table(spark, tmp_path):
    rows = [(i, f"name{i}", None if i % 3 else "x") for i in range(200)] + [(None, "nobody", "y"), (7, "again", None)]
    df = spark.createDataFrame(rows, "id bigint, name string, size string")
    return df, KeyedFolders.create(df, str(tmp_path / "t"), "id", folders=16)


def same(df, other):
    return sorted(map(repr, df.collect())) == sorted(map(repr, other.collect()))


def test_change_equals_the_whole_rewrite_and_leaves_other_folders(spark, table):
    df, stored = table
    assert same(stored.read(), df)
    before = by_folder(stored.path)
    patches = spark.createDataFrame([(5, "five"), (6, "six"), (900, "none")], "id int, name string")
    written = stored.change(patches, lambda rows, incoming: rw.patch(rows, incoming, "id"))
    assert same(stored.read(), rw.patch(df, patches, "id"))
    after = by_folder(stored.path)
    assert 1 <= len(written) <= 2 and len(before) == 16
    for number in before:
        assert (before[number] == after[number]) == (number not in written)


def test_a_repeated_change_writes_nothing(spark, table):
    _, stored = table
    incoming = spark.createDataFrame([(5, "five", "s"), (1000, "new", None)], "id bigint, name string, size string")
    change = lambda rows, new: rw.upsert(rows, new, "id", ["name"], ["size"])
    assert stored.change(incoming, change)
    before, rows = files(stored.path), stored.read().count()
    assert stored.change(incoming, change) == []
    assert files(stored.path) == before and stored.read().count() == rows == 203
    assert stored.change(incoming.limit(0), change) == []


def test_folders_that_lose_all_rows_go(spark, table):
    df, stored = table
    keys = df.select("id").filter("id < 150")
    stored.change(keys, lambda rows, gone: rw.delete_keys(rows, gone, "id"))
    assert same(stored.read(), df.filter("id is null or id >= 150"))
    everyone = df.select("id").filter("id is not null")
    stored.change(everyone, lambda rows, gone: rw.delete_keys(rows, gone, "id"))
    assert [tuple(r) for r in stored.read().collect()] == [(None, "nobody", "y")]
    assert len(by_folder(stored.path)) == 1
