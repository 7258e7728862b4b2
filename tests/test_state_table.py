"""Deltas and merged runs equal a table kept in memory; ids are found where they are."""

import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partlog.plans import state_table
from partlog.plans.id_store import IdStore
from partlog.plans.scratch import scratch_path
from partlog.plans.state_table import StateTable

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])


def rows(spark, given):
    return spark.createDataFrame(given, SCHEMA)


def held(table, batch_id, keys=None):
    return {r.k: r.v for r in table.read(batch_id, keys).collect()}


def test_newest_rows_over_many_batches(spark, monkeypatch):
    rng = random.Random(2)
    table = StateTable(spark, scratch_path(spark, "state"), SCHEMA, ["k"], buckets=4, fan_in=3)
    want = {}
    assert table.latest() == -1 and held(table, -1) == {}
    for batch in range(10):
        changed = {rng.choice([None, *"abcdefghij"]): rng.randrange(1000) for _ in range(3)}
        gone = {k for k in rng.sample([*"abcdefghij"], 2)} - set(changed)
        table.commit(batch, rows(spark, list(changed.items())), rows(spark, [(k, None) for k in gone]))
        want = {k: v for k, v in {**want, **changed}.items() if k not in gone}
        assert held(table, batch) == want
        some = rows(spark, [("a", 0), (None, 0), ("nowhere", 0), ("a", 1)])
        assert held(table, batch, some) == {k: v for k, v in want.items() if k in ("a", None)}
        monkeypatch.setattr(state_table, "NAMED_KEYS", 1)
        assert held(table, batch, some) == {k: v for k, v in want.items() if k in ("a", None)}
        monkeypatch.undo()
        assert len(table.runs(batch)) <= 5
    assert table.latest() == 9 and len(table.runs(9)) == 2  # 10 batches: 9 and 1
    again = StateTable.opened(spark, table.path, ["k"], buckets=4)
    assert held(again, 9) == want


def test_a_batch_writes_what_it_changes(spark):
    """With 20,000 keys in the state, a batch of ten keys writes ten rows."""
    path = scratch_path(spark, "state")
    table = StateTable(spark, path, SCHEMA, ["k"], buckets=8)
    table.commit(0, rows(spark, [(f"k{n}", n) for n in range(20_000)]))
    size = lambda run: sum(p.stat().st_size for p in Path(table._folder(run)).rglob("*.parquet"))
    for batch in (1, 2, 3):
        table.commit(batch, rows(spark, [(f"k{batch * 10 + n}", -n) for n in range(10)]))
        assert size((batch, batch)) < size((0, 0)) / 10
        assert spark.read.parquet(table._folder((batch, batch))).count() == 10
    found = held(table, 3)
    assert len(found) == 20_000 and [found[f"k{10 + n}"] for n in range(10)] == [-n for n in range(10)]


def test_old_rows_go_when_runs_are_merged(spark):
    table = StateTable(spark, scratch_path(spark, "state"), SCHEMA, ["k"], buckets=2, fan_in=2)
    table.commit(0, rows(spark, [("a", 1), ("b", 9)]))
    table.commit(1, rows(spark, [("c", 2)]), expired=F.col("v") < 5)
    assert held(table, 1) == {"b": 9}
    assert {r.k: r.v for r in table.read_where(1, F.col("v") > 5).collect()} == {"b": 9}
    table.commit(2, rows(spark, [("b", 3)]))
    # An older row of the key still passes the filter, the newest one does not.
    assert table.read_where(2, F.col("v") > 5).collect() == []


@pytest.mark.parametrize("lost", ["delta", "merged run", "list", "removal"])
def test_a_repeated_commit_changes_nothing(spark, monkeypatch, lost):
    table = StateTable(spark, scratch_path(spark, "state"), SCHEMA, ["k"], buckets=2, fan_in=2)
    for batch in range(3):
        table.commit(batch, rows(spark, [("a", batch), (f"k{batch}", batch)]))
    before = held(table, 2)
    write, writes = StateTable._write, Counter()

    def fails(self, given, run):
        write(self, given, run)
        writes[run] += 1
        if run == {"delta": (3, 3), "merged run": (0, 3)}.get(lost):
            raise RuntimeError("lost")

    def broken(*_):
        raise RuntimeError("lost")

    if lost == "list":
        monkeypatch.setattr(StateTable, "_manifest", lambda self, n: broken() if n == 3 else f"{self.path}/manifest/{n}")
    elif lost == "removal":
        monkeypatch.setattr(state_table, "remove", broken)
    else:
        monkeypatch.setattr(StateTable, "_write", fails)
    new = rows(spark, [("a", 30), ("new", 31)])
    with pytest.raises(Exception):
        table.commit(3, new)
    monkeypatch.undo()
    assert held(table, 2) == before
    table.commit(3, new)
    table.commit(3, new)
    assert held(table, 3) == {**before, "a": 30, "new": 31}
    assert table.runs(3) == [(0, 3)]


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_known_ids(spark):
    schema = T.StructType([T.StructField("id", T.StringType())])
    store = IdStore(spark, scratch_path(spark, "ids"), schema, buckets=4, fan_in=2)
    assert store.known(-1, ids(spark, ["a"])).collect() == []
    for batch in range(4):
        store.add(batch, ids(spark, [f"{batch}-{n}" for n in range(2_000)] + [None, "again"]))
    asked = [f"{b}-{n}" for b in (0, 2, 3, 9) for n in range(0, 4_000, 7)] + [None, "again", "never"]
    want = {a for a in asked if a in (None, "again") or (int(a.split("-")[-1] if "-" in a else 9_999) < 2_000 and a[0] != "9")}
    found = [r.id for r in store.known(3, ids(spark, asked)).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_new_ids_open_few_buckets_and_files_do_not_grow(spark):
    """After 3 and after 13 batches, a batch of new ids reads about as many files, and hardly a bucket."""
    schema = T.StructType([T.StructField("id", T.StringType())])
    store = IdStore(spark, scratch_path(spark, "ids"), schema, buckets=16, fan_in=2)
    files = []
    new = ids(spark, [f"new-{n}" for n in range(300)])
    for batch in range(13):
        store.add(batch, ids(spark, [f"{batch}-{n}" for n in range(400)]))
        if batch in (2, 12):
            likely = store.likely(batch, new)
            assert likely.count() <= 12
            files.append(len(store.read(batch, likely).inputFiles()))
            assert len(store.runs(batch)) <= 3
    assert max(files) <= 3 * 16
