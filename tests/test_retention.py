"""Purges and limits on stored logs touch only the files that they change."""

from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks import inputs as I
from partlog.operators import replay, retention
from partlog.plans.scratch import scratch_path
from partlog.sources import log, rewrite

LOST = "lost on the way"


@pytest.fixture
def stored(spark, small):
    path = scratch_path(spark, "log of messages")  # names with spaces are encoded in file paths
    log.write_log(replay.rekey(I.messages(spark, small), 3), path)
    return path


def files(path):
    return {str(p.relative_to(path)) for p in Path(path).rglob("part-*.parquet")}


def content(spark, path):
    return sorted(map(tuple, log.read_log(spark, path).collect()))


def purges(spark):
    return spark.createDataFrame([("LEDGER.00", 500), ("LEDGER.01", 5)], "subject string, purge_seq bigint")


def left_of(rows):
    return [r for r in rows if r[0] > {0: 500, 1: 5}.get(r[5], -1)]


def test_purge_replaces_only_files_with_purged_rows(spark, stored):
    before, rows = files(stored), content(spark, stored)
    assert retention.purge_log(spark, stored, purges(spark), "LEDGER") > 0
    assert content(spark, stored) == left_of(rows)
    after = files(stored)
    assert {f for f in before if "partition=2" in f} <= after
    # A second run finds nothing to do.
    assert retention.purge_log(spark, stored, purges(spark), "LEDGER") == 0
    assert files(stored) == after and not list(Path(stored).glob("_rewrite-*"))


def test_a_purge_of_all_leaves_an_empty_log(spark, stored):
    everything = spark.createDataFrame([(None, 10**9)], "subject string, purge_seq bigint")
    assert retention.purge_log(spark, stored, everything, "LEDGER") > 0
    assert content(spark, stored) == [] and files(stored) == set()


def test_retain_newest_on_a_stored_log(spark, stored):
    rows = content(spark, stored)
    newest = max(r[4] for r in rows)
    now = F.lit(datetime.fromtimestamp(newest / 1e9))
    assert retention.retain_log(spark, stored, now, "20 days", 300, span=64) > 0
    young = [r for r in rows if r[4] >= newest - 20 * 86_400 * 10**9]
    assert content(spark, stored) == sorted(young)[-300:] if len(young) > 300 else sorted(young)
    assert retention.retain_log(spark, stored, now, "20 days", 300, span=64) == 0


class Broken:
    """A file system whose given call fails for the n-th time."""

    def __init__(self, real, call, nth):
        self._real, self._call, self._left = real, call, nth

    def __getattr__(self, name):
        given = getattr(self._real, name)

        def counted(*args):
            if name == self._call:
                self._left -= 1
                if self._left < 0:
                    raise RuntimeError(LOST)
            return given(*args)

        return counted


@pytest.mark.parametrize("call, nth", [("create", 0), ("rename", 0), ("rename", 1), ("delete", 0), ("delete", 1)])
def test_a_failed_run_loses_nothing(spark, stored, monkeypatch, call, nth):
    rows = content(spark, stored)
    system = rewrite._file_system
    broken = Broken(system(spark, stored), call, nth)
    monkeypatch.setattr(rewrite, "_file_system", lambda *_: broken)
    with pytest.raises(RuntimeError, match=LOST):
        retention.purge_log(spark, stored, purges(spark), "LEDGER")
    monkeypatch.undo()
    assert set(left_of(rows)) <= set(content(spark, stored)) <= set(rows)
    retention.purge_log(spark, stored, purges(spark), "LEDGER")
    assert content(spark, stored) == left_of(rows)
