"""Purging stored files: what is untouched keeps its name; a failed run is finished."""

import datetime as dt
import os

import pytest

from postvet.sources import purge

DAY = dt.datetime(2024, 1, 1)
CUTOFF = dt.date(2024, 1, 5)


@pytest.fixture
def events(spark, tmp_path):
    path = str(tmp_path / "events")
    # One file for each span of days; user 9 is in the third only.
    for n, data in enumerate([
        [(1, 1, 0), (2, 2, 8)], [(3, 3, 9), (4, None, 9)], [(5, 9, 10), (6, 1, 10)], [(7, 2, 20)], [(8, 2, None)],
    ]):
        made = [(i, u, None if d is None else DAY + dt.timedelta(days=d)) for i, u, d in data]
        spark.createDataFrame(made, "event_id long, user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(path)
    return path


def files(path):
    return {name for name in os.listdir(path) if name.endswith(".parquet")}


def left(spark, path):
    return sorted(r.event_id for r in spark.read.parquet(path).collect())


def test_only_touched_files_are_written(spark, events):
    gone = spark.createDataFrame([(9,), (9,), (None,)], "user_id long")
    before = files(events)
    assert purge.purge_stored(spark, events, gone, CUTOFF) == 3
    assert left(spark, events) == [2, 3, 4, 6, 7]
    assert len(before & files(events)) == 2
    after = files(events)
    assert purge.purge_stored(spark, events, gone, CUTOFF) == 0 and files(events) == after


@pytest.mark.parametrize("step", ["delete", "rename"])
def test_a_failed_run_is_finished(spark, events, monkeypatch, step):
    gone = spark.createDataFrame([(9,)], "user_id long")
    real = purge._files

    class Broken:
        def __init__(self, fs):
            self.fs, self.calls = fs, 0

        def __getattr__(self, name):
            if name == step:
                self.calls += 1
                if self.calls > 1:
                    raise OSError("lost")
            return getattr(self.fs, name)

    broken = Broken(real(spark, events))
    # The first call clears an old journal.
    broken.calls = 0 if step == "rename" else -1
    monkeypatch.setattr(purge, "_files", lambda *_: broken)
    with pytest.raises(OSError):
        purge.purge_stored(spark, events, gone, CUTOFF)
        raise OSError("one file only")
    monkeypatch.setattr(purge, "_files", real)
    purge.purge_stored(spark, events, gone, CUTOFF)
    assert left(spark, events) == [2, 3, 4, 6, 7]
