import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from panescan.streaming import monitors

START = dt.datetime(2024, 1, 1)


def files(spark, folder, batches, ddl):
    """Each batch as one JSON file, so a trigger of one file is one micro-batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").json(str(folder))
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(folder))


def test_stream_images(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("a.bmp", "b.png", "c.txt"):
        (folder / name).write_bytes(b"12345")
    out = monitors.drain(monitors.stream_images(spark, str(folder), max_files=1), str(tmp_path / "run"))
    rows = out.select(F.substring_index("path", "/", -1).alias("name"), "length").collect()
    assert sorted((r["name"], r["length"]) for r in rows) == [("a.bmp", 5), ("b.png", 5)]


def test_late_rows_are_dropped(spark, tmp_path):
    at = lambda m: START + dt.timedelta(minutes=m)
    # the late-row filter of a batch uses the mark of the batch before, hence two batches in between
    batches = [[(at(1), 1.0), (at(5), 3.0)], [(at(60), 9.0)], [(at(61), 11.0)], [(at(2), 100.0)], [(at(120), 1.0)]]
    stream = files(spark, tmp_path / "in", batches, "ts timestamp, value double")
    out = monitors.drain(monitors.running_summary(stream, "value"), str(tmp_path / "run")).orderBy("window_start").collect()
    assert [(r["n"], r["avg"]) for r in out] == [(2, 2.0), (2, 10.0)]  # the 100 came too late


def test_memory_state_survives_batches(spark, tmp_path):
    at = lambda m: START + dt.timedelta(minutes=m)
    batches = [[(1, at(1), 1, 10.0), (1, at(2), 2, 15.0)], [(1, at(3), 3, 200.0), (2, at(3), 1, 5.0)]]
    stream = files(spark, tmp_path / "in", batches, "run_id long, ts timestamp, tie long, mb double")
    rows = monitors.drain(monitors.memory_alarms(stream, 100.0), str(tmp_path / "run")).collect()
    got = sorted((r["run_id"], r["first_mb"], r["peak_mb"], r["alarm"]) for r in rows)
    assert got == [(1, 10.0, 15.0, False), (1, 10.0, 200.0, True), (2, 5.0, 5.0, False)]


def test_early_stop_state_survives_batches(spark, tmp_path):
    batches = [[(1, e, v) for e, v in enumerate([5.0, 4.0, 4.5])], [(1, 3, 4.4), (1, 4, 4.3), (1, 5, 0.1)], [(2, 0, 1.0)]]
    stream = files(spark, tmp_path / "in", batches, "run_id long, epoch long, value double")
    rows = monitors.drain(monitors.early_stops(stream, 3), str(tmp_path / "run")).collect()
    assert [(r["run_id"], r["stop_epoch"]) for r in rows] == [(1, 4)]


def test_early_stop_folds_a_long_batch_in_order(spark, tmp_path):
    """One run brings 45,000 epochs in one micro-batch, out of order and in several chunks."""
    order = [e * 7919 % 45_000 for e in range(45_000)]
    values = lambda e: 1000.0 - e if e < 30_000 and e != 12_345 else 5000.0
    stream = files(spark, tmp_path / "in", [[(1, e, values(e)) for e in order], [(2, 0, 1.0)]], "run_id long, epoch long, value double")
    rows = monitors.drain(monitors.early_stops(stream, 100, 0.5), str(tmp_path / "run")).collect()
    assert [(r["run_id"], r["stop_epoch"]) for r in rows] == [(1, 30_099)]


def test_provider_setting_comes_back(spark):
    spark.conf.unset(monitors.PROVIDER)
    former = spark.conf.get(monitors.PROVIDER)  # the built-in default
    with monitors.rocksdb_state(spark):
        assert spark.conf.get(monitors.PROVIDER) == monitors.ROCKSDB
    assert spark.conf.get(monitors.PROVIDER) == former


def test_files_of_a_batch_are_listed_in_few_tasks(spark, tmp_path, monkeypatch):
    """Each task of a listing reports to the driver, so a task per photo grows with the photos."""
    started, start, n = [], DataStreamWriter.start, 2 * spark.sparkContext.defaultParallelism + 40
    monkeypatch.setattr(DataStreamWriter, "start", lambda self, *a, **k: started.append(start(self, *a, **k)) or started[-1])
    (tmp_path / "in").mkdir()
    for i in range(n):
        (tmp_path / "in" / f"p{i}.bmp").write_bytes(b"BM%d" % i)
    rows = monitors.stream_images(spark, str(tmp_path / "in"), "*.bmp", max_files=n).select("path", "length", "content")
    out = monitors.drain(rows, str(tmp_path / "out"))
    assert sorted(bytes(r["content"]) for r in out.collect()) == sorted(b"BM%d" % i for i in range(n))
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(str(started[0].runId))]
    tasks = [tracker.getStageInfo(s).numTasks for j in jobs for s in j.stageIds]
    assert len(tasks) >= 2 and max(tasks) < n
    assert spark.conf.get(monitors.LISTING) == "10000"


def photos(path, ids):
    path.mkdir(exist_ok=True)
    for i in ids:
        (path / f"p{i}.bmp").write_bytes(b"BM%d" % i)


def arrived(spark, tmp_path, max_files):
    rows = monitors.stream_images(spark, str(tmp_path / "in"), "*.bmp", max_files=max_files).select("path", "length", "content")
    return sorted(int(bytes(r["content"])[2:]) for r in monitors.drain(rows, str(tmp_path / "run")).collect())


def test_files_of_a_batch_are_read_in_few_tasks(spark, tmp_path, monkeypatch):
    """Each task of a batch starts a file of its own; the default is a task for some thirty photos."""
    started, start, cores = [], DataStreamWriter.start, spark.sparkContext.defaultParallelism
    monkeypatch.setattr(DataStreamWriter, "start", lambda self, *a, **k: started.append(start(self, *a, **k)) or started[-1])
    photos(tmp_path / "in", range(50 * cores))
    assert arrived(spark, tmp_path, 50 * cores) == list(range(50 * cores))
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(str(started[0].runId))]
    assert max(tracker.getStageInfo(s).numTasks for j in jobs for s in j.stageIds) <= cores
    assert len(list((tmp_path / "run/out").glob("*.parquet"))) <= cores


@pytest.mark.parametrize("former", [None, {}])
def test_a_stream_goes_on_where_it_stopped(spark, tmp_path, monkeypatch, former):
    """Also from a checkpoint of the default settings, and over the compaction of its log."""
    photos(tmp_path / "in", range(12))
    with monkeypatch.context() as m:
        if former is not None:
            m.setattr(monitors, "batch_settings", lambda *a: former)
        assert arrived(spark, tmp_path, 1) == list(range(12))
    log = tmp_path / "run/state/sources/0"
    assert bool(list(log.glob("*.compact"))) == (former is not None)
    for more in (range(12, 15), range(15, 27)):
        photos(tmp_path / "in", more)
        assert arrived(spark, tmp_path, 1) == list(range(more.stop))
    assert spark.read.parquet(str(tmp_path / "run/out")).count() == 27


def test_log_of_files_grows_over_its_compactions(spark, tmp_path, monkeypatch):
    settings = monitors.batch_settings
    faster = {monitors.COMPACTION: "4"} | dict.fromkeys(monitors.CLEANUP, "0s")
    monkeypatch.setattr(monitors, "batch_settings", lambda *a: settings(*a) | faster)
    for n in (10, 11, 17):
        photos(tmp_path / "in", range(n))
        assert arrived(spark, tmp_path, 1) == list(range(n))
    log = tmp_path / "run/state/sources/0"
    assert (log / "15.compact").exists()


def test_logs_in_local_folders_are_renamed(spark, tmp_path):
    found = monitors.batch_settings(spark, str(tmp_path))
    assert found[monitors.MANAGER] == monitors.LOCAL_MANAGER and found == monitors.batch_settings(spark, f"file://{tmp_path}")
    assert monitors.MANAGER not in monitors.batch_settings(spark, "http://localhost/run")
    with monitors.setting(spark, monitors.MANAGER, "of.ones.Own"):
        assert monitors.MANAGER not in monitors.batch_settings(spark, str(tmp_path))
    photos(tmp_path / "in", range(3))
    former = {key: spark.conf.get(key, None) for key in found}
    assert arrived(spark, tmp_path, 2) == [0, 1, 2]
    assert {key: spark.conf.get(key, None) for key in found} == former
