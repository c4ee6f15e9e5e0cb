import datetime as dt

from pyspark.sql import functions as F

from quillmill.streaming import tasks as stream

T0 = dt.datetime(2024, 1, 1, 9)
ROWS = [("a", "queued", T0), ("a", "processing", T0 + dt.timedelta(minutes=1)), ("a", "processing", T0 + dt.timedelta(minutes=1)), ("b", "queued", T0), ("b", "ready", T0)]


def source(spark, tmp_path, rows=ROWS, name="in"):
    spark.createDataFrame(rows, "id string, status string, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return spark.readStream.schema("id string, status string, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))


def run(query, mode, name):
    q = query.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()


def test_latest_states(spark, tmp_path):
    run(stream.latest_states(source(spark, tmp_path)), "complete", "latest")
    assert {r["id"]: r["status"] for r in spark.table("latest").collect()} == {"a": "processing", "b": "ready"}


def test_windows_and_repeats(spark, tmp_path):
    run(stream.counts_by_window(source(spark, tmp_path)), "complete", "windows")
    assert sum(r["n"] for r in spark.table("windows").collect()) == 5
    run(stream.without_repeats(source(spark, tmp_path, name="in2")), "append", "once")
    assert spark.table("once").count() == 4


def test_watch_reports_timeouts(spark, tmp_path):
    later = [("z", "queued", T0 + dt.timedelta(hours=3))]
    source(spark, tmp_path)
    run(stream.watched(source(spark, tmp_path, later)), "update", "watch")
    got = [(r["id"], r["status"]) for r in spark.table("watch").collect()]
    assert ("a", "processing") in got and ("b", "ready") in got and ("a", "error") in got


def test_batches(spark, tmp_path):
    seen = []
    q = stream.apply_batches(source(spark, tmp_path), lambda df, n: seen.append((n, df.agg(F.count("*")).first()[0])), str(tmp_path / "cp"))
    q.awaitTermination()
    assert seen == [(0, 2)]


def test_state_over_several_batches(spark, tmp_path):
    """One file a micro-batch: the newest change wins, also if a later batch repeats an older one."""
    hour = dt.timedelta(hours=1)
    for rows in ([("a", "queued", T0), ("b", "queued", T0)], [("a", "ready", T0 + 2 * hour)], [("a", "processing", T0 + hour), ("b", "error", T0 + hour), ("a", "queued", T0)]):
        changes = source(spark, tmp_path, rows, "several")
    seen = {}

    def keep(batch, number):
        seen[number] = {r["id"]: r["status"] for r in batch.collect()}

    stream.apply_batches(changes, keep, str(tmp_path / "cp")).awaitTermination()
    final = {}
    for number in sorted(seen):
        final |= seen[number]
    assert len(seen) == 3 and final == {"a": "ready", "b": "error"}


def test_dispatch(spark, tmp_path):
    rows = [("1", "tags"), ("2", "questions"), ("3", "other"), ("4", None)]
    spark.createDataFrame(rows, "id string, task_type string").coalesce(1).write.parquet(str(tmp_path / "typed"))
    changes = spark.readStream.schema("id string, task_type string").parquet(str(tmp_path / "typed"))
    got = {}
    keep = lambda name: lambda batch, n: got.setdefault(name, []).extend(tuple(r) for r in batch.drop("task_type").orderBy("id").collect())
    stream.dispatched(changes, {k: keep(k) for k in ("tags", "questions", "error")}, str(tmp_path / "cp2")).awaitTermination()
    assert got == {"tags": [("1",)], "questions": [("2",)], "error": [("3", "Unknown task type: other"), ("4", "Unknown task type: null")]}
