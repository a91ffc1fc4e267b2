"""Due projects kept by timers against the same question over whole tables."""

import datetime as dt

from pyspark.sql import functions as F

from graphloom.streaming import due_state, polling

T = dt.datetime(2024, 1, 1)
SCHEMA = "project string, at timestamp, minutes int, enabled boolean"


def at(minutes, **kw):
    return T + dt.timedelta(minutes=minutes, **kw)


class Run:
    """A stream over a folder that is fed batch by batch; each step restarts it from its checkpoint."""

    def __init__(self, spark, folder, **kw):
        self.spark, self.folder, self.kw = spark, folder, kw
        (folder / "in").mkdir()

    def step(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(self.folder / "in"))
        stream = self.spark.readStream.schema(SCHEMA).parquet(str(self.folder / "in"))
        due_state.start_log(due_state.due_log(stream, **self.kw), str(self.folder / "log"), str(self.folder / "state")).awaitTermination(120)
        self.log = self.spark.read.schema(due_state.LOG).parquet(str(self.folder / "log"))
        return {r["project"]: r["last_checked"] for r in due_state.due_now(self.log).collect()}


def test_timers_late_rows_and_settings(spark, tmp_path):
    run = Run(spark, tmp_path, minutes=60, late="10 minutes")
    check = lambda p, m, **kw: (p, at(m, **kw), None, None)
    assert run.step([check("a", 0), check("b", 30), ("new", at(0), 5, None), ("off", at(0), None, False), (None, at(0), None, None), ("a", None, None, None)]) == {"new": None}
    assert run.step([check("clock", 69)]) == {"new": None}  # now is 59
    assert run.step([check("clock", 70)]) == {"a": at(0), "new": None}  # now is 60: an hour after a's check, exactly
    assert run.step([check("a", 62), check("a", 61), check("new", 64)]) == {}  # the newer of two holds
    assert run.step([check("b", 85), check("clock", 95)]) == {"new": at(64)}  # b in time; new has five minutes
    assert run.step([check("b", 50), ("new", at(96), 60, None)]) == {}  # a check behind the last one changes nothing; settings do
    assert run.step([("off", at(97), None, True), ("a", at(97), None, False)]) == {"off": None}
    assert run.step([check("clock", 400)]) == {"b": at(85), "new": at(64), "off": None}  # clock itself is ten behind
    seqs = [tuple(r) for r in run.log.groupBy("project").agg(F.count("*"), F.max("seq"), F.countDistinct("seq")).collect()]
    assert all(n == top == distinct for _, n, top, distinct in seqs)


def test_equals_the_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    checks = events.select(F.col("user_id").cast("string").alias("project"), F.col("ts").cast("timestamp").alias("at"), F.lit(None).cast("int").alias("minutes"), F.lit(None).cast("boolean").alias("enabled"))
    checks.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    due_state.start_log(due_state.due_log(stream, late="60 days"), str(tmp_path / "log"), str(tmp_path / "state")).awaitTermination(200)
    assert due_state.due_now(spark.read.schema(due_state.LOG).parquet(str(tmp_path / "log"))).count() == 0  # now is before all of them
    run = [(f"{tmp_path}/in", "2024-03-31 00:00:00")]
    late = spark.createDataFrame([("clock", dt.datetime(2024, 3, 31), None, None)], SCHEMA)
    late.coalesce(1).write.mode("append").parquet(run[0][0])
    due_state.start_log(due_state.due_log(stream, late="60 days"), str(tmp_path / "log"), str(tmp_path / "state")).awaitTermination(200)
    got = {(r["project"], str(r["last_checked"])) for r in due_state.due_now(spark.read.schema(due_state.LOG).parquet(str(tmp_path / "log"))).collect()}
    want = {(str(r["user_id"]), r["last_checked"]) for r in polling.due_projects(events.withColumn("ts", F.date_trunc("second", "ts").cast("timestamp_ntz")), "2024-01-31 00:00:00").collect()}
    assert {(p, x[:19]) for p, x in got} == want and want


def test_the_registry_feeds_the_stream(spark, tmp_path):
    from graphloom.plans.entries import Project, Projects, Settings

    path = str(tmp_path / "projects.toml")
    kept = Projects(path)
    kept.settings.check_interval_minutes = 30
    for id_ in ("never", "once", "off"):
        kept.add(Project(id_, id_, str(tmp_path), settings={"registry_only": False} if id_ == "once" else {}))
    for minute in (5, 1):
        kept.checked("once", at(minute).replace(tzinfo=dt.UTC))
    kept.enable("off", False)
    kept.save()
    again = Projects(path)
    assert again.items == kept.items and again.settings == Settings(check_interval_minutes=30)
    assert [again.setting(x, "registry_only") for x in ("never", "once")] == [True, False]
    run = Run(spark, tmp_path, late="0 seconds")
    own = lambda m: [*again.watched(spark, at(0)).collect(), ("clock", at(m), None, None)]
    assert run.step(own(34)) == {"never": None}
    assert run.step([("clock", at(35), None, None)]) == {"never": None, "once": at(5)}
