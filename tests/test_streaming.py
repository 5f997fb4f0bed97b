"""Streaming forms give the rows of their batch forms."""

from pyspark.sql import functions as F

from tesserae.streaming import jobs


def test_alerts_and_state(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    folder = str(tmp_path / "in")
    events.repartition(3, "event_id").write.parquet(folder)
    stream = jobs.event_stream(spark, folder, events.schema)
    q = jobs.alerts(stream, 50.0).writeStream.format("memory").queryName("alerts_out").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("alerts_out").count() == jobs.alerts(events, 50.0).count()
    q = jobs.latest_state(jobs.event_stream(spark, folder, events.schema), str(tmp_path / "state"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    last = max(int(p.name[1:]) for p in (tmp_path / "state").iterdir())
    got = {r["user_id"]: r["event_id"] for r in spark.read.parquet(str(tmp_path / f"state/v{last}")).collect()}
    assert got == {r["user_id"]: r["m"] for r in events.groupBy("user_id").agg(F.max("event_id").alias("m")).collect()}


def test_windowed_counts_drop_late_rows(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    folder = str(tmp_path / "in")
    events.coalesce(1).write.parquet(folder)
    q = jobs.windowed_counts(jobs.event_stream(spark, folder, events.schema)).writeStream.format("memory").outputMode("complete").queryName("counts_out").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("counts_out").agg(F.sum("n")).first()[0] == events.count()
