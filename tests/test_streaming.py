"""Streams over files, run to their end, against the batch operators."""

from pyspark.sql import functions as F

from loomspark.operators import crawl
from loomspark.streaming import crawl as S


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def test_domain_states(spark, tmp_path):
    rows = [("d", i, 100 + i, False) for i in range(1, 4)] + [("e", 1, 5, False), ("e", 2, 6, True)]
    batch = spark.createDataFrame(rows, "domain string, id int, at long, ok boolean")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    run(S.domain_states(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))), "states", "update")
    got = {r.domain: r for r in spark.table("states").collect()}
    for r in crawl.domain_states(batch).collect():
        assert (got[r.domain].fail_streak, got[r.domain].backoff_until) == (r.fail_streak, r.backoff_until)


def test_windows(spark, data):
    logs = spark.read.parquet(f"{data}/crawl_logs.parquet")
    stream = S.timed(spark.readStream.schema(logs.schema).parquet(f"{data}/crawl_logs.parquet*"))
    run(S.status_windows(stream), "windows", "complete")
    want = S.timed(logs).groupBy(F.window("ts", "1 hour"), "status").count().count()
    assert spark.table("windows").count() == want


def test_clicks(spark, tmp_path):
    rows = [("i1", "s", "2024-01-01 00:00:00"), ("i1", "s", "2024-01-01 00:00:01"), ("i1", None, "2024-01-01 00:00:02")]
    df = spark.createDataFrame(rows, "impression_id string, session_hash string, t string").withColumn("ts", F.to_timestamp("t"))
    df.coalesce(1).write.parquet(str(tmp_path / "c"))
    run(S.first_clicks(spark.readStream.schema(df.schema).parquet(str(tmp_path / "c"))), "clicks")
    assert spark.table("clicks").count() == 2


def test_upsert(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, at int, v string")
    write = S.upsert_sink(str(tmp_path / "t"), ["k"], ["at"])
    write(df, 0)
    write(spark.createDataFrame([("a", 1, "late"), ("b", 1, "z")], df.schema), 1)
    assert sorted(map(tuple, S.current(spark, str(tmp_path / "t")).collect())) == [("a", 2, "y"), ("b", 1, "z")]
