"""Structured Streaming over crawl logs, links and clicks.

Each function takes a streaming DataFrame and returns one; sources and sinks are the
caller's.  Late rows are dropped behind the watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import urls as U
from ..operators.crawl import ERRORS
from ..session import file_system

STATE = "next_request_at long, backoff_until long, fail_streak int, seen long"
DOMAIN = "domain string, next_request_at long, backoff_until long, fail_streak int"


def timed(logs: DataFrame, seconds: str = "created_at") -> DataFrame:
    return logs.withColumn("ts", F.timestamp_seconds(seconds))


def status_windows(logs: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Attempts and errors per tumbling window and status."""
    return logs.withWatermark("ts", late).groupBy(F.window("ts", size), "status").agg(F.count("*").alias("attempts")).select(F.col("window.start").alias("start"), "status", "attempts")


def error_share(logs: DataFrame, size: str = "10 minutes", step: str = "1 minute", late: str = "1 hour", least: int = 20, share: float = 0.05) -> DataFrame:
    """Sliding windows in which so many attempts fail that someone should look."""
    n = logs.withWatermark("ts", late).groupBy(F.window("ts", size, step)).agg(F.count("*").alias("attempts"), F.count_if(F.col("status").isin(*ERRORS)).alias("errors"))
    return n.where((F.col("attempts") > least) & (F.col("errors") > share * F.col("attempts"))).select(F.col("window.start").alias("start"), "attempts", "errors")


def sessions(events: DataFrame, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), user).agg(F.count("*").alias("n")).select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_clicks(clicks: DataFrame, late: str = "1 day") -> DataFrame:
    """One click per impression and session; a missing session is one session."""
    return clicks.withColumn("session_hash", F.coalesce("session_hash", F.lit(""))).withWatermark("ts", late).dropDuplicatesWithinWatermark(["impression_id", "session_hash"])


def new_urls(found: DataFrame, late: str = "1 day") -> DataFrame:
    """Discovered URLs, each once within the watermark."""
    return found.withColumn("url_hash", U.url_hash("url")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["url_hash"])


def clicks_on_impressions(impressions: DataFrame, clicks: DataFrame, late: str = "1 hour") -> DataFrame:
    """Inner join of two streams within the time that a click may follow its impression."""
    i = impressions.withWatermark("shown_at", late).alias("i")
    c = clicks.withWatermark("clicked_at", late).alias("c")
    return i.join(c, F.expr("i.id = c.impression_id and c.clicked_at >= i.shown_at and c.clicked_at <= i.shown_at + interval 1 hour"))


def backoff(state: tuple, rows: list[tuple[int, bool]], delay: float = 1.0) -> tuple:
    """A domain's state after results (time, success) in order."""
    wait = max(1, -(-int(delay * 1000) // 1000))
    next_at, until, streak = state
    for at, ok in rows:
        if ok:
            next_at, until, streak = at + wait, None, 0
        else:
            streak += 1
            until = at + int(min(wait * 2 ** min(streak, 10), 3600))
    return next_at, until, streak


def domain_states(results: DataFrame, delay: float = 1.0, late: str = "1 day", expires: int = 30) -> DataFrame:
    """The state machine of each domain over a stream of (domain, at, ok); one row per domain and batch.

    Results older than the last one seen come too late to change the state.  A domain without results for
    `expires` days of event time is forgotten, and rows behind the watermark are dropped."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        *old, seen = state.get if state.exists else (None, None, 0, 0)
        rows = sorted((int(a), bool(o)) for p in parts for a, o in zip(p["at"], p["ok"]) if a >= seen)
        new = backoff(tuple(old), rows, delay)
        state.update((*new, max([seen, *(a for a, _ in rows)])))
        state.setTimeoutTimestamp(max((max([seen, *(a for a, _ in rows)]) + expires * 86_400) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *new)], columns=["domain", "next_request_at", "backoff_until", "fail_streak"]).astype({"next_request_at": "Int64", "backoff_until": "Int64", "fail_streak": "int32"})

    timed_results = results.withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", late)
    return timed_results.groupBy("domain").applyInPandasWithState(step, DOMAIN, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def versions(spark, path: str) -> list[int]:
    """Complete versions of a table kept by upsert_sink, on any file system."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return []
    names = [f.getPath() for f in fs.listStatus(p)]
    done = [x.getName() for x in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
    return sorted(int(x[2:]) for x in done if x.startswith("v="))


def current(spark, path: str) -> DataFrame:
    """The newest complete version."""
    return spark.read.parquet(f"{path}/v={versions(spark, path)[-1]}")


def upsert_sink(path: str, keys: list[str], order: list[str], keep: int = 2):
    """For foreachBatch: keeps the last writer of each key.

    Each batch writes a version of its own beside the last one; a version counts once its _SUCCESS mark stands, so readers never see
    half of it, a batch that runs again replaces its own, and nothing is renamed.  `keep` versions stay."""
    from ..operators.tables import upsert

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [v for v in versions(spark, path) if v < batch_id]
        old = spark.read.parquet(f"{path}/v={before[-1]}") if before else spark.createDataFrame([], batch.schema)
        upsert(old, batch, keys, order).write.mode("overwrite").parquet(f"{path}/v={batch_id}")
        for v in before[: max(0, len(before) + 1 - keep)]:
            fs, p = file_system(spark, f"{path}/v={v}")
            fs.delete(p, True)

    return write
