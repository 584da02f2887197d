"""robots.txt rules as a table function: (host, body) and the URLs to test."""

from __future__ import annotations

from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U


def _rules(body: str | None) -> RobotFileParser:
    p = RobotFileParser()
    p.parse((body or "").splitlines())
    return p


def allowed(urls: DataFrame, robots: DataFrame, agent: str = "loomspark") -> DataFrame:
    """(url, allowed, crawl_delay); hosts without rules allow everything.  Rules are parsed once per text and batch."""

    @F.pandas_udf("allowed boolean, crawl_delay double")
    def test(url: pd.Series, body: pd.Series) -> pd.DataFrame:
        parsed: dict[str, RobotFileParser] = {}
        rows = []
        for u, b in zip(url, body):
            if b is None or u is None:
                rows.append((True, None))
                continue
            p = parsed.get(b)
            if p is None:
                p = parsed[b] = _rules(b)
            rows.append((p.can_fetch(agent, u), float(d) if (d := p.crawl_delay(agent)) else None))
        return pd.DataFrame(rows, columns=["allowed", "crawl_delay"])

    named = urls.select("url").distinct().withColumn("_host", U.host("url"))
    joined = named.join(robots.select(F.col("host").alias("_host"), "body").dropDuplicates(["_host"]), "_host", "left")
    return joined.select("url", test("url", "body").alias("r")).select("url", "r.allowed", "r.crawl_delay")
