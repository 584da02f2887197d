"""Configuration files: lists of rules and evaluation cases, validated, as Python objects or rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

CASE = "query string, query_type string, expected string, notes string, judgments array<struct<relevance:int,url:string,domain:string,path_prefix:string,title_terms:array<string>,notes:string>>"


def read_rules(path: str) -> dict:
    """A JSON or YAML file; YAML needs its library and is left to it."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yml", ".yaml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML files need the yaml package; use JSON") from e
        return yaml.safe_load(text)
    return json.loads(text)


def problems(cases: list[dict]) -> list[str]:
    """What is wrong with a list of evaluation cases."""
    out, seen = [], set()
    for i, c in enumerate(cases):
        query = str(c.get("query") or "").strip().lower()
        if not query:
            out.append(f"case {i}: no query")
        elif query in seen:
            out.append(f"case {i}: query {query!r} occurs twice")
        seen.add(query)
        for j, g in enumerate(c.get("judgments") or []):
            if not isinstance(g.get("relevance"), int):
                out.append(f"case {i}, judgment {j}: no relevance")
            if not any(g.get(k) for k in ("url", "domain", "path_prefix", "title_terms")):
                out.append(f"case {i}, judgment {j}: matches everything")
    return out


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a JSON file as rows; of equal queries the first counts."""
    rows, seen = [], set()
    for c in read_rules(path).get("cases", []):
        key = str(c.get("query") or "").strip().lower()
        if key and key not in seen:
            seen.add(key)
            rows.append({"query": c["query"], "query_type": c.get("query_type"), "expected": c.get("expected"), "notes": c.get("notes"), "judgments": [{k: g.get(k) for k in ("relevance", "url", "domain", "path_prefix", "title_terms", "notes")} for g in c.get("judgments") or []]})
    return spark.createDataFrame(rows, CASE)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
