"""Sinks for results and evidence: a page, a ledger, captured plans, and fixtures that are reused only if their source is unchanged."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.relational import fingerprint

from .tables import Store


def as_table(df: DataFrame, most_rows: int = 200) -> str:
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{'' if v is None else html.escape(str(v))}</td>" for v in row) + "</tr>" for row in df.limit(most_rows).collect())
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def write_page(path: str | Path, title: str, results: dict[str, DataFrame], most_rows: int = 200) -> None:
    """One page with a section for each result. Any query that fails stops the page."""
    sections = "".join(f"<section><h2>{html.escape(n)}</h2>{as_table(df, most_rows)}</section>" for n, df in results.items())
    Path(path).write_text(f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{sections}", "utf-8")


def write_ledger(path: str | Path, **entries) -> None:
    Path(path).write_text(json.dumps(entries, indent=1, sort_keys=True, default=str), "utf-8")


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    spark = df.sparkSession
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def plan_facts(df: DataFrame) -> dict[str, object]:
    """What a plan does, as numbers that reproduce where a clock doesn't."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return {
        "exchanges": len(re.findall(r"\bExchange (?!.*Broadcast)", text)), "broadcasts": text.count("BroadcastExchange"), "sort_merge_joins": text.count("SortMergeJoin"), "hash_joins": text.count("BroadcastHashJoin"), "nested_loops": text.count("NestedLoopJoin"), "windows": len(re.findall(r"\bWindow \[", text)), "python": bool(re.search("Python|Arrow|Pandas", text)),
        "partition_filters": re.findall(r"PartitionFilters: \[([^\]]*)\]", text), "pushed_filters": re.findall(r"PushedFilters: \[([^\]]*)\]", text),
    }


def fixture(store: Store, name: str, source: DataFrame, columns: Sequence[str], build: Callable[[SparkSession], DataFrame]) -> tuple[DataFrame, bool]:
    """(table, built anew): the stored table if it was built from a source with this fingerprint and still has its rows; the provenance is written last."""
    spark = store.spark
    seen = fingerprint(source, columns).first()
    if store.exists("perf", name) and store.exists("perf", f"{name}_provenance"):
        p = store.read("perf", f"{name}_provenance").first()
        table = store.read("perf", name)
        if (p["n"], p["checksum"], p["rows"]) == (seen["n"], str(seen["checksum"]), table.count()):
            return table, False
    table = store.write(build(spark), "perf", name)
    store.write(spark.createDataFrame([(seen["n"], str(seen["checksum"]), table.count())], "n long, checksum string, rows long"), "perf", f"{name}_provenance")
    return table, True
