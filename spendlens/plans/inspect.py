"""Plan checks: what a reviewer looks for in ``explain("formatted")``, as numbers."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def plan_summary(df: DataFrame) -> dict:
    """Counts of shuffles and risky operators plus the columns each scan reads."""
    text = plan_text(df)
    tree = text.split("\n\n")[0]
    return {
        "exchanges": len(re.findall(r"\bExchange\b", tree)),  # shuffles (BroadcastExchange does not match)
        "broadcasts": len(re.findall(r"BroadcastExchange", tree)),
        "single_partition_exchanges": len(re.findall(r"SinglePartition", text)),
        "cartesian": len(re.findall(r"CartesianProduct|BroadcastNestedLoopJoin", tree)),
        "python_udfs": len(re.findall(r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas", tree)),
        "scans": [(loc, schema) for loc, schema in
                  re.findall(r"Location: \w+ \[([^\]]+)\][^\n]*\n(?:[^\n]*\n)*?ReadSchema: (struct<[^\n]*>)", text)],
    }


def executed_scans(df: DataFrame) -> dict[str, int]:
    """Runs ``df`` and counts how often its final plan, subqueries included, scans each file or folder; reused shuffles
    count once.
    """
    df.collect()
    text = plan_text(df)
    final = re.findall(r"== Final Plan ==\n(.*?)\+- == Initial Plan ==", text, re.S) or [text.split("\n\n")[0]]
    counts: dict[str, int] = {}
    for node in {n for tree in final for n in re.findall(r"Scan parquet\s+\((\d+)\)", tree)}:
        location = re.search(rf"\n\({node}\) Scan parquet[^\n]*\n(?:[^\n]+\n)*?Location: \w+ \[([^\],]+)", text)[1]
        name = location.rstrip("/").split("/")[-1]
        counts[name] = counts.get(name, 0) + 1
    return counts
