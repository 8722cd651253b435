"""A look at a plan before it runs: what would hurt on a large cluster."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

#: A pattern of the physical plan, and what it means.
RULES = (
    ("CartesianProduct|BroadcastNestedLoopJoin", "every-pair join", "rows of both sides meet without a key; the work grows with their product"),
    (r"Exchange SinglePartition(?!.*partial)", "single partition", "all rows go to one task"),
    (r"Window \[[^\]]*\](?:, \[\])", "window without a partition", "a window over all rows runs in one task"),
    ("BatchEvalPython", "row-at-a-time Python", "each row goes through a Python function by itself"),
    ("CollectLimit", "rows to the driver", "the driver gathers rows of a limit"),
)
#: Nested unions and joins beyond these depths mean a loop that builds plans.
MOST_UNIONS, MOST_JOINS = 20, 20


@dataclass(frozen=True)
class Finding:
    rule: str
    count: int
    meaning: str


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def lint(df: DataFrame) -> list[Finding]:
    """Findings for a DataFrame's physical plan; nothing runs."""
    text = plan_text(df)
    out = [Finding(rule, len(hits), meaning) for pattern, rule, meaning in RULES if (hits := re.findall(pattern, text))]
    for pattern, most, rule in ((r"\bUnion\b", MOST_UNIONS, "many unions"), (r"\w+Join\b", MOST_JOINS, "many joins")):
        if (n := len(re.findall(pattern, text))) > most:
            out.append(Finding(rule, n, "the plan grows with a loop; write a table or take a checkpoint in between"))
    scans = re.findall(r"FileScan \w+ \[([^\]]*)\]", text)
    if len(scans) != len(set(scans)):
        out.append(Finding("repeated scans", len(scans), "the same columns are read more than once"))
    return out


def report(df: DataFrame, form: str = "plain") -> str:
    """Findings as plain text, JSON or CSV."""
    found = lint(df)
    if form == "json":
        import json

        return json.dumps([f.__dict__ for f in found])
    if form == "csv":
        return "\n".join(["rule,count,meaning", *(f'{f.rule},{f.count},"{f.meaning}"' for f in found)])
    return "\n".join(f"{f.rule} ({f.count}): {f.meaning}" for f in found) or "nothing found"
