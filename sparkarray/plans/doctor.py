"""Watches how arrays are used by a program, and names habits that a distributed engine pays dearly for.

``with watch() as seen: ...`` counts; ``findings(seen)`` tells. What a single plan shows is the lint's business.
"""

from __future__ import annotations

import builtins
import sys
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

from sparkarray import array
from sparkarray.array import SparkArray
from sparkarray.plans.lint import Finding

#: Uses of one line of a program from which they count as a loop.
REPEATED = 10
MEANINGS = {
    "item": ("repeated items", "each item() is a job of its own; take the cells together with take or to_numpy"),
    "nonzero": ("nonzero", "the number of hits is counted by a job before the plan goes on; a mask or where needs none"),
    "builtin": ("builtin reduction", "Python's own max, min, sum, any or all walks the array slice by slice; the array's methods are one aggregate"),
    "iteration": ("iteration", "every step is a plan of its own over the whole array; an operator along the axis is one plan"),
}
_BUILTINS = ("max", "min", "sum", "any", "all", "sorted")


def _line() -> tuple[str, int]:
    frame = sys._getframe(2)
    while frame and "sparkarray" in frame.f_code.co_filename.replace("\\", "/").split("/"):
        frame = frame.f_back
    return (frame.f_code.co_filename, frame.f_lineno) if frame else ("", 0)


@contextmanager
def watch() -> Iterator[Counter]:
    """Counts (kind, file, line) of the uses inside."""
    seen: Counter = Counter()
    inside: list[str] = []

    def count(kind: str) -> None:
        if not (kind == "iteration" and inside):
            seen[kind, *_line()] += 1

    def wrapped(f):
        def run(*a, **k):
            if not a or not isinstance(a[0], SparkArray):
                return f(*a, **k)
            seen["builtin", *_line()] += 1
            inside.append("")
            try:
                return f(*a, **k)
            finally:
                inside.pop()

        return run

    plain = {n: getattr(builtins, n) for n in _BUILTINS}
    array.watchers.append(count)
    for n, f in plain.items():
        setattr(builtins, n, wrapped(f))
    try:
        yield seen
    finally:
        for n, f in plain.items():
            setattr(builtins, n, f)
        array.watchers.remove(count)


def findings(seen: Counter) -> list[Finding]:
    out = []
    for kind, (rule, meaning) in MEANINGS.items():
        hits = {k: n for k, n in seen.items() if k[0] == kind and (kind != "item" or n >= REPEATED)}
        if hits:
            (_, file, line), _ = max(hits.items(), key=lambda x: x[1])
            out.append(Finding(rule, sum(hits.values()), f"{meaning} (most at {file}:{line})"))
    return out
