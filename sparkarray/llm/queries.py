"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

#: In the order of the operators' numbers.
MODULES = ("mixing", "suffix_dedup", "lm", "quality", "minhash", "chat", "licenses", "pii", "packing", "embed_dedup")


def _modules():
    return [import_module(f"sparkarray.llm.{m}") for m in MODULES]


def queries() -> dict:
    out = {}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for m in _modules():
        out.update(m.ORACLE)
    return out
