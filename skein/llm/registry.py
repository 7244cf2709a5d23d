"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("mixing", "warc", "ann", "sketch", "toxicity", "packing", "url_rules", "sharding", "simhash", "substrings", "importance", "quality", "divergence")


def _gather(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"{__package__}.{name}"), what)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("SQL")
