"""All queries of the library by name, with the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

MODULES: list[str] = ["observations", "fires", "feeds", "quality", "fire_days", "indices", "directory", "ingest", "statistics", "selections", "geometry", "stores", "capabilities", "roundtrips", "causes"]


def queries() -> dict:
    out = {}
    for name in MODULES:
        out |= import_module(f"airstrata.plans.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for name in MODULES:
        out |= import_module(f"airstrata.plans.{name}").ORACLE
    return out
