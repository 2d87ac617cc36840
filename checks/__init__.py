"""Registered queries with their DuckDB counterparts; each reads whole tables."""

from importlib import import_module

MODULES = (
    "profile_checks", "sensitivity_checks", "relation_checks", "statement_checks", "compare_checks",
)


def all_registries():
    return [import_module(f"checks.{name}").registry for name in MODULES]
