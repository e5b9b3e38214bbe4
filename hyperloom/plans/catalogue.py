"""Collects the named plans of this package: each is a Spark query and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
_PLANS: dict[str, tuple[Plan, str | None]] = {}


def plan(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Registers a query under a name, with the SQL that must give the same rows."""

    def add(f: Plan) -> Plan:
        if name in _PLANS:
            raise ValueError(f"two plans are named {name}")
        _PLANS[name] = (f, sql)
        return f

    return add


def _load() -> None:
    from importlib import import_module

    for module in MODULES:
        import_module(f"hyperloom.plans.{module}")


MODULES: tuple[str, ...] = ("relational", "folded", "corpora", "outside", "building", "searching", "testing", "layers", "files", "replies", "wording", "channels", "stored", "upkeep", "pairs")


def queries() -> dict[str, Plan]:
    _load()
    return {k: f for k, (f, _) in _PLANS.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: s for k, (_, s) in _PLANS.items() if s}
