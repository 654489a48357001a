"""All queries and their SQL, from the modules that define them."""

from __future__ import annotations

from normloom.plans import reference, training


def _modules() -> list:
    return [reference, training]


def queries() -> dict:
    out: dict = {}
    for m in _modules():
        out |= m.queries()
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in _modules():
        out |= m.oracle_sql()
    return out
