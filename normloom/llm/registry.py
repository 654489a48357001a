"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from normloom.llm import training


def queries() -> dict:
    return training.queries()


def oracle_sql() -> dict[str, str]:
    return training.oracle_sql()
