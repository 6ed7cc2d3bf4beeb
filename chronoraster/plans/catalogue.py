"""All core queries by name, and the SQL that they are checked against."""

from __future__ import annotations

from chronoraster.plans import problems, reference


def queries() -> dict:
    return reference.QUERIES | problems.queries()


def oracle_sql() -> dict[str, str]:
    return reference.SQL | problems.oracle_sql()
