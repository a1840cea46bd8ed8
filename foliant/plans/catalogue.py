"""All analytics queries, by importing the modules that register them."""

from __future__ import annotations

from foliant.plans import classes, cleaning, extracts, languages, profiles, scores, served, structure, tables
from foliant.plans.registry import QUERIES, SQL, Query

MODULES = (served, languages, classes, cleaning, scores, tables, extracts, structure, profiles)


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
