"""All registered queries with their SQL counterparts."""

from __future__ import annotations

from folioscope.plans import comparing, editing, lineage, reading, verifying

FAMILIES = (reading, comparing, verifying, editing, lineage)


def queries() -> dict:
    return {name: fn for family in FAMILIES for name, fn in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.SQL.items()}


def flagship(spark, sf_dir):
    return verifying.verify_pages(spark, sf_dir)
