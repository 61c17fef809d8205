"""Registered queries over the retail tables, each with SQL that checks it."""

from reachline.plans import campaign, customer, receipt, reply, segment, stream

AREAS = [customer, segment, receipt, campaign, reply, stream]


def queries() -> dict:
    return {name: query for area in AREAS for name, query in area.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for area in AREAS for name, sql in area.ORACLES.items()}
