"""Queries that bind the operators to the driver's tables, and SQL for them."""

from ledgerloom.plans import extra, reconciliation, slips, workflow

QUERIES = {**reconciliation.QUERIES, **slips.QUERIES, **workflow.QUERIES, **extra.QUERIES}
ORACLE = {**reconciliation.ORACLE, **slips.ORACLE, **workflow.ORACLE, **extra.ORACLE}
