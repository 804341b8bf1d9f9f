"""The queries of the library and the SQL that must give the same rows."""

from __future__ import annotations

from evidentia.plans import evidence_plans, fusion_plans, java_plans, lineage_plans, lookup_plans, scope_plans, search_plans, source_plans

FAMILIES = (fusion_plans, search_plans, lineage_plans, lookup_plans, source_plans, evidence_plans, scope_plans, java_plans)
QUERIES = {name: query for family in FAMILIES for name, query in family.QUERIES.items()}
ORACLE_SQL = {name: sql for family in FAMILIES for name, sql in family.ORACLE_SQL.items()}
