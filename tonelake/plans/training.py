"""Queries of the core's own operator for training data: amounts in common units."""

from __future__ import annotations

from tonelake.operators.units import conversion_cases, to_common_units
from tonelake.plans.catalog import query, table


@query()
def p4_found(spark, folder):
    return conversion_cases(table(spark, folder, "guidance"), table(spark, folder, "fx_rates"))


@query()
def p4_amounts(spark, folder):
    return to_common_units(table(spark, folder, "guidance"), table(spark, folder, "fx_rates"))
