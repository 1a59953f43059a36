"""Structured filters as Columns: no text from a contract reaches SQL."""

from __future__ import annotations

import math
import operator
import re
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_]{0,62}$")
COMPARISONS = {
    "=": operator.eq, "!=": operator.ne, "<>": operator.ne,
    "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
}


class ContractError(ValueError):
    """A contract, filter or name that is not acceptable."""


def identifier(name: Any, what: str = "name") -> str:
    if not isinstance(name, str) or not IDENTIFIER.match(name):
        raise ContractError(f"{what} is not an identifier: {name!r}")
    return name


def check_literal(value: Any) -> Any:
    """None, bool, finite number or string."""
    if value is not None and not isinstance(value, (bool, str, int, float)):
        raise ContractError(f"a filter can't hold a {type(value).__name__}")
    if isinstance(value, float) and not math.isfinite(value):
        raise ContractError("a filter's number must be finite")
    return value


def check_filter(rule: Any) -> tuple[str, str, Any]:
    """(field, operator, value) of one {field, op, value}, checked without Spark."""
    if not isinstance(rule, dict) or set(rule) - {"field", "op", "value"}:
        raise ContractError(f"a filter must be a mapping of field, op and value: {rule!r}")
    field = identifier(rule.get("field"), "filter field")
    op = rule["op"].upper() if isinstance(rule.get("op"), str) else rule.get("op")
    if op in ("IS NULL", "IS NOT NULL"):
        if "value" in rule:
            raise ContractError(f"{op} takes no value")
        return field, op, None
    if op in ("IN", "NOT IN"):
        values = rule.get("value")
        if not isinstance(values, (list, tuple)) or not values:
            raise ContractError(f"{op} takes a list that isn't empty")
        return field, op, [check_literal(v) for v in values]
    if op not in COMPARISONS:
        raise ContractError(f"unknown operator: {op!r}")
    if "value" not in rule:
        raise ContractError(f"{op} needs a value")
    return field, op, check_literal(rule["value"])


def check_filters(filters: Any) -> list[tuple[str, str, Any]]:
    if filters is None:
        return []
    if not isinstance(filters, list):
        raise ContractError("filters must be a list")
    return [check_filter(f) for f in filters]


def predicate(rule: Any) -> Column:
    """One filter; nulls follow three-valued logic, so ``= null`` keeps nothing."""
    name, op, value = check_filter(rule)
    field = F.col(name)
    if op in ("IS NULL", "IS NOT NULL"):
        return field.isNull() if op == "IS NULL" else field.isNotNull()
    if op in ("IN", "NOT IN"):
        inside = field.isin(*[F.lit(v) for v in value])
        return inside if op == "IN" else ~inside
    return COMPARISONS[op](field, F.lit(value))


def where_all(filters: Any) -> Column:
    """All filters at once; none at all keeps every row."""
    check_filters(filters)
    return reduce(operator.and_, [predicate(f) for f in filters or []], F.lit(True))


def fields_of(filters: list[dict] | None) -> set[str]:
    return {f["field"] for f in filters or [] if isinstance(f, dict)}


def is_blank(column: Column) -> Column:
    """Null, or nothing but spaces as text."""
    return column.isNull() | (F.trim(column.cast("string")) == "")


def is_truthy(column: Column) -> Column:
    """1, true, yes or t in any case; null is not."""
    return F.coalesce(F.lower(column.cast("string")).isin("1", "true", "yes", "t"), F.lit(False))
