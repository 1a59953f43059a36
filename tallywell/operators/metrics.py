"""Metric contracts compiled to DataFrames of one value a day.

A contract is a strict mapping. Compiling it yields (dt, value), where dt is a
day as text; a ratio over columns yields its sums as well.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.functions.predicates import ContractError, check_filters, fields_of, identifier, where_all

TYPES = ("ratio", "sum", "count", "avg")
FIELDS = frozenset({
    "metric", "description", "type", "grain", "time_column", "numerator", "denominator", "filters",
    "queryable_dimensions", "freshness_contract", "owners", "version", "value_range", "order_key",
})


@dataclass(frozen=True)
class Contract:
    metric: str
    type: str
    grain: str
    time_column: str
    numerator: str | None = None
    denominator: str | None = None
    filters: list | None = None
    order_key: str | None = None
    dimensions: tuple[str, ...] = ()
    max_delay: str = "unknown"
    value_range: tuple[float, float] | None = None
    version: int = 1
    extra: Mapping[str, Any] = field(default_factory=dict, compare=False)


def _part(raw: Mapping[str, Any], name: str) -> str:
    part = raw.get(name)
    if not isinstance(part, Mapping) or not part.get("metric"):
        raise ContractError(f"a {raw['type']} contract needs {name}.metric")
    return identifier(part["metric"], f"{name}.metric")


def parse_contract(raw: Mapping[str, Any]) -> Contract:
    """Check a mapping strictly: required, typed, and nothing unknown."""
    if not isinstance(raw, Mapping):
        raise ContractError("a contract must be a mapping")
    if missing := [f for f in ("metric", "type", "grain", "time_column") if f not in raw]:
        raise ContractError(f"missing required field: {', '.join(missing)}")
    if unknown := set(raw) - FIELDS:
        raise ContractError(f"unknown fields: {sorted(unknown)}")
    kind = raw["type"]
    if kind not in TYPES:
        raise ContractError(f"type must be one of {TYPES}, not {kind!r}")
    if not isinstance(raw["grain"], str) or not raw["grain"].strip():
        raise ContractError("grain must be text")
    key = raw.get("order_key")
    if key is not None and kind != "count":
        raise ContractError("only a count can have an order_key")
    limits = raw.get("value_range")
    if limits is not None:
        numbers = isinstance(limits, (list, tuple)) and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in limits)
        if not numbers or len(limits) != 2 or not all(map(math.isfinite, limits)) or limits[0] > limits[1]:
            raise ContractError("value_range must be two finite numbers in order")
    version = raw.get("version", 1)
    if not isinstance(version, int) or isinstance(version, bool):
        raise ContractError("version must be an integer")
    check_filters(raw.get("filters"))
    fresh = raw.get("freshness_contract") or {}
    return Contract(
        metric=identifier(raw["metric"], "metric"), type=kind, grain=raw["grain"],
        time_column=identifier(raw["time_column"], "time_column"),
        numerator=_part(raw, "numerator") if kind in ("ratio", "sum", "avg") else None,
        denominator=_part(raw, "denominator") if kind == "ratio" else None,
        filters=raw.get("filters"), order_key=None if key is None else identifier(key, "order_key"),
        dimensions=tuple(identifier(d, "dimension") for d in raw.get("queryable_dimensions") or ()),
        max_delay=fresh.get("max_delay", "unknown") if isinstance(fresh, Mapping) else "unknown",
        value_range=None if limits is None else tuple(limits), version=version,
        extra={k: raw[k] for k in ("description", "owners") if k in raw},
    )


def load_contracts(folder: str | Path) -> dict[str, Contract]:
    """Every YAML contract of a folder, by metric."""
    import yaml

    found = {}
    for path in sorted(Path(folder).glob("*.y*ml")):
        c = parse_contract(yaml.safe_load(path.read_text(encoding="utf-8-sig")))
        found[c.metric] = c
    return found


def day_of(column: str) -> Column:
    return F.date_format(F.col(column), "yyyy-MM-dd")


def _guard(fact: DataFrame, c: Contract, *columns: str) -> None:
    needed = {c.time_column, *fields_of(c.filters), *columns}
    if missing := sorted(needed - set(fact.columns)):
        raise ContractError(f"{c.metric}: the table has no {', '.join(missing)}")


def _kept(fact: DataFrame, c: Contract) -> DataFrame:
    """Rows that the filters keep; test orders, and rows not known to be none, never count."""
    keep = where_all(c.filters)
    if "test_order" in fact.columns:
        keep = keep & (F.col("test_order") == F.lit(False))
    return fact.where(keep)


def compile_metric(fact: DataFrame, contract: Contract, contracts: Mapping[str, Contract] | None = None,
                   by: tuple[str, ...] = (), _seen: tuple[str, ...] = ()) -> DataFrame:
    """(dt, value) of a contract over a fact table, unsorted.

    A ratio whose two parts are contracts divides their daily values; days of
    one side only stay, with a null value, and filters of the ratio itself are
    not applied, as each part has its own. Otherwise its parts are columns. A
    zero denominator gives null. ``by`` slices by declared dimensions.
    """
    c, contracts = contract, contracts or {}
    if c.metric in _seen:
        raise ContractError(f"contracts form a cycle: {' -> '.join((*_seen, c.metric))}")
    if extra := set(by) - set(c.dimensions):
        raise ContractError(f"{c.metric} has no dimension {', '.join(sorted(extra))}")
    keys = ["dt", *by]
    if c.type == "ratio" and c.numerator in contracts and c.denominator in contracts:
        sides = [
            compile_metric(fact, contracts[part], contracts, by, (*_seen, c.metric)).select(*keys, F.col("value").alias(name))
            for part, name in ((c.numerator, "numerator"), (c.denominator, "denominator"))
        ]
        both = sides[0].join(sides[1], keys, "full_outer")
        return both.select(*keys, F.try_divide("numerator", F.nullif("denominator", F.lit(0.0))).alias("value"))
    if c.type == "ratio":
        _guard(fact, c, c.numerator, c.denominator, *by)
        day = _kept(fact, c).groupBy(day_of(c.time_column).alias("dt"), *by).agg(
            F.sum(F.col(c.numerator).cast("double")).alias("numerator"), F.sum(F.col(c.denominator).cast("double")).alias("denominator"))
        return day.select(*keys, F.try_divide("numerator", F.nullif("denominator", F.lit(0.0))).alias("value"), "numerator", "denominator")
    if c.type == "count":
        _guard(fact, c, *([c.order_key] if c.order_key else []), *by)
        value = F.count_distinct(F.col(c.order_key)) if c.order_key else F.count("*")
    else:
        _guard(fact, c, c.numerator, *by)
        value = (F.sum if c.type == "sum" else F.avg)(F.col(c.numerator).cast("double"))
    return _kept(fact, c).groupBy(day_of(c.time_column).alias("dt"), *by).agg(value.cast("double").alias("value"))


def lineage(contract: Contract, contracts: Mapping[str, Contract] | None = None) -> set[str]:
    """Columns of the fact table that a metric rests on, through its parts."""
    contracts = contracts or {}
    own = {contract.time_column} | fields_of(contract.filters) | ({contract.order_key} if contract.order_key else set())
    parts = [p for p in (contract.numerator, contract.denominator) if p]
    if contract.type == "ratio" and all(p in contracts for p in parts):
        return {contract.time_column}.union(*[lineage(contracts[p], contracts) for p in parts])
    return own | set(parts)


def columns_read(df: DataFrame) -> set[str]:
    """Names of the columns of its tables that ``df`` rests on, taken from its plan.

    Every column of a table has an id in the plan; those ids that any step above
    a table refers to are read. What the optimiser finds to be unused doesn't
    count, and computed columns lead back to what they are computed from.
    """
    if not hasattr(df, "_jdf"):
        raise ContractError("the plan can be seen only by a session with its own JVM")
    names: dict[int, str] = {}
    used: set[int] = set()

    def each(found):
        return [found.apply(i) for i in range(found.size())]

    def walk(node) -> None:
        children = each(node.children())
        if not children:
            names.update({a.exprId().id(): a.name() for a in each(node.output())})
            return
        used.update(a.exprId().id() for a in each(node.references().toSeq()))
        for child in children:
            walk(child)

    plan = df._jdf.queryExecution().optimizedPlan()
    walk(plan)
    used.update(a.exprId().id() for a in each(plan.output()))  # a table that is shown as it is
    return {names[k] for k in used & names.keys()}
