"""Data health and three-level assertions.

Checks over one table are fused into one aggregation; duplicates, orphans and
cross-source differences need a shuffle each. All assertions run; a blocking
one that failed, or broke, raises at the end.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywell.functions.predicates import is_blank

NAME = re.compile(r"^[A-Za-z_一-鿿][A-Za-z0-9_一-鿿]{0,62}$")
LEVELS = ("L1", "L2", "L3")
# Parts of column names that mark dates and amounts.
DATE_WORDS = ("date", "日期", "时间", "time")
AMOUNT_WORDS = ("amount", "金额", "price", "数量", "qty")


def column_name(name: str) -> str:
    if not isinstance(name, str) or not NAME.match(name):
        raise ValueError(f"not a column name: {name!r}")
    return name


@dataclass(frozen=True)
class Assertion:
    """``fused``: (aggregates, judge of their values); else ``run`` (context -> outcome)."""

    name: str
    level: str
    blocking: bool
    human_text: str
    aggregates: dict[str, Column] = field(default_factory=dict)
    judge: Callable | None = None
    run: Callable | None = None

    def __post_init__(self):
        if self.level not in LEVELS or not isinstance(self.blocking, bool):
            raise ValueError("a level is L1, L2 or L3, and blocking true or false")


@dataclass
class Report:
    entries: list[dict]

    @property
    def blocked(self) -> bool:
        return any(e["blocking"] and not e["passed"] for e in self.entries)


class AssertionBlocked(RuntimeError):
    def __init__(self, report: Report):
        super().__init__("; ".join(e["human_text"] for e in report.entries if e["blocking"] and not e["passed"]))
        self.report = report


def run_assertions(df: DataFrame, assertions: Iterable[Assertion], context: dict | None = None) -> Report:
    """Every assertion in order; (passed, affected rows, detail) each."""
    assertions = list(assertions)
    fused = {f"c{i}_{k}": c.alias(f"c{i}_{k}") for i, a in enumerate(assertions) for k, c in a.aggregates.items()}
    values, problem = {}, None
    if fused:
        try:
            values = df.agg(*fused.values()).first().asDict()
        except Exception as e:  # a column that is missing fails its assertion, not the run
            problem = e
    entries = []
    for i, a in enumerate(assertions):
        try:
            if a.run:
                passed, affected, detail = a.run(df, context or {})
            else:
                if problem is not None:
                    own = df.agg(*[c.alias(f"c{i}_{k}") for k, c in a.aggregates.items()]).first().asDict()
                else:
                    own = values
                passed, affected, detail = a.judge(**{k: own[f"c{i}_{k}"] for k in a.aggregates})
        except Exception as e:
            passed, affected, detail = False, 0, f"{type(e).__name__}: {e}"
        entries.append({
            "name": a.name, "level": a.level, "blocking": a.blocking, "passed": bool(passed),
            "human_text": a.human_text, "affected_rows": int(affected), "detail": detail,
        })
    report = Report(entries)
    if report.blocked:
        raise AssertionBlocked(report)
    return report


def row_count_band(history: list[int], band: float = 0.4, blocking: bool = True) -> Assertion:
    """Row count within ``band`` of the mean of the last seven; no history passes."""
    last = list(history)[-7:]

    def judge(n):
        if not last:
            return True, 0, "no history"
        mean = sum(last) / len(last)
        ok = mean * (1 - band) <= n <= mean * (1 + band)
        return ok, 0 if ok else n, f"{n} rows, mean {mean:.1f}"

    return Assertion("row_count_band", "L1", blocking, f"the row count stays within {band:.0%} of its recent mean", {"n": F.count("*")}, judge)


def not_null(column: str, blocking: bool = True) -> Assertion:
    blank = F.count_if(is_blank(F.col(column_name(column))))
    return Assertion(f"not_null:{column}", "L1", blocking, f"{column} is never blank", {"n": blank}, lambda n: (n == 0, n, f"{n} blank"))


def duplicates(df: DataFrame, column: str) -> DataFrame:
    """duplicate_keys, duplicate_rows: keys of more than one row (null is a key) and their rows."""
    groups = df.groupBy(F.col(f"`{column}`")).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return groups.agg(F.count("*").alias("duplicate_keys"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("duplicate_rows"))


def unique(column: str, blocking: bool = True) -> Assertion:
    def run(df, _):
        keys, rows = duplicates(df, column).first()
        return keys == 0, rows, f"{keys} keys repeat"

    column_name(column)
    return Assertion(f"unique:{column}", "L1", blocking, f"{column} is unique", run=run)


def enum_values(column: str, allowed: Iterable[str], blocking: bool = True) -> Assertion:
    """Values as lower-case text are among the allowed; null is ignored, no list passes."""
    known = sorted({str(a).lower() for a in allowed})
    if not known:
        return Assertion(f"enum:{column}", "L2", blocking, f"{column} has no value list", {"n": F.lit(0)}, lambda n: (True, 0, "no list"))
    odd = F.count_if(~F.lower(F.col(column_name(column)).cast("string")).isin(*known))
    return Assertion(f"enum:{column}", "L2", blocking, f"{column} is one of {known}", {"n": odd}, lambda n: (n == 0, n, f"{n} others"))


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows of ``child`` whose key is not null and has no parent."""
    keys = parent.select(F.col(parent_column).alias("tw_key"))
    return child.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("tw_key"), "left_anti")


def referential_integrity(column: str, parent: DataFrame, parent_column: str, blocking: bool = True) -> Assertion:
    def run(df, _):
        n = orphans(df, column, parent, parent_column).count()
        return n == 0, n, f"{n} orphans"

    return Assertion(f"references:{column}", "L2", blocking, f"every {column} has a parent", run=run)


def mismatches(source: DataFrame, target: DataFrame, key: str, source_value: str, target_value: str, tolerance: float = 1e-9) -> DataFrame:
    """Pairs of equal key whose values differ by more than ``tolerance``."""
    s = source.select(F.col(key).alias("key"), F.col(source_value).cast("double").alias("source_value"))
    t = target.select(F.col(key).alias("key"), F.col(target_value).cast("double").alias("target_value"))
    return s.join(t, "key").where(F.abs(F.col("source_value") - F.col("target_value")) > tolerance)


def cross_source_reconcile(target: DataFrame, key: str, source_value: str, target_value: str, tolerance: float = 1e-9, blocking: bool = True) -> Assertion:
    def run(df, _):
        n = mismatches(df, target, key, source_value, target_value, tolerance).count()
        return n == 0, n, f"{n} pairs differ"

    return Assertion(f"reconcile:{source_value}", "L3", blocking, f"{source_value} agrees with {target_value}", run=run)


def trend_reasonableness(current: float, previous: float | None, bound: float = 0.5, blocking: bool = False) -> Assertion:
    if not 0 < bound < 10:
        raise ValueError("a bound lies between 0 and 10")

    def run(df, _):
        if not previous:
            return True, 0, "nothing to compare with"
        change = (current - previous) / abs(previous)
        return abs(change) <= bound, 0, f"changed by {change:.2%}"

    return Assertion("trend", "L3", blocking, f"the value changes by {bound:.0%} at most", run=run)


def default_assertions(columns: Iterable[str], key: str | None, history: list[int] = (), required: Iterable[str] = (), enums: dict | None = None) -> list[Assertion]:
    """The usual set, over columns that exist; value lists don't block."""
    columns = set(columns)
    out = [row_count_band(list(history))]
    if key in columns:
        out += [unique(key), not_null(key)]
    out += [not_null(c) for c in required if c in columns]
    out += [enum_values(c, v, blocking=False) for c, v in (enums or {}).items() if c in columns]
    return out


def commerce_assertions(df: DataFrame, history=(), key: str = "order_id") -> list[Assertion]:
    return default_assertions(df.columns, key, history, ["created_at"], {"status": ["paid", "cancelled"]})


def research_assertions(df: DataFrame, history=(), key: str = "participant_id") -> list[Assertion]:
    return default_assertions(df.columns, key, history, ["arm"], {"arm": ["a", "b"], "converted": ["0", "1", "true", "false", "yes", "no", "t", "f"]})


def health_aggregates(columns: Iterable[str]) -> list[Column]:
    """row_count; per date column slash_ and dash_, per amount column blank_: one pass."""
    out = [F.count("*").alias("row_count")]
    for c in columns:
        text = F.col(f"`{c}`").cast("string")
        if any(w in c.lower() for w in DATE_WORDS):
            out += [F.count_if(text.contains("/")).alias(f"slash_{c}"), F.count_if(text.contains("-")).alias(f"dash_{c}")]
        if any(w in c.lower() for w in AMOUNT_WORDS):
            out.append(F.count_if(is_blank(F.col(f"`{c}`"))).alias(f"blank_{c}"))
    return out


def health_profile(df: DataFrame) -> DataFrame:
    return df.agg(*health_aggregates(df.columns))


def health_check(df: DataFrame) -> dict:
    """Warnings: a date column written both ways, and blank amounts."""
    v = health_profile(df).first().asDict()
    issues = []
    for c in df.columns:
        slash, dash = v.get(f"slash_{c}", 0), v.get(f"dash_{c}", 0)
        if slash and dash:
            issues.append({"code": "date_format_mixed", "column": c, "affected_rows": slash + dash, "severity": "warn"})
        if v.get(f"blank_{c}"):
            issues.append({"code": "blank_value", "column": c, "affected_rows": v[f"blank_{c}"], "severity": "warn"})
    return {"row_count": v["row_count"], "issues": issues}


def row_count_bands(daily: DataFrame, band: float = 0.4) -> DataFrame:
    """dt, n, mean, passed: every day's rows against the seven days before it.

    ``daily`` has one row a day, so that the one ordered window stays small.
    """
    before = Window.orderBy("dt").rowsBetween(-7, -1)
    d = daily.select("dt", "n", F.avg("n").over(before).alias("mean"))
    inside = F.col("n").between(F.col("mean") * (1 - band), F.col("mean") * (1 + band))
    return d.withColumn("passed", F.coalesce(inside, F.lit(True)))


def trend_series(series: DataFrame) -> DataFrame:
    """dt, value, change against the day before; null where there is none or it is zero."""
    previous = F.lag("value").over(Window.orderBy("dt"))
    return series.select("dt", "value", F.try_divide(F.col("value") - previous, F.nullif(F.abs(previous), F.lit(0.0))).alias("change"))
