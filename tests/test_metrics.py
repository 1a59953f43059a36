"""Metric semantics: days, distinct keys, filters, ratios, versions."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallywell.functions.predicates import ContractError, where_all
from tallywell.operators.metrics import columns_read, compile_metric, lineage, parse_contract
from tallywell.plans.semantic import Semantic


def contract(metric="m", kind="count", **more):
    return parse_contract({"metric": metric, "type": kind, "grain": "order", "time_column": "created_at"} | more)


PAID = [{"field": "status", "op": "=", "value": "paid"}]


def orders(spark, *rows, columns="created_at timestamp_ntz, status string, order_id string"):
    return spark.createDataFrame([(datetime(2026, 8, *r[0]), *r[1:]) for r in rows], columns)


def series(df):
    return {r["dt"]: r["value"] for r in df.collect()}


def test_days_and_filters(spark):
    df = orders(spark, ((25,), "paid", "a"), ((26,), "paid", "b"), ((26,), "cancelled", "c"), ((27,), "paid", "d"))
    assert series(compile_metric(df, contract(filters=PAID))) == {"2026-08-25": 1.0, "2026-08-26": 1.0, "2026-08-27": 1.0}


def test_distinct_after_filters(spark):
    df = orders(spark, ((25,), "paid", "O-1"), ((25,), "paid", "O-1"), ((25,), "cancelled", "O-9"), ((25,), "paid", "O-9"), ((25,), "paid", None))
    assert series(compile_metric(df, contract(filters=PAID, order_key="order_id"))) == {"2026-08-25": 2.0}


def test_midnight(spark):
    df = orders(spark, ((26, 23, 45), "p", "a"), ((26, 10), "p", "b"), ((27, 0, 30), "p", "c"), ((28, 9), "p", "d"))
    assert series(compile_metric(df, contract())) == {"2026-08-26": 2.0, "2026-08-27": 1.0, "2026-08-28": 1.0}


def test_zero_denominator(spark):
    df = spark.createDataFrame([(datetime(2026, 8, 25), 0.0, 0.0), (datetime(2026, 8, 25), 3.0, 0.0)], "created_at timestamp_ntz, num double, den double")
    out = compile_metric(df, contract(kind="ratio", numerator={"metric": "num"}, denominator={"metric": "den"})).collect()
    assert out[0]["value"] is None and out[0]["numerator"] == 3.0


def test_one_sided_day_and_own_filters_ignored(spark):
    df = orders(spark, ((26,), "paid", "a"), ((26,), "cancelled", "b"), ((27,), "cancelled", "c"))
    parts = {c.metric: c for c in (contract("good", filters=PAID), contract("every"))}
    rate = contract("rate", "ratio", numerator={"metric": "good"}, denominator={"metric": "every"}, filters=[{"field": "status", "op": "=", "value": "nothing"}])
    assert series(compile_metric(df, rate, parts)) == {"2026-08-26": 0.5, "2026-08-27": None}
    assert lineage(rate, parts) == {"created_at", "status"}


def test_test_orders_never_count(spark):
    df = spark.createDataFrame([(datetime(2026, 8, 25), f) for f in (False, True, None)], "created_at timestamp_ntz, test_order boolean")
    assert series(compile_metric(df, contract())) == {"2026-08-25": 1.0}


def test_cycle(spark):
    a = contract("a", "ratio", numerator={"metric": "a"}, denominator={"metric": "a"})
    with pytest.raises(ContractError, match="cycle"):
        compile_metric(orders(spark, ((25,), "p", "x")), a, {"a": a})


@pytest.mark.parametrize("bad", [
    {"type": "median"}, {"extra": 1}, {"time_column": "a;b"}, {"grain": " "}, {"filters": "status = 'paid'"}, {"filters": ["status = 'paid'"]},
    {"filters": [{"field": "a", "op": "LIKE", "value": "x"}]}, {"filters": [{"field": "a", "op": "IN", "value": []}]},
    {"filters": [{"field": "a", "op": "IS NULL", "value": 1}]}, {"filters": [{"field": "a", "op": "="}]},
    {"filters": [{"field": "a", "op": "=", "value": float("nan")}]}, {"type": "sum"}, {"type": "ratio"}, {"version": True},
    {"value_range": [1]}, {"type": "sum", "numerator": {"metric": "x"}, "order_key": "k"},
])
def test_contracts_are_strict(bad, spark):
    with pytest.raises(ContractError):
        contract(**{"kind": bad.pop("type", "count")} | bad)


def test_injection_is_a_value(spark):
    df = orders(spark, ((25,), "x' OR '1'='1", "a"), ((25,), "paid", "b"))
    assert df.where(where_all([{"field": "status", "op": "=", "value": "x' OR '1'='1"}])).count() == 1
    assert df.where(where_all([{"field": "status", "op": "NOT IN", "value": ["paid", None]}])).count() == 0


def test_unknown_column(spark):
    with pytest.raises(ContractError, match="no nowhere"):
        compile_metric(orders(spark, ((25,), "p", "a")), contract(order_key="nowhere"))


def test_semantic_layer(spark):
    s = Semantic()
    s.compile("commerce", orders(spark, ((26,), "p", "a"), ((25,), "p", "b")), contract(freshness_contract={"max_delay": "PT30M"}, version=3))
    out = s.query("commerce", "m", "r-1", 1)
    assert out["rows"] == [["2026-08-25", 1.0]] and out["metric_version"] == 3 and out["freshness"] == "PT30M"
    for track, metric in (("research", "m"), ("commerce", "other"), ("commerce", "m; drop")):
        with pytest.raises(ContractError):
            s.query(track, metric, "r-1")


def test_columns_read_from_the_plan(spark, tmp_path):
    spark.createDataFrame([("O-1", "2026-01-01 00:00:00", "paid", 3.0, "x")], "order_id string, created_at string, status string, amount double, note string").write.parquet(str(tmp_path / "t"))
    fact = spark.read.parquet(str(tmp_path / "t"))
    base = {"grain": "order", "time_column": "created_at"}
    parts = {c["metric"]: parse_contract(base | c) for c in (
        {"metric": "paid", "type": "count", "order_key": "order_id", "filters": [{"field": "status", "op": "=", "value": "paid"}]},
        {"metric": "all_orders", "type": "count", "order_key": "order_id"},
        {"metric": "rate", "type": "ratio", "numerator": {"metric": "paid"}, "denominator": {"metric": "all_orders"}},
        {"metric": "total", "type": "sum", "numerator": {"metric": "amount"}})}
    for name, want in {"rate": {"order_id", "created_at", "status"}, "paid": {"order_id", "created_at", "status"}, "total": {"created_at", "amount"}}.items():
        assert columns_read(compile_metric(fact, parts[name], parts)) == want == lineage(parts[name], parts) | want
    renamed = fact.select(F.upper("note").alias("amount"), F.lit(1).alias("status"), "order_id").where("amount > 'A'").groupBy("amount").count()
    assert columns_read(renamed) == {"note"} and columns_read(fact.select("status")) == {"status"} and columns_read(spark.range(3)) == {"id"}
