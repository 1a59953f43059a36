import pytest

from tallywell.operators import quality as Q


def failed(df, *assertions):
    with pytest.raises(Q.AssertionBlocked) as e:
        Q.run_assertions(df, assertions)
    return e.value.report.entries


def test_all_run_and_failures_count(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, " "), (None, "x"), (None, "x")], "id int, name string")
    entries = failed(df, Q.not_null("name"), Q.unique("id"), Q.enum_values("name", ["A", "x"], blocking=False), Q.row_count_band([5, 5]))
    assert [(e["passed"], e["affected_rows"]) for e in entries] == [(False, 2), (False, 4), (False, 1), (True, 0)]


def test_a_missing_column_fails_its_assertion_only(spark):
    df = spark.createDataFrame([(1,)], "id int")
    entries = failed(df, Q.not_null("nowhere"), Q.not_null("id"))
    assert [e["passed"] for e in entries] == [False, True]


@pytest.mark.parametrize("history,passes", [([], True), ([100] * 7, True), ([200] * 7, False), ([72] * 7, True), ([1000] + [100] * 7, True)])
def test_band(spark, history, passes):
    report = Q.run_assertions(spark.range(100), [Q.row_count_band(history, blocking=False)])
    assert report.entries[0]["passed"] is passes


def test_references_and_reconcile(spark):
    child = spark.createDataFrame([(1, 1), (2, 99), (3, None)], "id int, pid int")
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    assert failed(child, Q.referential_integrity("pid", parent, "id"))[0]["affected_rows"] == 1
    s = spark.createDataFrame([(1, 10.0), (2, 5.0), (3, 1.0)], "k int, v double")
    t = spark.createDataFrame([(1, 10.5), (2, 5.0)], "k int, v double")
    assert failed(s, Q.cross_source_reconcile(t, "k", "v", "v"))[0]["affected_rows"] == 1


def test_trend():
    assert Q.trend_reasonableness(1.0, 0).run(None, {})[0]
    assert not Q.trend_reasonableness(2.0, 1.0).run(None, {})[0]
    with pytest.raises(ValueError):
        Q.trend_reasonableness(1, 1, bound=10)


def test_gates_use_existing_columns(spark):
    df = spark.createDataFrame([("o1", "paid"), ("o2", "hacked")], "order_id string, status string")
    report = Q.run_assertions(df, Q.commerce_assertions(df))
    assert [e["name"] for e in report.entries] == ["row_count_band", "unique:order_id", "not_null:order_id", "enum:status"]
    assert not report.entries[-1]["passed"] and not report.blocked


def test_health(spark):
    df = spark.createDataFrame([("2026-08-26", "5"), ("2026/08/26", " ")], "order_date string, amount_total string")
    issues = Q.health_check(df)["issues"]
    assert [(i["code"], i["affected_rows"]) for i in issues] == [("date_format_mixed", 2), ("blank_value", 1)]


def test_names_and_levels():
    assert Q.column_name("订单编号")
    for bad in ("a b", "1a", "a;"):
        with pytest.raises(ValueError):
            Q.column_name(bad)
    with pytest.raises(ValueError):
        Q.Assertion("x", "L4", True, "")
