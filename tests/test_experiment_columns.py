import hashlib

import pytest
from pyspark.sql import functions as F

from tallywell.operators import experiment as E


def test_buckets_equal_hashlib_and_are_even(spark):
    ids = [f"u-{i}" for i in range(2000)] + ["用户", "1", " "]
    df = spark.createDataFrame([(i,) for i in ids] + [(None,)], "id string")
    got = {r[0]: r[1:] for r in df.select("id", E.unit_bucket(F.col("id"), "s"), E.assign(F.col("id"), "s", {"b": 0.5, "a": 0.5})).collect()}
    for i in ids:
        b = int(hashlib.sha256(f"s:{i}".encode()).hexdigest()[:16], 16) % 1000
        assert got[i] == (b, "a" if b < 500 else "b")
    assert got[None] == (None, None)
    assert abs(sum(v[1] == "a" for v in got.values()) / 2000 - 0.5) < 0.03


@pytest.mark.parametrize("arms", [{}, {"a": 0.5}, {"a": 0.7, "b": 0.4}, {"a": 1.5, "b": -0.5}])
def test_weights(arms):
    with pytest.raises(E.AssignmentError):
        E.assign(F.lit("x"), "s", arms)


def test_guardrails(spark):
    g = spark.createDataFrame([("a", "not_increase", 0.1), ("b", "not_decrease", 0.1), ("c", "not_increase", 0.0)], "name string, direction string, threshold double")
    v = spark.createDataFrame([("a", 1.0, 1.2), ("b", 1.0, 0.95)], "name string, baseline double, variant double")
    assert {r["name"]: r["status"] for r in E.guardrail_status(g, v).collect()} == {"a": "BROKEN", "b": "OK", "c": "NO_DATA"}
