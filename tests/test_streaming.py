from datetime import datetime

import pytest

from tallywell.functions.predicates import ContractError
from tallywell.operators.metrics import parse_contract
from tallywell.streaming.daily import stream_metric, watermark_of


def contract(**more):
    return parse_contract({"metric": "n", "type": "count", "grain": "event", "time_column": "ts", "freshness_contract": {"max_delay": "PT30M"}} | more)


def test_days_close_after_the_delay(spark, tmp_path):
    def write(name, *moments):
        spark.createDataFrame([(m, "click") for m in moments], "ts timestamp_ntz, event_type string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    write("a", datetime(2026, 8, 26, 23), datetime(2026, 8, 26, 1))
    events = spark.readStream.schema("ts timestamp_ntz, event_type string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = stream_metric(events, contract(filters=[{"field": "event_type", "op": "=", "value": "click"}]))
    q = out.writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert spark.table("days").count() == 0
        write("b", datetime(2026, 8, 28, 1))
        q.processAllAvailable()
        assert [tuple(r) for r in spark.table("days").collect()] == [("2026-08-26", 2.0)]
    finally:
        q.stop()


def test_limits(spark):
    assert watermark_of(contract(freshness_contract={"max_delay": "P1DT2H"})) == "1 days 2 hours"
    with pytest.raises(ContractError):
        watermark_of(contract(freshness_contract={"max_delay": "soon"}))
    with pytest.raises(ContractError):
        stream_metric(spark.range(1), contract(order_key="k"))
