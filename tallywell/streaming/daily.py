"""Metrics over streams: an extension, with the contract's allowed delay as its watermark."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywell.functions.predicates import ContractError, where_all
from tallywell.operators.metrics import Contract

_DELAY = re.compile(r"^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$")


def watermark_of(contract: Contract) -> str:
    """An ISO duration such as PT30M as Spark writes it."""
    m = _DELAY.match(contract.max_delay)
    if not m or not any(m.groups()):
        raise ContractError(f"no delay to wait for: {contract.max_delay!r}")
    return " ".join(f"{n} {u}" for n, u in zip(m.groups(), ("days", "hours", "minutes", "seconds"), strict=True) if n)


def stream_metric(events: DataFrame, contract: Contract) -> DataFrame:
    """(dt, value) a day once its events can no longer come; late rows are dropped.

    Counts, sums and averages; distinct counts and ratios need the batch compiler.
    """
    if contract.type == "ratio" or contract.order_key:
        raise ContractError("a stream gives counts, sums and averages")
    kept = where_all(contract.filters)
    if "test_order" in events.columns:
        kept = kept & (F.col("test_order") == F.lit(False))
    value = F.count("*") if contract.type == "count" else (F.sum if contract.type == "sum" else F.avg)(F.col(contract.numerator).cast("double"))
    at = F.col(contract.time_column).cast("timestamp")
    day = events.where(kept).withColumn("tw_at", at).withWatermark("tw_at", watermark_of(contract)).groupBy(F.window("tw_at", "1 day")).agg(value.cast("double").alias("value"))
    return day.select(F.date_format("window.start", "yyyy-MM-dd").alias("dt"), "value")
