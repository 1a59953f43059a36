"""Experiment assignment by hash, sample-ratio statistics and guardrails."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1000


class AssignmentError(ValueError):
    pass


def unit_bucket(unit: Column, salt: str, buckets: int = BUCKETS) -> Column:
    """First 64 bits of SHA-256 of ``salt:unit``, modulo ``buckets``; null units get none."""
    if not salt or buckets < 2:
        raise AssignmentError("buckets need a salt, and there are two or more")
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), unit.cast("string")), 256)
    number = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    return F.pmod(number, F.lit(buckets)).cast("int")


def check_weights(arms: Mapping[str, float]) -> None:
    if not arms or any(w <= 0 for w in arms.values()) or abs(sum(arms.values()) - 1) > 1e-9:
        raise AssignmentError(f"weights must be positive and sum to 1: {dict(arms)}")


def assign(unit: Column, salt: str, arms: Mapping[str, float]) -> Column:
    """The arm of each unit: arms in order of name, each with its share of buckets."""
    check_weights(arms)
    bucket, upto, out = unit_bucket(unit, salt), 0.0, None
    names = sorted(arms)
    for name in names:
        upto += arms[name]
        test = bucket < int(upto * BUCKETS)
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.when(bucket.isNotNull(), out.otherwise(names[-1]))


def srm_terms(df: DataFrame, arm: str, arms: Mapping[str, float]) -> DataFrame:
    """arm, observed, expected, term: the sum of terms is chi squared."""
    check_weights(arms)
    counts = df.groupBy(F.col(arm).alias("arm")).agg(F.count("*").alias("observed"))
    share = F.create_map(*[x for k, w in sorted(arms.items()) for x in (F.lit(k), F.lit(float(w)))])
    total = counts.agg(F.sum("observed").alias("total"))
    out = counts.join(F.broadcast(total)).withColumn("expected", F.col("total") * share[F.col("arm")])
    return out.select("arm", "observed", "expected", (F.pow(F.col("observed") - F.col("expected"), F.lit(2)) / F.col("expected")).alias("term"))


def guardrail_status(guardrails: DataFrame, values: DataFrame) -> DataFrame:
    """guardrails (name, direction, threshold) left join values (name, baseline, variant)."""
    d = guardrails.join(values, "name", "left").withColumn("delta", F.col("variant") - F.col("baseline"))
    worse = F.when(F.col("direction") == "not_increase", F.col("delta") > F.col("threshold")).otherwise(F.col("delta") < -F.col("threshold"))
    status = F.when(F.col("delta").isNull(), "NO_DATA").when(worse, "BROKEN").otherwise("OK")
    return d.select("name", "direction", "threshold", "delta", status.alias("status"))
