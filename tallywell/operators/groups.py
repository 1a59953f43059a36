"""Sufficient statistics of two groups, and privacy groups, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.functions.predicates import identifier, is_truthy
from tallywell.operators.running import cumulative
from tallywell.operators.shift import median_difference
from tallywell.session import checkpoint_ready


def group_counts(df: DataFrame, arm: str, converted: str, arms: tuple[str, str] = ("a", "b")) -> DataFrame:
    """One row s_a, n_a, s_b, n_b, by one scan; raises for an arm that isn't known."""
    a = F.col(identifier(arm))
    yes = is_truthy(F.col(identifier(converted)))
    row = df.agg(F.min(F.when(~a.isin(*arms), a.cast("string"))), *[x for k in arms for x in (F.count_if((a == k) & yes), F.count_if(a == k))]).first()
    if row[0] is not None:
        raise ValueError(f"an arm that isn't {arms[0]} or {arms[1]}: {row[0]!r}")
    return df.sparkSession.createDataFrame([tuple(row[1:])], "s_a long, n_a long, s_b long, n_b long")


def moments(df: DataFrame, group: str, value: str) -> DataFrame:
    """grp, n, mean, var, skew, kurt of values that aren't null; sums alone, so no group is gathered."""
    x = F.col(value).cast("double")
    return df.where(x.isNotNull() & F.col(group).isNotNull()).groupBy(F.col(group).alias("grp")).agg(
        F.count("*").alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"),
        F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"))


def _counted(df: DataFrame, group: str, value: str) -> DataFrame:
    x = F.col(value).cast("double")
    return df.where(x.isNotNull() & F.col(group).isNotNull()).groupBy(x.alias("x"), F.col(group).alias("grp")).agg(F.count("*").alias("n"))


def medians(df: DataFrame, group: str, value: str) -> DataFrame:
    """grp, median (exact; an even number of values averages the middle two) of values that aren't null."""
    c = cumulative(_counted(df, group, value), ["grp"], "n")
    n = c.groupBy("grp").agg(F.sum("n").alias("all"))
    at = lambda k: F.min(F.when(F.col("upto") >= k, F.col("x")))
    low, high = F.floor((F.col("all") + 1) / 2), F.floor(F.col("all") / 2) + 1
    return c.join(n, "grp").groupBy("grp").agg(((at(low) + at(high)) / 2).alias("median"))


def value_ranks(df: DataFrame, group: str, value: str) -> DataFrame:
    """x, ties, rank, and n by group: average ranks over distinct values, which are counted first."""
    per = _counted(df, group, value).groupBy("x").agg(
        F.sum("n").alias("ties"), F.map_from_entries(F.collect_list(F.struct("grp", "n"))).alias("by"))
    per = cumulative(per.withColumn("one", F.lit(1)), ["one"], "ties")
    return per.select("x", "ties", (F.col("upto") - (F.col("ties") - 1) / 2).alias("rank"), "by")


def rank_sums(df: DataFrame, group: str, value: str) -> DataFrame:
    """grp, n, rank_sum, tie_sum (of t^3 - t over all ties, the same in each row)."""
    ranks = value_ranks(df, group, value)
    ties = ranks.agg(F.sum(F.pow("ties", F.lit(3)) - F.col("ties")).alias("tie_sum"))
    each = ranks.select("rank", F.explode("by").alias("grp", "k"))
    return each.groupBy("grp").agg(F.sum("k").alias("n"), F.sum(F.col("rank") * F.col("k")).alias("rank_sum")).join(F.broadcast(ties))


def hodges_lehmann(df: DataFrame, group: str, value: str, a: str, b: str) -> float | None:
    """Median of all differences between the groups, exact for any size; None if a group is empty."""
    checkpoint_ready(df.sparkSession)
    c = _counted(df.where(F.col(group).isin(a, b)), group, value).withColumnRenamed("n", "w").checkpoint()  # read several times
    return median_difference(*(c.where(F.col("grp") == g).select("x", "w") for g in (a, b)))


def two_proportion_terms(s_a: Column, n_a: Column, s_b: Column, n_b: Column) -> tuple[Column, Column]:
    """(difference, z) as columns, for series of many comparisons."""
    p, q = s_a / n_a, s_b / n_b
    pool = (s_a + s_b) / (n_a + n_b)
    se = F.sqrt(pool * (1 - pool) * (1 / n_a + 1 / n_b))
    return p - q, F.coalesce(F.try_divide(p - q, F.nullif(se, F.lit(0.0))), F.lit(0.0))


def k_anonymity_groups(df: DataFrame, quasi: list[str], k: int) -> DataFrame:
    """Groups of quasi-identifiers with fewer than k rows; null is a value."""
    if k < 1 or not quasi:
        raise ValueError("k-anonymity needs a k of 1 or more and a quasi-identifier")
    names = [identifier(q, "quasi-identifier") for q in quasi]
    return df.groupBy(*names).agg(F.count("*").alias("n")).where(F.col("n") < k)


def smallest_groups(df: DataFrame, quasi: list[str], k: int) -> DataFrame:
    """The groups that break k-anonymity, smallest first, ties in order of their values."""
    return k_anonymity_groups(df, quasi, k).orderBy("n", *quasi)


def k_anonymity(df: DataFrame, quasi: list[str], k: int) -> dict:
    """satisfied, min_group, offending_groups, affected_rows; an empty table is satisfied."""
    k_anonymity_groups(df, quasi, k)  # checks the names
    groups = df.groupBy(*quasi).agg(F.count("*").alias("n"))
    small = F.col("n") < k
    row = groups.agg(F.min("n"), F.count_if(small), F.sum(F.when(small, F.col("n")))).first()
    return {"satisfied": not row[1], "min_group": row[0] or 0, "offending_groups": row[1], "affected_rows": row[2] or 0, "k": k}


def require_k_anonymity(df: DataFrame, quasi: list[str], k: int) -> dict:
    found = k_anonymity(df, quasi, k)
    if not found["satisfied"]:
        raise PermissionError(f"{found['offending_groups']} groups have fewer than {k} rows")
    return found
