"""Normality of all groups of a table at once, without gathering a group's values."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywell.functions import kernels as K
from tallywell.operators.running import cumulative

#: Values up to which Shapiro-Wilk is taken; beyond, K squared of the moments.
SHAPIRO = 5000
#: Ranks of equal values that stand in one row at most.
RUN = 10_000


def normality(df: DataFrame, group: str, value: str, shapiro: int | None = SHAPIRO) -> DataFrame:
    """grp, n, test, statistic, p_value of each group's values that aren't null.

    Ranks come from running counts over ranges of values. Each of a small group's
    ranks meets its expected place, and W needs only sums over ranks and the
    outmost two values; larger groups need their moments alone. Fewer than three
    values, or values that are all equal, give nulls. Null groups don't count.
    ``shapiro`` is the size up to which a group is small; None: any.
    """
    small_one = lambda n: shapiro is None or n <= shapiro
    x = F.col(value).cast("double")
    own = df.where(x.isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("grp"), x.alias("x"))
    sums = own.groupBy("grp").agg(
        F.count("*").alias("n"), (F.var_samp("x") * (F.count("*") - 1)).alias("squares"), F.skewness("x").alias("skew"), F.kurtosis("x").alias("kurt"))
    small = sums.where((F.col("n") >= 3) & small_one(F.col("n"))).select("grp", "n")
    counted = own.join(small, "grp").groupBy("grp", "x", "n").agg(F.count("*").alias("k"))
    # ranks of a value in short runs, as it may be that of millions of rows
    runs = cumulative(counted, ["grp"], "k").select("grp", "n", "x", "upto", F.explode(F.sequence(F.col("upto") - F.col("k") + 1, F.col("upto"), F.lit(RUN))).alias("first"))
    places = runs.select("grp", "n", "x", F.explode(F.sequence("first", F.least("upto", F.col("first") + (RUN - 1)))).alias("i"))

    @F.pandas_udf("double")
    def expected(i: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([K.expected_order(a, b) for a, b in zip(i, n, strict=True)])

    at = lambda i: F.max(F.when(F.col("i") == i, F.col("x")))
    n = F.col("n")
    ranked = places.withColumn("m", expected("i", "n")).groupBy("grp").agg(
        F.sum(F.col("m") * F.col("m")).alias("mm"), F.sum(F.col("m") * F.col("x")).alias("mx"), at(F.lit(1)).alias("x1"), at(F.lit(2)).alias("x2"), at(n).alias("z1"), at(n - 1).alias("z2"))
    rows = sums.join(ranked, "grp", "left").select("grp", "n", "squares", "skew", "kurt", "mm", "mx", "x1", "x2", "z1", "z2")
    kind = rows.schema["grp"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tests, stats, ps = [], [], []
            for r in batch.to_pylist():
                test, found = ("shapiro" if small_one(r["n"]) else "k_squared"), (None, None)
                try:
                    if not small_one(r["n"]):
                        found = K.k_squared(r["n"], r["skew"], r["kurt"])
                    elif r["n"] >= 3:
                        found = K.shapiro_of_sums(r["n"], r["mm"], r["mx"], (r["x1"], r["x2"]), (r["z1"], r["z2"]), r["squares"])
                except (K.StatInputError, TypeError):  # values that are all equal have no shape
                    pass
                tests.append(test)
                stats.append(found[0])
                ps.append(found[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tests, pa.string()), pa.array(stats, pa.float64()), pa.array(ps, pa.float64())], ["grp", "n", "test", "statistic", "p_value"])

    return rows.mapInArrow(judge, f"grp {kind}, n long, test string, statistic double, p_value double")
