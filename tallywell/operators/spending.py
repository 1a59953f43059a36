"""Budgets over tables of spends: whether one is accepted depends on those accepted before."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywell.operators.running import cumulative
from tallywell.session import stored

#: Spends of one group that a task folds at a time, and what a budget may be exceeded by through rounding.
CHUNK, SLACK = 100_000, 1e-9


def fold(spends: list[float], spent: float, total: float) -> tuple[list[bool], float]:
    """Which of ``spends`` are accepted in their order, and what is spent then."""
    out = []
    for e in spends:
        fits = spent + e <= total + SLACK
        out.append(fits)
        if fits:
            spent += e
    return out, spent


def accept(spends: DataFrame, group: str, order: list[str], amount: str, total: float, chunk: int | None = None) -> DataFrame:
    """``spends`` with ``accepted``, and ``spent_before`` of those that were judged one by one, of each group in order.

    A spend is accepted if with all accepted before it stays within ``total``.
    A null or negative amount is refused. Amounts above what a group has left
    can never be accepted later, so only chunks that hold one that still fits are
    folded: the next such chunk of every group at once, with what it has spent
    carried over. ``order`` must tell the rows of a group apart. Null groups are
    one group.
    """
    width = chunk or CHUNK
    key = F.struct(*order)
    own = spends.select(F.struct("*").alias("r"), F.coalesce(F.col(group).cast("string"), F.lit("\x00")).alias("g"), key.alias("x"), F.col(amount).cast("double").alias("e"), F.lit(1).alias("one"))
    ranked = cumulative(own, ["g"], "one").withColumn("c", F.floor((F.col("upto") - 1) / width))
    bad = F.col("e").isNull() | F.isnan("e") | (F.col("e") < 0)
    ranked = stored(ranked.withColumn("bad", bad), "spends")
    sizes = stored(ranked.where(~F.col("bad")).groupBy("g", "c").agg(F.min("e").alias("least")), "chunks")
    state = ranked.select("g").distinct().select("g", F.lit(0.0).alias("spent"), F.lit(-1).cast("long").alias("done"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, spent, upto, amounts = (batch.column(i).to_pylist() for i in range(4))
            rows: dict[str, list] = {"g": [], "upto": [], "ok": [], "before": [], "after": []}
            for name, before, places, es in zip(g, spent, upto, amounts, strict=True):
                now = before
                for place, e in zip(places, es, strict=True):
                    (fits,), after = fold([e], now, total)
                    for k, v in (("g", name), ("upto", place), ("ok", fits), ("before", now), ("after", after)):
                        rows[k].append(v)
                    now = after
            yield pa.RecordBatch.from_arrays([pa.array(rows["g"], pa.string()), pa.array(rows["upto"], pa.int64()), pa.array(rows["ok"], pa.bool_()), pa.array(rows["before"], pa.float64()), pa.array(rows["after"], pa.float64())], list(rows))

    judged = []
    while True:
        # the next chunk of each group with an amount that still fits
        ahead = sizes.join(state, "g").where((F.col("c") > F.col("done")) & (F.col("spent") + F.col("least") <= total + SLACK))
        turn = stored(ahead.groupBy("g", "spent").agg(F.min("c").alias("c")), "turn")
        if turn.isEmpty():
            break
        rows = ranked.where(~F.col("bad")).join(turn, ["g", "c"]).where(F.col("spent") + F.col("e") <= total + SLACK)
        # at most ``chunk`` rows of a group
        lists = rows.groupBy("g", "spent", "c").agg(F.array_sort(F.collect_list(F.struct("upto", "e"))).alias("l"))
        out = lists.select("g", "spent", "l.upto", "l.e").mapInArrow(judge, "g string, upto long, ok boolean, before double, after double")
        out = stored(out, "judged")
        judged.append(out)
        after = out.groupBy("g").agg(F.max("after").alias("after")).join(turn.select("g", "c"), "g", "right")
        state = stored(state.join(after, "g", "left").select("g", F.coalesce("after", "spent").alias("spent"), F.coalesce("c", "done").alias("done")), "state")
    if not judged:
        return ranked.select("r.*", F.lit(False).alias("accepted"), F.lit(None).cast("double").alias("spent_before"))
    every = judged[0]
    for j in judged[1:]:
        every = every.unionByName(j)
    found = ranked.join(every, ["g", "upto"], "left")
    return found.select("r.*", F.coalesce("ok", F.lit(False)).alias("accepted"), F.col("before").alias("spent_before"))
