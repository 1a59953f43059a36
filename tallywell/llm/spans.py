"""Spans of regular expressions in whole texts, in DataFrame functions only.

Spark's functions return matched strings, not places. A text split by a
pattern and the pattern's matches alternate, so that running sums of their
lengths are the matches' places, counted in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywell.llm.common import let, materialise


@dataclass(frozen=True)
class Kind:
    """A pattern and what a match must hold to count (given the match).

    ``needs``: a string that every match holds, which spares other texts the
    pattern. Patterns are Java's.
    """

    name: str
    pattern: str
    holds: object = None
    needs: str = ""


def _pieces(order: int, matches: Column, context: int):
    """Gaps -> for each match its order, the gap before it, itself and its context."""

    def of(gaps: Column) -> Column:
        def one(x: Column, j: Column) -> Column:
            gap, after = F.get(gaps, j), F.get(gaps, j + 1)
            return F.struct(
                F.lit(order).alias("order"), F.length(gap).alias("gap"), x.alias("match"),
                (F.right(gap, F.lit(context)) if context else F.lit("")).alias("before"),
                (F.left(after, F.lit(context)) if context else F.lit("")).alias("after"))

        return F.transform(matches, one)

    return of


def find_spans(
    docs: DataFrame, id_col: str, text_col: str, kinds: list[Kind], extra: dict[str, Column] | None = None,
    context: int = 0, name: str = "spans",
) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` and the spans in them, as two narrow tables.

    Rows: tw_row (their number), tw_id and the columns of ``extra``. Spans:
    those, and tw_order (the kind's place in ``kinds``), tw_kind, tw_start,
    tw_end (exclusive), tw_match, tw_before and tw_after (``context`` code
    points around it, up to the kind's neighbouring matches). Matches are
    leftmost and don't overlap within a kind; those that fail the kind's test
    are left out. Null texts are empty. What the texts are read for is written
    to the shared folder once; the numbers are those of the written rows.
    """
    extra = extra or {}
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("tw_id"), *[c.alias(n) for n, c in extra.items()], text.alias("tw_text"))
    d = d.withColumn("tw_row", F.monotonically_increasing_id())
    none = F.array().cast("array<string>")
    found = {}
    for i, k in enumerate(kinds):
        m = F.regexp_extract_all("tw_text", F.lit(k.pattern), F.lit(0))
        found[f"tw_m{i}"] = F.when(F.contains("tw_text", F.lit(k.needs)), m).otherwise(none) if k.needs else m
    d = d.withColumns(found)
    piece = "array<struct<order:int,gap:int,match:string,before:string,after:string>>"
    pieces = []
    for i, k in enumerate(kinds):
        m = F.col(f"tw_m{i}")
        at_gaps = let(F.split("tw_text", k.pattern), _pieces(i, m, context))
        pieces.append(F.when(F.size(m) > 0, at_gaps).otherwise(F.array().cast(piece)))
    shared = ["tw_row", "tw_id", *extra]
    d = d.select(*shared, F.posexplode_outer(F.concat(*pieces)).alias("tw_at", "tw_piece"))
    d = materialise(d.select(*shared, F.coalesce("tw_at", F.lit(0)).alias("tw_at"), "tw_piece.*"), name)
    rows = d.where(F.col("tw_at") == 0).select(*shared)
    # gaps and matches before a match; a document's matches are in one task, documents in many
    before = Window.partitionBy("tw_row", "order").orderBy("tw_at").rowsBetween(Window.unboundedPreceding, 0)
    placed = d.where(F.col("order").isNotNull()).withColumn("tw_end", F.sum(F.col("gap") + F.length("match")).over(before))
    tests = F.lit(True)
    for i, k in enumerate(kinds):
        if k.holds is not None:
            tests = F.when(F.col("order") == i, k.holds(F.col("match"))).otherwise(tests)
    names = F.element_at(F.array(*[F.lit(k.name) for k in kinds]), F.col("order") + 1)
    spans = placed.where(tests).select(
        *shared, F.col("order").alias("tw_order"), names.alias("tw_kind"), (F.col("tw_end") - F.length("match")).alias("tw_start"),
        "tw_end", F.col("match").alias("tw_match"), F.col("before").alias("tw_before"), F.col("after").alias("tw_after"))
    return rows, spans


def spans_text(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, of structs (start, order, end, kind)."""
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_struct() -> Column:
    return F.struct(F.col("tw_start").alias("start"), F.col("tw_order").alias("order"), F.col("tw_end").alias("end"), F.col("tw_kind").alias("kind"))


def mask(text: Column, spans: Column, label) -> Column:
    """``text`` with each span replaced by ``label(span)``; overlapping spans become one, under the first's label."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        inside = s["start"] < acc["at"]
        out = F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(kept, label(s))))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    def end(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(F.sort_array(spans), start, step, end)).otherwise(text)
