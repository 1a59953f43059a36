"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every window of 13 words has a fingerprint: the least hash of the 5-word
grams in it. Two texts that share 13 words in a row share the fingerprint of
that window, whatever surrounds it. Windows in a row mostly have the same one,
which is kept once with the run of windows it stands for. Documents' runs meet
the fingerprints of the benchmark; a hit is extended to its run's windows, which
are confirmed by their whole 13 words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import BROADCAST_ROWS, let, lookup, lower_ascii, materialise, maybe_broadcast

#: Words of a window, and of a gram; a window holds WINDOW - GRAM + 1 grams.
WINDOW, GRAM = 13, 5
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A document is contaminated if 1 / SHARE of its words or more are hit.
SHARE = 20


def words_of(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and characters beyond ASCII."""
    return F.array_remove(F.split(lower_ascii(text), _BETWEEN), "")


def fingerprints(words: Column) -> Column:
    """The fingerprint of each window of WINDOW words, by the window's first word."""
    grams = F.transform(words, lambda w: F.xxhash64(w))

    def hashes(g: Column) -> Column:
        return F.transform(
            F.slice(g, F.lit(1), F.greatest(F.size(g) - (GRAM - 1), F.lit(0))), lambda _, i: F.xxhash64(F.slice(g, i + 1, GRAM)))

    def minima(h: Column) -> Column:
        n = WINDOW - GRAM + 1
        return F.transform(
            F.slice(h, F.lit(1), F.greatest(F.size(h) - (n - 1), F.lit(0))), lambda _, i: F.array_min(F.slice(h, i + 1, n)))

    return let(grams, lambda g: let(hashes(g), minima))


_RUN = "array<struct<print:bigint,at:int,upto:int>>"


def runs(words: Column) -> Column:
    """The thinned fingerprints: each with the first and last window, from 1, of the run that shares it."""

    def thin(m: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: (i == 0) | (F.get(m, i) != F.get(m, i - 1)))
        return let(starts, lambda s: F.transform(s, lambda i, j: F.struct(
            F.get(m, i).alias("print"), (i + 1).alias("at"), F.coalesce(F.get(s, j + 1), F.size(m)).alias("upto"))))

    return let(fingerprints(words), lambda m: F.when(F.size(m) > 0, thin(m)).otherwise(F.array().cast(_RUN)))


def windows_text(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    fingerprint_rows: int = BROADCAST_ROWS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Per row of ``docs``: id, text_hash, n_words, n_hit, item_ids and contaminated.

    A word is hit if it lies in an occurrence of a window of an item: 13
    consecutive words, or the whole item if it has fewer. ``item_ids`` are the
    items with occurring windows, as sorted strings. A document with n_hit > 0
    and 20 * n_hit >= n_words is contaminated. Null and empty texts have no
    words; items without words or without an id take no part; repeated rows of
    documents each get a row and repeated items count once; empty tables give
    no rows or no hits; other columns are ignored.

    Winnowing covers windows of 13 words. Shorter items are found by their
    first word instead, in one more pass, if there are any. Fingerprints are
    broadcast in parts of at most ``fingerprint_rows``; each part is one pass.
    Only hits are shuffled, with a window's number in place of its items.
    """
    b = items.select(F.col(item_id_col).cast("string").alias("tw_item"), words_of(F.col(item_text_col)).alias("tw_words"))
    b = b.where(F.col("tw_item").isNotNull() & (F.size("tw_words") > 0))
    b = b.withColumn("tw_span", F.least(F.size("tw_words"), F.lit(WINDOW)))
    each = b.select("tw_item", "tw_words", "tw_span", F.explode(F.sequence(F.lit(1), F.size("tw_words") - F.col("tw_span") + 1)).alias("tw_at"))
    each = each.select("tw_item", "tw_span", windows_text(F.col("tw_words"), F.col("tw_at"), F.col("tw_span")).alias("tw_text")).distinct()
    each = materialise(each, "windows")
    known = materialise(each.select("tw_text", "tw_span").distinct().withColumn("tw_window", F.monotonically_increasing_id()), "known")
    owners = materialise(lookup(each, known.drop("tw_span"), "tw_text", limit=broadcast_rows).select("tw_window", "tw_item"), "owners")
    long_items = b.where(F.col("tw_span") == WINDOW)
    prints = materialise(long_items.select(F.explode(runs(F.col("tw_words"))["print"]).alias("tw_print")).distinct(), "prints")
    parts = max(1, -(-prints.count() // fingerprint_rows))
    short = not each.where(F.col("tw_span") < WINDOW).isEmpty()

    text = F.col(text_col)
    d = docs.select(
        F.col(id_col).alias("tw_id"), F.xxhash64(text).alias("tw_hash"), words_of(text).alias("tw_words"))
    n_words = F.size("tw_words").alias("tw_n")

    # each row of documents gives one row with place 0, which stays, and one for each run
    def found(part: int) -> DataFrame:
        mine = prints.where(F.pmod(F.col("tw_print"), F.lit(parts)) == part) if parts > 1 else prints
        mine = F.broadcast(mine.withColumn("tw_known", F.lit(True)))
        all_runs = runs(F.col("tw_words"))
        if part == 0:
            row = F.struct(F.lit(None).cast("long").alias("print"), F.lit(0).alias("at"), F.lit(0).alias("upto"))
            all_runs = F.concat(F.array(row), all_runs)
        # a column of its own first, so that the rows it explodes into pass through generated code; outer, as
        # for the inner form Spark would compute the array once more, to drop empty ones beforehand
        e = d.withColumn("tw_runs", all_runs)
        e = e.select("tw_id", "tw_hash", "tw_words", F.explode_outer("tw_runs").alias("tw_run"))
        e = e.select("tw_id", "tw_hash", "tw_words", F.col("tw_run.print").alias("tw_print"), F.col("tw_run.at").alias("tw_at"), F.col("tw_run.upto").alias("tw_upto"))
        e = e.join(mine, "tw_print", "left").where(F.col("tw_known") | (F.col("tw_at") == 0))
        covered = F.when(F.col("tw_at") > 0, windows_text(F.col("tw_words"), F.col("tw_at"), F.col("tw_upto") - F.col("tw_at") + WINDOW))
        return e.select("tw_id", "tw_hash", n_words, "tw_at", "tw_upto", F.lit(WINDOW).alias("tw_span"), covered.alias("tw_covered"))

    seen = found(0)
    for part in range(1, parts):
        seen = seen.unionByName(found(part))
    if short:
        first = b.where(F.col("tw_span") < WINDOW).select(F.col("tw_words")[0].alias("tw_first"), F.col("tw_span").alias("tw_len"))
        first = maybe_broadcast(materialise(first.groupBy("tw_first").agg(F.collect_set("tw_len").alias("tw_lens")), "first"))
        e = d.select("tw_id", "tw_hash", "tw_words", F.posexplode("tw_words").alias("tw_at", "tw_first")).join(first, "tw_first")
        e = e.select("tw_id", "tw_hash", "tw_words", (F.col("tw_at") + 1).alias("tw_at"), F.explode("tw_lens").alias("tw_span"))
        e = e.where(F.col("tw_at") + F.col("tw_span") - 1 <= F.size("tw_words"))
        seen = seen.unionByName(e.select(
            "tw_id", "tw_hash", n_words, "tw_at", F.col("tw_at").alias("tw_upto"), "tw_span",
            windows_text(F.col("tw_words"), F.col("tw_at"), F.col("tw_span")).alias("tw_covered")))
    key = F.concat_ws(":", F.col("tw_hash").cast("string"), F.col("tw_id").cast("string"))
    seen = materialise(seen.withColumn("tw_key", key), "seen")

    # a run's windows by their words; only those that are an item's stay
    covered = F.split("tw_covered", " ")
    window = F.transform(F.sequence("tw_at", "tw_upto"), lambda p: F.struct(
        p.alias("tw_at"), windows_text(covered, p - F.col("tw_at") + 1, F.col("tw_span")).alias("tw_text")))
    hits = seen.where(F.col("tw_at") > 0).select("tw_key", F.explode(window).alias("w")).select("tw_key", "w.tw_at", "w.tw_text").distinct()
    hits = lookup(hits, known, "tw_text", limit=broadcast_rows)
    of_doc = hits.groupBy("tw_key").agg(
        F.sort_array(F.collect_set(F.struct("tw_at", "tw_span"))).alias("tw_hits"), F.sort_array(F.collect_set("tw_window")).alias("tw_windows"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def extend(acc: Column, x: Column) -> Column:
        end = x["tw_at"] + x["tw_span"]
        new = F.greatest(end, acc["end"])
        return F.struct(new.alias("end"), (acc["n"] + (new - F.greatest(x["tw_at"], acc["end"]))).cast("long").alias("n"))

    of_doc = of_doc.select(
        "tw_key", F.aggregate("tw_hits", start, extend)["n"].alias("n_hit"), "tw_windows", F.md5(F.array_join("tw_windows", ",")).alias("tw_set"))
    of_doc = materialise(of_doc, "hits")
    # documents that hold the same windows hold the same items, which are gathered once for all of them
    sets = of_doc.groupBy("tw_set").agg(F.first("tw_windows").alias("tw_windows")).select("tw_set", F.explode("tw_windows").alias("tw_window"))
    sets = sets.join(owners, "tw_window").groupBy("tw_set").agg(F.sort_array(F.collect_set("tw_item")).alias("item_ids"))
    of_doc = lookup(of_doc.select("tw_key", "n_hit", "tw_set"), materialise(sets, "items"), "tw_set", limit=broadcast_rows).drop("tw_set")
    rows = seen.where(F.col("tw_at") == 0).select("tw_key", "tw_id", "tw_hash", "tw_n")
    out = lookup(rows, materialise(of_doc, "of_doc"), "tw_key", "left", limit=broadcast_rows).select(
        F.col("tw_id").alias(id_col), F.col("tw_hash").alias("text_hash"), F.col("tw_n").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words")))
