"""Personal data: patterns, and information-theoretic sanitisation of terms.

Emails, IP addresses, payment cards and phone numbers are found by pattern:
the protected entities. Terms of texts that hold them are weighed by how much
they reveal: over the whole corpus, how often a text that has the term holds
that entity, and how many bits that adds to the entity's own frequency.
Terms beyond both thresholds are spans too. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywell.llm.common import BROADCAST_ROWS, lookup, materialise, maybe_broadcast, within
from tallywell.llm.spans import Kind, find_spans, mask, span_struct

#: Different texts in which a term must stand together with an entity.
SUPPORT = 3
#: A term is disclosing if P(entity | term) is so high and so many bits are gained.
CERTAINTY, BITS = 0.5, 6.0
#: From this certainty a term is removed; below it is generalised.
REMOVE = 0.9
#: Letters of a term at least: short names are terms too.
LETTERS = 2

_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    d = _digits(match)

    def worth(i: Column) -> Column:
        v = F.substring(d, -i, F.lit(1)).cast("int")
        doubled = F.when(v > 4, 2 * v - 9).otherwise(2 * v)
        return F.when(i % 2 == 0, doubled).otherwise(v)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(d)), worth), F.lit(0), lambda a, b: a + b) % 10 == 0


# Each pattern finds what its plain form finds, in time linear in the text: a
# match can start only where a run of its first class starts, loops don't give
# back, and a chain of digits that isn't 14 to 19 long is skipped whole.
KINDS = [
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None, "@"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), "."),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])", _luhn),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(10, 15), "+"),
]
BASE = len(KINDS)


def _words(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), r"\P{L}+")), lambda w: F.length(w) >= LETTERS)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per row of ``docs``: tw_row, id, base and all spans as arrays, and how many terms were weighed.

    Spans are (start, order, end, kind), counted in code points, sorted by
    start and then by kind; ``removed`` holds the starts of terms to remove
    rather than generalise; ``weighed`` counts the text's different words that
    were weighed against its entities. Base spans are always reported. Every occurrence of
    a term in a text that holds an entity it reveals is a ``term`` span, however
    far away, unless it overlaps a base span.
    Null and empty texts have none; repeated rows keep their rows; other
    columns are ignored; an empty table gives an empty result.
    """
    rows, hits = find_spans(docs, id_col, text_col, KINDS, extra={"tw_hash": F.xxhash64(text_col)}, name="private")
    texts = docs.select(F.xxhash64(text_col).alias("tw_hash"), F.col(text_col).alias("tw_text"))
    entity = F.concat_ws(":", "tw_kind", F.lower(F.regexp_replace("tw_match", r"[\x20()-]", "")))
    # all is counted by different texts, which know their numbers of rows
    held = hits.select(entity.alias("entity"), "tw_hash", "tw_row").distinct().groupBy("entity", "tw_hash").agg(F.count("*").alias("copies"))
    held = materialise(held, "held")
    every = docs.count()
    # of an entity in fewer texts, or in so many rows that no term adds enough bits, no term can be told
    of_entity = held.groupBy("entity").agg(F.count("*").alias("texts"), F.sum("copies").alias("entity_rows"))
    of_entity = of_entity.where((F.col("texts") >= SUPPORT) & (F.col("entity_rows") * 2.0**BITS <= every)).drop("texts")
    of_entity = maybe_broadcast(materialise(of_entity, "entities"))
    held = materialise(held.join(of_entity.select("entity"), "entity"), "open")
    holding = materialise(held.groupBy("tw_hash").agg(F.first("copies").alias("copies")), "holding")
    words = texts.join(maybe_broadcast(holding.select("tw_hash")), "tw_hash").select("tw_hash", F.explode(_words(F.col("tw_text"))).alias("term"))
    words = materialise(words.distinct(), "words")
    pairs = words.join(held, "tw_hash").groupBy("term", "entity").agg(F.count("*").alias("support"), F.sum("copies").alias("both"))
    # a term is in no fewer rows than hold any such entity: most words can't be
    # certain enough by that alone, and need not be counted over the corpus
    around_any = words.join(holding, "tw_hash").groupBy("term").agg(F.sum("copies").alias("near_rows"))
    pairs = pairs.where(F.col("support") >= SUPPORT).join(around_any, "term").where(F.col("both") >= CERTAINTY * F.col("near_rows")).drop("near_rows")
    pairs = materialise(pairs, "terms")
    known = materialise(pairs.select("term").distinct(), "known")
    # outer: for the inner form Spark would split every text once more, to drop empty ones beforehand
    anywhere = texts.select(F.explode_outer(F.array_distinct(F.split(F.lower("tw_text"), r"\P{L}+"))).alias("term"))
    few = within(known, broadcast_rows)  # else words are counted before they meet the terms, a row each
    seen = (anywhere.join(F.broadcast(known), "term") if few else anywhere).groupBy("term").agg(F.count("*").alias("rows"))
    told = pairs.join(seen, "term").join(of_entity, "entity")
    certainty = F.least(F.col("both") / F.col("rows"), F.lit(1.0))
    told = told.withColumn("certainty", certainty).where(
        (certainty >= CERTAINTY) & (F.log2(certainty * every / F.col("entity_rows")) >= BITS))
    told = maybe_broadcast(materialise(told.select("term", "entity", "certainty"), "told"))
    here = held.join(told, "entity").join(words, ["tw_hash", "term"]).groupBy("tw_hash", "term").agg((F.max("certainty") >= REMOVE).alias("gone"))
    here = materialise(here, "here")
    # a text is split once, whatever its copies; its words' places are running sums
    once = texts.join(maybe_broadcast(here.select("tw_hash").distinct()), "tw_hash").groupBy("tw_hash").agg(F.first("tw_text").alias("tw_text"))
    found, gaps = F.regexp_extract_all("tw_text", F.lit(r"\p{L}+"), F.lit(0)), F.split("tw_text", r"\p{L}+")
    each = once.select("tw_hash", F.posexplode(F.zip_with(
        found, F.slice(gaps, F.lit(1), F.size(found)), lambda w, g: F.struct(w.alias("word"), (F.length(g)).alias("gap")))).alias("at", "w"))
    before = Window.partitionBy("tw_hash").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    each = each.select("tw_hash", F.lower("w.word").alias("term"), F.length("w.word").alias("n"), F.sum(F.col("w.gap") + F.length("w.word")).over(before).alias("tw_end"))
    placed = each.join(here, ["tw_hash", "term"]).select(
        "tw_hash", (F.col("tw_end") - F.col("n")).alias("tw_start"), "tw_end", F.lit(BASE).alias("tw_order"), F.lit("term").alias("tw_kind"), "gone")
    of_text = placed.groupBy("tw_hash").agg(
        F.collect_list(span_struct()).alias("added"), F.collect_list(F.when(F.col("gone"), F.col("tw_start"))).alias("removed"))
    of_row = hits.groupBy("tw_row").agg(F.collect_list(span_struct()).alias("base"))
    empty = F.array().cast("array<struct<start:bigint,order:int,end:bigint,kind:string>>")
    out = rows.select("tw_row", "tw_hash", F.col("tw_id").alias(id_col)).join(of_row, "tw_row", "left")
    of_text = materialise(words.groupBy("tw_hash").agg(F.count("*").alias("weighed")).join(of_text, "tw_hash", "left"), "of_text")
    out = lookup(out, of_text, "tw_hash", "left", limit=broadcast_rows)
    out = out.withColumns({
        "base": F.coalesce("base", empty), "added": F.coalesce("added", empty),
        "removed": F.coalesce("removed", F.array().cast("array<bigint>")), "weighed": F.coalesce("weighed", F.lit(0).cast("long"))})
    apart = F.filter("added", lambda a: ~F.exists("base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    return out.select("tw_row", id_col, "base", F.sort_array(F.concat("base", apart)).alias("spans"),
                      F.array_intersect("removed", F.transform(apart, lambda a: a["start"])).alias("removed"), "weighed")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with entities replaced by their kind, disclosing terms by ``[TERM]`` or nothing.

    Rows come back by id and text; other columns and rows without spans stay.
    """
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    found = scan(docs.withColumn("tw_key", key), "tw_key", text_col).where(F.size("spans") > 0)
    found = found.groupBy(F.col("tw_key.id").alias("tw_rid"), F.col("tw_key.hash").alias("tw_rhash")).agg(
        F.first("spans").alias("tw_spans"), F.first("removed").alias("tw_removed"))
    found = maybe_broadcast(found)
    same = F.col(id_col).eqNullSafe(F.col("tw_rid")) & (F.xxhash64(text_col) == F.col("tw_rhash"))

    def label(s: Column) -> Column:
        gone = (s["kind"] == "term") & F.array_contains("tw_removed", s["start"])
        return F.when(gone, "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))

    masked = F.when(F.col("tw_spans").isNotNull(), mask(F.col(text_col), F.col("tw_spans"), label)).otherwise(F.col(text_col))
    return docs.join(found, same, "left").withColumn(text_col, masked).select(*docs.columns)
