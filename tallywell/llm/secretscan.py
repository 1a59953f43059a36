"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found in every text. Their hashes are counted by distinct
repositories and owners over the whole corpus: a string that many owners hold,
or that several hold in many repositories, is a copied example; one that stays
with an owner or two, in however many repositories of theirs, looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import BROADCAST_ROWS, lookup, materialise, maybe_broadcast
from tallywell.llm.spans import Kind, find_spans, mask, span_struct

#: A candidate of at most so many owners is theirs.
LIVE_OWNERS = 2
#: A candidate of so many owners is a widely copied example, and so is one of
#: more than LIVE_OWNERS that is in so many repositories.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 5, 10
#: Strings that mark a placeholder, whoever holds it.
PLACEHOLDER = r"(?i)example|changeme|your[_-]?|placeholder|dummy|x{6,}|\*{3,}|<|\$\{|0{8,}|1234567"


_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def _long_value(match: Column) -> Column:
    return F.length(F.regexp_extract(match, _ASSIGN, 2)) >= 12


#: The base kinds, as listed, then what the method adds.
KINDS = [
    Kind("assign", _ASSIGN, _long_value),
    Kind("access", r"AKIA[A-Z0-9]{14,}", None, "AKIA"),
    Kind("hex", r"[0-9a-f]{16,}"),
    Kind(
        "generic", r"(?<![A-Za-z0-9+_=-])[A-Za-z0-9+_=-]{24,}+",
        lambda m: m.rlike(r"[A-Z]") & m.rlike(r"[a-z]") & m.rlike(r"[0-9].*[0-9].*[0-9]") & (F.size(F.array_distinct(F.split(m, ""))) >= 12),
    ),
]
BASE = 3


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repo_col: str = "doc_id",
    owner_col: str = "source",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Per row of ``docs``: tw_row, id, base and all spans, and their classes.

    Columns: base and spans (arrays of (start, order, end, kind)), live and
    examples (how many spans look live or copied; others are neither). Base
    spans are always reported. A ``generic`` span is reported if it overlaps no
    base span and looks live: few owners hold it, and nothing marks it as a
    placeholder. By default a document is a repository of its source. A null
    owner or repository is one of its own kind. Null and empty texts have no
    spans; repeated rows keep their rows; other columns are ignored; an empty
    table gives an empty result. Rows are numbered in the written table of matches.
    """
    owners = {"tw_repo": F.coalesce(F.col(repo_col).cast("string"), F.lit("")), "tw_owner": F.coalesce(F.col(owner_col).cast("string"), F.lit(""))}
    all_rows, hits = find_spans(docs, id_col, text_col, KINDS, owners, name="secrets")
    hits = hits.withColumn("tw_hash", F.sha2("tw_match", 256))
    # distinct counts go by (hash, owner) and (hash, repository) first: a string
    # that a third of the corpus holds is spread and reduced before it meets
    known = hits.groupBy("tw_hash").agg(F.count_distinct("tw_repo").alias("tw_repos"), F.count_distinct("tw_owner").alias("tw_owners"))
    spans = lookup(hits, materialise(known, "owned"), "tw_hash", limit=broadcast_rows)
    owned = F.col("tw_owners") <= LIVE_OWNERS
    copied = (F.col("tw_owners") >= EXAMPLE_OWNERS) | (~owned & (F.col("tw_repos") >= EXAMPLE_REPOS)) | F.col("tw_match").rlike(PLACEHOLDER)
    spans = spans.withColumn("tw_class", F.when(copied, "example").when(owned, "live").otherwise(""))
    spans = spans.where((F.col("tw_order") < BASE) | (F.col("tw_class") == "live"))
    place = F.struct(F.col("tw_start").alias("start"), F.col("tw_order").alias("order"))
    of_row = spans.groupBy("tw_row").agg(
        F.collect_list(F.when(F.col("tw_order") < BASE, span_struct())).alias("base"),
        F.collect_list(F.when(F.col("tw_order") >= BASE, span_struct())).alias("added"),
        F.collect_list(F.when(F.col("tw_class") == "live", place)).alias("live_at"),
        F.collect_list(F.when(F.col("tw_class") == "example", place)).alias("example_at"),
    )
    empty = F.array().cast("array<struct<start:bigint,order:int,end:bigint,kind:string>>")
    none = F.array().cast("array<struct<start:bigint,order:int>>")
    rows = all_rows.select("tw_row", F.col("tw_id").alias(id_col)).join(of_row, "tw_row", "left")
    rows = rows.withColumns({
        "base": F.coalesce("base", empty), "added": F.coalesce("added", empty),
        "live_at": F.coalesce("live_at", none), "example_at": F.coalesce("example_at", none)})
    apart = F.filter("added", lambda a: ~F.exists("base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    rows = rows.withColumn("spans", F.sort_array(F.concat("base", apart)))
    # added spans all look live; those that were left out for a base span don't count
    gone = F.size("added") - (F.size("spans") - F.size("base"))
    return rows.select("tw_row", id_col, "base", "spans", (F.size("live_at") - gone).cast("long").alias("live"), F.size("example_at").cast("long").alias("examples"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """``docs`` with every reported secret in the text replaced by a label.

    Spans depend on a text and its owner alone, so they are brought back to
    rows by id and text; texts without spans stay as they are, and so do all
    other columns, nulls among them.
    """
    found = scan(docs.withColumn("tw_key", F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))), "tw_key", text_col, **columns)
    found = found.where(F.size("spans") > 0).groupBy(F.col("tw_key.id").alias("tw_rid"), F.col("tw_key.hash").alias("tw_rhash")).agg(F.first("spans").alias("tw_spans"))
    found = maybe_broadcast(found)
    same = F.col(id_col).eqNullSafe(F.col("tw_rid")) & (F.xxhash64(text_col) == F.col("tw_rhash"))
    masked = F.when(F.col("tw_spans").isNotNull(), mask(F.col(text_col), F.col("tw_spans"), lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
    return docs.join(found, same, "left").withColumn(text_col, masked.otherwise(F.col(text_col))).select(*docs.columns)
