"""The training-data pipeline: five stages, each written as Parquet and reread.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns a DataFrame; all but the last return the columns of
``documents``. A document is a row: repeated ids and null ids are rows like
others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.llm import langid, packing, partenum, secretscan, winnowing
from tallywell.llm.common import clean_up, fresh_path, lookup, materialise, maybe_broadcast, working_tables

#: A text counts as none of the known languages below this share of n-grams.
LEAST_SCORE = 0.2


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a language, or far from all, go.

    The others get the predicted language where they have none.
    """
    model = langid.train(docs.where(~langid.held_out("doc_id")))
    judged = langid.predict(docs, model, keep=docs.columns, names=("tw_predicted", "tw_share"))
    kept = judged.where((F.col("tw_predicted") != langid.UNKNOWN) & (F.col("tw_share") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "tw_predicted")).select(*docs.columns)


def _same() -> Column:
    """A document's row and a key of (tw_id, tw_hash) are of one id and text."""
    return F.col("doc_id").eqNullSafe(F.col("tw_id")) & (F.xxhash64("text") == F.col("tw_hash"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, text) isn't among ``gone`` (doc_id, text_hash)."""
    gone = gone.select(F.col("doc_id").alias("tw_id"), F.col("text_hash").alias("tw_hash")).distinct()
    return docs.join(maybe_broadcast(materialise(gone, "gone")), _same(), "left_anti")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Jaccard join: of each group of near-duplicates one row stays.

    It is the row of the least id, null ids last, and of those the one with the
    least hash of its text; of rows that are equal in both any one. Groups are
    told apart by their own keys, so that documents which merely share an id
    stay. Texts without words are in no group and all stay.
    """
    groups = partenum.jaccard_components(docs).where(F.col("component").isNotNull())
    groups = materialise(groups.select("doc_id", "text_hash", "component"), "groups")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    least = groups.groupBy("component").agg(F.min(rank).alias("tw_least"), F.count("*").alias("tw_rows"))
    least = materialise(least.where(F.col("tw_rows") > 1).select("component", "tw_least.doc_id", "tw_least.text_hash").toDF("component", "tw_id", "tw_hash"), "least")
    first = F.col("doc_id").eqNullSafe(F.col("tw_id")) & (F.col("text_hash") == F.col("tw_hash"))
    several = materialise(lookup(groups, least, "component"), "several")
    kept = _without(docs, several.where(~first))
    again = several.where(first).groupBy("tw_id", "tw_hash").agg(F.count("*").alias("n")).where(F.col("n") > 1).drop("n")
    again = materialise(again, "again")
    if again.isEmpty():
        return kept
    marked = kept.join(maybe_broadcast(again), _same(), "left")
    single = marked.where(F.col("tw_hash").isNull())
    chosen = marked.where(F.col("tw_hash").isNotNull()).dropDuplicates(["tw_id", "tw_hash"])
    return single.unionByName(chosen).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: contaminated documents go."""
    found = winnowing.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("contaminated"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: every reported span becomes a label; n_chars follows the text."""
    masked = secretscan.redact(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of all sequences, with their token ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("jaccard_join", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: SQL cannot express the stages; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    others = working_tables(spark)  # of results that a caller may not have read yet
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        clean_up(spark, keep=(*others, path))  # the stage's own working tables and its input
    return docs
