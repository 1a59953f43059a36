"""Helpers shared by the training-data operators.

Every operator selects the columns that it needs under names of its own
(``tw_*``) before it adds any, so extra columns of a caller's table never
clash with working columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a broadcast side may have at most; beyond it operators shuffle.
BROADCAST_ROWS = 1_000_000

#: Used only where the session names no shared folder and runs on one machine (tests, notebooks).
LOCAL_CHECKPOINTS = "/tmp/checkpoints/tallywell"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors share.

    Without one, a session whose tasks all run in the driver's own process
    (master ``local``) gets a folder there; on a cluster that is an error, as
    no machine's own folder can be read by the others.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = LOCAL_CHECKPOINTS
    return found.rstrip("/")


#: Rows and bytes of an Arrow batch, in place of Spark's defaults, which are
#: meant for short rows: a task holds several copies of a batch, some off the heap.
ARROW_BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m"),
}


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small, unless the session says otherwise."""
    for key, (default, own) in ARROW_BATCH.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, own)


def _path(spark: SparkSession, uri: str):
    """A Hadoop path and its file system, whichever store the URI names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tallywell-{spark.sparkContext.applicationId}"


_KNOWN: set[str] = set()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it goes when the application ends."""
    folder = _own_folder(spark)
    if folder not in _KNOWN:
        path, store = _path(spark, folder)
        store.mkdirs(path)
        store.deleteOnExit(path)
        _KNOWN.add(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Lineage ends there, so a lost executor costs no recomputation of what
    stands before, and branches over the result don't repeat that work.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def working_tables(spark: SparkSession) -> tuple[str, ...]:
    """Names of this application's working tables."""
    folder, store = _path(spark, _own_folder(spark))
    return tuple(x.getPath().getName() for x in store.listStatus(folder)) if store.exists(folder) else ()


def clean_up(spark: SparkSession, keep: tuple[str, ...] = ()) -> None:
    """Delete this application's working tables, but for the names or paths in ``keep``.

    For callers that have written or collected a query's result: until then the
    result still reads some of them. What is left goes when the application ends.
    """
    kept = {k.rstrip("/").rpartition("/")[2] for k in keep}
    for name in working_tables(spark):
        if name not in kept:
            path, store = _path(spark, f"{_own_folder(spark)}/{name}")
            store.delete(path, True)


def within(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``limit`` rows (reads no more than needed)."""
    return df.limit(limit + 1).count() <= limit


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast only if its row count is within ``limit``."""
    return F.broadcast(df) if within(df, limit) else df


def let(value: Column, body) -> Column:
    """``body(x)`` with x bound to ``value``, which is computed once a row."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null becomes the empty string."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def lookup(big: DataFrame, small: DataFrame, key: str, how: str = "inner", salts: int = 16, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``big`` with ``small``, which has one row for each ``key``.

    ``small`` is broadcast if its row count is within ``limit``. Beyond it both
    sides are shuffled by (key, salt): a key with a third of ``big``'s rows goes
    to ``salts`` tasks, and ``small`` is sent that many times.
    """
    if within(small, limit):
        return big.join(F.broadcast(small), key, how)
    salted = big.withColumn("tw_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    each = small.withColumn("tw_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return salted.join(each, [key, "tw_salt"], how).drop("tw_salt")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): the least node that each node of ``edges`` reaches.

    Alternating large and small stars: every round points neighbours to the
    least one in sight, so that even long chains end after a logarithmic number
    of rounds. Each round is written to the shared folder, none is collected.
    """
    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = materialise(e, "edges")
    before, now = None, state(e)
    while before != now and now[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = lookup(both, least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = lookup(large, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        e = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, now = now, state(e)
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("comp")))
