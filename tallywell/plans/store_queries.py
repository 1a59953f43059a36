"""Registered round trips through what the engine stores: landed files, snapshots, ledgers, fingerprints.

Each writes what it needs below the session's shared folder, under a name of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.operators.metrics import compile_metric, parse_contract
from tallywell.plans import governance, report
from tallywell.session import shared_folder
from tallywell.sources import files, landing, merkle, snapshots
from tallywell.sources.ledger import Ledger

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: About how many lines a fingerprinted file of a status has at most.
FILE_ROWS = 250_000


def _register(name: str, sql: str):
    def add(query):
        QUERIES[name], ORACLES[name] = query, sql
        return query

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fresh(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tallywell-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


@_register("landed_csv", "select o_orderkey, o_orderstatus, o_totalprice, o_orderpriority from orders")
def landed_csv(spark, sf_dir):
    """Orders as CSV files in Latin-1, with quotes and commas in a field, landed in byte ranges, transcoded, and read by their contract."""
    root = _fresh(spark)
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    notes = ("café", 'dit "café", 2')
    marked = orders.withColumn("note", F.when(F.col("o_orderkey") % 3 == 0, notes[0]).otherwise(notes[1]))
    marked.write.option("header", True).option("encoding", "ISO-8859-1").option("escape", '"').csv(f"{root}/source")
    columns = [{"name": "o_orderkey", "type": "integer", "nullable": False}, {"name": "o_orderstatus", "type": "string"}, {"name": "o_totalprice", "type": "number"},
               {"name": "o_orderpriority", "type": "string"}, {"name": "note", "type": "string", "nullable": False}]
    parts = []
    for name, _ in files.list_files(f"{root}/source"):
        if name.endswith(".csv"):
            batch = landing.land(f"{root}/volume", "orders", f"{root}/source/{name}", width=1 << 18)
            parts.append(files.read_csv(spark, batch["readable"], columns))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("note").isin(*notes)).drop("note")  # a note that came back otherwise costs its row


@_register("snapshot_replay", "select strftime(o_orderdate, '%Y-%m-%d') as dt, count(*)::double as value from orders group by 1")
def snapshot_replay(spark, sf_dir):
    """A day's counts published as a snapshot, verified, and read back."""
    root = _fresh(spark)
    frame = compile_metric(_table(spark, sf_dir, "orders"), parse_contract({"metric": "n", "type": "count", "grain": "day", "time_column": "o_orderdate"}))
    told = snapshots.publish({"n": frame}, root, "s-1", "commerce")
    if snapshots.verify(root, "s-1") != told["snapshot_sha256"]:
        raise RuntimeError("the snapshot differs from what was published")
    return snapshots.replay(spark, root, "s-1", "n")


@_register("ledger_history", """
select 'r-' || year(o_orderdate) as run_id, case when year(o_orderdate) % 2 = 0 then 'commerce' else 'research' end as track, count(*) as rows, year(o_orderdate) || '-01-01' as started_at,
  case when year(o_orderdate) >= 1996 then 'late' end as reviewer from orders group by year(o_orderdate) order by started_at desc limit 4""")
def ledger_history(spark, sf_dir):
    """A run for each year of orders: recorded, given a new column on the way, merged, and the latest four read back."""
    book = Ledger(spark, _fresh(spark))
    years = _table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).count().orderBy("y").collect()  # a row for each year
    for y, n in years:
        run = {"run_id": f"r-{y}", "track": "commerce" if y % 2 == 0 else "research", "started_at": f"{y}-01-01", "rows": n, "provenance": {"run_id": f"r-{y}", "snapshot_id": "s", "batch_id": "b", "commit_sha": "c"}}
        if y == 1996:
            book.add_column("runs", "reviewer", "string")
        book.run(run | ({"reviewer": "late"} if y >= 1996 else {}))
    book.merge("runs")
    out = book.history(4)
    return out.select("run_id", "track", "rows", "started_at", F.col("reviewer") if "reviewer" in out.columns else F.lit(None).cast("string").alias("reviewer"))


@_register("fingerprint_changes", """
select o_orderstatus as name, case when o_orderstatus = 'F' then 'changed' when o_orderstatus = 'P' then 'removed' end as kind from orders where o_orderstatus in ('F', 'P') group by 1
union all select 'Q', 'added'""")
def fingerprint_changes(spark, sf_dir):
    """Trees over the lines of each order status: one changed, one removed, one added, told by their digests.

    A status's lines are dealt to files by their hashes, so that equal lines give equal files whatever other statuses hold.
    """
    root = _fresh(spark)
    orders = _table(spark, sf_dir, "orders")
    slots = orders.count() // FILE_ROWS + 1
    for k in range(2):
        status = F.when(F.lit(k == 1) & (F.col("o_orderstatus") == "P"), "Q").otherwise(F.col("o_orderstatus"))
        line = F.concat_ws(",", "o_orderkey", F.when(F.lit(k == 1) & (F.col("o_orderstatus") == "F"), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
        # null and the empty string share a folder, as they do in the writer
        lines = orders.select(F.coalesce(status, F.lit("")).alias("name"), line.alias("value")).withColumn("slot", F.pmod(F.xxhash64("value"), F.lit(slots)))
        lines.repartition("name", "slot").sortWithinPartitions("name", "slot", "value").write.partitionBy("name", "slot").text(f"{root}/{k}")

    def tree(k: int) -> dict:
        """Files of a status under the status, whatever Spark named them."""
        found = merkle.tree(f"{root}/{k}", [n for n, _ in files.list_files(f"{root}/{k}") if n.endswith(".txt")])["files"]
        by: dict[str, list[str]] = {}
        for n, d in found.items():
            by.setdefault(n.partition("/")[0].removeprefix("name="), []).append(d)
        return {"files": {s: merkle.root_of(sorted(d)) for s, d in by.items()}}

    told = merkle.changed(tree(0), tree(1))
    return spark.createDataFrame(list(told.items()), "name string, kind string")


_FACT = "select o_orderkey, o_custkey, o_orderstatus from orders"


def _fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")


@_register("backup_restore", _FACT)
def backup_restore(spark, sf_dir):
    """A published snapshot backed up, restored elsewhere after every file was checked, and read there."""
    root = _fresh(spark)
    snapshots.publish({"fact": _fact(spark, sf_dir)}, f"{root}/volume", "s-1", "commerce")
    made = governance.backup(f"{root}/volume", f"{root}/backups", "commerce")
    governance.restore(made["path"], f"{root}/restored", "commerce")
    return spark.read.parquet(f"{root}/restored/snapshots/s-1/fact")


@_register("bridge_import", _FACT)
def bridge_import(spark, sf_dir):
    """A run's snapshot that crosses from one track to the other by a token, audited on both sides, and is read there."""
    root = _fresh(spark)
    one, two = Ledger(spark, f"{root}/commerce"), Ledger(spark, f"{root}/research")
    told = snapshots.publish({"fact": _fact(spark, sf_dir)}, f"{root}/commerce", "s-1", "commerce")
    one.run({"run_id": "r-1", "track": "commerce", "started_at": "2026-01-01", "snapshot_id": "s-1", "snapshot_sha256": told["snapshot_sha256"],
             "provenance": {"run_id": "r-1", "snapshot_id": "s-1", "batch_id": "b-1", "commit_sha": "c"}})
    bridge = governance.Bridge(f"{root}/bridge")
    token = bridge.issue("study", "commerce", "research")
    found = bridge.export(token, "study", f"{root}/commerce", f"{root}/research", "commerce", "research", one, two, "r-1")
    if one.rollup()["bridged"] + two.rollup()["bridged"] != 2:
        raise RuntimeError("the crossing isn't audited on both sides")
    return spark.read.parquet(f"{found['path']}/fact")


@_register("redacted_sink", """
select c_custkey, left(c_name, 1) || repeat('*', greatest(length(c_name) - 1, 1)) as c_name, 'tok_' || substr(sha256('s1:' || c_mktsegment), 1, 12) as c_mktsegment from customer""")
def redacted_sink(spark, sf_dir):
    """Customers as JSON lines for a viewer who may see neither names nor segments, read back."""
    rows = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    out = f"{_fresh(spark)}/shown"
    report.export_redacted(rows, out, f"{sf_dir}/customer.parquet", {"c_mktsegment": "restricted", "c_name": "confidential", "c_custkey": "public"}, salt="s1")
    return spark.read.schema("c_custkey long, c_name string, c_mktsegment string").json(out)
