"""Immutable snapshots: Parquet written aside, hashed, then moved into place."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.sources.files import digests, exists, inside, list_files, read_bytes, store, write_bytes


class SnapshotError(RuntimeError):
    pass


def content_hash(df: DataFrame) -> str:
    """Of the rows, whatever their order and files."""
    n, x, s = df.agg(F.count("*"), F.bit_xor(F.xxhash64(*df.columns)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{df.schema.simpleString()}|{n}|{x}|{s}".encode()).hexdigest()


def manifest_hash(folder: str) -> str:
    """Of all data files' names and bytes; files are hashed where tasks run."""
    names = [n for n, _ in list_files(folder) if n != "manifest.json" and not n.rpartition("/")[2].startswith(".")]
    found = digests(folder, names)
    return hashlib.sha256("".join(f"{n}:{found[n]}\n" for n in names).encode()).hexdigest()


def publish(tables: dict[str, DataFrame], root: str, snapshot_id: str, track: str) -> dict:
    """Write named tables as one snapshot; an id is used once."""
    final = inside(root, f"{root.rstrip('/')}/snapshots/{snapshot_id}")
    if exists(final):
        raise SnapshotError(f"snapshot {snapshot_id} exists")
    aside = f"{final}.partial"
    s, path = store(aside)
    try:
        hashes = {}
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{aside}/{name}")
            hashes[name] = content_hash(df.sparkSession.read.parquet(f"{aside}/{name}"))
        out = {"snapshot_id": snapshot_id, "track": track, "snapshot_sha256": manifest_hash(aside), "content": hashes}
        write_bytes(f"{aside}/manifest.json", json.dumps(out, indent=2).encode())
        s.move(path, store(final)[1])
    except Exception:
        if s.get_file_info(path).type.name == "Directory":
            s.delete_dir(path)
        raise
    return out | {"path": final}


def verify(root: str, snapshot_id: str) -> str:
    """The snapshot's hash now; raises if it isn't the one it was published with."""
    folder = inside(root, f"{root.rstrip('/')}/snapshots/{snapshot_id}")
    if not exists(f"{folder}/manifest.json"):
        raise SnapshotError(f"no snapshot {snapshot_id}")
    told = json.loads(read_bytes(f"{folder}/manifest.json"))["snapshot_sha256"]
    now = manifest_hash(folder)
    if told != now:
        raise SnapshotError(f"snapshot {snapshot_id} was changed")
    return now


def replay(spark: SparkSession, root: str, snapshot_id: str, metric: str) -> DataFrame:
    """(dt, value) as published, in order; never logged as a query."""
    folder = inside(root, f"{root.rstrip('/')}/snapshots/{snapshot_id}/{metric}")
    return spark.read.parquet(folder).select("dt", "value").orderBy(F.asc_nulls_last("dt"))
