"""Files on whichever store a URI names, and CSV as the engine reads it."""

from __future__ import annotations

import codecs
import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterable
from contextlib import contextmanager
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY = re.compile(r"^[A-Za-z0-9][A-Za-z0-9_-]*$")
TRACKS = ("commerce", "research")
#: Encodings tried on the first 256 KiB, in order; the last takes anything.
ENCODINGS, HEAD = ("utf-8-sig", "utf-8", "gb18030", "big5", "latin-1"), 256 << 10
#: Types of a source contract's columns.
TYPES = {
    "string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType(),
    "date": T.DateType(), "datetime": T.TimestampNTZType(),
}


class SourceError(ValueError):
    pass


def store(uri: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"^[a-z0-9]+:", uri):
        return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))  # pyarrow knows that store by one name
    return fs.LocalFileSystem(), uri


def read_bytes(uri: str) -> bytes:
    s, path = store(uri)
    with s.open_input_stream(path, compression=None) as f:
        return f.read()


def write_bytes(uri: str, data: bytes) -> None:
    """Whole or not at all: written aside, then moved into place."""
    s, path = store(uri)
    s.create_dir(path.rpartition("/")[0], recursive=True)
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    with s.open_output_stream(aside, compression=None) as f:
        f.write(data)
    s.move(aside, path)


def exists(uri: str) -> bool:
    s, path = store(uri)
    return s.get_file_info(path).type != fs.FileType.NotFound


#: Stores in which a file appears when it is closed, whole, and creating one that is there fails; elsewhere files are moved into place.
WHOLE_ON_CLOSE = ("s3a", "gs", "abfs", "abfss")


def claim(uri: str, note: str = "") -> bool:
    """Create a file with its content only if there is none, in one step; False if there is one."""
    aside = f"{uri}.{uuid.uuid4().hex}.tmp"
    if not re.match(r"^[a-z0-9]+:", uri) or uri.startswith("file:"):
        path, aside = (("/" + u.removeprefix("file:").lstrip("/") if u.startswith("file:") else u) for u in (uri, aside))
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(aside, "w") as f:
            f.write(note)
        try:
            os.link(aside, path)
        except FileExistsError:
            return False
        finally:
            os.unlink(aside)
        return True
    spark = SparkSession.getActiveSession()
    as_path = spark._jvm.org.apache.hadoop.fs.Path
    whole = uri.partition(":")[0] in WHOLE_ON_CLOSE
    path, target = as_path(uri), as_path(uri if whole else aside)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        out = found.create(target, False)
        out.write(bytearray(note.encode()))
        out.close()
        if whole or found.rename(target, path):  # a move never replaces a file
            return True
        found.delete(target, False)
        return False
    except Exception:
        if exists(uri):
            return False
        raise


class Held(RuntimeError):
    """Someone else writes."""


@contextmanager
def held(uri: str, minutes: float = 30):
    """Be the only writer of ``uri``; one that ended without letting go holds it for ``minutes`` at most."""
    lock = f"{uri}.lock"
    mark = uuid.uuid4().hex
    if not claim(lock, mark):
        s, path = store(lock)
        found = s.get_file_info(path)
        old = found.mtime is not None and (datetime.now(timezone.utc) - found.mtime).total_seconds() > 60 * minutes
        if not old:
            raise Held(f"another writer holds {uri}")
        s.move(path, f"{path}.{mark}")  # of several that find it old, one can move it
        s.delete_file(f"{path}.{mark}")
        if not claim(lock, mark):
            raise Held(f"another writer holds {uri}")
    try:
        yield
    finally:
        # a writer that took too long may have lost the lock to another, whose it is now
        if exists(lock) and read_bytes(lock).decode() == mark:
            s, path = store(lock)
            s.delete_file(path)


def of_each(names: list[str], run) -> dict[str, str]:
    """``run(name)`` of each name, by tasks where a session is active: bytes stay with them, only the results come back.

    A task may be tried again or run twice, so ``run`` must bear that.
    """
    spark = SparkSession.getActiveSession()
    if spark is None or not names:
        return {n: run(n) for n in names}

    def each(batches):
        for b in batches:
            got = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.string()), pa.array([run(n) for n in got], pa.string())], ["name", "found"])

    rows = spark.createDataFrame([(n,) for n in names], "name string").repartition(min(len(names), 1000))
    return {r["name"]: r["found"] for r in rows.mapInArrow(each, "name string, found string").collect()}


def digests(folder: str, names: list[str]) -> dict[str, str]:
    """SHA-256 of each of ``names`` below ``folder``."""
    return of_each(names, lambda n: digest(f"{folder}/{n}"))


def copies(source: str, target: str, names: list[str]) -> None:
    """Copy each of ``names`` from below ``source`` to below ``target``."""
    of_each(names, lambda n: copy(f"{source}/{n}", f"{target}/{n}"))


def list_files(uri: str) -> list[tuple[str, int]]:
    """(path below ``uri``, size) of all files, sorted; a file itself holds none."""
    s, path = store(uri)
    if s.get_file_info(path).is_file:
        return []
    found = s.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted((f.path[len(path.rstrip("/")) + 1:], f.size) for f in found if f.is_file)


def digest(uri: str) -> str:
    """SHA-256 of a file, read in pieces."""
    s, path = store(uri)
    h = hashlib.sha256()
    with s.open_input_stream(path, compression=None) as f:
        while chunk := f.read(1 << 20):
            h.update(chunk)
    return h.hexdigest()


def copy(source: str, target: str, decode: str | None = None) -> None:
    """Copy a file in pieces, from ``decode`` to UTF-8 if given; whole or not at all, so that it may be tried again."""
    s, path = store(source)
    t, to = store(target)
    t.create_dir(to.rpartition("/")[0], recursive=True)
    aside = f"{to}.{uuid.uuid4().hex}.tmp"
    text = codecs.getincrementaldecoder(decode)("replace") if decode else None
    with s.open_input_stream(path, compression=None) as f, t.open_output_stream(aside, compression=None) as g:
        while chunk := f.read(1 << 20):
            g.write(text.decode(chunk).encode() if text else chunk)
        if text:
            g.write(text.decode(b"", True).encode())
    t.move(aside, to)


def detect_encoding(uri: str) -> str:
    s, path = store(uri)
    with s.open_input_stream(path, compression=None) as f:
        head = f.read(HEAD)
    for name in ENCODINGS:
        try:  # a character may be cut at the end of the head
            codecs.getincrementaldecoder(name)().decode(head, len(head) < HEAD)
            return name
        except UnicodeDecodeError:
            continue
    return ENCODINGS[-1]


def utf8_copy(uri: str, folder: str) -> str:
    """The file itself if it is UTF-8 (or a folder of landed parts), else a copy that is, named by content; a large one is copied in parts by tasks."""
    from tallywell.sources import landing

    if landing.is_folder(uri):
        return uri
    found = detect_encoding(uri)
    if found in ("utf-8", "utf-8-sig"):
        return uri
    target = f"{folder.rstrip('/')}/{digests(*_split(uri))[_split(uri)[1][0]][:16]}.utf8"
    spark = SparkSession.getActiveSession()
    if spark is None or landing.size_of(uri) <= landing.RANGE:
        if not exists(f"{target}.csv"):
            copy(uri, f"{target}.csv", found)
        return f"{target}.csv"
    if not exists(f"{target}/.whole"):  # written last; parts have names of their own, so writers of the same file don't disturb each other
        scanned = landing.scan(spark, uri)
        landing.write_parts(spark, scanned, target, landing.detect(spark, scanned))
        write_bytes(f"{target}/.whole", b"")
    return target


def _split(uri: str) -> tuple[str, list[str]]:
    folder, _, name = uri.rpartition("/")
    return folder or ".", [name]


def contract_schema(columns: Iterable[dict]) -> T.StructType:
    """A schema from {name, type, nullable}; bad records are kept aside."""
    fields = []
    for c in columns:
        if c["type"] not in TYPES:
            raise SourceError(f"unknown type: {c['type']!r}")
        fields.append(T.StructField(c["name"], TYPES[c["type"]], True))
    return T.StructType([*fields, T.StructField("_corrupt_record", T.StringType(), True)])


def read_csv(spark: SparkSession, uri: str, columns: list[dict] | None = None, folder: str | None = None, as_text: bool = False,
             multi_line: bool | None = None) -> DataFrame:
    """A CSV with a header, of any of the known encodings, or a folder of its landed parts; quotes within quotes are doubled.

    With a contract its types hold, and a row that breaks them raises; without,
    types are inferred over the whole file; ``as_text`` keeps every column text.
    Unless ``multi_line`` says so, a large file is scanned for line breaks within fields: without any it is split over tasks.
    """
    from tallywell.sources import landing

    path = utf8_copy(uri, folder or f"{uri.rpartition('/')[0]}/.utf8")
    if multi_line is None:
        multi_line = landing.is_folder(path) or landing.size_of(path) <= landing.RANGE or not landing.scan(spark, path).splittable
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("mode", "PERMISSIVE").option("escape", '"')
    if not columns:
        return reader.option("inferSchema", not as_text).option("timestampType", "TIMESTAMP_NTZ").csv(path)
    df = reader.option("columnNameOfCorruptRecord", "_corrupt_record").option("enforceSchema", False).schema(contract_schema(columns)).csv(path).cache()
    try:
        tests = [F.count_if(F.col("_corrupt_record").isNotNull()).alias("_bad")]
        tests += [F.count_if(F.col(f"`{c['name']}`").isNull()).alias(c["name"]) for c in columns if not c.get("nullable", True)]
        row = df.agg(*tests).first().asDict()
    finally:
        df.unpersist()
    if wrong := {k: v for k, v in row.items() if v}:
        raise SourceError(f"{uri} breaks its contract: {wrong}")
    return df.drop("_corrupt_record")


def check_upload(spark: SparkSession, uri: str, required: Iterable[str] = (), max_bytes: int = 20 << 20, max_lines: int = 200_000,
                 max_columns: int = 1000, max_field: int = 10_000) -> DataFrame:
    """An upload within its limits, as text columns; raises for the first that is broken."""
    s, path = store(uri)
    if s.get_file_info(path).size > max_bytes:
        raise SourceError("the file is too large")
    if detect_encoding(uri) not in ("utf-8", "utf-8-sig"):
        raise SourceError("the file must be UTF-8")
    df = read_csv(spark, uri, as_text=True)
    if len(df.columns) > max_columns:
        raise SourceError("too many columns")
    if missing := sorted(set(required) - set(df.columns)):
        raise SourceError(f"columns are missing: {', '.join(missing)}")
    n, longest = df.agg(F.count("*"), F.max(F.greatest(*[F.coalesce(F.length(f"`{c}`"), F.lit(0)) for c in df.columns], F.lit(0)))).first()
    if not n or n > max_lines or longest > max_field:
        raise SourceError("no rows, too many, or a field that is too long")
    return df


def check_track(track: str) -> str:
    if track not in TRACKS:
        raise SourceError(f"a track is one of {TRACKS}")
    return track


def inside(root: str, path: str) -> str:
    """``path`` if it stays below ``root``: tracks never reach into each other."""
    root = root.rstrip("/")
    if not path.startswith(root + "/") or ".." in path.split("/"):
        raise PermissionError(f"{path} lies outside {root}")
    return path
