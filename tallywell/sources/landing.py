"""Landing of large files: byte ranges are read, judged, copied and transcoded by tasks, and committed together.

A file is cut into ranges of bytes. Each range tells its quotes and the first
record that starts in it, for a beginning inside and outside of quotes; running
parities then fix where records start. Line feeds and quotes are the same
single bytes in every known encoding and never part of another character, so no
part cuts a character. Parts are written aside and moved; a manifest written
last makes them a batch. The driver holds a few numbers for each range.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywell.sources import files
from tallywell.sources.merkle import root_of

#: Bytes of a range, and of what a task reads of it at a time.
RANGE, PIECE = 64 << 20, 1 << 20
_LF, _QUOTE = 10, 34
#: Bytes that may stand before a quote that opens a field, and behind one that closes it.
_BEFORE, _BEHIND = np.frombuffer(b",;\t|\r\n", np.uint8), np.frombuffer(b",;\t|\r\n\"", np.uint8)
_SCAN = "k long, size long, quotes long, even long, odd long, breaks_even long, breaks_odd long, stray_even long, stray_odd long, sha256 string"


def _reader(uri: str):
    s, path = files.store(uri)
    return s.open_input_file(path)


def size_of(uri: str) -> int:
    s, path = files.store(uri)
    return s.get_file_info(path).size


def is_folder(uri: str) -> bool:
    s, path = files.store(uri)
    return s.get_file_info(path).type == fs.FileType.Directory


def scan_range(uri: str, start: int, length: int, size: int) -> dict:
    """What one range holds, for a beginning outside (even) and inside (odd) of quotes.

    even, odd: where the first record starts behind a line feed, or null;
    breaks: line feeds within quotes; stray: quotes that neither open nor close a field.
    """
    out = {"quotes": 0, "even": None, "odd": None, "breaks_even": 0, "breaks_odd": 0, "stray_even": 0, "stray_odd": 0}
    h, done = hashlib.sha256(), 0
    with _reader(uri) as f:
        last = f.read_at(1, start - 1)[0] if start else _LF
        while done < length:
            n = min(PIECE, length - done)
            data = f.read_at(n + 1, start + done)
            following = data[n] if len(data) > n else _LF
            data = data[:n]
            h.update(data)
            b = np.frombuffer(data, np.uint8)
            quote = b == _QUOTE
            before = (np.cumsum(quote) - quote + out["quotes"]) & 1
            feeds = np.flatnonzero(b == _LF)
            inside = before[feeds]
            at = np.flatnonzero(quote)
            if len(at):
                left, right = np.r_[np.uint8(last), b[:-1]][at], np.r_[b[1:], np.uint8(following)][at]
                opens, shuts = np.isin(left, _BEFORE) | (left == _QUOTE), np.isin(right, _BEHIND)
                if start + done == 0 and data[:3] == codecs.BOM_UTF8:
                    opens |= at == 3
            for name, parity in (("even", 0), ("odd", 1)):
                if out[name] is None and len(good := feeds[inside == parity]):
                    out[name] = start + done + int(good[0]) + 1
                out[f"breaks_{name}"] += int((inside != parity).sum())
                if len(at):
                    opening = before[at] == parity
                    out[f"stray_{name}"] += int((opening & ~opens).sum() + (~opening & ~shuts).sum())
            out["quotes"] += len(at)
            done, last = done + n, int(b[-1])
    return out | {"size": size, "sha256": h.hexdigest()}


@dataclass(frozen=True)
class Cut:
    """A part: its bytes [start, end), which begin with a record."""

    k: int
    start: int
    end: int


@dataclass(frozen=True)
class Scanned:
    """A file's cuts, and what its ranges told."""

    uri: str
    size: int
    cuts: list[Cut]
    breaks: int  # line feeds within quotes
    regular: bool  # every quote opens or closes a field
    leaves: list[str]  # SHA-256 of each range

    @property
    def splittable(self) -> bool:
        return self.regular and not self.breaks


def scan(spark: SparkSession, uri: str, width: int | None = None) -> Scanned:
    """Scan a file's ranges by tasks. One that isn't regularly quoted is one part."""
    size, width = size_of(uri), width or RANGE
    n = max(1, -(-size // width))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _SCAN.split(", ")]
        for batch in batches:
            rows = [{"k": k, **scan_range(uri, k * width, min(width, size - k * width), size)} for k in batch.column(0).to_pylist()]
            types = [*[pa.int64()] * 9, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, types, strict=True)], names)

    found = spark.range(0, n, 1, n).mapInArrow(each, _SCAN)
    # a row for each range: parities of the quotes before it
    inside = F.coalesce(F.sum("quotes").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 1
    pick = lambda name: F.when(F.col("inside"), F.col(f"{name}odd")).otherwise(F.col(f"{name}even"))
    rows = found.withColumn("inside", inside).select(
        "k", pick("").alias("start"), pick("breaks_").alias("breaks"), pick("stray_").alias("stray"), "quotes", "sha256").orderBy("k").collect()
    regular = not any(r["stray"] for r in rows) and sum(r["quotes"] for r in rows) % 2 == 0
    starts = [0, *(r["start"] for r in rows[1:] if r["start"] is not None and r["start"] < size)] if regular else [0]
    starts = sorted(set(starts))
    cuts = [Cut(k, a, b) for k, (a, b) in enumerate(zip(starts, [*starts[1:], size], strict=True))]
    return Scanned(uri, size, cuts, sum(r["breaks"] for r in rows), regular, [r["sha256"] for r in rows])


def _over(spark: SparkSession, cuts: list[Cut], run, schema: str) -> DataFrame:
    """``run(cut)`` -> a tuple for each cut, a task each."""
    names = [c.split()[0] for c in schema.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [run(Cut(*c)) for c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])

    df = spark.createDataFrame([(c.k, c.start, c.end) for c in cuts], "k long, start long, end long")
    return df.repartitionByRange(len(cuts), "k").mapInArrow(each, schema)


def _pieces(uri: str, cut: Cut) -> Iterator[bytes]:
    with _reader(uri) as f:
        at = cut.start
        while at < cut.end:
            data = f.read_at(min(PIECE, cut.end - at), at)
            if not data:
                raise files.SourceError(f"{uri} ended while it was read")
            yield data
            at += len(data)


def detect(spark: SparkSession, scanned: Scanned) -> str:
    """The first known encoding that decodes every part."""
    uri, known = scanned.uri, files.ENCODINGS

    def run(cut: Cut) -> tuple:
        bad = []
        for name in known:
            decoder = codecs.getincrementaldecoder(name)()
            try:
                for data in _pieces(uri, cut):
                    decoder.decode(data)
                decoder.decode(b"", True)
                bad.append(0)
            except UnicodeDecodeError:
                bad.append(1)
        return cut.k, *bad

    schema = "k long, " + ", ".join(f"b{i} long" for i in range(len(known)))
    row = _over(spark, scanned.cuts, run, schema).agg(*[F.sum(f"b{i}") for i in range(len(known))]).first()
    return next(name for name, bad in zip(known, row, strict=True) if not bad)  # the last takes anything


def head_record(scanned: Scanned, encoding: str) -> str:
    """The first record, which is the header; within the first range."""
    with _reader(scanned.uri) as f:
        data = f.read_at(min(files.HEAD, scanned.size), 0)
    b = np.frombuffer(data, np.uint8)
    quotes = np.cumsum(b == _QUOTE) & 1
    ends = np.flatnonzero((b == _LF) & (quotes == 0))
    if not len(ends):
        raise files.SourceError("the header is too long, or there is nothing else")
    return data[:int(ends[0]) + 1].decode(encoding, "replace").removeprefix("\ufeff")


def write_parts(spark: SparkSession, scanned: Scanned, folder: str, encoding: str | None = None) -> list[dict]:
    """Write each part below ``folder``: its bytes, or with an encoding UTF-8 text that begins with the header. A part is whole or absent."""
    uri = scanned.uri
    header = head_record(scanned, encoding) if encoding and len(scanned.cuts) > 1 else ""

    def run(cut: Cut) -> tuple:
        name = f"part-{cut.k:06d}" + (".csv" if encoding else "")
        s, path = files.store(f"{folder}/{name}")
        s.create_dir(path.rpartition("/")[0], recursive=True)
        aside = f"{path.rpartition('/')[0]}/.{name}.{uuid.uuid4().hex}"
        text = codecs.getincrementaldecoder(encoding if cut.k == 0 else encoding.removesuffix("-sig"))("replace") if encoding else None
        h, n = hashlib.sha256(), 0
        with s.open_output_stream(aside, compression=None) as g:
            def put(data: bytes) -> None:
                nonlocal n
                g.write(data)
                h.update(data)
                n += len(data)

            if text and cut.k:
                put(header.encode())
            for data in _pieces(uri, cut):
                put(text.decode(data).encode() if text else data)
            if text:
                put(text.decode(b"", True).encode())
        s.move(aside, path)
        return cut.k, name, n, h.hexdigest()

    rows = _over(spark, scanned.cuts, run, "k long, name string, bytes long, sha256 string").orderBy("k").collect()
    return [{"name": r["name"], "bytes": r["bytes"], "sha256": r["sha256"]} for r in rows]


def land_ranges(spark: SparkSession, folder: str, source: str, width: int | None = None) -> dict:
    """Land a source of several ranges below ``folder``: its bytes in raw parts, and UTF-8 parts to read. What the manifest says of it."""
    scanned = scan(spark, source, width)
    encoding = detect(spark, scanned)
    raw = write_parts(spark, scanned, f"{folder}/raw")
    text = write_parts(spark, scanned, f"{folder}/readable", encoding)
    if sum(p["bytes"] for p in raw) != scanned.size:
        raise files.SourceError(f"{source} changed while it was landed")
    whole = files.digests(source.rpartition("/")[0], [source.rpartition("/")[2]])  # SHA-256 of a whole file is one task's work
    return {
        "raw": f"{folder}/raw", "readable": f"{folder}/readable", "encoding": encoding, "sha256": next(iter(whole.values())),
        "parts": raw, "readable_parts": text, "root": root_of([p["sha256"] for p in raw]), "splittable": scanned.splittable}


def verify_parts(folder: str, manifest: dict) -> list[str]:
    """Names of parts that are missing or were changed since they were landed."""
    wrong = []
    for kind, key in (("raw", "parts"), ("readable", "readable_parts")):
        parts = manifest.get(key) or []
        there = dict(files.list_files(f"{folder}/{kind}"))
        present = [p["name"] for p in parts if there.get(p["name"]) == p["bytes"]]
        found = files.digests(f"{folder}/{kind}", present)
        wrong += [f"{kind}/{p['name']}" for p in parts if found.get(p["name"]) != p["sha256"]]
    return wrong


def land(root: str, entity: str, source: str, width: int | None = None) -> dict:
    """Keep a source's bytes under raw/entity/dt=/batch=, with a manifest; never over another batch.

    A source of one range is kept as one file. Bytes pass through tasks where a session is active.
    """
    if not files.ENTITY.match(entity):
        raise files.SourceError(f"not an entity: {entity!r}")
    now = datetime.now(timezone.utc)
    batch = f"b{now:%Y%m%d%H%M%S}-{uuid.uuid4().hex[:4]}"
    folder = files.inside(root, f"{root.rstrip('/')}/raw/{entity}/dt={now:%Y-%m-%d}/batch={batch}")
    name, spark = source.rpartition("/")[2], SparkSession.getActiveSession()
    if spark is not None and size_of(source) > (width or RANGE):
        found = land_ranges(spark, folder, source, width)
    else:
        files.copies(source.rpartition("/")[0], folder, [name])
        encoding = files.detect_encoding(source)
        readable = f"{folder}/{name}"
        if encoding not in ("utf-8", "utf-8-sig"):
            readable = f"{folder}/normalized.utf8.csv"
            files.copy(source, readable, encoding)  # one range at most
        found = {"raw": f"{folder}/{name}", "readable": readable, "encoding": encoding, "sha256": files.digests(folder, [name])[name]}
    manifest = {"entity": entity, "batch_id": batch, "source": source, **found, "landed_at": now.isoformat()}
    files.write_bytes(f"{folder}/manifest.json", json.dumps(manifest, ensure_ascii=False, indent=2).encode())
    return manifest
