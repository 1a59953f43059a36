"""WARC archives with a merged capture index.

Captures are written as gzipped WARC records, one file for each task and its
roll-overs, to a shared folder. Every task also leaves an index run, sorted by
URL key and timestamp. Runs are merged: key ranges are dealt out, and each
range's run slices go through a k-way loser tree, so that the index holds
globally ordered capture histories. Reading follows that index.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import bound_batches, fresh_path, lower_ascii, materialise, maybe_broadcast

#: Payloads of fewer bytes are always stored.
MIN_REVISIT = 100
#: A task starts a new file beyond so many bytes.
FILE_BYTES = 256 << 20
#: Index rows of one merged key range, about.
RANGE_ROWS = 200_000
#: Parts that a payload's copies are spread over before they meet.
SALTS = 16
#: Date of records of tables without one.
DATE = "2000-01-01T00:00:00Z"

INDEX = "urlkey string, ts string, page_id long, file string, at long, size long"
READ = "page_id long, url string, ts string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def url_key(url: Column) -> Column:
    """Host labels reversed, then the rest: ``com,example)/path``. Null is empty."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(url, r"://(.*)$", 1)
    rest = F.when(rest == "", url).otherwise(rest)
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(rest, r"^[^/?#]*", ""))


def _digest(payload: Column) -> Column:
    return F.unhex(F.sha2(payload, 256))


def revisits(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """tw_id, tw_digest, tw_refers: each (id, payload) whose payload a page of smaller id has.

    Only ids and digests are shuffled; they are written once. A payload's copies,
    which may be a third of all rows, are reduced per salt before they meet, and
    meet again per salt.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    d = pages.select(F.col(id_col).cast("long").alias("tw_id"), F.octet_length(payload).alias("n"), _digest(payload).alias("tw_digest"))
    d = d.where((F.col("n") >= min_bytes) & F.col("tw_id").isNotNull()).drop("n")
    d = materialise(d.withColumn("salt", F.pmod(F.xxhash64("tw_id"), F.lit(SALTS))), "digests")
    least = d.groupBy("tw_digest", "salt").agg(F.min("tw_id").alias("least"), F.max("tw_id").alias("most"))
    least = least.groupBy("tw_digest").agg(F.min("least").alias("tw_refers"), F.max("most").alias("most"))
    least = least.where(F.col("most") > F.col("tw_refers")).drop("most")
    least = least.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
    found = d.join(least, ["tw_digest", "salt"]).where(F.col("tw_id") > F.col("tw_refers"))
    return materialise(found.select("tw_id", "tw_digest", "tw_refers").distinct(), "revisits")


def _record(page_id, url: str, date: str, payload: bytes, refers) -> bytes:
    """One WARC record as a gzip member of its own."""
    urn = f"<urn:tallywell:page:{'null' if page_id is None else page_id}>"
    lines = [
        "WARC/1.1", f"WARC-Type: {'resource' if refers is None else 'revisit'}", f"WARC-Record-ID: {urn}",
        f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if url is not None:  # a header line can't hold a line break
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    body = payload
    if refers is None:
        lines[1] = "WARC-Type: response"
        lines.append("Content-Type: text/html; charset=utf-8")
    else:
        body = b""
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:tallywell:page:{refers}>")
    lines.append(f"Content-Length: {len(body)}")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def _parse(raw: bytes) -> dict:
    plain = zlib.decompress(raw, 31)
    cut = plain.index(b"\r\n\r\n")
    head, body = plain[:cut].decode(), plain[cut + 4:-4]
    lines = head.split("\r\n")
    if lines[0] != "WARC/1.1" or plain[-4:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    if int(fields["Content-Length"]) != len(body):
        raise ValueError("a WARC record of another length than it states")
    number = lambda urn: None if urn is None or urn.endswith(":null>") else int(urn.rpartition(":")[2][:-1])
    kind = fields["WARC-Type"]
    digest = hashlib.sha256(body).hexdigest() if kind == "response" else fields["WARC-Payload-Digest"].partition(":")[2]
    if f"sha256:{digest}" != fields["WARC-Payload-Digest"]:
        raise ValueError("a payload doesn't match its digest")
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": number(fields["WARC-Record-ID"]), "ts": fields["WARC-Date"], "record_type": kind,
        "url": url if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "refers_to": number(fields.get("WARC-Refers-To")), "payload_digest": digest,
        "payload_bytes": len(body) if kind == "response" else int(fields["WARC-Payload-Length"]),
        "payload": body if kind == "response" else None,
    }


def _store(uri: str):
    """A file system and path for a URI, on whichever store it names."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    uri = re.sub(r"^s3[an]:", "s3:", uri)  # pyarrow knows this store by one name
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", date_col: str | None = None) -> DataFrame:
    """Write every row as a WARC record below ``folder``; returns the index runs.

    Of rows with equal payloads of at least 100 bytes the one with the smallest
    id is a response and the others revisit it; a null id is always a response.
    A file's name depends on its task's partition alone and its bytes on its
    rows, so a task that runs again replaces a file by the same bytes.
    """
    bound_batches(pages.sparkSession)
    again = maybe_broadcast(revisits(pages, id_col, payload_col))
    date = F.lit(None) if date_col is None else F.date_format(F.col(date_col), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    src = pages.select(
        F.col(id_col).cast("long").alias("tw_id"), F.col(url_col).cast("string").alias("tw_url"),
        F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("tw_payload"),
        F.coalesce(date, F.lit(DATE)).alias("tw_date"), url_key(F.col(url_col)).alias("tw_key"),
    )
    # by id and payload: other payloads under the same id are records of their own
    src = src.withColumn("tw_digest", _digest(F.col("tw_payload"))).join(again, ["tw_id", "tw_digest"], "left")
    src = src.select("tw_id", "tw_url", "tw_payload", "tw_date", "tw_key", "tw_refers")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        part, tries = task.partitionId(), task.taskAttemptId()
        out, name, at, files, run = None, "", 0, 0, []

        def close():
            if out is not None:
                out.close()
                store.move(f"{base}/.{tries}-{name}", f"{base}/{name}")

        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, payload, date, key, refers = (c[row].as_py() for c in batch.columns)
                if out is None or at > FILE_BYTES:
                    close()
                    name, at, files = f"part-{part:06d}-{files:04d}.warc.gz", 0, files + 1
                    out = store.open_output_stream(f"{base}/.{tries}-{name}", compression=None)
                record = _record(page_id, url, date, payload, refers)
                out.write(record)
                run.append((key, date, page_id, name, at, len(record)))
                at += len(record)
        close()
        run.sort(key=_order)
        for low in range(0, len(run), 10_000):
            yield _index_batch(run[low:low + 10_000])

    return src.mapInArrow(write, INDEX)


def _order(row) -> tuple:
    return row[0], row[1], -1 if row[2] is None else row[2], row[3], row[4]


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["urlkey", "ts", "page_id", "file", "at", "size"])


def loser_tree(runs: list[list[tuple]]) -> Iterator[tuple]:
    """Merge sorted runs: an inner node keeps the loser of its match, so one path of matches yields the next row."""
    k = len(runs)
    if not k:
        return
    places = [0] * k
    heads = [_order(r[0]) if r else None for r in runs]

    def beats(a: int, b: int) -> bool:
        if heads[a] is None or heads[b] is None:
            return heads[a] is not None
        return (heads[a], a) < (heads[b], b)

    losers = [-1] * k

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        a, b = (a, b) if beats(a, b) else (b, a)
        losers[node] = b
        return a

    winner = play(1) if k > 1 else 0
    while heads[winner] is not None:
        yield runs[winner][places[winner]]
        places[winner] += 1
        row = runs[winner][places[winner]] if places[winner] < len(runs[winner]) else None
        heads[winner] = row if row is None else _order(row)
        node = (winner + k) // 2
        while node:
            if beats(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2


def merge_index(runs: DataFrame, rows: int | None = None) -> DataFrame:
    """The runs' rows in global order of URL key and timestamp.

    Ranges are drawn over (key, timestamp, id), so the captures of one URL may
    lie in several. A shuffled range holds one sorted slice of each run after
    another; where the order falls, a new run begins.
    """
    total = runs.count() if rows is None else rows
    ranges = max(1, -(-total // RANGE_ROWS))
    dealt = runs.repartitionByRange(ranges, "urlkey", "ts", "page_id") if ranges > 1 else runs.coalesce(1)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: list[list[tuple]] = []
        last = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last is None or _order(row) < _order(last):
                    slices.append([])
                slices[-1].append(row)
                last = row
        ready: list[tuple] = []
        for row in loser_tree(slices):
            ready.append(row)
            if len(ready) == 10_000:
                yield _index_batch(ready)
                ready = []
        if ready:
            yield _index_batch(ready)

    return dealt.mapInArrow(merge, INDEX)


def read_archive(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` names, read from the archive files and checked."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        opened, stream = None, None
        for batch in batches:
            found, held = [], 0
            for name, at, size in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if name != opened:
                    opened, stream = name, store.open_input_file(f"{base}/{name}")
                found.append(_parse(stream.read_at(size, at)))
                held += len(found[-1]["payload"] or b"")
                if held > 16 << 20:
                    yield _records(found)
                    found, held = [], 0
            yield _records(found)

    # a file's records are read by one task and in their order there
    by_file = index.select("file", "at", "size").repartition("file").sortWithinPartitions("file", "at")
    return by_file.mapInArrow(read, READ)


def _records(rows: list[dict]) -> pa.RecordBatch:
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types[t]) for n, t in fields], [n for n, _ in fields])


def round_trip(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Archive ``pages``, merge the index, and read every record back.

    One row per row of ``pages``. A null payload is empty; a null URL stays
    null; repeated rows of one id are records of their own, of which none
    revisits another (a revisit refers to a smaller id); rows of one id with
    other payloads are judged each by its own payload. An empty table writes
    no file and gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    runs = materialise(write_archive(pages, folder, **columns), "runs")
    index = materialise(merge_index(runs), "index")
    return read_archive(index, folder)
