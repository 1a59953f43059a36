"""Packing documents into fixed-length token sequences.

Bounded-space online packing. Each partition keeps a fixed number of open
windows. A document's whole windows leave at once; its rest goes to the open
window where it leaves the least room. When none fits, the fullest window is
topped up with the beginning of the rest and emitted. A partition ends with
its open windows merged into full ones and one leftover of less than a window;
leftovers are merged again over groups of partitions, level by level, until
one is left, which is cut at powers of two, where no padding is due.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallywell.llm.common import bound_batches, materialise

#: Partitions (or groups of them) whose leftovers are merged at a time, and
#: levels of merging: enough for FAN_IN ** LEVELS partitions.
FAN_IN = 128
LEVELS = 3
PIECES = "start long, ids binary, doc_tokens long, sequence_id long, offset long, tw_part long, tw_open boolean"
_ARROW = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
#: The end-of-text string, which the tokenizer takes as one token.
SPECIAL = "<|endoftext|>"


def encoder(folder: str | None = None):
    """text -> ids exactly as ``tokenizers`` gives them for byte_bpe_50k.json.

    The same vocabulary through ``tiktoken`` is several times faster; a text
    that holds a special token, and one that ``tiktoken`` fails on, go to
    ``tokenizers`` itself. tests/llm compares the two.
    """
    import base64
    import os

    import public_tokenizers as known
    import tiktoken
    from tokenizers import Tokenizer

    at = (lambda name: f"{folder}/{name}") if folder else known.path
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    slow = Tokenizer.from_file(at("byte_bpe_50k.json"))
    with open(at("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=known.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if SPECIAL not in text:
            try:
                return fast.encode_ordinary(text)
            except BaseException as problem:  # a panic of the native code isn't an Exception
                if isinstance(problem, (KeyboardInterrupt, SystemExit)):
                    raise
        return slow.encode(text, add_special_tokens=False).ids

    return encode


class Packer:
    """Open windows of one partition. A piece is (doc, start, ids, doc_tokens)."""

    def __init__(self, size: int, windows: int):
        self.size, self.windows = size, windows
        self.rooms: list[tuple[int, int]] = []  # (room, window), sorted: the first that is large enough fits best
        self.held: dict[int, list] = {}
        self.made = 0
        self.done: list[list] = []

    def _emit(self, pieces: list) -> None:
        self.done.append(pieces)

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        whole = len(ids) // self.size * self.size
        for i in range(0, whole, self.size):
            self._emit([(doc, start + i, ids[i:i + self.size], total)])
        start, ids = start + whole, ids[whole:]
        if not len(ids):
            return
        k = bisect.bisect_left(self.rooms, (len(ids), -1))
        if k == len(self.rooms) and len(self.held) >= self.windows:
            room, w = self.rooms.pop(0)
            self._emit([*self.held.pop(w), (doc, start, ids[:room], total)])
            self.add(doc, start + room, ids[room:], total)
            return
        if k == len(self.rooms):
            w, room = self.made, self.size
            self.made += 1
            self.held[w] = []
        else:
            room, w = self.rooms.pop(k)
        self.held[w].append((doc, start, ids, total))
        if room > len(ids):
            bisect.insort(self.rooms, (room - len(ids), w))
        else:
            self._emit(self.held.pop(w))

    def leftover(self) -> list:
        """Merge the open windows; what fills no window is returned."""
        pieces = [p for w in sorted(self.held) for p in self.held[w]]
        self.held, self.rooms = {}, []
        rest: list = []
        room = self.size
        for doc, start, ids, total in pieces:
            while len(ids):
                part = ids[:room]
                rest.append((doc, start, part, total))
                start, ids, room = start + len(part), ids[len(part):], room - len(part)
                if not room:
                    self._emit(rest)
                    rest, room = [], self.size
        return rest


def powers_of_two(pieces: list) -> list[list]:
    """Cut pieces of less than a window into sequences of power-of-two lengths."""
    total, out = sum(len(p[2]) for p in pieces), []
    queue = list(reversed(pieces))
    for bit in reversed(range(total.bit_length())):
        need, own = total & (1 << bit), []
        while need:
            doc, start, ids, n = queue.pop()
            own.append((doc, start, ids[:need], n))
            if len(ids) > need:
                queue.append((doc, start + need, ids[need:], n))
            need -= len(own[-1][2])
        if own:
            out.append(own)
    return out


def _rows(id_type: pa.DataType, sequences: list[list], first: int, part: int, is_open: bool) -> pa.RecordBatch:
    names = ["tw_doc", *(x.split()[0] for x in PIECES.split(", "))]
    types = [id_type, *_ARROW]
    cols: list[list] = [[] for _ in types]
    for k, pieces in enumerate(sequences):
        at = 0
        for doc, start, ids, total in pieces:
            for c, v in zip(cols, (doc, start, ids.astype("<u4").tobytes(), total, first + k, at, part, is_open), strict=True):
                c.append(v)
            at += len(ids)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 1024,
    windows: int = 32,
    end_id: int = 0,
    tokenizer_folder: str | None = None,
) -> DataFrame:
    """Pieces (id, start, ids, doc_tokens, sequence_id, offset) of packed sequences.

    ``ids`` holds little-endian unsigned 32-bit token ids. A null or empty
    text is one document of just the end id. Repeated rows and null ids are
    packed as rows of their own; an empty table gives no pieces; other columns
    are ignored. The id column keeps its type. Which documents share a sequence
    depends on how the input is split; the pieces always tile every document
    and every sequence.
    """
    bound_batches(docs.sparkSession)
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    schema = f"tw_doc {docs.schema[id_col].dataType.simpleString()}, {PIECES}"
    src = docs.select(
        F.col(id_col).alias("tw_doc"),
        F.coalesce(F.col(text_col), F.lit("")).alias("tw_text"),
    )

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_folder)
        part = TaskContext.get().partitionId()
        packer, made = Packer(size, windows), part << 36
        for batch in batches:
            docs, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                ids = np.array([*encode(texts[i].as_py()), end_id], dtype=np.uint32)
                packer.add(docs[i].as_py(), 0, ids, len(ids))
                if len(packer.done) >= 2000:
                    yield _rows(id_type, packer.done, made, part, False)
                    made, packer.done = made + len(packer.done), []
        rest = packer.leftover()
        yield _rows(id_type, packer.done, made, part, False)
        yield _rows(id_type, [rest], made + len(packer.done), part, True)

    def merge_level(level: int):
        def merge(key: tuple, rows: pa.Table) -> pa.Table:
            # ids below 2**60 are the first level's; each level has its own range above
            group = key[0].as_py()
            packer, base = Packer(size, windows), (level << 60) | (group << 24)
            rows = rows.sort_by([("tw_part", "ascending"), ("offset", "ascending")])
            packer.held[0] = [
                (r["tw_doc"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]) for r in rows.to_pylist()
            ]
            rest = packer.leftover()
            made = len(packer.done)
            out = [_rows(id_type, packer.done, base, group, False)]
            if level < LEVELS:
                out.append(_rows(id_type, [rest], base + made, group, True))
            else:
                out.append(_rows(id_type, powers_of_two(rest), base + made, group, False))
            return pa.Table.from_batches(out)

        return merge

    packed = materialise(src.mapInArrow(first_level, schema), "packed")
    done, rest = [packed.where(~F.col("tw_open"))], packed.where("tw_open")
    for level in range(1, LEVELS + 1):
        group = F.lit(0).cast("long") if level == LEVELS else F.floor(F.col("tw_part") / FAN_IN).cast("long")
        merged = rest.groupBy(group.alias("tw_group")).applyInArrow(merge_level(level), schema)
        done.append(merged.where(~F.col("tw_open")))
        rest = merged.where("tw_open")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(F.col("tw_doc").alias(id_col), "start", "ids", "doc_tokens", "sequence_id", "offset")
