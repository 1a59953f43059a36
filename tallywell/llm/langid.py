"""Language ID by language-bitmask n-gram filters.

A table of slots holds one bit per language, in as many 64-bit words as the
languages take: a bit-sliced set of Bloom filters. The slots of an n-gram,
combined by AND, name every language whose filter contains it. Per-language
popcounts over all n-grams of a text, freed of the expected false positives,
decide. Texts are read whole; n-grams are
computed with numpy over the bytes of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallywell.llm.common import bound_batches, lookup, materialise

UNKNOWN = "und"
#: Bytes of an n-gram. Texts are UTF-8, so a letter beyond ASCII has two or more.
N = 4
#: Labelled documents a language may contribute to training, about.
TRAIN_DOCS = 3000
#: N-grams a language's filter holds at most: its most frequent ones.
GRAMS = 12_000
#: An n-gram enters a filter only if its rate among the language's n-grams is
#: at least this share of its rate in the language where it is most frequent.
RELATIVE = 0.2
#: Slots of the filter (a power of two) and hashes of an n-gram.
SLOTS, HASHES = 1 << 19, 2
#: Languages whose bits one word of a slot holds.
WORD = 64
#: Bytes of text that are counted at a time.
BLOCK = 1 << 20

_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def _classes() -> np.ndarray:
    """Byte -> the byte that n-grams see: a-z and bytes beyond ASCII, else 0."""
    to = np.zeros(256, np.uint8)
    for low in range(ord("a"), ord("z") + 1):
        to[low] = to[low - 32] = low
    to[128:] = np.arange(128, 256)
    return to


_CLASS = _classes()


def grams_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of UTF-8 bytes and where their second bytes are.

    A run of other characters than letters counts as one boundary; n-grams
    span a boundary only at their first or last byte.
    """
    c = _CLASS[data]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    at = np.flatnonzero(keep)
    c = c[at].astype(np.uint32)
    if len(c) < N:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    n = len(c) - N + 1
    g, inner = np.zeros(n, np.uint32), np.ones(n, bool)
    for i in range(N):
        g = (g << np.uint32(8)) | c[i:i + n]
        if 0 < i < N - 1:
            inner &= c[i:i + n] != 0
    return g[inner], at[1:n + 1][inner]


def slots_of(grams: np.ndarray) -> Iterator[np.ndarray]:
    shift = np.uint64(64 - (SLOTS.bit_length() - 1))
    for k in range(HASHES):
        yield (grams.astype(np.uint64) * np.uint64(_MULTIPLIERS[k])) >> shift


@dataclass
class Model:
    """Language names by bit, the slots' masks (words x slots), and each filter's false-positive rate."""

    langs: list[str]
    slots: np.ndarray
    false_positives: np.ndarray

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each text: n-grams, and n-grams in each language's filter."""
        totals, hits = np.zeros(len(texts)), np.zeros((len(texts), len(self.langs)))
        for data, ends, rows in blocks_of(texts):
            g, second = grams_of(data)
            k = rows[np.searchsorted(ends, second, side="right")]
            totals += np.bincount(k, minlength=len(texts))
            at = list(slots_of(g))
            for first, word in zip(range(0, len(self.langs), WORD), self.slots, strict=True):
                masks = word[at[0]]
                for s in at[1:]:
                    masks &= word[s]
                for b in range(first, min(first + WORD, len(self.langs))):
                    hits[:, b] += np.bincount(k, weights=(masks >> np.uint64(b - first)) & np.uint64(1), minlength=len(texts))
        return totals, hits

    def decide(self, totals: np.ndarray, hits: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language with the highest popcount less its expected false positives."""
        f = self.false_positives
        right = np.clip((hits - totals[:, None] * f) / (1 - f), 0, None)
        best = right.argmax(axis=1)
        score = right[np.arange(len(best)), best] / np.maximum(totals, 1)
        return [self.langs[b] for b in best], np.clip(score, 0, 1)


def _pieces(data: bytes) -> Iterator[bytes]:
    """A text's bytes in pieces of at most BLOCK, cut after a byte that is no letter if one is near."""
    while len(data) > BLOCK:
        near = np.flatnonzero(_CLASS[np.frombuffer(data[BLOCK // 2:BLOCK], np.uint8)] == 0)
        cut = BLOCK // 2 + int(near[-1]) + 1 if len(near) else BLOCK
        yield data[:cut]
        data = data[cut:]
    yield data


def blocks_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts' bytes in bounded blocks, with a boundary before and after each piece.

    Also where each piece ends, and the number of its text.
    """
    joined, ends, rows = bytearray(b" "), [], []
    for i, t in enumerate(texts):
        for piece in _pieces(t.as_py().encode("utf-8", "surrogatepass")):
            joined += piece + b" "
            ends.append(len(joined))
            rows.append(i)
            if len(joined) >= BLOCK:
                yield np.frombuffer(bytes(joined), np.uint8), np.array(ends), np.array(rows)
                joined, ends, rows = bytearray(b" "), [], []
    if rows:
        yield np.frombuffer(bytes(joined), np.uint8), np.array(ends), np.array(rows)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          train_docs: int = TRAIN_DOCS, grams: int = GRAMS) -> Model:
    """Fit filters on about ``train_docs`` documents of each language.

    The sample is every document whose hashed id falls below a share that is
    set from the language's count, so its size doesn't grow with the table.
    Null texts, ids or labels are left out. Every language of the sample gets a
    filter; with none, every text is ``und``. Texts are read once, whatever the
    number of languages; the driver gets a language's name and bits alone.
    """
    bound_batches(docs.sparkSession)
    d = docs.select(
        F.col(id_col).cast("string").alias("tw_id"), F.col(text_col).alias("tw_text"),
        F.col(lang_col).cast("string").alias("tw_lang"),
    ).where(F.col("tw_lang").isNotNull() & F.col("tw_id").isNotNull())
    counts = materialise(d.groupBy("tw_lang").agg(F.count("*").alias("tw_docs")), "langs")
    place = F.pmod(F.xxhash64("tw_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = lookup(d.where(F.col("tw_text").isNotNull()), counts, "tw_lang").where(place * F.col("tw_docs") < train_docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(1).to_pylist()
            parts = {}
            for lang in sorted(set(names)):
                rows = pa.array([i for i, x in enumerate(names) if x == lang])
                found = [np.unique(grams_of(data)[0], return_counts=True) for data, _, _ in blocks_of(batch.column(0).take(rows))]
                g, n = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
                g, at = np.unique(g, return_inverse=True)
                parts[lang] = g, np.bincount(at, weights=n, minlength=len(g))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([g for g, _ in parts.values()]).astype(np.int64)),
                pa.array(np.concatenate([n for _, n in parts.values()]).astype(np.int64)),
                pa.array([k for k, (g, _) in parts.items() for _ in range(len(g))]),
            ], ["gram", "n", "lang"])

    found = sample.select("tw_text", "tw_lang").mapInArrow(count, "gram long, n long, lang string")
    found = materialise(found.groupBy("gram", "lang").agg(F.sum("n").alias("n")), "grams")
    totals = found.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = lookup(found, materialise(totals, "totals"), "lang").select("gram", "lang", (F.col("n") / F.col("total")).alias("rate"))
    # a gram's rows are its languages, a language's those of its bounded sample
    most = F.max("rate").over(Window.partitionBy("gram"))
    rated = rated.withColumn("most", most).where(F.col("rate") >= RELATIVE * F.col("most"))
    order = Window.partitionBy("lang").orderBy(F.desc("rate"), "gram")
    kept = rated.withColumn("place", F.row_number().over(order)).where(F.col("place") <= grams)
    kept = materialise(kept.select("lang", "gram"), "kept")
    langs = sorted(r[0] for r in kept.select("lang").distinct().collect())
    bit = {k: i for i, k in enumerate(langs)}

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([bit[k] for k in batch.column(0).to_pylist()], np.int64)
            mask = (np.uint64(1) << (bits % WORD).astype(np.uint64)).view(np.int64)
            for s in slots_of(batch.column(1).to_numpy().astype(np.uint32)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bits // WORD), pa.array(s.astype(np.int64)), pa.array(mask)], ["word", "slot", "mask"])

    # at most SLOTS rows a word come to the driver
    words = kept.mapInArrow(masks, "word long, slot long, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    slots = np.zeros((-(-len(langs) // WORD), SLOTS), np.uint64)
    slots[words["word"].to_numpy(), words["slot"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    fill = np.array([((slots[b // WORD] >> np.uint64(b % WORD)) & np.uint64(1)).mean() for b in range(len(langs))])
    return Model(langs, slots, fill**HASHES)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None,
            names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` of ``docs`` with a language and a score (0 to 1), called ``names``, added.

    A null text and one without any letter get ``und`` and 0, as does every
    text when the model knows no language; a text with letters but too short
    for n-grams gets the model's first language and 0. Repeated rows and null
    ids keep their rows. Prediction sees the text alone.
    """
    keep = [c for c in docs.columns if c not in names] if keep is None else keep
    types = [docs.schema[c].dataType for c in keep]
    schema = ", ".join([*(f"`{c}` {t.simpleString()}" for c, t in zip(keep, types, strict=True)), f"`{names[0]}` string", f"`{names[1]}` double"])
    arrow = [to_arrow_type(t) for t in types]
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS * 8 bytes, whatever the input
    sends = keep if text_col in keep else [*keep, text_col]
    text_at = sends.index(text_col)
    src = docs.select(
        *[F.col(c).alias(f"tw_{i}") for i, c in enumerate(sends)],
        F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("tw_letters"),
    )
    columns = [*keep, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            n = batch.num_rows
            letters = np.array(batch.column(len(sends)).to_pylist(), bool)
            langs, score = [UNKNOWN] * n, np.zeros(n)
            if m.langs and n:
                langs, score = m.decide(*m.count(batch.column(text_at).fill_null("")))
            out = [x if ok else UNKNOWN for x, ok in zip(langs, letters, strict=True)]
            own = [batch.column(i).cast(t) for i, t in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(out, pa.string()), pa.array(np.where(letters, score, 0.0))], columns)

    return src.mapInArrow(run, schema)


def held_out(doc_id) -> F.col:
    """Whether crc32 of the id as text leaves 1 when divided by 3: never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """Train on the rows that aren't held out; predict every row.

    Returns id, held_out, lang_pred, score. A null id is not held out and not
    learnt from.
    """
    model = train(docs.where(~held_out(id_col)), text_col, lang_col, id_col)
    out = predict(docs.withColumn("held_out", held_out(id_col)), model, text_col, [id_col, "held_out"])
    return out.select(id_col, "held_out", "lang_pred", "score")
