"""Encoding and decoding with SentencePiece vocabularies of merge type.

Symbols start as single characters. An agenda holds all adjacent pairs of
symbols that form a piece, the best score first and of equal scores the
leftmost; merging a pair adds the pairs that it forms with its neighbours. What
is no piece in the end falls back to the pieces of its bytes. The vocabulary's
own library normalises texts, decodes ids, and checks every text's ids, a batch
at a time.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallywell.llm.common import bound_batches

#: What stands for a blank in pieces.
BLANK = "▁"
#: The longest words, in characters, whose agendas are kept side by side in arrays, and the number of words that are at a time.
SHORT, ROWS = 40, 1 << 15
#: Words that a task remembers the ids of.
REMEMBERED = 200_000


def model_path(model: str | None = None) -> str:
    """``model``, or by default the public vocabulary piece_bpe_32k.model."""
    if model:
        return model
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Agenda:
    """Merges the symbols of normalised words by a merge-type vocabulary."""

    def __init__(self, library):
        n = library.get_piece_size()
        text = [library.id_to_piece(i) for i in range(n)]
        if any(library.is_unused(i) for i in range(n)):
            raise ValueError("vocabularies with unused pieces aren't supported")
        self.ids = {text[i]: i for i in range(n) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))}
        self.scores = {t: -library.get_score(i) for t, i in self.ids.items() if len(t) > 1}  # the least is merged first
        self.unknown = library.unk_id()
        self.bytes = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(library.is_byte(i) for i in self.bytes):
            self.bytes = []
        # no pair spans two words if no piece holds a blank behind another character: words then have their own agendas
        inner = any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.scores)
        self.words = re.compile(".+" if inner else f"{BLANK}*[^{BLANK}]+|{BLANK}+", re.DOTALL)
        # symbols by number: pieces, then other characters of pieces; characters of no piece follow by code point
        self.symbols = list(self.ids) + sorted({c for t in self.ids for c in t} - self.ids.keys())
        number = {t: k for k, t in enumerate(self.symbols)}
        self.characters = np.arange(0x110000) + len(number)
        for t, k in number.items():
            if len(t) == 1:
                self.characters[ord(t)] = k
        pairs = {(number[t[:i]] << 32) | number[t[i:]]: t for t in self.scores for i in range(1, len(t)) if t[:i] in number and t[i:] in number}
        self.pairs = pd.Index(np.fromiter(pairs, np.int64, len(pairs)))
        self.numbers = np.array(list(self.ids.values()))
        self.merged = np.array([number[t] for t in pairs.values()] + [-1], np.int64)
        self.cost = np.array([self.scores[t] for t in pairs.values()] + [np.inf])

    def one(self, word: str) -> list[str]:
        """The symbols of one word that no agenda entry is left for; the agenda is a heap."""
        symbol, n = list(word), len(word)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        scores, agenda = self.scores, []
        for i in range(n - 1):
            if (s := scores.get(word[i:i + 2])) is not None:
                agenda.append((s, i, 2))
        heapq.heapify(agenda)
        while agenda:
            _, left, size = heapq.heappop(agenda)
            right = after[left]
            # an entry is void if one of its symbols has merged meanwhile
            if not symbol[left] or right < 0 or len(symbol[left]) + len(symbol[right]) != size:
                continue
            symbol[left] += symbol[right]
            symbol[right] = ""
            after[left] = nearest = after[right]
            if nearest >= 0:
                before[nearest] = left
                if (s := scores.get(symbol[left] + symbol[nearest])) is not None:
                    heapq.heappush(agenda, (s, left, size + len(symbol[nearest])))
            if (previous := before[left]) >= 0 and (s := scores.get(symbol[previous] + symbol[left])) is not None:
                heapq.heappush(agenda, (s, previous, size + len(symbol[previous])))
        return [s for s in symbol if s]

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost and merged symbol of pairs of symbols; infinite for those that form no piece."""
        at = self.pairs.get_indexer((left << 32) | right)
        return self.cost[at], self.merged[at]

    def many(self, words: list[str]) -> np.ndarray:
        """Symbols of short words, a row each, -1 where none is left; every round takes the best entry of each row's agenda."""
        lengths = np.array([len(w) for w in words])
        width = int(lengths.max()) + 1
        inside = np.arange(width) < lengths[:, None]
        symbol = np.full((len(words), width), -1)
        symbol[inside] = self.characters[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
        before, after = (np.tile(np.arange(width) + d, (len(words), 1)).ravel() for d in (-1, 1))
        cost, merged = np.full(symbol.shape, np.inf), np.full(symbol.shape, -1)
        pair = inside[:, 1:]
        cost[:, :-1][pair], merged[:, :-1][pair] = self._pairs(symbol[:, :-1][pair], symbol[:, 1:][pair])
        flat, costs, results = symbol.ravel(), cost.ravel(), merged.ravel()
        rows = np.arange(len(words))
        while len(rows):
            left = rows * width + np.argmin(cost[rows], axis=1)  # of equal ones the leftmost
            open_ = costs[left] < np.inf
            rows, left = rows[open_], left[open_]
            base = rows * width
            right = base + after[left]
            flat[left], flat[right] = results[left], -1
            costs[right] = costs[left] = np.inf
            after[left] = after[right]
            nearest = base + after[left]  # a row's last place holds no symbol
            before[nearest] = left - base
            inner = np.flatnonzero(flat[nearest] >= 0)
            costs[left[inner]], results[left[inner]] = self._pairs(flat[left[inner]], flat[nearest[inner]])
            inner = np.flatnonzero(before[left] >= 0)
            previous = base[inner] + before[left[inner]]
            costs[previous], results[previous] = self._pairs(flat[previous], flat[left[inner]])
        return symbol

    def _fallback(self, character: str) -> list[int]:
        return [self.bytes[b] for b in character.encode()] if self.bytes else [self.unknown]

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each of ``words``."""
        out: list[list[int]] = [[] for _ in words]
        order = np.argsort(np.array([len(w) for w in words], np.int64), kind="stable").tolist()
        short = [k for k in order if len(words[k]) <= SHORT]
        for at in range(0, len(short), ROWS):
            some = short[at:at + ROWS]
            table = self.many([words[k] for k in some])
            left = table >= 0
            symbols = table[left]
            odd = np.flatnonzero((table >= len(self.numbers)).any(axis=1))
            ids = self.numbers[np.minimum(symbols, len(self.numbers) - 1)].tolist()
            ends = np.cumsum(left.sum(axis=1)).tolist()
            for k, a, b in zip(some, [0, *ends], ends, strict=False):
                out[k] = ids[a:b]
            for row in odd.tolist():
                out[some[row]] = self._ids([self.symbol(x) for x in table[row][left[row]].tolist()])
        for k in order[len(short):]:
            out[k] = self._ids(self.one(words[k]))
        return out

    def symbol(self, number: int) -> str:
        return self.symbols[number] if number < len(self.symbols) else chr(number - len(self.symbols))

    def _ids(self, symbols: list[str]) -> list[int]:
        return [x for s in symbols for x in ([self.ids[s]] if s in self.ids else self._fallback(s))]


class Pieces:
    """A vocabulary with begin and end ids."""

    def __init__(self, model: str | None = None, begin: bool = True, end: bool = True):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=model_path(model))
        self.agenda = Agenda(self.library)
        self.begin, self.end = begin, end
        self.prefix = self.library.normalize("a") == f"{BLANK}a"  # set before a text as if it began with a blank
        self.seen: dict[str, list[int]] = {}
        self.first = [self.library.bos_id()] if begin else []
        self.last = [self.library.eos_id()] if end else []

    def by_library(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, add_bos=self.begin, add_eos=self.end, num_threads=1)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[bool]]:
        """Ids of each of ``texts``, and whether the library encodes each of its words to the same ids.

        Words are merged and checked once for all texts; as no piece spans two of
        them, a text's ids are those of its words.
        """
        cut = [self.agenda.words.findall(self.library.normalize(t)) for t in texts]
        index: dict[str, int] = {}
        codes = np.array([index.setdefault(w, len(index)) for ws in cut for w in ws], np.int64)
        each, right = self._words(list(index))
        counts = np.array([len(i) for i in each], np.int64)
        pool = np.fromiter(chain.from_iterable(each), np.int64, int(counts.sum()))
        n = counts[codes]
        ends = np.cumsum(n)
        flat = pool[np.repeat((np.cumsum(counts) - counts)[codes] - ends + n, n) + np.arange(int(n.sum()))]
        upto = np.cumsum([0, *(len(ws) for ws in cut)])
        bounds, wrong = np.r_[0, ends][upto].tolist(), np.r_[0, np.cumsum(~right[codes])][upto]
        out = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            ids = flat[a:b]
            if not self.agenda.bytes and len(ids):  # unknown characters in a row are one
                ids = ids[np.r_[True, (ids[1:] != ids[:-1]) | (ids[1:] != self.agenda.unknown)]]
            out.append([*self.first, *ids.tolist(), *self.last])
        return out, (np.diff(wrong) == 0).tolist()

    def _words(self, words: list[str]) -> tuple[list[list[int]], np.ndarray]:
        """Ids of different words, and whether the library's are the same; the first REMEMBERED that are right are kept."""
        each = [self.seen.get(w) for w in words]
        right = np.ones(len(words), bool)
        new = [k for k, ids in enumerate(each) if ids is None]
        some = [words[k] for k in new]
        for k, ids, good in zip(new, self.agenda.encode(some), self._checked(some), strict=True):
            each[k], right[k] = ids, ids == good
            if right[k] and len(self.seen) < REMEMBERED and len(words[k]) <= SHORT:
                self.seen[words[k]] = ids
        return each, right

    def _checked(self, words: list[str]) -> list[list[int]]:
        """The library's ids of ``words``."""
        bare = [w[1:] if self.prefix and w[:1] == BLANK else w for w in words]
        blank = [self.library.piece_to_id(BLANK)]
        return [ids or blank for ids in self.library.encode(bare, num_threads=1)]


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, begin: bool = True, end: bool = True) -> DataFrame:
    """(id, n_tokens, ids, decoded, agrees) of each row of ``docs``.

    ``ids`` holds little-endian unsigned 32-bit ids, ``decoded`` what the
    library makes of them again, ``agrees`` whether the library encodes each of the
    text's words to the same ids. A null text counts as empty, which has just the begin and
    end ids. Rows are encoded one by one, so repeated ones and null ids stay;
    other columns are ignored; an empty table gives no rows. No row is shuffled;
    a task holds one Arrow batch of texts. ``model`` must be readable by all
    executors, as the installed public vocabulary is.
    """
    bound_batches(docs.sparkSession)
    id_type = to_arrow_type(docs.schema[id_col].dataType)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Pieces(model, begin, end)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids, agrees = vocabulary.encode(texts)
            decoded = vocabulary.library.decode(ids) if ids else []
            packed = [np.array(i, "<u4").tobytes() for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(id_type), pa.array([len(i) for i in ids], pa.int64()), pa.array(packed, pa.binary()), pa.array(decoded, pa.string()), pa.array(agrees)],
                ["tw_id", "n_tokens", "ids", "decoded", "agrees"])

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("tw_id"), F.coalesce(F.col(text_col), F.lit("")).alias("tw_text"))
    out = src.mapInArrow(encode, f"tw_id {kind}, n_tokens long, ids binary, decoded string, agrees boolean")
    return out.select(F.col("tw_id").alias(id_col), "n_tokens", "ids", "decoded", "agrees")


def decode_ids(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """(id, text) of rows whose ``ids_col`` holds little-endian unsigned 32-bit ids, as ``encode_texts`` gives them.

    Null ids give an empty text; begin and end ids give nothing. An id beyond
    the vocabulary is an error of the library's.
    """
    bound_batches(tokens.sparkSession)
    id_type = to_arrow_type(tokens.schema[id_col].dataType)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Pieces(model).library
        for batch in batches:
            ids = [np.frombuffer(b, "<u4").tolist() for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(id_type), pa.array(library.decode(ids) if ids else [], pa.string())], ["tw_id", "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    src = tokens.select(F.col(id_col).alias("tw_id"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("tw_ids"))
    return src.mapInArrow(decode, f"tw_id {kind}, text string").select(F.col("tw_id").alias(id_col), "text")
