"""Finding runs: maximal periodic stretches of words.

By the runs theorem every run holds, at any of its Lyndon roots but one that
starts where the run starts, the longest Lyndon word of that place under one of
two opposite orders of words. Longest Lyndon words end at the next smaller (or,
for the opposite order, the next greater) value of the inverse suffix array, so
two candidates a word suffice. Each is extended to both sides by longest common
prefixes of suffixes of the text and of the reversed text: range minima of the
LCP array, by a sparse table. The texts of an Arrow batch are worked on at
once, as arrays that lie one behind the other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallywell.llm.common import bound_batches

#: Words that a run has at least, and how often its period fits in.
LEAST, TIMES = 24, 3
RUN = "struct<start:long,length:long,period:long>"


def suffix_ranks(codes: np.ndarray, stops: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words; the last entry is the inverse suffix array.

    ``stops`` has for each place the end of its text: a suffix ends there, and
    texts are ordered as they stand. Only places whose rank is shared still
    take part in a round. A rank is the number of suffixes that are smaller.
    """
    n = len(codes)
    key = stops * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    heads = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
    sizes = np.diff(np.r_[heads, n])
    ranks = np.empty(n, np.int32)
    ranks[order] = np.repeat(heads, sizes)
    levels, width = [ranks], 1
    active = order[np.repeat(sizes, sizes) > 1]
    while len(active):
        after = active + width
        behind = np.where(after < stops[active], ranks[np.minimum(after, n - 1)], -1).astype(np.int64)
        own = ranks[active].astype(np.int64)
        key = own * (n + 1) + behind + 1
        order = np.argsort(key, kind="stable")
        active, own, key = active[order], own[order], key[order]
        group = np.r_[True, np.diff(own) != 0]
        first = np.flatnonzero(group)
        fresh = np.r_[True, np.diff(key) != 0]
        heads = np.flatnonzero(fresh)
        sizes = np.diff(np.r_[heads, len(key)])
        offset = heads - np.repeat(first, np.diff(np.r_[first, len(key)]))[heads]
        ranks = ranks.copy()
        ranks[active] = np.repeat(own[heads] + offset, sizes)
        levels.append(ranks)
        active, width = active[np.repeat(sizes, sizes) > 1], 2 * width
    return levels


def sparse_table(values: np.ndarray, longest: int, best=np.minimum) -> list[np.ndarray]:
    """``best`` of each 1, 2, 4, ... values from each place on, for ranges of up to ``longest``."""
    table, width = [values], 1
    while 2 * width <= min(longest, len(values)):
        table.append(best(table[-1][:-width], table[-1][width:]))
        width *= 2
    return table


class CommonPrefixes:
    """Lengths of the longest common prefixes of suffixes of one text, by LCP array and range minima."""

    def __init__(self, codes: np.ndarray, stops: np.ndarray, longest: int):
        levels = suffix_ranks(codes, stops)
        self.inverse = levels[-1]
        suffixes = np.empty(len(codes), np.int64)
        suffixes[self.inverse] = np.arange(len(codes))
        # neighbours in suffix order: ranks by 2^k words are equal just if so many words are
        a, b = suffixes[:-1].copy(), suffixes[1:].copy()
        lcp = np.zeros(len(a), np.int32)
        for k in reversed(range(len(levels))):
            equal = levels[k][np.minimum(a, len(codes) - 1)] == levels[k][np.minimum(b, len(codes) - 1)]
            equal &= (a < len(codes)) & (b < len(codes))
            step = equal.astype(np.int64) << k
            a, b, lcp = a + step, b + step, lcp + step.astype(np.int32)
        self.table = sparse_table(lcp, longest)

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For places i != j of the same text."""
        a, b = self.inverse[i].astype(np.int64), self.inverse[j].astype(np.int64)
        low, high = np.minimum(a, b), np.maximum(a, b)
        out = np.zeros(len(low), np.int64)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << k)])
        return out


def _next(table: list[np.ndarray], values: np.ndarray, stops: np.ndarray, further) -> np.ndarray:
    """The next place whose value isn't ``further`` than the own one, or the text's end; ``table`` has range minima or maxima."""
    at = np.arange(1, len(values) + 1)
    for k in reversed(range(len(table))):
        whole = np.flatnonzero(at + (1 << k) <= stops)
        go = whole[further(table[k][at[whole]], values[whole])]
        at[go] += 1 << k
    return at


def find_runs(codes: np.ndarray, lengths: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of at least ``least`` words and ``times`` periods, sorted.

    ``codes`` are the words of all texts, as numbers from 0; ``lengths`` the texts' numbers of words.
    """
    none = np.zeros((0, 4), np.int64)
    lengths = np.asarray(lengths, np.int64)
    # such a run holds two equal stretches of so many words: texts without any hold no run
    shared = -(-least * (times - 1) // times)
    text = np.repeat(np.arange(len(lengths)), lengths)
    begins = np.r_[0, np.cumsum(lengths)]
    if len(codes) <= shared:
        return none
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    window, width = mixed ^ (mixed >> np.uint64(29)), 1
    while width < shared:  # the last step may overlap: equal stretches stay equal
        step = min(width, shared - width)
        window = (window[:-step] * np.uint64(0xD6E8FEB86659FD93)) ^ (window[step:] * np.uint64(0xA0761D6478BD642F)) ^ (window[:-step] >> np.uint64(31))
        width += step
    at = np.flatnonzero(text[:len(window)] == text[width - 1:])
    order = at[np.lexsort((window[at], text[at]))]
    twice = (window[order[1:]] == window[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    kept = np.zeros(len(lengths), bool)
    kept[text[order[1:]][twice]] = True
    if not kept.any():
        return none

    which, codes, n = np.flatnonzero(kept), codes[kept[text]].astype(np.int64), lengths[kept]
    total, longest = int(n.sum()), int(n.max())
    ends = np.cumsum(n)
    stops, starts = np.repeat(ends, n), np.repeat(ends - n, n)
    forward = CommonPrefixes(codes, stops, longest)
    backward = CommonPrefixes(codes[::-1], np.repeat(np.cumsum(n[::-1]), n[::-1]), longest)
    inverse, here = forward.inverse, np.arange(total)
    smaller = _next(sparse_table(inverse, longest), inverse, stops, np.greater)
    greater = _next(sparse_table(inverse, longest, np.maximum), inverse, stops, np.less)
    found = []
    for nearest, at_end in ((smaller, True), (greater, False)):  # a text's end is smaller than any word
        period = nearest - here
        i = np.flatnonzero((nearest < stops if not at_end else nearest <= stops) & (times * period <= stops - starts) & (nearest < stops))
        p = period[i]
        right = forward.of(i, i + p)
        left = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > starts[i])
        left[inner] = backward.of(total - i[inner], total - i[inner] - p[inner])
        length = left + p + right
        good = length >= np.maximum(least, times * p)
        i, p, left, length = i[good], p[good], left[good], length[good]
        found.append(np.stack([np.searchsorted(ends, i, "right"), i - left - starts[i], length, p], 1))
    rows = np.unique(np.concatenate(found), axis=0)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    rows[:, 0] = which[rows[:, 0]]
    return rows


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period, exactly; of equals the first of ``runs``."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def loop_ends(words: list, doc_id) -> list:
    """For one id in ten the words from a place on repeat a stretch, as the query's contract says; a null id's stay."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES, change=None) -> DataFrame:
    """(id, n_words, runs, top, collapsed) of each row of ``docs``.

    Words are what stands between ASCII white space. ``runs`` are the maximal
    stretches of at least ``least`` words and ``times`` periods, as (start,
    length, period) by start, then period; ``top`` the one of greatest length by
    period (null without runs); ``collapsed`` the words, joined by one space,
    that no run holds behind its first period. ``change(words, id)`` may replace
    the words before. A null or blank text has no words, no runs and an empty
    ``collapsed``; rows are judged one by one, so repeated ones and null ids
    stay; other columns are ignored; an empty table gives no rows. No row is
    shuffled. A task holds one Arrow batch of texts, and about 100 bytes for
    each of its words, 12 x log2(words of the longest text) bytes more where
    stretches repeat.
    """
    bound_batches(docs.sparkSession)
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            words = [t.split() for t in batch.column(1).cast(pa.binary()).to_pylist()]  # bytes are split at ASCII white space alone
            if change:
                words = [change(w, i) for w, i in zip(words, ids, strict=True)]
            lengths = np.array([len(w) for w in words], np.int64)
            runs: list[list] = [[] for _ in words]
            kept = np.ones(int(lengths.sum()), bool)
            begins = np.r_[0, np.cumsum(lengths)]
            if lengths.sum():
                codes = pa.array([x for w in words for x in w], pa.large_binary()).dictionary_encode().indices.to_numpy()
                found = find_runs(codes, lengths, least, times)
                for k, *run in found.tolist():
                    runs[k].append(tuple(run))
                change_at = np.zeros(len(kept) + 1, np.int64)
                at = begins[found[:, 0]] + found[:, 1]
                np.add.at(change_at, at + found[:, 3], 1)
                np.add.at(change_at, at + found[:, 2], -1)
                kept = np.cumsum(change_at)[:-1] == 0
            text = [b" ".join(compress(w, kept[a:a + len(w)].tolist()) if r else w) for w, r, a in zip(words, runs, begins.tolist(), strict=False)]
            as_rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in runs]
            top = [dict(zip(("start", "length", "period"), s, strict=True)) if (s := strongest(own)) else None for own in runs]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), pa.array(lengths), pa.array(as_rows, pa.list_(run_type)), pa.array(top, run_type), pa.array(text, pa.binary()).view(pa.string())],
                ["tw_id", "n_words", "runs", "top", "collapsed"])

    src = docs.select(F.col(id_col).alias("tw_id"), F.coalesce(F.col(text_col), F.lit("")).alias("tw_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = src.mapInArrow(find, f"tw_id {kind}, n_words long, runs array<{RUN}>, top {RUN}, collapsed string")
    return out.select(F.col("tw_id").alias(id_col), "n_words", "runs", "top", "collapsed")
