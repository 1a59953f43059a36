"""The Hodges-Lehmann shift of two groups of any size: the median of all differences of their values.

Differences of two sorted sides form a sorted matrix that is never formed.
Both sides are sorted once and cut into blocks, a row each. Two blocks' ends
tell whether all their differences lie up to a pivot or beyond it; those that
lie on both sides of it stand along one staircase of the matrix, a few for each
block, and only those meet in a join, where tasks count. The ends alone bound
where the wanted difference lies; a few pivots in there are tried at a time,
evenly spaced at first, then interpolations between the nearest differences
known, so that a pass leaves a small share of what the one before left. The
driver holds the blocks' ends, which are bounded, and a row for each pivot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywell.operators.running import cumulative
from tallywell.session import checkpoint_ready

#: Pairs of different values that are formed in the end; about how many blocks a side has at most, but for ends of ranges; values of a block at least; pivots of a pass.
FORMED, RANKS, BLOCK, PIVOTS = 4_000_000, 4000, 4096, 24
#: Formed pairs of a batch.
BATCH = 500_000
_DEC = "decimal(38,0)"
_INF = float("inf")


def _ordinals(x: np.ndarray) -> np.ndarray:
    """Integers that order as the doubles do."""
    bits = x.view(np.int64)
    return np.where(bits >= 0, bits, -(bits & 0x7FFFFFFFFFFFFFFF))


def _doubles(n: np.ndarray) -> np.ndarray:
    return np.where(n >= 0, np.abs(n).view(np.float64), -np.abs(n).view(np.float64))


def least_partner(p: np.ndarray, t: float) -> np.ndarray:
    """For each p the least double b with p - b <= t, as rounded; rounding never goes against the order."""
    with np.errstate(over="ignore", invalid="ignore"):
        b = p - t
        b = np.where(p - b > t, np.nextafter(b, _INF), b)  # where rounding moves it by one, as it does half of them
        below = np.nextafter(b, -_INF)
        b = np.where(p - below <= t, below, b)
        odd = np.flatnonzero(~((p - b <= t) & (p - np.nextafter(b, -_INF) > t)))
        if len(odd):  # where it moves it further
            low = np.full(len(odd), _ordinals(np.array([-np.finfo(float).max]))[0])
            high = np.full(len(odd), _ordinals(np.array([_INF]))[0])
            for _ in range(65):
                mid = (low >> 1) + (high >> 1) + (low & high & 1)
                fits = p[odd] - _doubles(mid) <= t
                low, high = np.where(fits | (low >= high), low, mid + 1), np.where(fits & (low < high), mid, high)
            b[odd] = _doubles(high)
    return b


def _dot(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) and int(a.max()) * int(b.max()) * len(a) >= 1 << 63:
        a, b = a.astype(object), b.astype(object)
    return int(a @ b) if len(a) else 0


def _blocks(side: DataFrame, size: int) -> DataFrame:
    """Rows of ``size`` values in order: id, the least, the greatest, their weight, their number, and values and weights as bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, x, w = TaskContext.get().partitionId() << 32, np.zeros(0), np.zeros(0, np.int64)

        def block(k: int, x: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
            row = {"id": k, "lo": float(x[0]), "hi": float(x[-1]), "w": int(w.sum()), "n": len(x), "xs": x.tobytes(), "ws": w.tobytes()}
            return pa.RecordBatch.from_pylist([row], pa.schema([("id", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64()), ("w", pa.int64()), ("n", pa.int64()), ("xs", pa.binary()), ("ws", pa.binary())]))

        for batch in batches:
            x, w = np.r_[x, batch.column(0).to_numpy()], np.r_[w, batch.column(1).to_numpy()]
            whole = len(x) // size * size
            for at in range(0, whole, size):
                yield block(first, x[at:at + size], w[at:at + size])
                first += 1
            x, w = x[whole:], w[whole:]
        if len(x):
            yield block(first, x, w)

    sides = side.select(F.col("x").cast("double").alias("x"), F.col("w").cast("long").alias("w")).repartitionByRange("x").sortWithinPartitions("x")
    return sides.mapInArrow(cut, "id long, lo double, hi double, w long, n long, xs binary, ws binary").checkpoint()


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """Values and weights of the one block, and of the other, of each row."""
    for row in zip(*(batch.column(c) for c in ("px", "pw", "qx", "qw")), strict=True):
        yield tuple(np.frombuffer(x.as_buffer(), t) for x, t in zip(row, (np.float64, np.int64) * 2, strict=True))


class Selection:
    """Order statistics of the differences p - q of finite weighted values (x, w); sides may be of any size."""

    def __init__(self, one: DataFrame, two: DataFrame):
        self.spark = one.sparkSession
        checkpoint_ready(self.spark)
        self.one, self.two = (_blocks(s, max(BLOCK, -(-s.count() // RANKS))) for s in (one, two))
        a, b = (sorted(tuple(r) for r in s.select("lo", "hi", "w", "n", "id").collect()) for s in (self.one, self.two))
        self.weight, self.pairs = (sum(r[c] for r in a) * sum(r[c] for r in b) for c in (2, 3))
        self.passes = 0
        self.brackets: dict[int, tuple[float, float]] = {}
        if not self.weight:
            return
        self.lo, self.hi = (np.array([r[c] for r in a], float) for c in (0, 1))
        self.low, self.high = (np.array([r[c] for r in b], float) for c in (0, 1))
        self.w, self.n, self.i = (np.array([r[c] for r in a], np.int64) for c in (2, 3, 4))
        # of the other side: what stands from each block on
        self.w_from, self.n_from = (np.r_[np.cumsum(np.array([r[c] for r in b], np.int64)[::-1])[::-1], 0] for c in (2, 3))
        self.j = np.array([r[4] for r in b], np.int64)
        # (pivot, weighted pairs up to it, plain pairs up to it, nearest difference up to it, nearest above it)
        with np.errstate(over="ignore"):
            ends = float(self.lo[0] - self.high[-1]), float(self.hi[-1] - self.low[0])
        self.known = [(None, 0, 0, None, ends[0]), (_INF, self.weight, self.pairs, ends[1], None)]

    def _stairs(self, t: float) -> tuple[np.ndarray, np.ndarray]:
        """For each block of the one side: the first of the other that isn't wholly above ``t`` with it, and the first that is wholly up to it."""
        return np.searchsorted(self.high, least_partner(self.lo, t)), np.searchsorted(self.low, least_partner(self.hi, t))

    def _bracket(self, k: int) -> tuple[float, float]:
        """Values between which the k-th difference lies, by the ends of blocks alone: not up to the first, but up to the second."""
        if k not in self.brackets:
            ends = [int(x) for x in _ordinals(np.array([self.known[0][4], self.known[1][3]]))]

            def least(fits) -> float:
                a, b = ends
                while a < b:
                    mid = (a + b) // 2
                    a, b = (a, mid) if fits(self._stairs(float(_doubles(np.array([mid]))[0]))) else (mid + 1, b)
                return a

            high = least(lambda s: _dot(self.w, self.w_from[s[1]]) > k)
            low = least(lambda s: _dot(self.w, self.w_from[s[0]]) > k) - 1
            self.brackets[k] = tuple(float(x) for x in _doubles(np.array([low, high])))
        return self.brackets[k]

    def _met(self, spans: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        """Blocks of both sides that ``spans`` (from, to for each block of the one side) name: px, pw, qx, qw."""
        pairs = {(r, c) for a, b in spans for r in np.flatnonzero(a < b) for c in range(a[r], b[r])}
        named = self.spark.createDataFrame([(int(self.i[r]), int(self.j[c])) for r, c in pairs], "i long, j long")
        own = self.one.select(F.col("id").alias("i"), F.col("xs").alias("px"), F.col("ws").alias("pw")).join(F.broadcast(named), "i")
        other = self.two.select(F.col("id").alias("j"), F.col("xs").alias("qx"), F.col("ws").alias("qw"))
        return own.join(other, "j").select("px", "pw", "qx", "qw")

    def count_upto(self, cuts: list[float]) -> list[tuple]:
        """For each cut: itself, weighted pairs up to it, plain pairs up to it, the greatest difference up to it, the least above it."""
        stairs = [self._stairs(t) for t in cuts]

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = [[0, 0, -_INF, _INF] for _ in cuts]
            for batch in batches:
                for p, w, q, v in _arrays(batch):
                    v_from, n = np.r_[np.cumsum(v[::-1])[::-1], 0], len(q)
                    with np.errstate(over="ignore"):
                        for o, t in zip(out, cuts, strict=True):
                            if p[-1] - q[0] <= t or p[0] - q[-1] > t:
                                continue  # known by the blocks' ends
                            place = np.searchsorted(q, least_partner(p, t))
                            o[0] += _dot(w, v_from[place])
                            o[1] += int((n - place).sum())
                            upto, above = place < n, place > 0
                            if upto.any():
                                o[2] = max(o[2], float((p[upto] - q[place[upto]]).max()))
                            if above.any():
                                o[3] = min(o[3], float((p[above] - q[place[above] - 1]).min()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(cuts)), pa.int32()), *[pa.array([str(o[c]) for o in out]) for c in (0, 1)], *[pa.array([o[c] for o in out], pa.float64()) for c in (2, 3)]],
                ["cut", "w", "n", "below", "above"])

        met = self._met(stairs).mapInArrow(tally, "cut int, w string, n string, below double, above double")
        rows = met.groupBy("cut").agg(F.sum(F.col("w").cast(_DEC)).alias("w"), F.sum(F.col("n").cast(_DEC)).alias("n"), F.max("below").alias("below"), F.min("above").alias("above")).collect()
        found = {r["cut"]: tuple(r)[1:] for r in rows}
        out = []
        for k, (t, (a, b)) in enumerate(zip(cuts, stairs, strict=True)):
            w, n, below, above = found.get(k, (0, 0, -_INF, _INF))
            upto, beyond = b < len(self.low), a > 0
            with np.errstate(over="ignore"):
                below = max([below, *(self.hi[upto] - self.low[b[upto]]).tolist()])
                above = min([above, *(self.lo[beyond] - self.high[a[beyond] - 1]).tolist()])
            out.append((t, int(w) + _dot(self.w, self.w_from[b]), int(n) + _dot(self.n, self.n_from[b]), below, above))
        return out

    def _place(self, low: float | None, high: float, k: int) -> float:
        """The k-th difference, from 0 and weighted, of those above ``low`` (None: all) up to ``high``, which are formed."""
        start = self._stairs(high)[0]
        end = np.full(len(start), len(self.low)) if low is None else self._stairs(low)[1]

        def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for p, w, q, v in _arrays(batch):
                    a = np.searchsorted(q, least_partner(p, high))
                    b = np.full(len(p), len(q)) if low is None else np.searchsorted(q, least_partner(p, low))
                    upto = np.r_[0, np.cumsum(b - a)]
                    for at in range(0, int(upto[-1]), BATCH):
                        some = np.arange(at, min(at + BATCH, int(upto[-1])))
                        r = np.searchsorted(upto, some, "right") - 1
                        c = a[r] + some - upto[r]
                        with np.errstate(over="ignore"):
                            yield pa.RecordBatch.from_arrays([pa.array(p[r] - q[c]), pa.array(w[r]), pa.array(v[c])], ["x", "w", "v"])

        pairs = self._met([(start, end)]).mapInArrow(form, "x double, w long, v long")
        each = pairs.groupBy("x").agg(F.sum((F.col("w").cast("decimal(19,0)") * F.col("v").cast("decimal(19,0)")).cast(_DEC)).cast(_DEC).alias("m")).withColumn("one", F.lit(1))
        return cumulative(each, ["one"], "m").where(F.col("upto") > k).agg(F.min("x")).first()[0]

    def _pivots(self, k: int, done: int, upto: int, first: float, last: float) -> list[float]:
        """Some values from the difference ``first`` on, below ``last``, up to which ``done`` and more and ``upto`` lie."""
        low, high = self._bracket(k)
        inner = (k + 0.5 - done) / (upto - done)
        with np.errstate(over="ignore", invalid="ignore"):
            picks = [low, high] + [low + (high - low) * j / 8 for j in range(1, 8)]
            if self.passes:
                picks += [first + (last - first) * min(1.0, max(0.0, inner + d)) for e in (0.1, 0.03, 0.01, 0.001, 1e-4) for d in (-e, e)]
        first, last = max(first, low), min(last, high)
        ends = [int(x) for x in _ordinals(np.array([first, last]))]
        picks += [first] + [float(_doubles(np.array([ends[0] + (ends[1] - ends[0]) * j // 3]))[0]) for j in (1, 2)]
        return sorted({float(t) for t in picks if first <= t <= last})[:PIVOTS]

    def at(self, k: int) -> float:
        """The k-th least difference, from 0."""
        while True:
            low = max((c for c in self.known if c[1] <= k), key=lambda c: c[1])
            high = min((c for c in self.known if c[1] > k), key=lambda c: c[1])
            first, last = low[4], high[3]
            if first == last:
                return first + 0.0
            if high[2] - low[2] <= FORMED:
                return self._place(low[0], high[0], k - low[1]) + 0.0
            self.known += self.count_upto(self._pivots(k, low[1], high[1], first, last))
            self.passes += 1


def median_difference(one: DataFrame, two: DataFrame) -> float | None:
    """Median of p - q over all p of ``one`` and q of ``two``, both (x, w) of different values with their weights.

    Infinite values and NaN are counted aside; as in SQL, NaN is the greatest difference. None if a side is empty.
    """
    finite = F.abs("x") < _INF
    odd = [{repr(r[0]): r[1] for r in s.where(~finite).collect()} for s in (one, two)]  # three values at most
    n, m = (int(s.where(finite).agg(F.sum("w")).first()[0] or 0) for s in (one, two))
    up, down = (odd[0].get("inf", 0), odd[1].get("inf", 0)), (odd[0].get("-inf", 0), odd[1].get("-inf", 0))
    # pairs by difference: -inf, finite values', +inf, NaN
    least = down[0] * (m + up[1]) + n * up[1]
    greatest = up[0] * (m + down[1]) + n * down[1]
    total = (n + up[0] + down[0] + odd[0].get("nan", 0)) * (m + up[1] + down[1] + odd[1].get("nan", 0))
    if not total:
        return None
    selection = Selection(one.where(finite), two.where(finite)) if n * m else None

    def place(k: int) -> float:
        if k < least:
            return -_INF
        if k < least + n * m:
            return selection.at(k - least)
        return _INF if k < least + n * m + greatest else float("nan")

    first, second = place((total - 1) // 2), place(total // 2)
    return first if first == second else first * 0.5 + second * 0.5
