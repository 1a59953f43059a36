"""N-gram Jaccard join by PartEnum signatures.

Sets of word shingles are compared within bands of similar size. In a band
that reaches size u, two sets of Jaccard similarity t or more differ in at most
k = floor(2u (1 - t) / (1 + t)) features. The feature domain is dealt into
groups of PARTS partitions each. There are more than k / PARTS groups, so some
group has fewer than PARTS differences and at least one of its partitions is
the same in both sets. For PARTS = 2 the enumerated subsets of a group's
partitions are its single partitions; each gives a signature.

Equal empty partitions say nothing, and their signature would be shared by
everyone. So there are spare groups, and a set that has empty partitions in no
more groups than that can do without them; only the few sets that have more
emit the empty signatures too. No pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import bound_batches, components, lookup, materialise

#: Similarity: NUM / DEN.
NUM, DEN = 85, 100
#: Words of a shingle, partitions of a group, and how much a band's sizes grow.
WORDS, PARTS, GROWTH = 4, 2, 1.6
#: A bucket's members are compared in blocks of about this many. A block with
#: more than DENSE likely pairs a member compares its sets in place.
BLOCK, DENSE = 256, 1

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class _Powers:
    """Powers of the base and of its inverse, as far as a text has needed them."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (_BASE, _BACK))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    Words are runs of other characters than ASCII white space, with A-Z
    lower-cased. A text of fewer words is one shingle; none gives an empty set.
    """
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _POWERS.get(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[data] * up[:-1])])
    w = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MIX[2])
    n = len(w) - words + 1
    if n < 1:
        h = np.array([len(w)], np.uint64)
        for x in w:
            h = _mix(h * _MIX[3] + x)
        return h
    h = w[:n].copy()
    for i in range(1, words):
        h = h * _MIX[3] + w[i:i + n]
    return np.unique(_mix(h))


def bands(largest: int) -> list[tuple[int, int]]:
    """(least, greatest) size of each band, until ``largest`` is covered."""
    out, low = [], 1
    while low <= largest:
        high = max(low, int(low * GROWTH))
        out.append((low, high))
        low = high + 1
    return out


def signatures(found: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """64-bit signatures of a set, for its own band and those of larger partners."""
    n = len(found)
    largest = n * den // num  # no partner is larger
    if not n or (den - num) * (n + largest) // (den + num) < 1:
        return np.zeros(0, np.uint64)  # only an equal set is similar enough
    mixed = _mix(found ^ _MIX[2])
    out = []
    for number, (low, high) in enumerate(bands(largest)):
        if high < n:
            continue
        k = (den - num) * 2 * high // (den + num)
        groups = k // PARTS + 1
        spare = 2 + groups // 12
        parts = (groups + spare) * PARTS
        at = (mixed >> np.uint64(20)) % np.uint64(parts)
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        sums, filled = np.add.reduceat(mixed[order], first), at[first]
        empty = np.ones(parts, bool)
        empty[filled.astype(np.int64)] = False
        place = np.uint64(number << 40)
        out.append(_mix(sums ^ _mix(filled + place + np.uint64(1))))
        if empty.reshape(-1, PARTS).any(axis=1).sum() > spare:
            out.append(_mix(_mix(np.flatnonzero(empty).astype(np.uint64) + place + np.uint64(1)) ^ _MIX[3]))
    return np.concatenate(out)


def class_of(found: np.ndarray) -> int:
    """A set's number: 64 bits of its size and features, signed."""
    total = _mix(np.add.reduce(_mix(found + _MIX[1]), keepdims=True) + np.array([len(found)], np.uint64) * _MIX[0])
    return int(total.view(np.int64)[0])


def similar(a: np.ndarray, b: np.ndarray, num: int = NUM, den: int = DEN) -> bool:
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def _set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def parity_bits(found: np.ndarray) -> np.ndarray:
    """One bit for each of about 2n slices of the domain: whether it holds an odd number of features.

    Two sets' bits differ in at most as many places as the sets differ in
    features, so too many differing bits rule a pair out.
    """
    size = max(64, 1 << (2 * len(found) - 1).bit_length())
    at = (_mix(found ^ _MIX[3]) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(np.uint8))


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        bits = bits[:len(bits) // 2] ^ bits[len(bits) // 2:]
    return bits


def maybe_similar(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int, num: int = NUM, den: int = DEN) -> bool:
    """False only for pairs that are surely not similar enough."""
    if den * min(n_a, n_b) < num * max(n_a, n_b):
        return False
    size = min(len(a), len(b))
    apart = int(np.bitwise_count(fold(a, size) ^ fold(b, size)).sum())
    return apart * (den + num) <= (den - num) * (n_a + n_b)


def near_pairs(comps: list[int], sizes: list[int], bits: list[np.ndarray], sides: list[int], num: int = NUM, den: int = DEN) -> list[tuple[int, int, int]]:
    """(bits apart, i, j) of a bucket's pairs that may be similar and whose components differ.

    With two sides, only pairs across them count: other tasks have the rest.
    """
    least = min(map(len, bits))
    words = np.stack([fold(b, least) for b in bits]).view(np.uint64)
    n, side, comp = np.array(sizes), np.array(sides), np.array(comps)
    out: list[tuple[int, int, int]] = []
    for i in range(len(n) - 1):
        j = np.arange(i + 1, len(n))
        j = j[(comp[j] != comp[i]) & (den * np.minimum(n[j], n[i]) >= num * np.maximum(n[j], n[i]))]
        if side.any():
            j = j[side[j] != side[i]]
        if len(j):
            apart = np.bitwise_count(words[j] ^ words[i]).sum(axis=1, dtype=np.int64)
            keep = apart * (den + num) <= (den - num) * (n[j] + n[i])
            out += [(int(d), i, int(x)) for d, x in zip(apart[keep], j[keep], strict=True)]
    return out


def compare_bucket(classes: list[int], comps: list[int], sets: list[np.ndarray], sides: list[int]) -> list[tuple[int, int]]:
    """Links that join the components of a bucket's members.

    Pairs of one component are already joined. The closest pairs are compared
    first, as what they join spares the rest.
    """
    parent = {c: c for c in comps}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for _, i, j in sorted(near_pairs(comps, [len(s) for s in sets], [parity_bits(s) for s in sets], sides)):
        a, b = root(comps[i]), root(comps[j])
        if a != b and similar(sets[i], sets[j]):
            parent[max(a, b)] = min(a, b)
            links.append((classes[i], classes[j]))
    return links


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, text_hash, n_shingles, component_id and component.

    Rows link when their sets of 4-word shingles have a Jaccard similarity of
    0.85 or more; component_id is the least id that a row reaches, itself
    included; component is its own key, which tells components apart that share
    that id (null for empty sets). Equal sets are one class and compared once. A null text or one
    without words has an empty set and links with nothing. Rows of null id take
    part and get the least id of their component, or null. Repeated rows and
    ids keep their rows; other columns are ignored; an empty table gives an
    empty result. Sets are held as 64-bit hashes of shingles.
    """
    bound_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("tw_id"), F.col(text_col).alias("tw_text"), F.xxhash64(text_col).alias("tw_hash"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1000):
                b = whole.slice(low, 1000)
                n, cls, sigs, bits = [], [], [], []
                for text in b.column(1):
                    s = shingles(text.as_py())
                    n.append(len(s))
                    cls.append(class_of(s) if len(s) else None)
                    sigs.append(signatures(s).view(np.int64))
                    bits.append(parity_bits(s).tobytes() if len(sigs[-1]) else None)
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sigs])]).astype(np.int32)
                flat = pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([
                    b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(cls, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(bits, pa.binary()),
                ], ["tw_id", "tw_hash", "n", "cls", "sigs", "bits"])

    t = materialise(src.mapInArrow(sign, "tw_id long, tw_hash long, n long, cls long, sigs array<long>, bits binary"), "signed")
    emitted = t.select(F.explode("sigs").alias("sig"), "cls")

    # buckets of two classes or more; a signature of a third of all rows is reduced before it meets
    buckets = emitted.groupBy("sig").agg(F.min("cls").alias("pivot"), F.max("cls").alias("other"))
    buckets = materialise(buckets.where(F.col("pivot") != F.col("other")).select("sig", "pivot"), "buckets")
    # left to Spark to broadcast or sort; both sides are shuffled for this join alone, so it may split a hot signature
    members = materialise(emitted.join(buckets, "sig").distinct(), "members").where(F.col("cls") != F.col("pivot"))
    wanted = members.select("cls").union(members.select("pivot")).distinct()
    bits = lookup(t.select("cls", "n", "bits"), wanted, "cls").dropDuplicates(["cls"])
    bits = materialise(bits.select("cls", F.col("n").alias("size"), "bits"), "bits")

    def resign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                b = whole.slice(low, 500)
                yield pa.RecordBatch.from_arrays([
                    b.column(0), pa.array([shingles(x.as_py()).tobytes() for x in b.column(1)], pa.binary())], ["cls", "features"])

    def sets_of(classes: DataFrame) -> DataFrame:
        """cls, features: the sets themselves, made again from one text of each class."""
        reps = lookup(t.select("cls", "tw_id", "tw_hash"), classes.distinct(), "cls")
        reps = reps.groupBy("cls").agg(F.min(F.struct("tw_id", "tw_hash")).alias("r"))
        reps = reps.select("cls", F.col("r.tw_id").alias("rep_id"), F.col("r.tw_hash").alias("tw_hash"))
        texts = lookup(src, reps.dropDuplicates(["tw_hash"]), "tw_hash").where(F.col("tw_id").eqNullSafe(F.col("rep_id")))
        found = texts.select("cls", "tw_text").mapInArrow(resign, "cls long, features binary")
        return materialise(found.dropDuplicates(["cls"]), "sets")

    def both(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
        for key in ("a", "b"):
            pairs = pairs.join(table.select(F.col("cls").alias(key), *[F.col(c).alias(f"{c}_{key}") for c in columns]), key)
        return pairs.select("a", "b", *[f"{c}_{key}" for c in columns for key in ("a", "b")])

    def where_pairs(test):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ok = [test(*row) for row in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

        return run

    # first every member against its bucket's pivot: that joins what large groups have in common
    pairs = members.select(F.col("cls").alias("a"), F.col("pivot").alias("b")).distinct()
    may = where_pairs(lambda n_a, n_b, x, y: maybe_similar(np.frombuffer(x, np.uint8), n_a, np.frombuffer(y, np.uint8), n_b))
    pairs = materialise(both(pairs, bits, "size", "bits").mapInArrow(may, "a long, b long"), "pairs")
    sets = sets_of(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")))
    are = where_pairs(lambda x, y: similar(_set(x), _set(y)))
    links = materialise(both(pairs, sets, "features").mapInArrow(are, "a long, b long"), "links")

    # then the other members of a bucket, if they are not all of one component
    comps = components(links).withColumnRenamed("node", "cls")
    left = materialise(lookup(members, comps, "cls", "left").select("sig", "cls", F.coalesce("comp", "cls").alias("comp")), "left")
    mixed = left.groupBy("sig").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size"))
    mixed = mixed.where(F.col("low") != F.col("high")).select("sig", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    open_ = lookup(left, mixed, "sig").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    open_ = open_.select("sig", "cls", "comp", "own", other.alias("other"))
    open_ = open_.select(
        F.xxhash64("sig", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "cls", "comp",
        F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"),
    )

    def in_order(rows: pa.Table) -> pa.Table:
        return rows.sort_by([("cls", "ascending"), ("side", "ascending")])

    def narrow(key: tuple, rows: pa.Table) -> pa.Table:
        """Pairs that may be similar; where they are many for the members, the members instead."""
        rows = in_order(rows)
        found = near_pairs(
            rows["comp"].to_pylist(), rows["size"].to_pylist(), [np.frombuffer(x.as_py(), np.uint8) for x in rows["bits"]], rows["side"].to_pylist())
        own = rows.select(["task", "cls", "comp", "side"])
        if len(found) > DENSE * len(rows):
            out = own.take(pa.array(sorted({x for _, i, j in found for x in (i, j)}), pa.int64()))
            return out.append_column("other", pa.nulls(len(out), pa.int64()))
        out = own.take(pa.array([i for _, i, _ in found], pa.int64()))
        return out.append_column("other", rows["cls"].take(pa.array([j for _, _, j in found], pa.int64())))

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        rows = in_order(rows)
        found = compare_bucket(
            rows["cls"].to_pylist(), rows["comp"].to_pylist(), [_set(x.as_py()) for x in rows["features"]], rows["side"].to_pylist())
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    near = open_.join(bits, "cls").groupBy("task").applyInArrow(narrow, "task long, cls long, comp long, side int, other long")
    near = materialise(near, "near")
    # the same pair comes from many signatures: it is compared once
    pairs = near.where(F.col("other").isNotNull()).select(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")).distinct()
    dense = near.where(F.col("other").isNull()).drop("other")
    sets = sets_of(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).union(dense.select("cls")))
    more = both(pairs, sets, "features").mapInArrow(are, "a long, b long").union(
        dense.join(sets, "cls").groupBy("task").applyInArrow(compare, "a long, b long"))
    more = materialise(more.distinct(), "links")
    comps = components(links.unionByName(more)).withColumnRenamed("node", "cls")

    # classes get their least id; those of one component, the least of theirs
    least = t.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("tw_id").alias("least"), F.count("*").alias("rows"))
    joined = least.join(comps, "cls", "left")
    tops = joined.where(F.col("comp").isNotNull()).groupBy("comp").agg(F.min("least").alias("top"))
    labels = lookup(joined.where((F.col("rows") > 1) | F.col("comp").isNotNull()), tops, "comp", "left")
    labels = materialise(labels.select("cls", F.coalesce("top", "least").alias("component_id"), F.coalesce("comp", "cls").alias("component")), "labels")
    out = lookup(t.select("tw_id", "tw_hash", "n", "cls"), labels, "cls", "left")
    return out.select(F.col("tw_id").alias(id_col), F.col("tw_hash").alias("text_hash"), F.col("n").alias("n_shingles"),
                      F.coalesce("component_id", "tw_id").alias("component_id"), F.coalesce("component", "cls").alias("component"))
