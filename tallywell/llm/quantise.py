"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of one entry from each of several codebooks, all
of full dimension, trained on residuals and searched with a beam. The index
keeps the codes and the norm of the decoded vector, dealt by the first two
codes into cells. A query scores the codes of its nearest cells by its table of
inner products with all entries; the best are reranked by exact cosine in
double precision. Queries and codes meet in shuffles alone: none of either
passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywell.llm.common import lookup, materialise

#: Codebooks and their entries, vectors that a vector's code search keeps at a
#: time, and vectors of the training sample.
BOOKS, ENTRIES, BEAM, SAMPLE = 24, 256, 4, 12_000
#: Different vectors that are reranked for each query, and cells that a query looks into, at least.
RERANK, PROBES = 64, 32
#: Queries whose true neighbours are found by brute force, and the share of these that the cells looked into, and
#: then the reranked vectors, must hold: both together leave a recall of about FOUND squared.
TRIAL, FOUND = 128, 0.975
#: Codes of a shard (neighbouring cells, or a part of a large one), about, and
#: queries that one task scores against a shard.
SHARD_ROWS, SHARD_QUERIES = 1 << 18, 1 << 16


@dataclass
class Codebooks:
    entries: np.ndarray  # books x entries x dimension

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes and decoded norms of unit vectors, by beam search."""
        books, entries, dim = self.entries.shape
        n = len(x)
        each = np.arange(n)[:, None]
        codes = np.zeros((n, 1, 0), np.uint8)
        left = x[:, None, :]  # what each kept combination leaves of the vector
        for m in range(books):
            c = self.entries[m]
            error = (left * left).sum(2)[:, :, None] + (c * c).sum(1)[None, None]
            error -= 2 * (left.reshape(-1, dim) @ c.T).reshape(n, -1, entries)
            error = error.reshape(n, -1)
            keep = min(beam if m + 1 < books else 1, error.shape[1])
            best = np.argpartition(error, keep - 1, axis=1)[:, :keep]
            from_beam, code = best // entries, best % entries
            left = left[each, from_beam] - c[code]
            codes = np.concatenate([codes[each, from_beam], code[:, :, None].astype(np.uint8)], axis=2)
        return codes[:, 0], np.linalg.norm(x - left[:, 0], axis=1)


def fit(sample: np.ndarray, books: int = BOOKS, entries: int = ENTRIES, rounds: int = 8, seed: int = 1) -> Codebooks:
    """Residual k-means: each codebook is fitted to what the ones before leave."""
    rng = np.random.default_rng(seed)
    left = sample.astype(np.float32).copy()
    made = []
    for _ in range(books):
        c = left[rng.choice(len(left), entries, replace=len(left) < entries)].copy()
        for _ in range(rounds):
            near = ((c * c).sum(1)[None] - 2 * left @ c.T).argmin(1)
            n = np.bincount(near, minlength=entries)
            sums = np.zeros_like(c)
            np.add.at(sums, near, left)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c).astype(np.float32)
        near = ((c * c).sum(1)[None] - 2 * left @ c.T).argmin(1)
        left -= c[near]
        made.append(c)
    return Codebooks(np.stack(made))


def _matrix(column: pa.Array, dim: int, kind=np.float64) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(kind).reshape(len(column), dim)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _top(scores: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Places of the ``keep`` highest scores, ties to smaller ids."""
    if len(scores) > keep:
        edge = np.partition(scores, len(scores) - keep)[len(scores) - keep]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:keep]


def deal(sizes: list[int], rows: int = SHARD_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The first shard and the number of shards of each cell: small neighbours share one, a large cell has several."""
    first, many, shard, held = [], [], 0, 0
    for n in sizes:
        parts = -(-n // rows)
        if held and (parts > 1 or held + n > rows):
            shard, held = shard + 1, 0
        first.append(shard)
        many.append(parts)
        shard, held = (shard + parts, 0) if parts > 1 else (shard, held + n)
    return np.array(first, np.int64), np.array(many, np.int64)


def nearest_cells(scores: np.ndarray, sizes: np.ndarray, probes: int, candidates: int) -> np.ndarray:
    """Places of the best cells: at least ``probes``, and as many as hold ``candidates`` rows together."""
    most = min(len(scores), max(probes, 1024))
    best = np.argpartition(-scores, most - 1)[:most]
    best = best[np.argsort(-scores[best], kind="stable")]
    held = np.cumsum(sizes[best])
    if held[-1] < candidates and most < len(scores):
        best = np.argsort(-scores, kind="stable")
        held = np.cumsum(sizes[best])
    return best[:max(probes, int(np.searchsorted(held, candidates)) + 1)]


@dataclass(frozen=True)
class Effort:
    """What queries need for the recall that is asked: codes in the cells they look into, and vectors to rerank."""

    codes: int
    rerank: int
    share: float  # of all codes


def measure(each: DataFrame, index: DataFrame, wanted: DataFrame, books, cells: list[tuple[int, int]], dim: int, k: int, rerank: int, trial: int = TRIAL, found: float = FOUND) -> Effort:
    """Find by brute force the true neighbours of the ``trial`` queries of the smallest hashes, and what effort would have found them.

    Their exact cosines against all vectors give the neighbours; how many codes
    lie in the cells up to each one's, in the order in which a query looks into
    them, and how many codes score higher, give the effort. Two passes over the
    table, each of ``trial`` products or table look-ups a row.
    """
    asked = wanted.orderBy("tw_a", "tw_b").limit(trial).select("tw_a", "tw_b", "tw_vec").toArrow()  # ``trial`` vectors
    if not asked.num_rows or not cells:
        return Effort(0, rerank, 0.0)
    units = _units(_matrix(asked.column(2).combine_chunks(), dim))
    keys = np.stack([asked.column(i).to_numpy() for i in (0, 1)])
    schema = "q int, tw_v long, score double"

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0), np.zeros(0, np.int64)) for _ in range(len(units))]
        for batch in batches:
            x, v = _units(_matrix(batch.column(3), dim)), batch.column(0).to_numpy()
            a, b = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            scores = units @ x.T
            scores[(keys[0][:, None] == a) & (keys[1][:, None] == b)] = -2  # itself
            for q in range(len(units)):
                s, ids = np.concatenate([held[q][0], scores[q]]), np.concatenate([held[q][1], v])
                top = _top(s, ids, k)
                held[q] = s[top], ids[top]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(len(held), dtype=np.int32), [len(s) for s, _ in held])), pa.array(np.concatenate([i for _, i in held])), pa.array(np.concatenate([s for s, _ in held]))], ["q", "tw_v", "score"])

    best = Window.partitionBy("q").orderBy(F.desc("score"), "tw_v")
    true = each.select("tw_v", "tw_a", "tw_b", "tw_vec").mapInArrow(nearest, schema).where("score > -2").withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("q", "tw_v")
    # ``trial`` times k rows
    rows = index.join(F.broadcast(materialise(true, "true")), "tw_v").select("q", "cell", "codes", "norm").collect()
    if not rows:
        return Effort(0, rerank, 0.0)
    entries = books.entries
    tables = np.einsum("qd,med->qme", units.astype(np.float32), entries, optimize=True).reshape(len(units), -1)
    steps = np.arange(entries.shape[0]) * ENTRIES
    told = np.array([tables[r["q"]][np.frombuffer(r["codes"], np.uint8) + steps].sum() / max(r["norm"], 1e-12) for r in rows], np.float32)
    of = np.array([r["q"] for r in rows])

    def higher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = np.zeros(len(told), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                b = batch.slice(at, 8192)
                codes, norms = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1), np.maximum(b.column(1).to_numpy(), 1e-12)
                for q in np.unique(of):
                    scores = tables[q][codes + steps].sum(axis=1) / norms
                    mine = np.flatnonzero(of == q)
                    more[mine] += (scores[:, None] > told[mine]).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(told), dtype=np.int32)), pa.array(more)], ["k", "n"])

    ranks = [r[0] for r in index.select("codes", "norm").mapInArrow(higher, "k int, n long").groupBy("k").agg(F.sum("n")).select("sum(n)").collect()]
    ids, sizes = np.array([c for c, _ in cells]), np.array([n for _, n in cells])
    one, two = ids // ENTRIES, ids % ENTRIES
    half = ((entries[0][one] + entries[1][two]) ** 2).sum(1) / 2
    needed = []
    for q in np.unique(of):
        unit = units[q].astype(np.float32)
        order = np.argsort(-((entries[0] @ unit)[one] + (entries[1] @ unit)[two] - half), kind="stable")
        upto = dict(zip(ids[order].tolist(), np.cumsum(sizes[order]).tolist(), strict=True))
        needed += [upto[rows[j]["cell"]] for j in np.flatnonzero(of == q)]
    total = int(sizes.sum())
    codes = min(total, int(np.quantile(needed, found, method="higher")))
    return Effort(codes, max(rerank, int(np.quantile(ranks, found, method="higher")) + 1), codes / total)


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """tw_id, tw_vec (doubles), tw_a and tw_b (128 bits of it) of rows whose vector can be compared.

    Left out: null ids, null or empty vectors, vectors with a null or
    non-finite component, and zero vectors.
    """
    v = df.select(F.col(id_col).cast("long").alias("tw_id"), F.col(vec_col).cast("array<double>").alias("tw_vec"))
    sound = F.forall("tw_vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("tw_id").isNotNull() & (F.size("tw_vec") > 0) & sound & F.exists("tw_vec", lambda x: x != 0))
    return v.withColumns({"tw_a": F.xxhash64("tw_vec"), "tw_b": F.xxhash64(F.lit(1), "tw_vec")})


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    rerank: int = RERANK,
    sample: int = SAMPLE,
    probes: int = PROBES,
    own: bool = True,
    found: float = FOUND,
    efforts: list[Effort] | None = None,
) -> DataFrame:
    """The ``k`` rows of ``vectors`` nearest to each row of ``queries`` by cosine.

    Returns query_id, rank (from 1), vec_id, score: nearest first, ties to the
    smaller id. With ``own``, queries are rows of ``vectors`` and every row but
    the query's own is a candidate: repeated rows, and other rows of its id,
    too; without, every row is. Each row of ``queries`` is a query, repeated
    ones also. Rows that can't be compared (see valid_vectors) take no part;
    vectors are compared with those of their own length, by a search for each
    length. With fewer than ``k`` candidates all are returned; an empty table
    gives none; other columns are ignored.

    Equal vectors are indexed and searched once. Codebooks are fitted to at most
    ``sample`` of them, those with the smallest hashes; every one is indexed.
    How many codes a query scores, and how many vectors are reranked, is
    measured (see measure), so that recall doesn't fall as tables grow; where
    cells tell nothing, that is all codes. ``efforts``, if given, gets what was
    measured for each length.
    """
    rows, asked = valid_vectors(vectors, id_col, vec_col), valid_vectors(queries, id_col, vec_col)
    lengths = sorted(r[0] for r in rows.select(F.size("tw_vec")).distinct().collect())
    parts = [
        _search(rows.where(F.size("tw_vec") == n), asked.where(F.size("tw_vec") == n), n, k, rerank, sample, probes, own, found, efforts) for n in lengths
    ]
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _search(rows: DataFrame, asked: DataFrame, dim: int, k: int, rerank: int, sample: int, probes: int, own: bool, found: float, efforts: list | None) -> DataFrame:
    spark = rows.sparkSession
    # a vector's k + 1 least ids are all that can be returned of it; each task keeps no more of a copied one
    order = Window.partitionBy("tw_a", "tw_b").orderBy("tw_id")
    few = rows.withColumn("tw_n", F.row_number().over(order)).where(F.col("tw_n") <= k + 1)
    each = few.groupBy("tw_a", "tw_b").agg(F.first("tw_vec").alias("tw_vec"), F.sort_array(F.collect_list("tw_id")).alias("tw_ids"))
    each = materialise(each.withColumn("tw_v", F.monotonically_increasing_id()), "vectors")
    wanted = asked.groupBy("tw_a", "tw_b").agg(F.first("tw_vec").alias("tw_vec"))
    wanted = materialise(wanted.withColumn("tw_q", F.monotonically_increasing_id()), "queries")

    drawn = each.orderBy("tw_a", "tw_b").limit(sample).select("tw_vec").toArrow()
    books = fit(_units(_matrix(drawn.column(0).combine_chunks(), dim)))
    sent = spark.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                codes, norms = sent.value.encode(_units(_matrix(b.column(1), dim)).astype(np.float32))
                cell = codes[:, 0].astype(np.int64) * ENTRIES + codes[:, 1]
                yield pa.RecordBatch.from_arrays([
                    b.column(0), pa.array(cell), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms.astype(np.float32)),
                ], ["tw_v", "cell", "codes", "norm"])

    index = materialise(each.select("tw_v", "tw_vec").mapInArrow(encode, "tw_v long, cell long, codes binary, norm float"), "codes")
    # at most ENTRIES squared cells
    sizes = sorted((r["cell"], r["n"]) for r in index.groupBy("cell").agg(F.count("*").alias("n")).collect())
    cell_ids, counts = np.array([c for c, _ in sizes]), np.array([n for _, n in sizes])
    first, many = deal([n for _, n in sizes])
    effort = measure(each, index, wanted, books, sizes, dim, k, rerank, found=found)
    candidates, rerank = effort.codes, effort.rerank
    if efforts is not None:
        efforts.append(effort)
    at = spark.createDataFrame(list(zip(cell_ids.tolist(), first.tolist(), many.tolist(), strict=True)), "cell long, first long, many long")
    index = index.join(F.broadcast(at), "cell").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("tw_v"), F.col("many")))
    map_of_cells = spark.sparkContext.broadcast((cell_ids, counts, first, many))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = sent.value.entries
        cells, held, start, parts = map_of_cells.value
        one, two = cells // ENTRIES, cells % ENTRIES
        half = ((entries[0][one] + entries[1][two]) ** 2).sum(1) / 2
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                b = batch.slice(low, 64)
                q = _units(_matrix(b.column(1), dim)).astype(np.float32)
                scores = (q @ entries[0].T)[:, one] + (q @ entries[1].T)[:, two] - half
                out: list[tuple] = []
                for number, unit, own_scores in zip(b.column(0).to_pylist(), q, scores, strict=True):
                    best = nearest_cells(own_scores, held, probes, candidates)
                    best = best[np.argsort(start[best], kind="stable")]
                    single = best[parts[best] == 1]
                    cuts = np.flatnonzero(np.diff(start[single])) + 1
                    groups = [(int(start[g[0]]), g) for g in np.split(single, cuts) if len(g)]
                    groups += [(int(start[c]) + i, np.array([c])) for c in best[parts[best] > 1] for i in range(parts[c])]
                    out += [(shard, number, unit.tobytes(), cells[g].astype(np.int32).tobytes()) for shard, g in groups]
                yield pa.RecordBatch.from_arrays([
                    pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))
                ], ["shard", "tw_q", "unit", "cells"])

    routes = wanted.select("tw_q", "tw_vec").mapInArrow(probe, "shard long, tw_q long, unit binary, cells binary")
    routes = materialise(routes, "routes")
    # a shard that very many queries look into is scored by several tasks, each with its own part of them
    busy = routes.groupBy("shard").agg(F.ceil(F.count("*") / SHARD_QUERIES).cast("int").alias("parts")).where(F.col("parts") > 1)
    busy = materialise(busy, "busy")
    stored = lookup(index, busy, "shard", "left").select(
        "shard", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.lit(0).alias("kind"),
        F.col("tw_v").alias("number"), F.col("codes").alias("body"), F.lit(None).cast("binary").alias("cells"), "cell", "norm")
    looking = lookup(routes, busy, "shard", "left").select(
        "shard", F.coalesce(F.pmod(F.xxhash64("tw_q"), F.col("parts")), F.lit(0)).cast("int").alias("part"), F.lit(1).alias("kind"),
        F.col("tw_q").alias("number"), F.col("unit").alias("body"), "cells", F.lit(None).cast("long").alias("cell"), F.lit(None).cast("float").alias("norm"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's codes come first and are held; then its queries pass by."""
        entries = sent.value.entries
        shelf = _Shelf()
        for batch in batches:
            marks = np.stack([batch.column(i).to_numpy() for i in range(3)])
            edges = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges, edges[1:], strict=False):
                if low == high:
                    continue
                shelf.turn_to(tuple(marks[:2, low]))
                b = batch.slice(low, high - low)
                if marks[2, low] == 0:
                    shelf.add(b)
                    continue
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    units = np.stack([np.frombuffer(x.as_py(), np.float32) for x in part.column(4)])
                    tables = np.einsum("qd,med->qme", units, entries, optimize=True).reshape(len(units), -1)
                    hits = [shelf.best(t, np.frombuffer(c.as_py(), np.int32), rerank) for t, c in zip(tables, part.column(5), strict=True)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat(part.column(3).to_numpy(), [len(v) for v, _ in hits])),
                        pa.array(np.concatenate([v for v, _ in hits])), pa.array(np.concatenate([s for _, s in hits])),
                    ], ["tw_q", "tw_v", "near"])

    both = stored.unionByName(looking).repartition("shard", "part").sortWithinPartitions("shard", "part", "kind")
    near = both.select("shard", "part", "kind", "number", "body", "cells", "cell", "norm").mapInArrow(score, "tw_q long, tw_v long, near float")
    closest = Window.partitionBy("tw_q").orderBy(F.desc("near"), "tw_v")
    near = near.withColumn("tw_n", F.row_number().over(closest)).where(F.col("tw_n") <= rerank).select("tw_q", "tw_v")
    near = materialise(near, "near")
    for used in (sent, map_of_cells):  # what was made of them is written
        used.destroy()

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_matrix(batch.column(i), dim) for i in (3, 4))
            # scaled by powers of two, so that squares neither overflow nor vanish and nothing is rounded
            x, y = (v / np.exp2(np.frexp(np.abs(v).max(axis=1, keepdims=True))[1]) for v in (x, y))
            s = np.einsum("nd,nd->n", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(s)], ["tw_q", "tw_ids", "same", "score"])

    pairs = near.join(each, "tw_v").join(wanted.select("tw_q", F.col("tw_vec").alias("tw_asked"), F.col("tw_a").alias("qa"), F.col("tw_b").alias("qb")), "tw_q")
    pairs = pairs.select("tw_q", "tw_ids", ((F.col("tw_a") == F.col("qa")) & (F.col("tw_b") == F.col("qb"))).alias("same"), "tw_vec", "tw_asked")
    scored = pairs.mapInArrow(exact, "tw_q long, tw_ids array<long>, same boolean, score double")
    ranks = Window.partitionBy("tw_q").orderBy(F.desc("score"), "vec_id")
    top = scored.select("tw_q", "same", "score", F.explode("tw_ids").alias("vec_id")).withColumn("n", F.row_number().over(ranks)).where(F.col("n") <= k + 1)
    top = top.groupBy("tw_q").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score", "same"))).alias("top"))
    keys = materialise(wanted.select("tw_q", "tw_a", "tw_b").join(top, "tw_q"), "top")
    # every row that asked gets its vector's list, without one row of its own id and vector; a vector's rows may be many
    out = asked.select("tw_id", F.struct("tw_a", "tw_b").alias("tw_key"))
    out = lookup(out, keys.select(F.struct("tw_a", "tw_b").alias("tw_key"), "top"), "tw_key")
    if own:
        mine = F.array_min(F.transform(F.filter("top", lambda t: t["same"] & (t["vec_id"] == F.col("tw_id"))), lambda t: t["n"]))
        out = out.withColumn("top", F.filter("top", lambda t: mine.isNull() | (t["n"] != mine)))
    out = out.select("tw_id", F.posexplode(F.slice("top", 1, k)).alias("place", "t"))
    return out.select(F.col("tw_id").alias("query_id"), (F.col("place") + 1).alias("rank"), "t.vec_id", "t.score")


class _Shelf:
    """The codes of one shard, sorted by cell."""

    def __init__(self):
        self.mark, self.parts, self.ready = None, [], False

    def turn_to(self, mark: tuple) -> None:
        if mark != self.mark:
            self.mark, self.parts, self.ready = mark, [], False

    def add(self, b: pa.RecordBatch) -> None:
        codes = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint8).reshape(b.num_rows, -1)
        self.parts.append((b.column(6).to_numpy(), b.column(3).to_numpy(), codes, b.column(7).to_numpy()))
        self.ready = False

    def best(self, table: np.ndarray, cells: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the ``keep`` best codes in ``cells``."""
        if not self.ready and self.parts:
            cell, numbers, codes, norms = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            order = np.lexsort((numbers, cell))
            self.cell, self.numbers, self.norms = cell[order], numbers[order], np.maximum(norms[order], 1e-12)
            self.codes = codes[order]
            self.steps = np.arange(codes.shape[1]) * ENTRIES
            self.parts, self.ready = [(self.cell, self.numbers, self.codes, self.norms)], True
        if not self.ready:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        low, high = np.searchsorted(self.cell, cells, "left"), np.searchsorted(self.cell, cells, "right")
        at = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)])
        scores = np.concatenate([
            table[self.codes[at[i:i + 16384]] + self.steps].sum(axis=1) for i in range(0, max(len(at), 1), 16384)]) / self.norms[at]
        top = _top(scores, self.numbers[at], keep)
        return self.numbers[at][top], scores[top].astype(np.float32)
