"""Jaccard join and decontamination against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywell.llm import common, partenum, winnowing

WORDS = [f"w{i}" for i in range(400)] + ["Été", "日本", "x" * 300]


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 4]) for i in range(len(w) - 3)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = root(i)
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    return sorted(((doc, len(sets[i]), least.get(root(i))) for i, (doc, _) in enumerate(rows)), key=repr)


def near_copies(rng, base, n, most):
    out = []
    for _ in range(n):
        w = base.split(" ")
        for _ in range(rng.randrange(most + 1)):
            i = rng.randrange(len(w))
            w[i:i + rng.randrange(2)] = [rng.choice(WORDS)] * rng.randrange(2)
        out.append(" ".join(w))
    return out


def test_components_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "one", "One", "one two three", "a b c d", "A B\x0bC  d", "é b c d", "É b c d"]
    for size in (6, 8, 12, 30, 60, 120, 400):
        base = text_of(rng, size)
        texts += [base, base, base.upper()] + near_copies(rng, base, 25, max(2, size // 20))
    texts += near_copies(rng, text_of(rng, 150), 60, 12)
    rows = [(None if i % 17 == 0 else 1000 - i // 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, cls int, sig string")
    got = partenum.jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    assert partenum.jaccard_components(df.limit(0)).count() == 0


def test_signatures_lose_no_pair():
    rng = np.random.default_rng(0)
    for n in [*range(6, 40), 64, 100, 250, 700]:
        for _ in range(20 if n < 100 else 5):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            cut, new = rng.integers(0, 2 + n // 6), rng.integers(0, 2 + n // 6)
            b = np.unique(np.concatenate([rng.permutation(a)[cut:], rng.integers(0, 2**64, new, dtype=np.uint64)]))
            if partenum.similar(a, b):
                assert partenum.maybe_similar(partenum.parity_bits(a), len(a), partenum.parity_bits(b), len(b))
                if len(a) != len(b) or (a != b).any():
                    assert len(np.intersect1d(partenum.signatures(a), partenum.signatures(b)))


@pytest.mark.parametrize("dense", [4, 0])
def test_blocks_of_a_large_bucket(spark, monkeypatch, dense):
    monkeypatch.setattr(partenum, "BLOCK", 3)
    monkeypatch.setattr(partenum, "DENSE", dense)
    rng = random.Random(8)
    rows = list(enumerate(near_copies(rng, text_of(rng, 80), 60, 9)))
    got = partenum.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(200, 201), (5, 5)]
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 120)} | {200: 200, 201: 200}
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("limit", [100, 0])
def test_lookup_either_way(spark, limit):
    big = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    small = spark.createDataFrame([(1, "x")], "k int, w string")
    assert sorted(r["v"] for r in common.lookup(big, small, "k", limit=limit).collect()) == ["a", "b"]
    assert sorted((r["v"], r["w"]) for r in common.lookup(big, small, "k", "left", limit=limit).collect() if r["w"]) == [("a", "x"), ("b", "x")]
    assert common.lookup(big, small, "k", "left", limit=limit).count() == 4


def test_fingerprints_are_thinned(spark):
    """Each run's windows share its fingerprint, runs tile all windows, and are few."""
    rng = random.Random(9)
    texts = ["", "a b c", "a " * 13, "a " * 40, text_of(rng, 13), text_of(rng, 400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(winnowing.words_of(F.col("t")).alias("w"))
    for r in df.select(winnowing.fingerprints(F.col("w")).alias("m"), winnowing.runs(F.col("w")).alias("r"), F.size("w").alias("n")).collect():
        assert [p for x in r["r"] for p in [x["print"]] * (x["upto"] - x["at"] + 1)] == r["m"] and len(r["m"]) == max(r["n"] - 12, 0)
        assert [i for x in r["r"] for i in range(x["at"], x["upto"] + 1)] == list(range(1, len(r["m"]) + 1))
    assert len(r["r"]) < len(r["m"]) / 3


def words(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_contamination(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if w and item is not None else ():
            windows.setdefault(tuple(w[i:i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i:i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        out.append((doc, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [10**6, 7])
def test_contamination_equals_brute_force(spark, rows):
    rng = random.Random(4)
    items = [(i, text_of(rng, rng.choice([14, 20, 50, 90]))) for i in range(12)] + [(50, items_text := text_of(rng, 30)), (51, items_text), (51, items_text)]
    items += [(20, "w1"), (21, "W1 w2"), (22, "w3, w4; w5"), (23, text_of(rng, 12)), (24, text_of(rng, 13)), (25, None), (26, "..."), (None, text_of(rng, 40)), (27, "Été")]
    docs = [(None, None), (0, ""), (0, "w1"), (1, "!!"), (1, "w1 w1 w2 w3 w4 w5")]
    for i in range(120):
        parts = [text_of(rng, rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(w) + 1)
            parts += [" - ".join(w[a:a + rng.randrange(10, 40)]).upper().lower(), text_of(rng, rng.randrange(40))]
        docs.append((None if i % 11 == 0 else i // 2, " ".join(parts)))
    docs.append(docs[-1])
    d = spark.createDataFrame([(*r, 1, "c") for r in docs], "doc_id long, text string, item_id int, tw_text string")
    b = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, doc_id int")
    got = winnowing.decontaminate(d, b, fingerprint_rows=rows).collect()
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) for r in got]
    assert sorted(got, key=repr) == brute_contamination(docs, items)
    if rows == 7:
        got = winnowing.decontaminate(d, b, broadcast_rows=0).collect()
        got = [(r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) for r in got]
        assert sorted(got, key=repr) == brute_contamination(docs, items)
    assert winnowing.decontaminate(d.limit(0), b).count() == 0
    assert winnowing.decontaminate(d, b.limit(0)).where("n_hit > 0 or contaminated").count() == 0


def test_batches_are_bounded_unless_set(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        common.bound_batches(spark)
        assert spark.conf.get(key) == common.ARROW_BATCH[key][1]
        spark.conf.set(key, "77")
        common.bound_batches(spark)
        assert spark.conf.get(key) == "77"
    finally:
        spark.conf.set(key, before)
