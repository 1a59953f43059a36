"""Language ID by held-out accuracy, nearest neighbours by recall."""

import collections
import os
import random
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywell.llm import langid, quantise


def test_held_out_accuracy(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    out = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97


def test_edges(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(None, "the and with", None), (-1, None, "en"), (-2, "", "en"), (-3, "123 !?", "en"), (-4, "x" * 3_000_000, None), (-5, "é", "fr"), (-5, "é", "fr")]
    df = d.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    out = [r for r in langid.identify(df.selectExpr("*", "'x' as score", "1 as held_out")).collect() if r["doc_id"] is None or r["doc_id"] < 0]
    assert sorted((r["doc_id"], r["lang_pred"]) for r in out if r["doc_id"] in (-1, -2, -3)) == [(-3, "und"), (-2, "und"), (-1, "und")]
    assert len(out) == 7 and all(r["lang_pred"] != "und" for r in out if r["doc_id"] in (-4, -5))
    assert langid.identify(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


def grams_in(text):
    """The byte 4-grams of a text: a run of other characters than letters is one boundary, and stands at a gram's end only."""
    c = bytearray(b"\0")
    for x in text.encode() + b" ":
        x = ord(chr(x).lower()) if chr(x) in string.ascii_letters else x if x >= 128 else 0
        if x or c[-1]:
            c.append(x)
    return [bytes(c[i:i + 4]) for i in range(len(c) - 3) if 0 not in c[i + 1:i + 3]]


def sets_model(rows):
    """Per language the grams that its filter should hold: no hashes, no bits."""
    counts = {}
    for lang, text in rows:
        counts.setdefault(lang, collections.Counter()).update(grams_in(text))
    rates = {k: {g: n / c.total() for g, n in c.items()} for k, c in counts.items() if c}
    most = collections.defaultdict(float)
    for r in rates.values():
        for g, x in r.items():
            most[g] = max(most[g], x)
    return {k: set(sorted((g for g in r if r[g] >= langid.RELATIVE * most[g]), key=lambda g: (-r[g], g))[:langid.GRAMS]) for k, r in rates.items()}


def test_filters_equal_sets(spark, small):
    """Bloom filters lose no gram of brute-force sets, and decide as those do."""
    docs = [r for r in spark.read.parquet(f"{small}/documents.parquet").collect() if r["text"] is not None]
    rows = [(r["lang"], r["text"]) for r in docs if r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    sets = sets_model(rows)
    df = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.train(df.where(~langid.held_out("doc_id")))
    assert model.langs == sorted(sets)
    for b, lang in enumerate(model.langs):
        g = np.array([int.from_bytes(x) for x in sets[lang]], np.uint32)
        assert all(((model.slots[0][s] >> np.uint64(b)) & np.uint64(1)).all() for s in langid.slots_of(g))
    pred = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df).collect()}
    same = close = 0
    for r in docs:
        found = grams_in(r["text"])
        hits = sorted(((sum(g in s for g in found), k) for k, s in sets.items()), reverse=True)
        if found and hits[0][0] > hits[1][0] + 0.02 * len(found):
            same, close = same + (pred[r["doc_id"]] == hits[0][1]), close + 1
    assert close > 100 and same == close


def test_any_number_of_languages(spark):
    """65 languages give 65 filters over two words; all are found again."""
    rng = random.Random(7)
    own = {f"l{i:02d}": ["".join(rng.choice(string.ascii_lowercase) for _ in range(6)) for _ in range(12)] for i in range(65)}
    rows = [(n * 100 + i, " ".join(rng.choice(words) for _ in range(30)), lang) for n, (lang, words) in enumerate(own.items()) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    assert model.langs == sorted(own) and model.slots.shape == (2, langid.SLOTS)
    out = langid.predict(df, model, names=("tw_lang", "tw_score")).collect()
    assert all(r["tw_lang"] == r["lang"] for r in out)


def test_texts_are_read_once_in_training(spark, tmp_path):
    """The number of passes over texts doesn't depend on the number of languages."""
    reads = []
    for n in (2, 12):
        rows = [(i, f"word{i % n} other{i % n} third{i % n}" * 3, f"l{i % n}") for i in range(120)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        seen = spark.sparkContext.accumulator(0)

        def note(x, seen=seen):
            seen.add(1)
            return x

        counted = df.rdd.map(lambda r, note=note: (r[0], note(r[1]), r[2])).toDF("doc_id long, text string, lang string")
        langid.train(counted)
        reads.append(seen.value / len(rows))
    assert reads[0] == reads[1] <= 2


def test_batches_don_t_matter():
    import pyarrow as pa

    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "und", "que", "été", "1"]) for _ in range(rng.randrange(50))) for _ in range(40)]
    grams = np.unique(np.concatenate([langid.grams_of(d)[0] for d, _, _ in langid.blocks_of(pa.array(texts[:20]))]))
    slots = np.zeros((1, langid.SLOTS), np.uint64)
    for s in langid.slots_of(grams):
        slots[0, s] = 1
    m = langid.Model(["x"], slots, np.array([0.01]))
    whole = m.count(pa.array(texts))
    each = [m.count(pa.array([t])) for t in texts]
    assert whole[0].tolist() == [e[0][0] for e in each] and whole[1].tolist() == [e[1][0].tolist() for e in each]


def brute(rows, queries, k):
    out = []
    for q in sorted(queries):
        s = sorted((-float(np.dot(rows[q], v) / (np.linalg.norm(rows[q]) * np.linalg.norm(v))), i) for i, v in rows.items() if i != q)
        out += [(q, r, i, -c) for r, (c, i) in enumerate(s[:k], 1)]
    return out


def test_recall_and_exact_scores(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    got = [tuple(r) for r in quantise.search(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    want = brute(rows, [i for i in rows if i % 50 == 0], 5)
    assert len(got) == len(want)
    assert len({(g[0], g[2]) for g in got} & {(w[0], w[2]) for w in want}) / len(want) >= 0.9
    exact = {(q, i): s for q, _, i, s in brute(rows, [i for i in rows if i % 50 == 0], len(rows))}
    assert all(abs(g[3] - exact[g[0], g[2]]) < 1e-12 for g in got)


def test_vectors_that_cannot_be_compared(spark):
    nan, inf = float("nan"), float("inf")
    vecs = [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0], None, [nan, 1.0], [inf, 1.0], [None, 1.0], [], [1.0, 2.0, 3.0], [2.0, 0.0], [-1.0, 0.0], [1e300, 1e300], [1e-300, 0.0]]
    rows = [(i, v, 1) for i, v in enumerate(vecs)] + [(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in quantise.search(df, df.where("vec_id in (0, 3, 12)"), k=4).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 10, 1.0), (0, 4, 13, 1.0),
                   (12, 1, 0, round(0.5**0.5, 9)), (12, 2, 1, round(0.5**0.5, 9)), (12, 3, 1, round(0.5**0.5, 9)), (12, 4, 2, round(0.5**0.5, 9))]
    few = df.where("vec_id in (0, 2)")
    assert quantise.search(few, few).count() == 2
    assert quantise.search(df.limit(0), df).count() == 0 and quantise.search(df, df.limit(0)).count() == 0


def brute_rows(rows, k):
    """Every row but the query's own is a candidate, whatever its id; lengths are kept apart."""
    out = []
    for a, (q, x) in enumerate(rows):
        if q % 50 == 0:
            x = np.array(x)
            s = sorted((-round(float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y))), 9), i) for b, (i, y) in enumerate(rows) if b != a and len(y) == len(x) for y in [np.array(y)])
            out += [(q, r, i, -c) for r, (c, i) in enumerate(s[:k], 1)]
    return sorted(out)


def test_every_row_is_a_candidate(spark):
    """Copies, repeated ids with other vectors, repeated rows and two lengths, against brute force."""
    rng = random.Random(3)
    spot = lambda n: [rng.gauss(0, 1) for _ in range(n)]
    hot, cold = spot(6), spot(3)
    rows = [(i, spot(6)) for i in range(1, 160)] + [(1000 + i, hot) for i in range(300)] + [(3000 + i, cold) for i in range(4)] + [(50, hot), (50, hot), (50, spot(6)), (5000, spot(3)), (7, hot)]
    rows += [(5100, [2 * v for v in hot])] * 40
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = quantise.search(df, df.where("vec_id % 50 = 0"), k=5, probes=4).collect()
    want = brute_rows(rows, 5)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got)
    counts = lambda xs: collections.Counter((q, r) for q, r, *_ in xs)
    assert counts(got) == counts(want)
    both = sum((collections.Counter((g[0], g[2]) for g in got) & collections.Counter((w[0], w[2]) for w in want)).values())
    assert both / len(want) >= 0.9
    hot_rows = [x for x in want if x[0] >= 1000 and x[0] < 1300]
    assert [g for g in got if 1000 <= g[0] < 1300] == hot_rows  # 300 copies: the five least ids but one's own


@pytest.mark.parametrize("n", [60_000] + [200_000, 1_000_000] * bool(os.environ.get("TALLYWELL_LARGE")))
def test_recall_of_many_spread_vectors(spark, tmp_path, n):
    """Vectors without any clusters, which cells can't tell apart; the larger tables only where TALLYWELL_LARGE is set (README has their figures)."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    x = np.random.default_rng(6).normal(size=(n, 64)).astype(np.float32)
    for k in range(8):
        own = x[k::8]
        pq.write_table(pa.table({"vec_id": np.arange(k, n, 8), "embedding": pa.FixedSizeListArray.from_arrays(own.ravel(), 64).cast(pa.list_(pa.float32()))}), tmp_path / f"{k}.parquet")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = np.arange(0, n, n // 200)[:200]
    scores = unit[asked] @ unit.T
    scores[np.arange(200), asked] = -2
    want = np.argpartition(-scores, 4, axis=1)[:, :5]
    df, efforts = spark.read.parquet(str(tmp_path)), []
    got = {(r["query_id"], r["vec_id"]) for r in quantise.search(df, df.where(F.col("vec_id").isin(asked.tolist())), efforts=efforts).collect()}
    recall = sum((int(q), int(v)) in got for q, vs in zip(asked, want, strict=True) for v in vs) / 1000
    print(f"{n} vectors: recall {recall}, {efforts}")
    assert recall >= 0.9 and len(got) == 1000


def test_small_shards_change_nothing(spark, small, monkeypatch):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    one = sorted(map(tuple, quantise.search(df, df.where("vec_id % 50 = 0")).collect()))
    monkeypatch.setattr(quantise, "SHARD_QUERIES", 2)
    monkeypatch.setattr(quantise.deal, "__defaults__", (40,))
    assert sorted(map(tuple, quantise.search(df, df.where("vec_id % 50 = 0")).collect())) == one


def test_deal():
    first, many = quantise.deal([3, 4, 30, 1, 9, 2], rows=10)
    assert first.tolist() == [0, 0, 1, 4, 4, 5] and many.tolist() == [1, 1, 3, 1, 1, 1]


def test_beam_search_is_no_worse_than_greedy():
    x = np.random.default_rng(0).normal(size=(300, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    books = quantise.fit(x, books=4, entries=32)

    def error(beam):
        codes, _ = books.encode(x, beam)
        return sum(((x - sum(books.entries[m][codes[:, m]] for m in range(4))) ** 2).sum(1))

    assert error(8) <= error(1)
