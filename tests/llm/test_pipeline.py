"""The pipeline on a small corpus, against brute force of its stages."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from test_joins import brute_contamination, shingle_set
from test_spans import SECRETS

EN, DE = "the and that with from have this which river stone window".split(), "der und nicht mit auch sich wird über straße fenster haus".split()


def corpus(rng):
    def prose(words, n):
        return " ".join(rng.choice(words) + rng.choice(["", "er", "ing", "en"]) for _ in range(n))

    items = [(i, prose(EN, 40)) for i in range(4)]
    docs = [(i, prose(EN if i % 2 else DE, 80), "en" if i % 2 else "de", f"s{i % 3}") for i in range(60)]
    docs += [(100 + i, docs[i][1], docs[i][2], "s9") for i in range(10)]  # copies
    docs += [(200 + i, docs[i][1] + " more", docs[i][2], "s9") for i in range(10)]  # near copies
    docs += [(300 + i, prose(EN, 10) + " " + items[i][1] + " " + prose(EN, 30), "en", "s1") for i in range(4)]  # contaminated
    docs += [(400, prose(EN, 30) + " password=abcdefghijkl0 " + prose(EN, 30), "en", None), (401, prose(DE, 40) + " AKIA" + "Q" * 16, "de", "s2")]
    docs += [(500, None, "en", "s1"), (501, "", "en", "s1"), (502, "123 456", None, "s1"), (503, prose(EN, 70), None, "s1"), (None, prose(DE, 75), "de", "s1"), (None, docs[3][1], "en", "s1"), (7, docs[7][1], "en", "s0")]
    docs += [(5, prose(EN, 66), "en", "s7"), (5, prose(DE, 55), "de", "s8")]  # other texts under a known id
    twin = prose(EN, 64)
    docs += [(None, twin, "en", "s1")] * 3 + [(None, prose(DE, 61), "de", "s1")] * 2 + [(6, docs[6][1], "de", "s0")]  # groups of null ids alone; repeated rows
    return [(*d, len(d[1]) if d[1] is not None else None, "x", 0.5, "zz", 7) for d in docs], items


def one_of_each(pairs):
    """One (id, text) of each group of near-duplicates: the least id, null ids last."""
    sets, group = [shingle_set(t) for _, t in pairs], list(range(len(pairs)))
    for i in range(len(pairs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    best = {}
    for g, p in zip(group, pairs, strict=True):
        best.setdefault(g, []).append(p)
    return sorted((min(ps, key=lambda p: (p[0] is None, p[0] or 0)) for ps in best.values()), key=repr)


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    docs, items = corpus(random.Random(6))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, text_hash string, score double, lang_pred string, component int").write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d), docs, items


def rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_stages(spark, data):
    folder, docs, items = data
    df = spark.read.parquet(f"{folder}/documents.parquet")
    first = P.keep_known_languages(spark, df, folder)
    assert first.columns == df.columns
    kept = [d for d in docs if d[1] and re.search(r"[^\W\d_]", d[1])]
    assert rows(first) == sorted(((d[0], d[1]) for d in kept), key=repr)
    assert first.where("lang is null").count() == 0

    second = P.keep_one_of_each_group(spark, first, folder)
    pairs = [(d[0], d[1]) for d in kept]
    want = one_of_each(pairs)
    assert len([p for p in want if p[0] == 5]) == 3 and len([p for p in want if p[0] is None]) == 3
    assert rows(second) == want

    third = P.drop_contaminated(spark, second, folder)
    verdicts = brute_contamination(want, items)
    bad = {i for i, _, _, _, contaminated in verdicts if contaminated}
    assert bad == {300, 301, 302, 303} and rows(third) == [x for x in want if x[0] not in bad]

    fourth = P.mask_secrets(spark, third, folder)
    assert fourth.columns == df.columns and fourth.count() == third.count()
    assert not any(ok(m) for _, t in rows(fourth) for _, p, ok in SECRETS for m in p.finditer(t))
    clean = {t for _, t in rows(third)} & {t for _, t in rows(fourth)}
    assert len(clean) == third.count() - 2
    assert fourth.where(F.length("text") != F.col("n_chars")).count() == 0


def test_run(spark, data):
    import public_tokenizers
    from tokenizers import Tokenizer

    folder, _, _ = data
    out = P.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, got = {}, {}
    for r in docs.collect():
        want.setdefault(r["doc_id"], []).append([*t.encode(r["text"], add_special_tokens=False).ids, 0])
    for r in sorted(out, key=lambda r: r["start"]):
        got.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert got.keys() == want.keys()
    for i, texts in want.items():  # pieces of several rows of one id can't be told apart here
        assert got[i] == texts[0] if len(texts) == 1 else sorted(got[i]) == sorted(sum(texts, []))


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in P.STAGES] == ["language_id", "jaccard_join", "decontamination", "secret_scan", "packing"]


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
