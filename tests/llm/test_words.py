"""Pieces, spelling variants and periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywell.llm import periodic, pieces, queries, spelling

TEXTS = [None, "", " ", "a", "  a  b\tﬁ ", "▁▁x ▁", "\0a\0", "日本語テキスト 混ぜ", "<0x41></s><s><unk>", "\U0001f468‍\U0001f469 ﷽ \n\n\n", " " * 5000, "a" * 5000, "�é", "word " * 3000]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces()


def made_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(" ▁ab\nthe日éß1́😀\x00\x1c\xa0") for _ in range(rng.randrange(60))) for _ in range(n)]


def test_ids_equal_the_library(vocabulary, spark, small):
    texts = [t or "" for t in TEXTS] + made_texts(2000, 1) + [r[0] or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    ids, agrees = vocabulary.encode(texts)
    assert ids == vocabulary.by_library(texts) and all(agrees)
    assert vocabulary.encode([]) == ([], [])


def test_heap_and_arrays_are_one_agenda(vocabulary):
    rng = random.Random(2)
    words = list({"▁" + "".join(rng.choice("aeiounrstldgh1é日") for _ in range(rng.randrange(1, 30))) for _ in range(500)} | {"▁" * n for n in range(1, 40)})
    for word, row in zip(words, vocabulary.agenda.many(words), strict=True):
        assert [vocabulary.agenda.symbol(k) for k in row if k >= 0] == vocabulary.agenda.one(word)


def crafted(tmp_path, bytes_too):
    """A small vocabulary with ties, written down and not trained."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 2, bytes_too
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces = "identity", True, False
    kinds = proto.ModelProto.SentencePiece
    rows = [("<unk>", 0, kinds.UNKNOWN), ("<s>", 0, kinds.CONTROL), ("</s>", 0, kinds.CONTROL)]
    rows += [(f"<0x{b:02X}>", 0, kinds.BYTE) for b in range(256)] * bytes_too
    rows += [(p, s, kinds.NORMAL) for p, s in (("ab", -1), ("ba", -1), ("aa", -1), ("▁a", -2), ("aba", -3), ("abab", -3), ("b▁", -2.5 if not bytes_too else -9), ("▁", -9), ("a", -9), ("b", -9))]
    for piece, score, kind in rows:
        m.pieces.add(piece=piece, score=score, type=kind)
    path = tmp_path / f"m{bytes_too}.model"
    path.write_bytes(m.SerializeToString())
    return str(path)


@pytest.mark.parametrize("bytes_too", [True, False])
def test_ties_unknown_characters_and_pieces_over_blanks(tmp_path, bytes_too):
    v = pieces.Pieces(crafted(tmp_path, bytes_too))
    rng = random.Random(3)
    texts = ["".join(rng.choice("aaabbb c日") for _ in range(rng.randrange(20))) for _ in range(2000)]
    assert v.encode(texts)[0] == v.by_library(texts)


def test_encode_and_decode_rows(spark, vocabulary):
    rows = [(k, t, "x", 1) for k, t in enumerate(TEXTS)] + [(None, "null id", "x", 1), (1, "again", "y", 2), (1, "again", "y", 2)]
    df = spark.createDataFrame(rows, "doc_id int, text string, tw_id string, ids int")
    out = pieces.encode_texts(df)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, np.frombuffer(r["ids"], "<u4").tolist(), r["n_tokens"], r["decoded"], r["agrees"]) for r in out.collect())
    want = []
    for i, t, *_ in rows:
        ids = vocabulary.by_library([t or ""])[0]
        want.append((i if i is not None else -1, ids, len(ids), vocabulary.library.decode(ids), True))
    assert got == sorted(want)
    back = pieces.decode_ids(out).collect()
    assert sorted(r["text"] for r in back) == sorted(w[3] for w in want)
    assert pieces.encode_texts(df.limit(0)).count() == 0 and pieces.decode_ids(spark.createDataFrame([(1, None)], "doc_id long, ids binary")).first()["text"] == ""


def test_query_of_pieces(spark, small, vocabulary):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    want = {}
    for r in docs:
        ids = vocabulary.by_library([r["text"] or ""])[0]
        want[r["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(vocabulary.library.decode(ids).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op11_sentencepiece(spark, small).collect()}
    assert got == want


def brute_words(rows):
    counts: dict[str, int] = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute_forms(counts):
    """By all deletions of a word: two words one edit apart share one, or one is the other's."""
    shelves: dict[str, set] = {}
    for w in counts:
        for v in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            shelves.setdefault(v, set()).add(w)
    near: dict[str, set] = {w: set() for w in counts}
    for own in shelves.values():
        for a in own:
            near[a] |= {b for b in own if b != a and apart(a, b)}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda b: (-counts[b], b), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] is not None else None) for w, n in counts.items()}


def apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def found_forms(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_query_of_spelling(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = brute_forms(brute_words(docs))
    got = queries.op12_spelling_variants(spark, small).collect()
    assert len(got) == len(want) and {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == want
    assert any(v[1] != v[0] and v[0] is not None for v in want.values())  # chains of several links


@pytest.mark.parametrize("shard,few", [(1 << 20, 16), (40, 2), (200, 0)])
def test_spelling_by_dense_words_and_small_shards(spark, monkeypatch, shard, few):
    monkeypatch.setattr(spelling, "FEW", few)
    rng = random.Random(4)
    made = {"".join(rng.choice("abé") for _ in range(rng.randrange(5, 12))) for _ in range(700)} | {"stein" * 30, "stein" * 30 + "x", "Stein" * 30, "xstein" + "stein" * 29}
    counts = {w: rng.randrange(3, 60) for w in made}
    df = spark.createDataFrame([*counts.items()], "word string, n long").repartition(3)
    got = {r["word"]: (r["form"], r["n"], r["n_near"], r["form_n"]) for r in spelling.near_words(df, shard).collect()}
    assert got == {w: (f, n, k, m) for w, (f, _, n, k, m) in brute_forms(counts).items()}
    if few == 0:
        return
    assert spelling.one_edit("abc", "abcd") and spelling.one_edit("abc", "xbc") and not spelling.one_edit("abc", "abc") and not spelling.one_edit("abc", "cab")


def test_spelling_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "Straße STRASSE straße"), (3, "straße straße straße straße strase 12 strase,"), (3, "straße straße straße straße strase 12 strase,"), (4, "x" * 100_000 + " " + "x" * 100_000 + " " + "x" * 100_000)]
    df = spark.createDataFrame([(i, t, "w", 1, True) for i, t in rows], "doc_id long, text string, word string, n int, scanned boolean")
    want = brute_forms(brute_words(rows))
    assert found_forms(spelling.spelling_variants(df, change=spelling.slip)) == want and want["strase"][0] is not None
    assert spelling.spelling_variants(df.limit(0)).count() == 0


def test_chains_of_forms(spark):
    df = spark.createDataFrame([(f"w{k:02}", f"w{k + 1:02}" if k < 40 else None) for k in range(41)] + [("alone", None)], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling.follow(df).collect()} == {f"w{k:02}": "w40" for k in range(40)}


def brute_runs(words, least, times):
    """All runs by every period; a run's period is its smallest."""
    n, out = len(words), []
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least, times * p) and not any(all(words[x] == words[x + q] for x in range(i, j + p - q)) for q in range(1, p)):
                out.append((i, j - i + p, p))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_small_alphabets():
    rng = random.Random(5)
    for _ in range(400):
        docs = []
        for _ in range(rng.randrange(1, 6)):
            k = rng.randrange(1, 4)
            words = [rng.randrange(k) for _ in range(rng.randrange(60))]
            if rng.random() < 0.5:
                words = words[:20] + words[:rng.randrange(1, 8)] * rng.randrange(1, 9) + words[:5]
            docs.append(words)
        least, times = rng.choice([(24, 3), (4, 2), (6, 3), (1, 2), (9, 4)])
        got = periodic.find_runs(np.array([w for d in docs for w in d], np.int64), [len(d) for d in docs], least, times).tolist()
        assert got == [[k, *r] for k, d in enumerate(docs) for r in brute_runs(d, least, times)]


def brute_periodic(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    # periods beyond a third need no look; equal words at distance p are told by arrays
    codes = np.unique(np.array(words), return_inverse=True)[1] if words else np.zeros(0, int)
    runs = []
    for p in range(1, n // 3 + 1):
        same = np.r_[False, codes[p:] == codes[:-p], False]
        edges = np.flatnonzero(np.diff(same.astype(int)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a + p >= max(24, 3 * p) and not any((codes[a:b + p - q] == codes[a + q:b + p]).all() for q in range(1, p)):
                runs.append((a, b - a + p, p))
    runs.sort(key=lambda r: (r[0], r[2]))
    dropped = {i for a, m, p in runs for i in range(a + p, a + m)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{a},{m},{p}\n" for a, m, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_query_of_runs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, small).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()}
    assert got == {r["doc_id"]: brute_periodic(r["doc_id"], r["text"]) for r in docs}
    assert sum(v[0] > 0 for v in got.values()) > 10


def test_runs_of_odd_rows(spark):
    rows = [(None, "a " * 30), (2, None), (3, ""), (4, " \t\n"), (5, "x\x1cy\xa0z " * 40 + "é"), (11, "a b " * 20 + "c " * 30), (11, "a b " * 20 + "c " * 30), (7, "ab " * 200_000), (38, "one two three four five six seven")]
    df = spark.createDataFrame([(i, t, "r", 5) for i, t in rows], "doc_id long, text string, runs string, period int").repartition(2)
    got = sorted(tuple(str(x) for x in r) for r in periodic.periodic_runs(df, change=periodic.loop_ends).select("doc_id", F.size("runs").alias("k"), "top.start", "top.length", "top.period", "collapsed").collect())
    want = [("None", "1", "0", "30", "1", "a"), ("2", "0", *["None"] * 3, ""), ("3", "0", *["None"] * 3, ""), ("4", "0", *["None"] * 3, "")]
    assert set(want) <= set(got) and len(got) == len(rows)
    assert got.count(("11", "2", "40", "30", "1", "a b c")) == 2 and any(r[0] == "7" and r[1] == "1" for r in got)
    assert periodic.periodic_runs(df.limit(0)).count() == 0
    assert periodic.strongest([(0, 30, 9), (5, 31, 10), (7, 30, 9)]) == (0, 30, 9)
