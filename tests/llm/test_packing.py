import random

import numpy as np
import pytest

from tallywell.llm import packing


def check(rows, docs, size):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted([[*t.encode(text or "", add_special_tokens=False).ids, 0] for _, text in docs])
    by_doc, by_seq = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        by_doc.setdefault(r["doc_id"], []).append((r["start"], ids, r["doc_tokens"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], len(ids)))
    for pieces in by_seq.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= size
    lengths = [sum(n for _, n in p) for p in by_seq.values()]
    assert all(n == size or n & (n - 1) == 0 for n in lengths)  # nothing is padded
    got = []
    for pieces in by_doc.values():
        for start, ids, total in sorted(pieces, key=lambda p: p[0]):
            if start == 0:
                got.append([])
            assert start == len(got[-1])
            got[-1] += ids
            assert len(got[-1]) <= total
    assert sorted(got) == want


@pytest.mark.parametrize("size,windows,parts", [(1024, 32, 3), (16, 2, 5), (7, 1, 1)])
def test_pieces_tile_documents_and_sequences(spark, monkeypatch, size, windows, parts):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    rng = random.Random(2)
    texts = [None, "", "a", "<|endoftext|> x", "é" * 500, "word " * 3000, " " * 4000, "\u0000\n\n"] + [
        " ".join(rng.choice(["the", "token", "日本", "x1"]) for _ in range(rng.randrange(200))) for _ in range(60)]
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(*d, 9) for d in docs], "doc_id long, text string, ids int").repartition(parts, "doc_id")
    rows = packing.pack_documents(df, size=size, windows=windows).collect()
    if size & (size - 1) == 0:
        check(rows, docs, size)
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_ids_of_other_types_and_nulls(spark):
    df = spark.createDataFrame([("a", "x"), (None, "y"), ("a", "x")], "doc_id string, text string")
    assert sorted((r["doc_id"] or "", r["doc_tokens"]) for r in packing.pack_documents(df).collect()) == [("", 2), ("a", 2), ("a", 2)]


def test_encoder_equals_tokenizers(spark, small):
    from tokenizers import Tokenizer
    import public_tokenizers

    t, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder()
    texts = [r[0] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    for text in [*texts, "a" * 5000, "\u200b \t\r\n x", "1" * 999, "I'll we'Ve  ", "<|endoftext|><|endoftext|>", "\U0001f468\u200d\U0001f469 ﷽"]:
        assert encode(text) == t.encode(text, add_special_tokens=False).ids


def test_best_fit_and_fullest():
    p = packing.Packer(10, 2)
    ids = lambda n: np.arange(n, dtype=np.uint32)
    p.add("a", 0, ids(7), 7)  # room 3
    p.add("b", 0, ids(4), 4)  # room 6
    p.add("c", 0, ids(3), 3)  # best fit: beside a
    assert [[x[0] for x in s] for s in p.done] == [["a", "c"]]
    p.add("d", 0, ids(5), 5)  # beside b, room 1
    p.add("e", 0, ids(4), 4)  # its own window
    p.add("f", 0, ids(8), 8)  # fits nowhere: tops up the fullest, the rest opens a window
    assert [[(x[0], x[1], len(x[2])) for x in s] for s in p.done][1:] == [[("b", 0, 4), ("d", 0, 5), ("f", 0, 1)]]
    assert [[len(x[2]) for x in s] for s in packing.powers_of_two([("x", 0, ids(9), 9), ("y", 0, ids(4), 4)])] == [[8], [1, 3], [1]]
