"""Secret scans and personal data against Python's regular expressions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallywell.llm import privacy, secretscan
from tallywell.llm.spans import spans_text

ASSIGN = re.compile(r'''((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)''')
SECRETS = [
    ("assign", ASSIGN, lambda m: len(m[2]) >= 12), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


PRIVATE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(digits(m[0])) <= 15),
]


def brute(kinds, text):
    found = [(m.start(), o, m.end(), k) for o, (k, p, ok) in enumerate(kinds) for m in p.finditer(text or "") if ok(m)]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def random_texts(n=400):
    rng = random.Random(5)
    parts = ["password", "=", ": ", "secret", "Token", "api_key", "APIKEY", '"', "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "é", "😀", " ",
             "\n", "a.b@c.de", "x@y", "@", "1.2.3.4", "255.255.300.1", "4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1112", "1", "2 3", "--", "+1 (575) 555-9977",
             "+12", "+44.20.7946.0958", ".", "00", "9999999999999999999999", "_", "%", "z@z.z_z@z.z"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(n)]


EDGE = [None, "", "password=", "+" * 50, "1 " * 30_000, "a" * 100_000 + "@b.c", "1." * 20_000, "a.b@" * 20_000 + "c.d.e.f" * 5000, "secret: secret: abcdefghijklmnop", "é" * 70_000 + "AKIA" + "A" * 20]


@pytest.mark.parametrize("scan,kinds", [(secretscan.scan, SECRETS), (privacy.scan, PRIVATE)])
def test_base_spans_equal_brute_force(spark, scan, kinds):
    texts = EDGE + random_texts()
    rows = [(i // 2 if i % 7 else None, t, "s", "x", "y") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, spans string, base string")
    got = scan(df).select("doc_id", spans_text(F.col("base"))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(r[0], brute(kinds, r[1])) for r in rows], key=repr)
    shuffled = scan(df, broadcast_rows=0).select("doc_id", spans_text(F.col("base"))).collect()
    assert sorted(map(tuple, shuffled), key=repr) == sorted(map(tuple, got), key=repr)
    assert scan(df.limit(0)).count() == 0


def test_driver_rows(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    for scan, kinds in ((secretscan.scan, SECRETS), (privacy.scan, PRIVATE)):
        assert {r[0]: r[1] for r in scan(df).select("doc_id", spans_text(F.col("base"))).collect()} == {i: brute(kinds, t) for i, t in texts.items()}


def test_ownership_separates_examples_from_live(spark):
    copied, own = "AKIA" + "ABCDEFGHIJKLMN12", "AKIA" + "QWERTYUIOPASDF34"
    generic, shared = "Zx9Qw7Rt5Yp3Lk1Mn8Bv6Cd4", "Aq1Sw2De3Fr4Gt5Hy6Ju7Ki8"
    rows = [(i, f"see {copied} and {shared}", f"o{i}") for i in range(8)] + [(100, f"key {own} {generic}", "o1"), (101, f"again {own}", None)]
    out = {r["doc_id"]: r for r in secretscan.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert (out[0]["live"], out[0]["examples"]) == (0, 1) and [s["kind"] for s in out[0]["spans"]] == ["access"]
    assert (out[100]["live"], out[100]["examples"]) == (2, 0) and [s["kind"] for s in out[100]["spans"]] == ["access", "generic"]


def test_copying_flips_ownership(spark):
    """One owner's string looks live in any number of repositories; a third owner's copy makes it an example."""
    key = "Zx9Qw7Rt5Yp3Lk1Mn8Bv6Cd4"
    own = [(i, f"cfg {key}", f"o{i % 2}") for i in range(12)]
    few = [(i, f"cfg {key}", f"o{i}") for i in range(3)]

    def classes(rows, **more):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        return {(r["live"], r["examples"], len(r["spans"])) for r in secretscan.scan(df, **more).collect()}

    assert classes(own) == {(1, 0, 1)}
    assert classes([*own, (99, f"copy {key}", "o9")]) == {(0, 0, 0)}
    assert classes(few) == {(0, 0, 0)}  # neither: a generic string isn't reported
    aws = [(i, "AKIA" + "QWERTYUIOPASDF34", o) for i, _, o in own]
    assert classes(aws, broadcast_rows=0) == {(1, 0, 1)}
    assert classes([*aws, (99, aws[0][1], "o9")]) == {(0, 1, 1)}
    assert classes([(i, aws[0][1], o) for i, _, o in few]) == {(0, 0, 1)}


def test_redaction(spark):
    rows = [(1, "😀 password=abcdefghijkl0 token: 0123456789abcdef0123 end", "s", 1), (2, "clean", None, 2), (None, None, "s", 3), (1, "other text", "s", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, tw_row int")
    got = {r["tw_row"]: r["text"] for r in secretscan.redact(df).collect()}
    assert got == {1: "😀 [ASSIGN] [ASSIGN] end", 2: "clean", 3: None, 4: "other text"}


def test_disclosing_terms(spark):
    rng = random.Random(1)
    filler = lambda: " ".join(rng.choice(["alpha", "bravo", "charlie", "delta", "echo"]) for _ in range(8))
    rows = [(i, f"{filler()} Quillfeather wrote a.b@mail.example {filler()}") for i in range(4)]
    rows += [(100 + i, f"{filler()} nobody {filler()}") for i in range(400)] + [(900 + i, f"{filler()} x{i}@mail.example") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in privacy.scan(df).collect()}
    again = {r["doc_id"]: r for r in privacy.scan(df, broadcast_rows=0).collect()}
    assert {k: r["spans"] for k, r in out.items()} == {k: r["spans"] for k, r in again.items()}
    assert out[0]["weighed"] > 5 and out[100]["weighed"] == 0 and len(out[0]["removed"]) == 2
    for i, text in rows:
        terms = [text[s["start"]:s["end"]] for s in out[i]["spans"] if s["kind"] == "term"]
        assert terms == (["Quillfeather"] * (i < 4) + ["wrote"] * (i < 4)), (i, terms)
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitise(df).collect()}
    assert "Quillfeather" not in clean[0] and "[EMAIL]" in clean[0] and clean[100] == dict(rows)[100]


def test_terms_far_from_their_entity(spark):
    rng = random.Random(2)
    filler = lambda n=40: " ".join(rng.choice(["alpha", "bravo", "charlie", "delta", "echo"]) for _ in range(n))
    rows = [(i, f"Quill Xu {filler()} a.b@mail.example {filler()} Xu") for i in range(4)]
    rows += [(10 + i, f"{filler()}\n-- \nZoe wrote c.d@mail.example and her signature block never changes at all, at all") for i in range(4)]
    rows += [(100 + i, f"{filler()} and her signature block never changes at all") for i in range(600)]
    out = {r["doc_id"]: r for r in privacy.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        terms = [text[s["start"]:s["end"]] for s in out[i]["spans"] if s["kind"] == "term"]
        assert terms == (["Quill", "Xu", "Xu"] if i < 4 else ["Zoe", "wrote"] if i < 14 else []), (i, terms)
