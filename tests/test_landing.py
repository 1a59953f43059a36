"""Landing in byte ranges, and fingerprints."""

import csv
import hashlib
import io
import json
import random
import subprocess

import pytest

from tallywell.sources import files, landing, merkle


def made_csv(rng, n, breaks):
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(["id", "销售渠道", "备注"])
    for i in range(n):
        note = rng.choice(["渠道一", "x,y", "", "長い" * rng.randrange(9)]) + (rng.choice(["\n换行", "\r\n", ' 说"好"', ""]) if breaks else "")
        w.writerow([i, rng.choice("甲乙丙") * rng.randrange(1, 5), note])
    return out.getvalue()


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "gb18030"])
@pytest.mark.parametrize("breaks", [False, True])
def test_ranges_cut_neither_records_nor_characters(spark, tmp_path, encoding, breaks):
    text = made_csv(random.Random(1), 60, breaks)
    path = tmp_path / "o.csv"
    path.write_bytes(text.encode(encoding))
    want = list(csv.reader(io.StringIO(text, newline="")))
    for width in (17, 300):  # cuts characters of two to four bytes
        scanned = landing.scan(spark, str(path), width)
        assert scanned.regular and bool(scanned.breaks) == breaks and scanned.splittable != breaks
        assert scanned.cuts[0].start == 0 and [c.end for c in scanned.cuts[:-1]] == [c.start for c in scanned.cuts[1:]]
        out = str(tmp_path / f"w{width}")
        m = landing.land_ranges(spark, out, str(path), width)
        raw = b"".join((tmp_path / f"w{width}/raw" / p["name"]).read_bytes() for p in m["parts"])
        assert raw == path.read_bytes() and m["sha256"] == hashlib.sha256(raw).hexdigest() and m["encoding"] == ("utf-8-sig" if encoding == "utf-8" else encoding)
        got = []
        for k, p in enumerate(m["readable_parts"]):
            rows = list(csv.reader(io.StringIO((tmp_path / f"w{width}/readable" / p["name"]).read_bytes().decode(), newline="")))
            assert rows[0] == want[0]
            got += rows if k == 0 else rows[1:]
        assert got == want and len(m["parts"]) > 2
        assert landing.verify_parts(out, m) == []
        (tmp_path / f"w{width}/raw" / m["parts"][2]["name"]).write_bytes(b"x")
        assert landing.verify_parts(out, m) == ["raw/part-000002"]


def test_stray_quotes_make_one_part(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('id,note\n1,5" pipe\n2,"a\nb"\n3,c\n')
    scanned = landing.scan(spark, str(path), 5)
    assert not scanned.regular and len(scanned.cuts) == 1 and not scanned.splittable
    (tmp_path / "empty.csv").write_bytes(b"")
    assert landing.scan(spark, str(tmp_path / "empty.csv")).cuts == [landing.Cut(0, 0, 0)]


def test_landed_batches_are_read(spark, tmp_path, monkeypatch):
    text = made_csv(random.Random(2), 200, False)
    path = tmp_path / "o.csv"
    path.write_bytes(text.encode("gb18030"))
    want = [tuple(x or None for x in r) for r in csv.reader(io.StringIO(text))][1:]
    one = landing.land(str(tmp_path / "c"), "orders", str(path))
    several = landing.land(str(tmp_path / "c"), "orders", str(path), width=500)
    for m in (one, several):
        assert json.loads(files.read_bytes(f"{m['raw'].rpartition('/')[0]}/manifest.json"))["sha256"] == hashlib.sha256(path.read_bytes()).hexdigest()
        df = files.read_csv(spark, m["readable"], as_text=True)
        assert df.columns == ["id", "销售渠道", "备注"] and sorted(map(tuple, df.collect())) == sorted(want)
    assert len(several["parts"]) > 5 and one["encoding"] == several["encoding"] == "gb18030"
    monkeypatch.setattr(landing, "RANGE", 700)  # a large file that isn't landed
    assert sorted(map(tuple, files.read_csv(spark, str(path), as_text=True).collect())) == sorted(want)
    with pytest.raises(files.SourceError):
        landing.land(str(tmp_path / "c"), "../x", str(path))


def test_detection_looks_at_all_ranges(spark, tmp_path):
    path = tmp_path / "late.csv"
    path.write_bytes(b"id,name\n" + b"1,plain\n" * 40_000 + "2,渠道\n".encode("gb18030"))
    assert files.detect_encoding(str(path)).startswith("utf-8")  # its head alone
    assert landing.detect(spark, landing.scan(spark, str(path), 50_000)) == "gb18030"


def test_merkle_proofs():
    for n in (1, 2, 3, 5, 8, 13):
        d = [hashlib.sha256(bytes([i])).hexdigest() for i in range(n)]
        root = merkle.root_of(d)
        for k in range(n):
            steps = merkle.proof(d, k)
            assert merkle.proves(d[k], steps, root) and len(steps) <= 4
            assert not merkle.proves(hashlib.sha256(b"other").hexdigest(), steps, root)
        assert n < 2 or merkle.root_of(d[::-1]) != root


def test_trees_of_files_and_chunks(spark, tmp_path):
    for name, data in {"a/x.txt": b"1" * 1000, "a/y.txt": b"2", "z": b""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    before = merkle.tree(str(tmp_path), chunk=64)
    assert before["files"]["a/y.txt"] == hashlib.sha256(b"2").hexdigest() and merkle.tree(str(tmp_path), chunk=64) == before
    steps = merkle.prove_file(before, "a/x.txt")
    assert merkle.file_is_in("a/x.txt", before["files"]["a/x.txt"], steps, before["root"])
    assert not merkle.file_is_in("a/z.txt", before["files"]["a/x.txt"], steps, before["root"])
    (tmp_path / "a/x.txt").write_bytes(b"1" * 999 + b"3")  # one byte of the last chunk
    (tmp_path / "z").rename(tmp_path / "w")
    after = merkle.tree(str(tmp_path), chunk=64)
    assert merkle.changed(before, after) == {"a/x.txt": "changed", "w": "added", "z": "removed"} and after["root"] != before["root"]
    with pytest.raises(merkle.FingerprintError):
        merkle.tree(str(tmp_path), ["nowhere"])


def test_builds(spark, tmp_path):
    root = tmp_path / "src"
    (root / "core").mkdir(parents=True)
    (root / "core/m.py").write_text("x = 1\n")
    with pytest.raises(merkle.FingerprintError, match="lock"):
        merkle.build(str(root), ["core"], "lock.txt")
    (root / "lock.txt").write_text("a==1\n")
    with pytest.raises(merkle.FingerprintError, match="plugins"):
        merkle.build(str(root), ["core", "plugins"], "lock.txt")
    one = merkle.build(str(root), ["core"], "lock.txt")
    assert one["dirty"] == "unknown(no-git-repo)" and one["dependencies"] == hashlib.sha256(b"a==1\n").hexdigest()
    (root / ".git").mkdir()
    assert merkle.dirty(str(root)).startswith("unknown(git-exit")
    (root / ".git").rmdir()
    if subprocess.run(["git", "init", "-q", str(root)], capture_output=True).returncode == 0:
        assert merkle.dirty(str(root)) == "true"
    (root / "core/m.py").write_text("x = 2\n")
    two = merkle.build(str(root), ["core"], "lock.txt")
    assert two["build"] != one["build"] and two["dependencies"] == one["dependencies"] and merkle.changed(one, two) == {"core/m.py": "changed"}
    (root / "lock.txt").write_text("a==2\n")
    assert merkle.build(str(root), ["core"], "lock.txt")["build"] != two["build"]
