"""The gate's exit statuses, exported claims, and files copied by tasks."""

import json

import pytest

from tallywell.operators.metrics import parse_contract
from tallywell.plans import gate, governance
from tallywell.plans import pipelines as P
from tallywell.sources import files

RATE = parse_contract({"metric": "orders", "type": "count", "grain": "one order", "time_column": "created_at"})


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("gate")
    rows = "".join(f"O-{i},2026-08-2{i % 2},paid,10.5,false,c{i}\n" for i in range(6))
    (folder / "o.csv").write_text("order_id,created_at,order_status,amount,test_order,customer_id\n" + rows)
    root = str(folder / "commerce")
    done = P.run_commerce(spark, root, str(folder / "o.csv"), {"orders": RATE}, "orders", commit="c0")
    checked = P.claims_of_run(spark, root, done)
    assert gate.export_claims(checked, f"{folder}/claims.json") == 0
    return folder, root, done["run_id"], checked


def _gate(spark, run, narrative, claims="claims.json", run_id=None, **more):
    folder, root, own, _ = run
    (folder / "n.txt").write_text(narrative)
    return gate.gate_files(spark, root, run_id or own, f"{folder}/{claims}", f"{folder}/n.txt", **more)


def test_exit_statuses(spark, run):
    folder, root, own, checked = run
    key = f"orders#{checked['entries'][0]['period']}"
    assert _gate(spark, run, "there were 3.0 orders", citations=[key])[0] == 0
    assert _gate(spark, run, json.dumps({"narrative": "there were 3.0 orders", "citations": [key]}))[0] == 0
    assert _gate(spark, run, "there were 3.0 orders")[0] == 2
    assert _gate(spark, run, "there were 4.5 orders", citations=[key])[0] == 2
    assert _gate(spark, run, " ")[0] == 1 and _gate(spark, run, "x", claims="none.json")[0] == 1
    assert _gate(spark, run, "x", run_id="r-other")[0] == 3
    bad = checked | {"entries": [e | {"status": "FAIL"} for e in checked["entries"]], "summary": "MISMATCH"}
    assert gate.export_claims(bad, f"{folder}/bad.json") == 1
    assert _gate(spark, run, "x", claims="bad.json")[0] == 3


def test_command(spark, run, capsys):
    folder, root, own, _ = run
    (folder / "m.txt").write_text("no numbers here")
    assert gate.main(["--root", root, "--run", own, "--claims", f"{folder}/claims.json", "--narrative", f"{folder}/m.txt"]) == 0
    assert json.loads(capsys.readouterr().out)["status"] == "PASS"


def test_a_changed_snapshot_blocks(spark, run):
    folder, root, own, _ = run
    part = next((folder / "commerce" / "snapshots").rglob("*.parquet"))
    kept = part.read_bytes()
    part.write_bytes(kept + b"x")
    assert _gate(spark, run, "x")[0] == 3
    part.write_bytes(kept)


def test_tasks_copy_whole_trees(spark, tmp_path):
    volume = tmp_path / "volume"
    for i in range(20):
        (volume / f"d{i % 3}").mkdir(parents=True, exist_ok=True)
        (volume / f"d{i % 3}" / f"f{i}.bin").write_bytes(bytes([i]) * (i * 1000))
    assert governance.drill(str(volume), str(tmp_path / "backups"), str(tmp_path / "scratch"), "commerce")
    assert files.list_files(str(tmp_path / "scratch")) == files.list_files(str(volume))
    (tmp_path / "one.txt").write_text("one")
    governance.package(str(tmp_path / "package"), {"data": str(volume), "note": str(tmp_path / "one.txt")})
    assert governance.verify_package(str(tmp_path / "package")) == []
    assert (tmp_path / "package" / "note" / "one.txt").read_text() == "one"


def test_csv_split_over_tasks(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text("i,t\n" + "".join(f"{i},{'x' * 100}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        one, several = (files.read_csv(spark, str(path), as_text=True, multi_line=m) for m in (True, False))
        assert one.rdd.getNumPartitions() == 1 < several.rdd.getNumPartitions()
        assert one.exceptAll(several).isEmpty() and several.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
