"""Sources, snapshots, ledger, claims, narratives, reports and both pipelines."""

import json

import pytest

from tallywell.operators import claims as C
from tallywell.operators.metrics import parse_contract
from tallywell.plans import governance as G
from tallywell.plans import narrative as N
from tallywell.plans import pipelines as P
from tallywell.plans import report as R
from tallywell.sources import files, snapshots
from tallywell.sources.ledger import Ledger, LedgerError

PARTS = [
    {"metric": "paid", "type": "count", "order_key": "order_id", "filters": [{"field": "status", "op": "=", "value": "paid"}]},
    {"metric": "all_orders", "type": "count", "order_key": "order_id"},
    {"metric": "paid_rate", "type": "ratio", "numerator": {"metric": "paid"}, "denominator": {"metric": "all_orders"}},
]
CONTRACTS = {c["metric"]: parse_contract({"grain": "order", "time_column": "created_at"} | c) for c in PARTS}
SOURCE = {"query_id": "q", "run_id": "r", "snapshot_id": "s"}


def order_csv(path, encoding="utf-8"):
    rows = [f"O-{i},2026-08-26 0{i}:00:00,渠道,{'' if i == 3 else 85},{0 if i == 7 else 72},{'cancelled' if i == 7 else 'paid'}" for i in range(8)]
    path.write_bytes("\n".join(["order_id,created_at,销售渠道,amount_total,amount_paid,status", *rows]).encode(encoding))
    return str(path)


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "gb18030"])
def test_csv_in_any_encoding(spark, tmp_path, encoding):
    df = files.read_csv(spark, order_csv(tmp_path / "o.csv", encoding))
    assert df.columns[2] == "销售渠道" and df.count() == 8 and df.first()[2] == "渠道"


def test_csv_contract(spark, tmp_path):
    columns = [{"name": "id", "type": "integer", "nullable": False}, {"name": "v", "type": "number"}]
    (tmp_path / "a.csv").write_text("id,v\n1,2.5\n2,\n")
    (tmp_path / "b.csv").write_text("id,v\n1,x\n")
    (tmp_path / "c.csv").write_text("id,v\n,1\n")
    assert files.read_csv(spark, str(tmp_path / "a.csv"), columns).collect() == [(1, 2.5), (2, None)]
    for name in "bc":
        with pytest.raises(files.SourceError):
            files.read_csv(spark, str(tmp_path / f"{name}.csv"), columns)


def test_upload_limits(spark, tmp_path):
    p = order_csv(tmp_path / "o.csv")
    assert files.check_upload(spark, p, ["status"]).count() == 8
    for limits in ({"max_bytes": 10}, {"max_lines": 3}, {"max_columns": 2}, {"max_field": 3}, {"required": ["nowhere"]}):
        with pytest.raises(files.SourceError):
            files.check_upload(spark, p, **limits)


def test_paths_stay_inside():
    assert files.inside("/a/commerce", "/a/commerce/x")
    for bad in ("/a/research/x", "/a/commerce/../research/x", "/a/commerce2/x"):
        with pytest.raises(PermissionError):
            files.inside("/a/commerce", bad)


def test_commerce_pipeline(spark, tmp_path):
    root = str(tmp_path / "commerce")
    run = P.run_commerce(spark, root, order_csv(tmp_path / "o.csv", "gb18030"), CONTRACTS, "paid_rate", commit="c0")
    assert run["answer"]["rows"] == [["2026-08-26", 0.875]] and run["health"]["issues"][0]["code"] == "blank_value"
    checked = P.claims_of_run(spark, root, run)
    assert checked["summary"] == "clean"
    ledger = Ledger(spark, root)
    assert ledger.rollup()["runs"] == 1 and ledger.row_counts() == [8]
    claim = checked["entries"][0]
    assert C.prove_source(claim, ledger.table("queries"), ledger.table("runs"), lambda s: snapshots.verify(root, s)) == []
    assert C.prove_source({**claim, "metric": "other"}, ledger.table("queries"), ledger.table("runs"), lambda s: "changed") == [
        "the query asked for another metric", "the snapshot was changed"]
    conclusion = R.build_conclusion("commerce", "paid_rate", 1, run["provenance"], run["answer"]["rows"], checked)
    out = R.export_report(conclusion, root + "/exports", ledger)
    assert out["file_name"].startswith("[C]") and ledger.table("exports").count() == 1 and "0.875" in R.render_qmd(conclusion)
    tampered = {**run, "answer": {**run["answer"], "rows": [["2026-08-26", 0.9]]}}
    with pytest.raises(R.ConclusionError):
        R.build_conclusion("commerce", "paid_rate", 1, run["provenance"], [], P.claims_of_run(spark, root, tampered))
    record = ledger.table("runs").first().asDict()
    entries = checked["entries"]
    assert N.run_gate("the rate is 87.5%", record, entries, ["paid_rate#2026-08-26"], run["snapshot"]["snapshot_sha256"])[0] == 0
    assert N.run_gate("the rate is 90.1%", record, entries, ["paid_rate#2026-08-26"], run["snapshot"]["snapshot_sha256"])[0] == 2
    assert N.run_gate("x", record, entries, [], "other")[0] == 3 and N.run_gate("x", {}, entries, [], "other")[0] == 4
    snapshot = tmp_path / "commerce/snapshots" / run["snapshot"]["snapshot_id"] / "paid_rate"
    next(p for p in snapshot.iterdir() if p.suffix == ".parquet").write_bytes(b"tampered")
    with pytest.raises(snapshots.SnapshotError):
        P.claims_of_run(spark, root, run)


def test_failed_run_is_an_event(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("order_id,created_at,status\nO-1,2026-08-26,paid\nO-1,2026-08-26,paid\n")
    with pytest.raises(Exception, match="unique"):
        P.run_commerce(spark, str(tmp_path / "c"), str(tmp_path / "bad.csv"), CONTRACTS, "paid_rate")
    ledger = Ledger(spark, str(tmp_path / "c"))
    event = ledger.table("events").first()
    assert event["event_type"] == "run_failed" and json.loads(event["payload"])["step"] == "assert" and ledger.table("runs").count() == 0


def test_ledger_appends_only(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    run = {"run_id": "r1", "track": "commerce", "provenance": {"run_id": "r1", "snapshot_id": "s", "batch_id": "b", "commit_sha": "c"}}
    ledger.run(run)
    with pytest.raises(LedgerError):
        ledger.run(run)
    with pytest.raises(LedgerError, match="commit_sha"):
        ledger.run({"run_id": "r2", "provenance": {"run_id": "r2", "snapshot_id": "s", "batch_id": "b"}})


def test_research_pipeline(spark, tmp_path):
    rows = [f"p{a}{i},{a},{int(i % 2 == 0 if a == 'a' else i % 3 == 0)},c{i % 3},{20 + (i // 3) % 2}" for a in "ab" for i in range(650)]
    (tmp_path / "c.csv").write_text("\n".join(["participant_id,arm,converted,city,age", *rows]))
    manifest = {"dataset_name": "d", "version": "1", "owner": "o", "collection_method": "survey",
                "irb": {"approved": True, "expires_at": "2999-01-01", "approval_no": "n"}, "privacy": {"quasi_identifiers": ["city", "age"], "k": 5, "dp_epsilon": 0.1}}
    plan = {"outcome": "binary", "design": "rct", "method": "two_proportion_test", "alpha": 0.05, "mde": 0.08, "power": 0.8}
    registry = G.Preregistry(str(tmp_path / "prereg.json"))
    registry.register("p1", plan)
    budget = G.PrivacyBudget(str(tmp_path / "dp.json"))
    run = P.run_research(spark, str(tmp_path / "research"), str(tmp_path / "c.csv"), manifest, registry, "p1", plan, budget=budget)
    assert run["counts"] == (325, 650, 217, 650) and run["conclusion"]["status"] == "GREEN"
    assert run["reconciled"]["summary"] == "clean" and run["budget_left"] == pytest.approx(0.9)
    with pytest.raises(G.GateError, match="alpha"):
        P.run_research(spark, str(tmp_path / "research"), str(tmp_path / "c.csv"), manifest, registry, "p1", plan | {"alpha": 0.1})


def test_claims(spark):
    ok = {"metric": "m", "period": "p", "value": 1.0, "source": SOURCE}
    C.validate_claim(ok, (0, 1))
    for bad in (float("nan"), float("inf"), True, "1", None, 2.0):
        with pytest.raises(C.ClaimError):
            C.validate_claim(ok | {"value": bad}, (0, 1))
    told = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", None), ("d", 1.0)], "period string, value double")
    replay = spark.createDataFrame([("a", 1.0), ("b", 1.1), ("c", 1.0), ("d", float("nan"))], "dt string, value double")
    assert {r["period"]: r["reason"] for r in C.reconcile_claims(told, replay).collect()} == {"a": None, "b": "differs", "c": "not finite", "d": "not finite"}
    assert C.reconcile([ok], {})["summary"] == "MISMATCH" and C.reconcile([ok], {"p": 1.0 + 1e-12})["summary"] == "clean"


def test_narratives(spark):
    bank = N.NumberBank([{"metric": "rate", "period": "d", "value": 0.875, "unit": "ratio"}, {"metric": "n", "period": "d", "value": 1234.5}])
    assert N.gate_narrative("8 orders, 87.5% paid", ["rate#d"], bank)["status"] == "PASS"
    assert N.gate_narrative("87.5% paid", [], bank)["status"] == "FAIL"
    assert N.gate_narrative("87.5% paid", [], bank, strict=False)["status"] == "PASS"
    assert N.gate_narrative("1,234.5", ["n#d", "x#y"], bank)["bad_citations"] == ["x#y"]
    assert N.render_narrative("{claim:rate#d} {claim:no}", bank) == "87.50% {claim:no}"
    texts = spark.createDataFrame([(1, "87.5% and 3.25 and 4"), (2, "1,234.5")], "k int, text string")
    cited = spark.createDataFrame([(1, 0.875), (2, 1234.5)], "k int, value double")
    assert [(r["k"], r["token"]) for r in C.uncited_numbers(texts, cited, "k").collect()] == [(1, "3.25")]


def test_snapshots(spark, tmp_path):
    df = spark.createDataFrame([("2026-08-27", 2.0), ("2026-08-26", 1.0)], "dt string, value double")
    made = snapshots.publish({"m": df}, str(tmp_path), "s1", "commerce")
    assert snapshots.verify(str(tmp_path), "s1") == made["snapshot_sha256"]
    assert [r[0] for r in snapshots.replay(spark, str(tmp_path), "s1", "m").collect()] == ["2026-08-26", "2026-08-27"]
    assert snapshots.content_hash(df) == snapshots.content_hash(df.orderBy("dt")) == made["content"]["m"]
    with pytest.raises(snapshots.SnapshotError):
        snapshots.publish({"m": df}, str(tmp_path), "s1", "commerce")


def test_verified_claims(spark, tmp_path):
    """Sources are proven before numbers: one that isn't fails every claim and is recorded."""
    ledger = Ledger(spark, str(tmp_path))
    ledger.run({"run_id": "r", "track": "commerce", "snapshot_id": "s", "snapshot_sha256": "h", "started_at": "1", "rows": 1,
                "provenance": {"run_id": "r", "snapshot_id": "s", "batch_id": "b", "commit_sha": "c"}})
    ledger.query({"query_id": "q", "run_id": "r", "track": "commerce", "metric": "m", "via_semantic": True})
    claim = {"metric": "m", "period": "2026-01-01", "value": 0.5, "source": SOURCE}
    replay = lambda snapshot, metric: {"2026-01-01": 0.5, "2026-01-02": 0.7}
    good = C.reconcile_verified([claim, claim | {"period": "2026-01-02", "value": 0.7}], ledger, lambda s: "h", replay)
    assert good["summary"] == "clean" and good["passed"] == 2
    assert C.reconcile_verified([claim | {"value": 0.6}], ledger, lambda s: "h", replay)["summary"] == "MISMATCH"
    for told, live in ((claim, "changed"), (claim | {"metric": "x"}, "h"), (claim | {"source": SOURCE | {"query_id": "none"}}, "h")):
        out = C.reconcile_verified([claim, told], ledger, lambda s, live=live: live, replay)
        assert out["passed"] == 0 and out["blocked"] == 2 and out["unproven"]
    assert ledger.table("events").where("event_type = 'source_unproven'").count() == 3
    with pytest.raises(C.ClaimError):
        C.reconcile_verified([claim], ledger, lambda s: "h", replay, limits=(0.6, 1.0))


@pytest.mark.parametrize("limits", [[0, float("nan")], [5, 1], [0, float("inf")], [1], ["a", 2], [True, 2]])
def test_value_ranges(limits):
    with pytest.raises(ValueError):
        parse_contract({"metric": "m", "type": "count", "grain": "order", "time_column": "t", "value_range": limits})
    assert parse_contract({"metric": "m", "type": "count", "grain": "order", "time_column": "t", "value_range": [0, 0]}).value_range


def test_one_writer_at_a_time(spark, tmp_path):
    """Of writers that start together one works and the others are refused; a writer that died blocks for a time only."""
    from concurrent.futures import ThreadPoolExecutor

    uri = str(tmp_path / "x.json")
    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(lambda i: files.claim(uri, str(i)), range(8))) == 1
    with files.held(uri + "2"), pytest.raises(G.GateError, match="being written"):
        G.JsonLedger(uri + "2", "notes").add("a", {})
    G.JsonLedger(uri + "2", "notes").add("a", {})
    with files.held(f"{tmp_path}/ledger/writer"):  # run ledgers need no lock
        Ledger(spark, str(tmp_path)).event("x")
    assert files.claim(f"{tmp_path}/ledger/writer.lock")  # as a crashed writer leaves it
    with pytest.raises(files.Held), files.held(f"{tmp_path}/ledger/writer"):
        pass
    with files.held(f"{tmp_path}/ledger/writer", minutes=-1):
        pass
    assert not files.exists(f"{tmp_path}/ledger/writer.lock")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a@b.example", "x", 1)], "email string, api_token string, order_count int")
    out = str(tmp_path / "shown")
    assert R.export_redacted(rows, out, str(tmp_path / "in"), salt="s") == 1
    got = spark.read.json(out).first()
    assert got["email"] == "a***@b.example" and got["api_token"].startswith("tok_") and got["order_count"] == 1
    for bad in ((out, "in"), (str(tmp_path / "same"), str(tmp_path / "same") + "/")):
        with pytest.raises(FileExistsError):
            R.export_redacted(rows, *bad)
    claim = {"metric": "m", "period": "p", "value": 1.0, "source": SOURCE}
    assert R.export_claims(C.reconcile([claim], {"p": 1.0}), str(tmp_path / "ok.json")) == 0
    assert R.export_claims(C.reconcile([claim], {}), str(tmp_path / "bad.json")) == 1 and json.loads((tmp_path / "bad.json").read_text())["blocked"] == 1


def test_fingerprints_of_lines_in_many_files(spark, tmp_path, monkeypatch):
    """A status that stays as it is isn't told as changed, wherever its lines are split."""
    from tallywell.plans import store_queries as Q

    monkeypatch.setattr(Q, "FILE_ROWS", 1000, raising=False)
    rows = [(i, "FOP"[i % 3] if i % 50 else None, i * 0.7) for i in range(6000)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_totalprice double").repartition(4).write.parquet(f"{tmp_path}/orders.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(tuple, Q.fingerprint_changes(spark, str(tmp_path)).collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == [("F", "changed"), ("P", "removed"), ("Q", "added")]
