from datetime import date

import pytest

from tallywell.plans import governance as G
from tallywell.sources import snapshots
from tallywell.sources.ledger import Ledger


def source(version=1, effective="2026-09-20T00:00:00+00:00", **types):
    return {"source": "orders", "version": version, "effective_at": effective,
            "columns": [{"name": k, "type": v.rstrip("!"), "nullable": not v.endswith("!")} for k, v in types.items()]}


def test_contract_changes(spark):
    old, new = source(a="string", b="number", c="string"), source(2, a="integer!", b="number!", d="date")
    review = {"review_id": "1", "reviewer": "x", "decision": "approved", "reviewed_at": "2026-09-01T00:00:00+00:00", "effective_at": "2026-09-20T00:00:00+00:00"}
    assert [(c["name"], c["kind"]) for c in G.gate_contract_change(spark, old, new, review)] == [
        ("a", "type_changed"), ("b", "nullability_tightened"), ("c", "removed"), ("d", "added")]
    for bad in (None, review | {"decision": "no"}, review | {"reviewed_at": "2026-09-10T00:00:00+00:00"}, review | {"effective_at": "2026-09-21T00:00:00+00:00"}):
        with pytest.raises(G.GateError):
            G.gate_contract_change(spark, old, new, bad)
    assert G.gate_contract_change(spark, source(a="string"), source(2, a="string", z="date")) == [{"name": "z", "kind": "added"}]
    with pytest.raises(G.GateError):
        G.gate_contract_change(spark, source(a="string"), source(1, a="string", z="date"))


def test_overlay(spark):
    base = {"shared": {"audit": {"retention_days": 400}}, "web": {"port": 80, "csrf": True}}
    assert G.overlay(base, {"web": {"port": 81.0}}, "commerce")["web"] == {"port": 81.0, "csrf": True}
    for bad in ({"web": {"csrf": 1}}, {"web": {"port": "80"}}, {"shared": {"audit": {"retention_days": 500}}}):
        with pytest.raises(G.GateError):
            G.overlay(base, bad, "commerce")
    with pytest.raises(G.GateError):
        G.overlay({"shared": {"audit": {"retention_days": 30}}}, {}, "commerce")
    rows = {r["key"]: r["origin"] for r in G.config_ledger(spark, base, {"commerce": {"web": {"port": 1}}, "research": {"x": 1}}).collect()}
    assert rows == {"shared.audit.retention_days": "base", "web.port": "base+commerce", "web.csrf": "base", "x": "research"}
    assert [r["key"] for r in G.config_diff(spark, {"a": 1, "b": 2}, {"a": 1, "b": 3, "c": None}).orderBy("key").collect()] == ["b", "c"]


def test_budget(tmp_path):
    b = G.PrivacyBudget(str(tmp_path / "b.json"), 1.0)
    assert b.spend("one", 0.6) == pytest.approx(0.4)
    with pytest.raises(G.BudgetExhausted):
        b.spend("two", 0.5)
    with pytest.raises(G.GateError):
        b.spend("one", 0.1)
    assert b.remaining() == pytest.approx(0.4)
    (tmp_path / "b.json").write_text("{")
    with pytest.raises(G.GateError, match="damaged"):
        b.spent()


def test_dataset_gate():
    ok = {"dataset_name": "d", "version": "1", "owner": "o", "collection_method": "m", "irb": {"approved": True, "expires_at": "2026-01-02", "approval_no": "n"}}
    assert G.gate_dataset(ok, date(2026, 1, 2))["privacy"] == {}
    for bad in (ok | {"owner": ""}, ok | {"irb": None}, ok | {"irb": ok["irb"] | {"approved": 1}}):
        with pytest.raises(G.GateError):
            G.gate_dataset(bad, date(2026, 1, 1))
    with pytest.raises(G.GateError):
        G.gate_dataset(ok, date(2026, 1, 3))


def test_assets(tmp_path):
    r = G.AssetRegistry(str(tmp_path / "a.json"))
    none = {"depends_on_track_semantics": False, "failure_contaminates_other_track": False, "managed_data_flow": False}
    assert r.register("a.1", "core/x.py", "code", "why", none) == "shared"
    assert r.register("a.2", "core/y.py", "code", "why", none | {"managed_data_flow": True}, "research") == "research"
    assert r.by_scope("shared") == ["a.1"]
    for args in (("a.1", "x", "code", "why", none), ("a.3", "/x", "code", "why", none), ("a.3", "x", "code", "why", none, "research"),
                 ("a.3", "x", "code", "why", none | {"managed_data_flow": True})):
        with pytest.raises(G.GateError):
            r.register(*args)


def test_access():
    seen = []
    a = G.Access(seen.append)
    a.register("k", {"pipeline_rerun"}, {"commerce", "research"}, {"p"}, expires_at="2999-01-01T00:00:00+00:00")
    a.authorize("L2", "pipeline_rerun", "commerce", "k", "p")
    for call in (("L1", "pipeline_rerun", "commerce", "k", "p"), ("L3", "pipeline_rerun", "research", "k", "p"), ("L2", "read_via_semantic", "commerce", "k", "p"),
                 ("L2", "pipeline_rerun", "commerce", "other", "p"), ("L2", "pipeline_rerun", "commerce", "k", "q")):
        with pytest.raises(PermissionError):
            a.authorize(*call)
    a.revoke("k")
    with pytest.raises(PermissionError):
        a.authorize("L2", "pipeline_rerun", "commerce", "k", "p")
    assert [x["allowed"] for x in seen] == [True] + [False] * 6


def test_backup(tmp_path):
    v = tmp_path / "v"
    (v / "d").mkdir(parents=True)
    (v / "d/a").write_text("1")
    assert G.drill(str(v), str(tmp_path / "b"), str(tmp_path / "r"), "commerce")
    made = G.backup(str(v), str(tmp_path / "b"), "commerce")
    with pytest.raises(G.GateError):
        G.restore(made["path"], str(tmp_path / "r"), "commerce")
    (tmp_path / "b/commerce" / made["backup_id"] / "d/a").write_text("2")
    with pytest.raises(G.GateError):
        G.restore(made["path"], str(tmp_path / "r2"), "commerce")
    with pytest.raises(G.GateError):
        G.backup(str(v), str(v / "inside"), "commerce")
    G.package(str(tmp_path / "p"), {"data": str(v), "one": str(v / "d/a")}, "c1")
    assert G.verify_package(str(tmp_path / "p"), "c1") == [] and len(G.verify_package(str(tmp_path / "p"), "c2")) == 1
    (tmp_path / "p/one/a").write_text("3")
    with pytest.raises(G.GateError):
        G.verify_package(str(tmp_path / "p"))


def test_bridge(spark, tmp_path):
    c, r = str(tmp_path / "commerce"), str(tmp_path / "research")
    made = snapshots.publish({"m": spark.createDataFrame([("d", 1.0)], "dt string, value double")}, c, "s1", "commerce")
    here, there = Ledger(spark, c), Ledger(spark, r)
    here.run({"run_id": "r1", "track": "commerce", "snapshot_id": "s1", "snapshot_sha256": made["snapshot_sha256"],
              "provenance": {"run_id": "r1", "snapshot_id": "s1", "batch_id": "b", "commit_sha": "c"}})
    b = G.Bridge(str(tmp_path / "bridge"))
    args = ("why", c, r, "commerce", "research", here, there, "r1")
    token = b.issue("why", "commerce", "research")
    out = b.export(token, *args)
    assert out["sha256"] == made["snapshot_sha256"] and there.rollup()["bridged"] == 1
    for bad in (token, "tk-none", b.issue("other", "commerce", "research"), b.issue("why", "research", "commerce")):
        with pytest.raises(G.GateError):
            b.export(bad, *args)
    with pytest.raises(G.GateError):
        b.issue("why", "commerce", "commerce")


def test_tokens_and_budgets_under_competition(tmp_path):
    """A token is redeemed once and a budget isn't overspent, whoever comes at the same time."""
    from concurrent.futures import ThreadPoolExecutor

    b = G.Bridge(str(tmp_path / "bridge"))
    token = b.issue("why", "commerce", "research")

    def tried(f, *a):
        try:
            f(*a)
        except G.GateError:
            return False
        return True

    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(lambda _: tried(b.redeem, token, "why", "commerce", "research"), range(8))) == 1
        budget = G.PrivacyBudget(str(tmp_path / "budget.json"), 1.0)
        spent = sum(pool.map(lambda i: tried(budget.spend, f"s{i}", 0.4), range(8)))
    assert 1 <= spent <= 2 and budget.spent() == pytest.approx(0.4 * spent)
