"""The two pipelines. Every stage fails loudly, and a failed run leaves an event, never a run."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from tallywell.operators.claims import reconcile, reconcile_verified
from tallywell.operators.groups import group_counts, require_k_anonymity
from tallywell.operators.metrics import Contract
from tallywell.operators.quality import commerce_assertions, health_check, research_assertions, run_assertions
from tallywell.plans.governance import PrivacyBudget, Preregistry, gate_dataset
from tallywell.plans.semantic import Semantic
from tallywell.plans.statistics import MethodRegistry, analyze, replay_stat
from tallywell.sources import snapshots
from tallywell.sources.files import check_track, read_csv
from tallywell.sources.landing import land
from tallywell.sources.ledger import Ledger


class PipelineError(RuntimeError):
    pass


def _ids() -> tuple[str, str, str]:
    now = datetime.now(timezone.utc)
    tail = f"{now:%Y%m%d-%H%M%S}-{uuid.uuid4().hex[:6]}"
    return f"r-{tail}", f"s-{tail}", now.isoformat(timespec="milliseconds")


def _built_by(build: dict | None) -> dict:
    return {"build": build["build"], "dependencies": build["dependencies"], "dirty": build["dirty"]} if build else {}


def _built(df: DataFrame, least: int = 1) -> int:
    n = df.count()
    if n < least:
        raise PipelineError(f"{n} rows, {least} are needed")
    return n


def run_commerce(spark: SparkSession, root: str, csv: str, contracts: Mapping[str, Contract], metric: str, commit: str = "unknown",
                 columns: list[dict] | None = None, key: str = "order_id", limit: int = 30, build: dict | None = None) -> dict:
    """Land, check health, assert, compile, query, snapshot, record.

    ``build`` (see merkle.build) puts the fingerprints of code and lock, and whether the tree is dirty, into the provenance.
    """
    ledger = Ledger(spark, root)
    run_id, snapshot_id, started = _ids()
    step = "land"
    try:
        batch = land(root, "orders", csv)
        step = "health"
        health = health_check(read_csv(spark, batch["readable"], as_text=True))
        step = "model"
        fact = read_csv(spark, batch["readable"], columns).cache()
        n = _built(fact)
        step = "assert"
        report = run_assertions(fact, commerce_assertions(fact, ledger.row_counts(), key))
        step = "compile"
        semantic = Semantic(ledger)
        frame = semantic.compile("commerce", fact, contracts[metric], contracts)
        step = "query"
        answer = semantic.query("commerce", metric, run_id, limit)
        step = "snapshot"
        snapshot = snapshots.publish({metric: frame.select("dt", "value"), "fact": fact}, root, snapshot_id, "commerce")
        step = "ledger"
        provenance = {"run_id": run_id, "snapshot_id": snapshot_id, "batch_id": batch["batch_id"], "commit_sha": commit, "query_id": answer["query_id"]} | _built_by(build)
        ledger.run({
            "run_id": run_id, "track": "commerce", "started_at": started, "batch_id": batch["batch_id"], "snapshot_id": snapshot_id,
            "snapshot_sha256": snapshot["snapshot_sha256"], "rows": n, "metric": metric, "metric_version": answer["metric_version"],
            "health": health, "provenance": provenance, "steps": [e["name"] for e in report.entries]})
        fact.unpersist()
        return {"run_id": run_id, "snapshot": snapshot, "health": health, "assertions": report.entries, "answer": answer, "provenance": provenance, "contract": contracts[metric]}
    except Exception as e:
        ledger.failed_run(run_id, "commerce", f"{type(e).__name__}: {e}", step)
        raise


def claims_of_run(spark: SparkSession, root: str, run: dict, first: int = 5, contract: Contract | None = None) -> dict:
    """The first points of a run's answer as claims: their sources are proven, then they are reconciled against a replay of their snapshot.

    The contract's range, of the run's own contract unless another is given, holds for every value.
    """
    a, p = run["answer"], run["provenance"]
    snapshots.verify(root, p["snapshot_id"])
    contract = contract or run.get("contract")

    def replay_of(snapshot: str, metric: str) -> dict:
        return {r["dt"]: r["value"] for r in snapshots.replay(spark, root, snapshot, metric).collect()}

    source = {"query_id": a["query_id"], "run_id": p["run_id"], "snapshot_id": p["snapshot_id"]}
    claims = [{"metric": a["metric"], "period": d, "operation": "point", "value": v, "unit": "value", "source": source} for d, v in a["rows"][:first]]
    none = [c for c in claims if c["value"] is None]
    out = reconcile_verified(
        [c for c in claims if c["value"] is not None], Ledger(spark, root), lambda s: snapshots.verify(root, s), replay_of, contract.value_range if contract else None)
    if none:  # a null can't be claimed
        out["entries"] += [c | {"status": "FAIL", "replayed": None} for c in none]
        out |= {"blocked": out["blocked"] + len(none), "summary": "MISMATCH"}
    return out


def run_research(spark: SparkSession, root: str, csv: str, manifest: dict, registry: Preregistry, plan_id: str, plan: dict, commit: str = "unknown",
                 budget: PrivacyBudget | None = None, columns: list[dict] | None = None, build: dict | None = None) -> dict:
    """Land, gate the dataset and the plan, assert, protect privacy, analyse, reconcile, snapshot, record.

    Counts come from the data alone; a result that doesn't reconcile with its
    own recomputation stops the run.
    """
    check_track("research")
    ledger = Ledger(spark, root)
    run_id, snapshot_id, started = _ids()
    step = "land"
    try:
        batch = land(root, "cohort", csv)
        step = "health"
        health = health_check(read_csv(spark, batch["readable"], as_text=True))
        step = "dataset"
        dataset = gate_dataset(manifest)
        step = "prereg"
        registry.require(plan_id, plan)
        methods = MethodRegistry()
        methods.freeze()
        step = "model"
        cohort = read_csv(spark, batch["readable"], columns).cache()
        n = _built(cohort)
        step = "assert"
        report = run_assertions(cohort, research_assertions(cohort, ledger.row_counts()))
        step = "privacy"
        privacy = dataset["privacy"]
        anonymous = None
        if privacy.get("quasi_identifiers") and privacy.get("k"):
            anonymous = require_k_anonymity(cohort, privacy["quasi_identifiers"], privacy["k"])
        left = budget.spend(run_id, float(privacy.get("dp_epsilon", 0.0)), plan_id) if budget else None
        step = "analyze"
        counts = tuple(group_counts(cohort, "arm", "converted").first()[:])
        source = {"query_id": f"q-{run_id}", "run_id": run_id, "snapshot_id": snapshot_id}
        conclusion = analyze(
            plan["outcome"], plan["design"], "research", counts=counts, method=plan["method"], suite="full", mde=plan["mde"], alpha=plan["alpha"],
            power=plan["power"], period=plan_id, source=source, run_id=run_id, research_mode=True, registry=methods)
        step = "reconcile"
        again = tuple(group_counts(cohort, "arm", "converted").first()[:])
        checked = reconcile(conclusion["claims"], replay_stat(conclusion, again))
        if checked["summary"] != "clean":
            raise PipelineError("the result doesn't match its recomputation")
        step = "snapshot"
        snapshot = snapshots.publish({"cohort": cohort}, root, snapshot_id, "research")
        step = "ledger"
        provenance = {"run_id": run_id, "snapshot_id": snapshot_id, "batch_id": batch["batch_id"], "commit_sha": commit, "methods": methods.fingerprint()} | _built_by(build)
        ledger.run({
            "run_id": run_id, "track": "research", "started_at": started, "batch_id": batch["batch_id"], "snapshot_id": snapshot_id,
            "snapshot_sha256": snapshot["snapshot_sha256"], "rows": n, "metric": plan["method"], "metric_version": 1, "health": health,
            "provenance": provenance, "steps": [e["name"] for e in report.entries]})
        ledger.event("prereg_checked", run_id, "research", {"plan_id": plan_id})
        cohort.unpersist()
        return {"run_id": run_id, "snapshot": snapshot, "counts": counts, "conclusion": conclusion, "reconciled": checked, "anonymity": anonymous, "budget_left": left, "provenance": provenance}
    except Exception as e:
        ledger.failed_run(run_id, "research", f"{type(e).__name__}: {e}", step)
        raise
