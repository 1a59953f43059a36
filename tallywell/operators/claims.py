"""Claims against replays: every reported number is looked up and compared."""

from __future__ import annotations

import math
from numbers import Real

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-9
SOURCE = ("query_id", "run_id", "snapshot_id")


class ClaimError(ValueError):
    pass


def validate_claim(claim: dict, limits: tuple[float, float] | None = None) -> dict:
    """A claim states a metric, a period and a finite number with its source."""
    for f in ("metric", "period", "value", "source"):
        if f not in claim:
            raise ClaimError(f"a claim has no {f}")
    v = claim["value"]
    if isinstance(v, bool) or not isinstance(v, Real) or not math.isfinite(v):
        raise ClaimError(f"a claim's value must be a finite number: {v!r}")
    if limits and not limits[0] <= v <= limits[1]:
        raise ClaimError(f"{v} lies outside {list(limits)}")
    if not isinstance(claim["source"], dict) or not all(claim["source"].get(k) for k in SOURCE):
        raise ClaimError(f"a claim's source needs {', '.join(SOURCE)}")
    return claim


def reconcile_claims(claims: DataFrame, replay: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """claims (period, value) with replayed, status and reason.

    ``replay`` is (dt, value). A period without a replay, and a value that is
    null or not finite on either side, fails.
    """
    r = replay.select(F.col("dt").alias("period"), F.col("value").alias("replayed"))
    d = claims.join(r, "period", "left")

    def finite(c):
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    v, w = F.col("value").cast("double"), F.col("replayed").cast("double")
    reason = F.when(w.isNull(), "missing").when(~finite(v) | ~finite(w), "not finite").when(F.abs(v - w) >= tolerance, "differs")
    return d.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "PASS").otherwise("FAIL"))


def reconcile(claims: list[dict], replay: dict[str, float | None]) -> dict:
    """The same for a report's handful of claims: entries and a summary."""
    entries = []
    for c in claims:
        got = replay.get(c["period"])
        sound = isinstance(got, Real) and not isinstance(got, bool) and math.isfinite(got)
        ok = sound and math.isfinite(c["value"]) and abs(c["value"] - got) < TOLERANCE
        entries.append({**c, "replayed": got, "status": "PASS" if ok else "FAIL"})
    bad = sum(e["status"] == "FAIL" for e in entries)
    return {"entries": entries, "passed": len(entries) - bad, "blocked": bad, "summary": "MISMATCH" if bad else "clean"}


#: What can be wrong with a source, in the order in which it is told.
REASONS = (
    "the query isn't logged", "the query bypassed the semantic layer", "the query belongs to another run", "the query asked for another metric",
    "the run isn't in the ledger", "the query and its run are of two tracks", "the run has another snapshot", "the snapshot was changed")


def prove_sources(claims: DataFrame, queries: DataFrame, runs: DataFrame, live: DataFrame) -> DataFrame:
    """``claims`` (query_id, run_id, snapshot_id, metric, and others) with ``reasons``, an array that is empty if the source is proven.

    All claims meet the logged queries, those queries' runs, and ``live``
    (snapshot_id, sha256 now) in one plan; each of these three has one row for
    each id. A snapshot that isn't live counts as changed.
    """
    q = queries.select("query_id", F.col("run_id").alias("tw_run"), F.col("track").alias("tw_track"), F.col("metric").alias("tw_metric"), F.col("via_semantic").alias("tw_via"), F.lit(True).alias("tw_logged"))
    r = runs.select(F.col("run_id").alias("tw_run"), F.col("snapshot_id").alias("tw_snapshot"), F.col("snapshot_sha256").alias("tw_hash"), F.col("track").alias("tw_run_track"), F.lit(True).alias("tw_known"))
    now = live.select(F.col("snapshot_id").alias("tw_snapshot"), F.col("sha256").alias("tw_live"))
    d = claims.join(q, "query_id", "left").join(r, "tw_run", "left").join(now, "tw_snapshot", "left")
    logged, known = F.col("tw_logged").isNotNull(), F.col("tw_known").isNotNull()
    other = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    moved = other("tw_snapshot", "snapshot_id")
    tests = (
        ~logged, logged & ~F.coalesce("tw_via", F.lit(False)), logged & other("tw_run", "run_id"), logged & other("tw_metric", "metric"), logged & ~known,
        logged & known & other("tw_track", "tw_run_track"), logged & known & moved, logged & known & ~moved & (other("tw_live", "tw_hash") | F.col("tw_live").isNull()))
    reasons = F.array_compact(F.array(*[F.when(t, reason) for t, reason in zip(tests, REASONS, strict=True)]))
    return d.select(*claims.columns, reasons.alias("reasons"))


def _proofs(claims: list[dict], queries: DataFrame, runs: DataFrame, live_hash) -> dict[str, list[str]]:
    """query id -> what is wrong with it, for a report's claims."""
    spark = queries.sparkSession
    asked = sorted({tuple(c["source"][k] for k in SOURCE) + (c["metric"],) for c in claims})
    live = [(s, live_hash(s)) for s in sorted({a[2] for a in asked})]
    out = prove_sources(
        spark.createDataFrame(asked, "query_id string, run_id string, snapshot_id string, metric string"), queries, runs,
        spark.createDataFrame(live, "snapshot_id string, sha256 string")).collect()
    found: dict[str, list[str]] = {}
    for r in out:
        found.setdefault(r["query_id"], []).extend(x for x in r["reasons"] if x not in found.get(r["query_id"], ()))
    return found


def prove_source(claim: dict, queries: DataFrame, runs: DataFrame, live_hash) -> list[str]:
    """What is wrong with a claim's source; nothing if it is proven.

    ``live_hash`` (snapshot id -> hash now) is compared with the ledger's.
    """
    return _proofs([claim], queries, runs, live_hash)[claim["source"]["query_id"]]


def reconcile_verified(claims: list[dict], ledger, live_hash, replay_of, limits: tuple[float, float] | None = None) -> dict:
    """Reconcile claims only if all their sources are proven and their values lie in the contract's range.

    ``ledger`` has the tables of queries and runs and records events;
    ``replay_of`` (snapshot id, metric -> {period: value}) reads a snapshot. One
    source that isn't proven fails every claim, and the refusal is recorded.
    """
    for c in claims:
        validate_claim(c, limits)
    found = _proofs(claims, ledger.table("queries"), ledger.table("runs"), live_hash) if claims else {}
    wrong = {k: v for k, v in found.items() if v}
    if wrong:
        ledger.event("source_unproven", claims[0]["source"]["run_id"], None, {"reasons": wrong})
        entries = [c | {"replayed": None, "status": "FAIL", "reason": "source unproven"} for c in claims]
        return {"entries": entries, "passed": 0, "blocked": len(entries), "summary": "MISMATCH", "unproven": wrong}
    out = {"entries": [], "passed": 0, "blocked": 0, "unproven": {}}
    for snapshot, metric in sorted({(c["source"]["snapshot_id"], c["metric"]) for c in claims}):
        own = [c for c in claims if (c["source"]["snapshot_id"], c["metric"]) == (snapshot, metric)]
        part = reconcile(own, replay_of(snapshot, metric))
        out = out | {k: out[k] + part[k] for k in ("entries", "passed", "blocked")}
    if out["blocked"]:
        ledger.event("claims_unreconciled", claims[0]["source"]["run_id"], None, {"periods": [e["period"] for e in out["entries"] if e["status"] == "FAIL"]})
    return out | {"summary": "MISMATCH" if out["blocked"] else "clean"}


def number_tokens(narratives: DataFrame, text: str = "text") -> DataFrame:
    """narrative rows exploded to decimal and percent tokens with their values."""
    token = F.explode(F.regexp_extract_all(text, F.lit(r"(-?\d{1,3}(?:,\d{3})*(?:\.\d+)?%?)"), F.lit(1)))
    d = narratives.select("*", token.alias("token")).where(F.col("token").contains(".") | F.col("token").contains("%"))
    plain = F.regexp_replace("token", "[,%]", "").cast("double")
    return d.withColumn("number", F.when(F.col("token").endswith("%"), plain / 100).otherwise(plain))


def uncited_numbers(narratives: DataFrame, cited: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Tokens of each narrative that equal no value cited by it (``cited``: key, value)."""
    t = number_tokens(narratives, text)
    near = F.abs(F.col("number") - F.col("value")) < TOLERANCE
    return t.join(cited, (t[key] == cited[key]) & near, "left_anti")
