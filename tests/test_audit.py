"""Access as of a time, budgets in order, proofs of sources, looks over time, normality by ranks."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywell.functions import kernels as K
from tallywell.operators import asof, claims, normality, spending
from tallywell.plans.experiments import Design, looks
from tallywell.plans.governance import LEVEL_ACTIONS, Access
from tallywell.sources.files import TRACKS

T0 = datetime(2026, 1, 1)


def at(h):
    return T0 + timedelta(hours=h)


def test_each_row_meets_the_version_of_its_time(spark):
    rng = random.Random(1)
    versions = [(f"k{rng.randrange(4)}" if rng.random() < 0.5 else "hot", at(rng.randrange(50)), i) for i in range(120)] + [(None, at(1), 900), ("k1", None, 901)]
    rows = [(i, "hot" if i % 3 else f"k{rng.randrange(6)}", at(rng.randrange(60)), i) for i in range(300)] + [(1000, None, at(3), 0), (1001, "hot", None, 0)] + [(7, "hot", at(9), 7)] * 2
    v = spark.createDataFrame(versions, "key string, since timestamp_ntz, value long")
    r = spark.createDataFrame(rows, "n long, key string, at timestamp_ntz, value long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges for the hot key
    try:
        got = sorted((x["n"], x["version"]["value"] if x["version"] else None) for x in asof.asof(r, v, "key", "at", "since").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

    def held(key, when):
        own = [(s, n) for k, s, n in versions if k is not None and s is not None and k == key and when is not None and s <= when]
        return max(own)[1] if own else None

    assert got == sorted((n, held(k, t)) for n, k, t, _ in rows)
    assert asof.asof(r, v.limit(0), "key", "at", "since").where("version is not null").isEmpty() and asof.asof(r.limit(0), v, "key", "at", "since").isEmpty()


def test_decisions_are_those_of_single_calls(spark):
    """Against the gate that judges one call, for keys whose last version holds."""
    rng = random.Random(2)
    schema = "key string, since timestamp_ntz, actions array<string>, tracks array<string>, projects array<string>, level string, expires_at timestamp_ntz, revoked boolean"
    keys = [("a", at(0), ["read_via_semantic"], ["commerce"], None, None, None, False), ("b", at(0), ["read_via_semantic", "pipeline_rerun"], list(TRACKS), ["p"], "L2", None, False),
            ("c", at(0), ["read_via_semantic"], ["research"], None, None, at(1), False), ("d", at(0), ["read_via_semantic"], ["commerce"], None, None, None, True)]
    gate = Access()
    for k, _, actions, tracks, projects, level, expires, revoked in keys:
        gate.register(k, set(actions), set(tracks), set(projects) if projects else None, level, expires.isoformat() if expires else None)
        if revoked:
            gate.revoke(k)
    calls = [(i, at(9), rng.choice(["a", "b", "c", "d", "e", None]), rng.choice(["L1", "L2", "L3", "L9", None]), rng.choice(["read_via_semantic", "pipeline_rerun", "x"]), rng.choice([*TRACKS, "other", None]), rng.choice(["p", "q", None])) for i in range(400)]
    df = spark.createDataFrame(calls, "n int, at timestamp_ntz, key string, level string, action string, track string, project string")
    got = {r["n"]: (r["note"], r["allowed"]) for r in asof.access_decisions(df, spark.createDataFrame(keys, schema), LEVEL_ACTIONS, TRACKS).collect()}
    for n, _, key, level, action, track, project in calls:
        want = gate._refusal(level, action, track, key, project)
        assert got[n] == (want, not want)
    assert len({note for note, _ in got.values()}) > 6


@pytest.mark.parametrize("chunk", [25, 1000])
def test_budgets_are_spent_in_order(spark, chunk):
    rng = random.Random(3)
    rows = [(g, i, rng.choice([0.0, 0.1, 0.4, 1.0, 2.5, None, -1.0, float("nan"), 11.0])) for i in range(60) for g in (["hot"] * 4 + ["b", None])[:1 + i % 6]]
    rows = [(g, k, e) for k, (g, _, e) in enumerate(rows)]
    df = spark.createDataFrame(rows, "g string, k long, e double").repartition(4)
    got = {r["k"]: r["accepted"] for r in spending.accept(df, "g", ["k"], "e", 10.0, chunk).collect()}
    left = {}
    for g, k, e in rows:
        ok = e is not None and e >= 0 and left.get(g, 0.0) + e <= 10 + 1e-9
        left[g] = left.get(g, 0.0) + e if ok else left.get(g, 0.0)
        assert got[k] == ok, (g, k, e)
    assert len(got) == len(rows) and spending.accept(df.limit(0), "g", ["k"], "e", 1.0).isEmpty()


def test_sources_are_proven_together(spark):
    queries = spark.createDataFrame([("q1", "r1", "commerce", "m", True), ("q2", "r1", "commerce", "m", False), ("q3", "r9", "commerce", "m", True), ("q4", "r1", "research", "m", True)],
                                    "query_id string, run_id string, track string, metric string, via_semantic boolean")
    runs = spark.createDataFrame([("r1", "s1", "h1", "commerce"), ("r2", "s2", "h2", "commerce")], "run_id string, snapshot_id string, snapshot_sha256 string, track string")
    rows = [("q1", "r1", "s1", "m", 1), ("q1", "r1", "s1", "m", 1), ("q0", "r1", "s1", "m", 2), ("q2", "r2", "s1", "other", 3), ("q3", "r9", "s1", "m", 4), ("q4", "r1", "s2", "m", 5), (None, None, None, None, 6)]
    told = spark.createDataFrame(rows, "query_id string, run_id string, snapshot_id string, metric string, reasons int").drop("reasons").withColumn("n", F.monotonically_increasing_id())
    got = claims.prove_sources(told, queries, runs, spark.createDataFrame([("s1", "h1")], "snapshot_id string, sha256 string"))
    R = claims.REASONS
    found = {(r["query_id"], r["metric"]): r["reasons"] for r in got.collect()}
    assert found == {("q1", "m"): [], ("q0", "m"): [R[0]], ("q2", "other"): [R[1], R[2], R[3]], ("q3", "m"): [R[4]], ("q4", "m"): [R[5], R[6]], (None, None): [R[0]]}
    changed = claims.prove_sources(told.where("query_id = 'q1'"), queries, runs, spark.createDataFrame([("s1", "h0")], "snapshot_id string, sha256 string"))
    assert [r["reasons"] for r in changed.collect()] == [[R[7]]] * 2
    assert [r["reasons"] for r in claims.prove_sources(told.where("query_id = 'q1'"), queries, runs, spark.createDataFrame([], "snapshot_id string, sha256 string")).collect()] == [[R[7]]] * 2


def test_looks_add_up(spark):
    rng = np.random.default_rng(4)
    rows = [(int(d), str(a), bool(rng.random() < (0.5 if a == "treatment" else 0.2))) for d in range(30) for a in rng.choice(["treatment", "control", "other"], 40)]
    rows = [r for r in rows if not (r[0] == 0 and r[1] == "control")] + [(None, "control", True)]  # at first an arm is empty
    df = spark.createDataFrame(rows, "day int, arm string, converted boolean").repartition(3)
    got = looks(df, "day", "arm", "converted", Design({"control": 0.5, "treatment": 0.5})).orderBy("day").collect()
    assert [r["look"] for r in got] == list(range(1, 31)) and got[0]["z"] is None and not got[0]["significant"]
    stopped = False
    for r in got:
        so_far = [x for x in rows if x[0] is not None and x[0] <= r["day"]]
        counts = [sum(x[1] == arm and (x[2] or not conv) for x in so_far) for arm in ("treatment", "control") for conv in (True, False)]
        assert [r["s_a"], r["n_a"], r["s_b"], r["n_b"]] == counts and r["level"] == pytest.approx(0.05 / r["look"])
        if r["z"] is not None:
            assert r["p_value"] == pytest.approx(K.two_proportion(*counts)["p_value"])
        stopped = stopped or r["significant"]
        assert r["stop"] == stopped
    assert stopped


def test_normality_of_all_groups(spark):
    rng = np.random.default_rng(5)
    groups = {f"n{n}": rng.normal(size=n) for n in (3, 4, 5, 6, 11, 12, 400)} | {"skew": rng.exponential(size=200), "ties": rng.integers(0, 5, 90).astype(float), "large": rng.exponential(size=6000)}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("flat", 2.0)] * 5 + [("two", 1.0), ("two", 2.0), ("n3", None), (None, 1.0)]
    got = {r["grp"]: r for r in normality.normality(spark.createDataFrame(rows, "g string, x double").repartition(4), "g", "x").collect()}
    assert set(got) == {*groups, "flat", "two"} and got["flat"]["p_value"] is None and got["two"]["statistic"] is None
    for g, v in groups.items():
        d = v - v.mean()
        want = K.shapiro_wilk(list(v)) if len(v) <= 5000 else K.k_squared(len(v), (d**3).mean() / (d**2).mean() ** 1.5, (d**4).mean() / (d**2).mean() ** 2 - 3)
        assert (got[g]["statistic"], got[g]["p_value"]) == pytest.approx(want, rel=1e-6, abs=1e-12), g
    assert got["skew"]["p_value"] < 0.001 and got["n400"]["p_value"] > 0.01 and got["large"]["test"] == "k_squared"


def test_normality_query_of_large_groups(spark, tmp_path, monkeypatch):
    """The query takes W whatever a group's size, as its SQL does; ties are cut into runs."""
    from tallywell.plans.audit_queries import normality_shapiro

    monkeypatch.setattr(normality, "RUN", 7, raising=False)
    rng = np.random.default_rng(6)
    nations = {0: rng.normal(size=5200).round(3), 1: rng.exponential(size=5001), 2: rng.normal(size=60), 3: rng.integers(0, 30, 5100).astype(float)}
    rows = [(k, float(x)) for k, v in nations.items() for x in v]
    spark.createDataFrame(rows, "c_nationkey int, c_acctbal double").repartition(3).write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["grp"]: r for r in normality_shapiro(spark, str(tmp_path)).collect()}
    for k, v in nations.items():
        assert got[k]["n"] == len(v) and (got[k]["statistic"], got[k]["p_value"]) == pytest.approx(K.shapiro_wilk(list(v)), abs=2e-6)
