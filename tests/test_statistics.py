import math

import numpy as np
import pytest

from tallywell.functions import kernels as K
from tallywell.operators import groups, shift
from tallywell.operators.groups import group_counts, hodges_lehmann, k_anonymity, rank_sums, require_k_anonymity
from tallywell.plans import experiments as E
from tallywell.plans import statistics as S

A, B = [10, 12, 9, 11, 13, 10, 12, 11], [8, 9, 7, 10, 8, 9, 7, 8]


@pytest.mark.parametrize("counts,diff,z,p,low,high", [
    ((325, 650, 217, 650), 0.166153846, 6.075208474, 1.2383e-9, 0.113316245, 0.218991447),
    ((460, 1000, 500, 1000), -0.04, -1.790287185, 0.073407755, -0.083755949, 0.003755949),
    ((560, 1000, 500, 1000), 0.06, 2.688124560, 0.007185459, 0.016331932, 0.103668068),
])
def test_two_proportions(counts, diff, z, p, low, high):
    r = K.two_proportion(*counts)
    got = r["effect"]["value"], r["statistic"]["z"], r["p_value"], *r["effect"]["ci"]
    assert got == pytest.approx((diff, z, p, low, high), rel=1e-4)


def test_kernels_against_the_jvm(spark):
    jvm = spark._jvm.org.apache.commons.math3.distribution
    from tallywell.functions import special

    for df in (1.5, 7.0, 40.0):
        t = jvm.TDistribution(df)
        assert special.t_two_sided(2.3, df) == pytest.approx(2 * (1 - t.cumulativeProbability(2.3)), rel=1e-9)
        assert special.t_quantile(0.975, df) == pytest.approx(t.inverseCumulativeProbability(0.975), rel=1e-7)
        assert special.chi2_tail(9.1, df) == pytest.approx(1 - jvm.ChiSquaredDistribution(df).cumulativeProbability(9.1), rel=1e-8)
    for a, b in ((2.0, 5.0), (100.0, 3.0), (0.5, 0.5)):
        assert special.beta_quantile(0.3, a, b) == pytest.approx(jvm.BetaDistribution(a, b).inverseCumulativeProbability(0.3), rel=1e-6)
    n = jvm.BinomialDistribution(50, 0.3)
    own = sum(n.probability(i) for i in range(51) if n.probability(i) <= n.probability(22) * (1 + 1e-7))
    assert special.binomial_two_sided(22, 50, 0.3) == pytest.approx(own, rel=1e-9)
    own = sum(n.probability(i) for i in range(51) if n.probability(i) <= n.probability(9) * (1 + 1e-7))
    assert special.binomial_two_sided(9, 50, 0.3) == pytest.approx(own, rel=1e-9)


def test_exact_rank_distribution_by_enumeration():
    from itertools import combinations

    n, m = 4, 5
    us = [sum(c) - n * (n - 1) // 2 for c in combinations(range(n + m), n)]
    for u in range(n * m + 1):
        far = max(u, n * m - u)
        assert K._exact_u(far, n, m) == pytest.approx(2 * sum(x >= far for x in us) / len(us))


def test_fisher_by_enumeration():
    total = sum(math.comb(8, k) * math.comb(8, 12 - k) for k in range(4, 9))
    p = sum(math.comb(8, k) * math.comb(8, 12 - k) for k in range(4, 9) if math.comb(8, k) * math.comb(8, 12 - k) <= math.comb(8, 7) * math.comb(8, 5)) / total
    assert K.fisher(7, 8, 5, 8)["p_value"] == pytest.approx(p)


def test_rates():
    r = K.poisson_rates(120, 1000, 100, 1000)
    assert r["effect"]["value"] == pytest.approx(1.2) and r["effect"]["ci"][0] < 1.2 < r["effect"]["ci"][1] and r["unchecked"] == ["overdispersion"]
    assert K.negative_binomial(120, 1000, 100, 1000)["effect"]["value"] == pytest.approx(1.2)
    with pytest.raises(K.StatInputError):
        K.poisson_rates(0, 1, 0, 1)
    with pytest.raises(K.StatInputError):
        K.negative_binomial(0, 1, 3, 1)


def test_normality():
    # a symmetric sample looks normal, a heavy tail doesn't
    w, p = K.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert (w, p) == pytest.approx((0.79, 0.0070), abs=0.01)  # Royston's published example
    assert K.shapiro_wilk([-1.2, -0.7, -0.4, -0.1, 0.1, 0.4, 0.7, 1.2])[1] > 0.5
    assert K.k_squared(10_000, 0.0, 0.0)[1] > 0.9 and K.k_squared(10_000, 0.5, 0.0)[1] < 1e-6


def test_samples_from_spark_equal_samples_from_lists(spark):
    df = spark.createDataFrame([("a", float(x)) for x in A] + [("b", float(x)) for x in B] + [("a", None)], "g string, x double")
    one, two = S.Sample.of(df, "g", "x"), S.Sample.of_values(A, B)
    for f in ("n", "mean", "var", "skew", "kurt", "u", "tie_sum", "shift"):
        assert getattr(one, f) == pytest.approx(getattr(two, f)), f
    for method in ("welch_t_test", "mann_whitney"):
        assert S.analyze("continuous", "two_group", "research", sample=one, method=method)["result"]["p_value"] < 0.05


def test_ranks_and_shift(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 2.0), ("b", 3.0)], "g string, x double")
    assert {r["grp"]: r["rank_sum"] for r in rank_sums(df, "g", "x").collect()} == {"a": 3.5, "b": 6.5}
    assert hodges_lehmann(df, "g", "x", "a", "b") == pytest.approx(-1.0)


def test_shift_is_exact_beyond_the_pairs_that_are_formed(spark, monkeypatch):
    rng = np.random.default_rng(3)

    def check(a, b):
        df = spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b] + [("a", None)], "g string, x double").repartition(3)
        got, want = hodges_lehmann(df, "g", "x", "a", "b"), float(np.median(np.subtract.outer(a, b)))
        assert got == want or np.isnan(got) and np.isnan(want), (got, want)

    check(rng.normal(size=2100), rng.exponential(size=2101))
    monkeypatch.setattr(shift, "RANKS", 20)
    for formed in (0, 50):
        monkeypatch.setattr(shift, "FORMED", formed)
        check(np.array([-1e308, 1e308, 5e-324, 0.0, *range(8)]), np.array([1e308, -1e308, 0.1, 3.0, 3.0, np.inf]))
    check(rng.integers(0, 40, 300), rng.integers(-9, 60, 201))  # few differences, often
    check(10.0 ** rng.integers(-300, 300, 90), -(10.0 ** rng.integers(-300, 300, 70)))  # spread over all magnitudes
    assert hodges_lehmann(spark.createDataFrame([("a", 1.0)], "g string, x double"), "g", "x", "a", "b") is None


def test_least_partner_of_odd_sums():
    rng = np.random.default_rng(4)
    p = np.concatenate([rng.normal(size=200) * 10.0 ** rng.integers(-20, 20, 200), [1e16, -1e16, 1e308, -1e308, 0.0, 5e-324]])
    for t in (0.0, 1e16, -1e16, 0.1, -3.7e-9, 1e308, -1e308, 5e-324, np.inf, -np.inf):
        b = shift.least_partner(p, t)
        with np.errstate(over="ignore", invalid="ignore"):
            assert (p - b <= t).all()
            below = np.nextafter(b, -np.inf)
            assert ((p - below > t) | (below < -1.7e308)).all()


def test_selected_places_of_weighted_values(spark, monkeypatch):
    monkeypatch.setattr(shift, "FORMED", 30)
    monkeypatch.setattr(shift, "RANKS", 10)
    rng = np.random.default_rng(5)
    x, y = (np.unique(rng.normal(size=n).round(3)) for n in (120, 77))
    w, v = (rng.integers(1, 10**6, len(z)) for z in (x, y))
    one, two = (spark.createDataFrame([(float(p), int(n)) for p, n in zip(*z, strict=True)], "x double, w long").repartition(3) for z in ((x, w), (y, v)))
    d, m = np.subtract.outer(x, y).ravel(), np.multiply.outer(w, v).ravel()
    order = np.argsort(d)
    upto = np.cumsum(m[order])
    selection = shift.Selection(one, two)
    for k in (0, int(upto[-1]) // 3, int(upto[-1]) - 1):
        assert selection.at(k) == d[order][np.searchsorted(upto, k, "right")]


def test_a_pass_meets_few_blocks(spark, monkeypatch):
    """What a pass sends grows with the blocks of the sides, not with its pivots or the pairs of blocks."""
    monkeypatch.setattr(shift, "FORMED", 100)
    monkeypatch.setattr(shift, "BLOCK", 4)
    monkeypatch.setattr(shift, "RANKS", 60)
    rng = np.random.default_rng(8)
    x, y = np.unique(rng.normal(size=500).round(2) * 10), np.unique(rng.exponential(size=400).round(3))
    one, two = (spark.createDataFrame([(float(p), 3) for p in z], "x double, w long").repartition(3) for z in (x, y))
    selection, met = shift.Selection(one, two), []
    own = selection._met
    monkeypatch.setattr(selection, "_met", lambda spans: met.append(len({(r, c) for a, b in spans for r in range(len(a)) for c in range(a[r], b[r])})) or own(spans))
    d = np.sort(np.subtract.outer(x, y).ravel())
    k = 9 * len(d) // 2
    assert selection.at(k) == d[k // 9]
    blocks = len(selection.lo) + len(selection.low)
    assert blocks > 60 and 0 < len(met) < 12 and max(met) <= 4 * blocks < len(selection.lo) * len(selection.low)


def test_exact_ranks_of_few_against_many(monkeypatch):
    from itertools import combinations

    for n, m in ((2, 4), (4, 3), (5, 5), (1, 7)):
        us = [sum(r - i for i, r in enumerate(c)) for c in combinations(range(n + m), n)]
        for u in range(n * m + 1):
            high = max(u, n * m - u)
            want = min(1.0, 2 * sum(x >= high for x in us) / len(us))
            assert K.mann_whitney(float(u), n, m, 0, 0.0)["p_value"] == pytest.approx(want) == K.mann_whitney(float(u), m, n, 0, 0.0)["p_value"]
    exact = [K.mann_whitney(q * 3 * 4000, 4000, 3, 0, 0.0)["p_value"] for q in (0.5, 0.8, 0.95)]
    monkeypatch.setattr(K, "EXACT_CELLS", 10)
    assert [K.mann_whitney(q * 3 * 4000, 4000, 3, 0, 0.0)["p_value"] for q in (0.5, 0.8, 0.95)] == pytest.approx(exact, rel=3e-3)
    assert 0 < K.mann_whitney(2.9 * 5e6, 5_000_000, 3, 0, 0.0)["p_value"] < 1e-3  # ends at once


def test_colours():
    g = S.analyze("binary", "rct", "research", counts=(460, 1000, 500, 1000))
    y = S.analyze("binary", "two_group", "research", counts=(460, 1000, 500, 1000))
    r = S.analyze("binary", "two_group", "research", counts=(7, 8, 5, 8), research_mode=True)
    assert [x["status"] for x in (g, y, r)] == ["GREEN", "YELLOW", "RED"]
    assert "warning" in y["result"] and r["result"] is None and r["method"]["diagnosis"]["items"][0]["check"] == "expected_cell_counts"
    assert S.analyze("binary", "two_group", "research", counts=(7, 8, 5, 8), method="fisher")["status"] == "RED"


def test_registry():
    with pytest.raises(S.MethodError):
        S.analyze("binary", "rct", "research", counts=(1, 2, 1, 2), method="welch_t_test")
    with pytest.raises(S.MethodError, match="not implemented"):
        S.analyze("binary", "rct", "research", counts=(1, 2, 1, 2), method="logistic")
    r = S.MethodRegistry()
    before = r.fingerprint()
    r.register_family("ordinal", "rct", ["welch_t_test"])
    assert r.fingerprint() != before
    r.freeze()
    with pytest.raises(S.FrozenError):
        r.register_family("x", "y", ["z"])


def test_replay():
    source = {"query_id": "q", "run_id": "r", "snapshot_id": "s"}
    c = S.analyze("binary", "rct", "research", counts=(560, 1000, 500, 1000), source=source, period="p")
    assert {x["period"]: x["value"] for x in c["claims"]} == S.replay_stat(c, counts=(560, 1000, 500, 1000))
    assert S.replay_stat(c, counts=(561, 1000, 500, 1000))["p#effect"] != c["claims"][0]["value"]


def test_required_sizes():
    assert [K.required_per_group(b, 0.08) for b in (0.5, 0.46, 0.56)] == [609, 613, 588]


def units(spark, *arms):
    """Units of (arm, converted, total)."""
    parts = [spark.range(n).selectExpr(f"'{arm}' as arm", f"if(id < {yes}, 'yes', 'no') as converted") for arm, yes, n in arms]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.unionByName(spark.createDataFrame([(None, "yes")], "arm string, converted string"))


def test_experiment(spark):
    design = E.Design({"control": 0.5, "treatment": 0.5})
    even = units(spark, ("control", 500, 1000), ("treatment", 560, 1000))
    rails = spark.createDataFrame([("g", "not_increase", 0.0)], "name string, direction string, threshold double")
    values = spark.createDataFrame([("g", 1.0, 1.5)], "name string, baseline double, variant double")
    plain = E.evaluate(even, "arm", "converted", design)
    assert plain.conclusion["status"] == "GREEN" and plain.significant and plain.verdict == "significant"
    assert plain.conclusion["result"]["p_value"] == pytest.approx(0.007185459) and plain.ratio.observed == {"control": 1000, "treatment": 1000}
    guarded = E.evaluate(even, "arm", "converted", design, rails, values)
    assert guarded.broken == ["g"] and guarded.verdict == "a guardrail is broken"
    with pytest.raises(E.SampleRatioMismatch):
        E.evaluate(units(spark, ("control", 500, 5000), ("treatment", 560, 4000)), "arm", "converted", design)
    peeked = E.evaluate(even, "arm", "converted", E.Design(design.weights, looks=10))
    assert not peeked.significant and peeked.design.level == pytest.approx(0.005)
    small = E.evaluate(units(spark, ("control", 4, 5), ("treatment", 3, 5)), "arm", "converted", design)
    assert small.verdict == "no numbers: premises fail" and small.conclusion["result"] is None
    for bad in ({"looks": 0}, {"variant": "other"}, {"variant": "control"}):
        with pytest.raises(ValueError):
            E.Design(design.weights, **bad)
    with pytest.raises(ValueError):
        E.evaluate(even, "arm", "converted", design, rails)
    with pytest.raises(ValueError):
        E.sample_ratio(even, "arm", {"control": 0.5, "b": 0.5})


def test_ranks_and_medians_over_ranges(spark):
    """Sums that cross ranges: many partitions, ties, infinite and null values, against numpy."""
    rng = np.random.default_rng(4)
    values = [*rng.integers(0, 90, 700).astype(float).tolist(), float("inf"), float("-inf"), 1e300]
    rows = [(("a", "b", "c")[i % 3], v) for i, v in enumerate(values)] + [("a", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        ranks = {r["x"]: r["rank"] for r in groups.value_ranks(df, "g", "x").collect()}
        mids = {r["grp"]: r["median"] for r in groups.medians(df, "g", "x").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    every = np.sort(values)
    assert ranks == {v: (np.searchsorted(every, v) + 1 + np.searchsorted(every, v, "right")) / 2 for v in set(values)}
    assert mids == {g: float(np.median([v for h, v in rows if h == g and v is not None])) for g in "abc"}


def test_counts_and_privacy(spark):
    rows = [("a", "1", "x", 1), ("a", "no", "x", 1), ("b", "TRUE", "y", 2), ("b", None, "y", 2), (None, "1", "y", 2)]
    df = spark.createDataFrame(rows, "arm string, converted string, city string, age int")
    assert group_counts(df, "arm", "converted").first()[:] == (1, 2, 1, 2)
    assert k_anonymity(df, ["city", "age"], 2)["satisfied"] and k_anonymity(df.limit(0), ["city"], 5)["min_group"] == 0
    with pytest.raises(PermissionError):
        require_k_anonymity(df, ["city", "age"], 3)
    with pytest.raises(ValueError):
        k_anonymity(df, ["city; drop"], 2)
    with pytest.raises(ValueError):
        group_counts(df.replace("a", "c", "arm"), "arm", "converted")
