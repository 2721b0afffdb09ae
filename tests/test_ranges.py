"""As-of joins over ranges, quantiles by counts, overlap listings, folds with a callback and the reports' rules, on random and small input."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.operators import factor, report, temporal

DAY = dt.date(2020, 1, 1)
day = lambda n: DAY + dt.timedelta(days=n)


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_ranged_as_of_join_equals_the_window_form(spark, ranges):
    r = random.Random(ranges)
    left = [(r.choice(["hot", "hot", "hot", "a", "b", None]), day(r.randint(0, 60)), i) for i in range(500)] + [("hot", day(30), 1000 + i) for i in range(300)]
    right = [(r.choice(["hot", "a", "c"]), day(r.randint(0, 60)), r.choice([None, r.random()])) for _ in range(60)]
    a, b = spark.createDataFrame(left, "k string, d date, i int"), spark.createDataFrame(right, "k string, x date, v double")
    shown = lambda df: sorted(map(repr, df.select("k", "d", "i", "asof_date", "v").collect()))
    plain = temporal.asof_backward(a, b, ["k"], "d", "x", ["v"])
    assert shown(temporal.asof_backward(a, b, ["k"], "d", "x", ["v"], ranges=ranges)) == shown(plain) and plain.count() == len(left)


def test_a_hot_key_is_spread_over_ranges(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(temporal, "saved", lambda df, name, own=temporal.saved: kept.append(own(df, name)) or kept[-1])
    left = spark.range(2000).select(F.lit("hot").alias("k"), F.lit(day(5)).alias("d"), "id")
    right = spark.createDataFrame([("hot", day(1), 1.0)], "k string, x date, v double")
    got = temporal.asof_backward(left, right, ["k"], "d", "x", ["v"], ranges=8)
    assert got.where("v = 1").count() == 2000
    sizes = [r["count"] for r in kept[0].groupBy("_part").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 800


def test_quantiles_by_counts_are_those_of_numpy(spark):
    r = random.Random(5)
    rows = []
    for g in range(6):
        n = [1, 2, 7, 100, 400, 50][g]
        for _ in range(n):
            v = [r.random(), r.choice([1.0, 2.0]), -(10.0 ** r.uniform(-300, 300)), r.gauss(0, 1), float(r.randint(0, 3)), 1.7e308 * r.uniform(-1, 1)][g]
            rows.append((g, v))
    rows += [(0, None), (9, None)]
    at = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    for ranges in (2, 1024):
        got = {x["g"]: x["q"] for x in factor.exact_quantiles(spark.createDataFrame([x for x in rows if ranges > 2 or x[0] in (1, 2, 4)], "g int, v double"), ["g"], "v", at, ranges).collect()}
        for g, q in got.items():
            own = sorted(v for x, v in rows if x == g and v is not None)
            with np.errstate(over="ignore"):
                for p, x in zip(at, q):
                    k = int((len(own) - 1) * p)
                    a, b = own[k], own[min(k + 1, len(own) - 1)]
                    want = a if (len(own) - 1) * p == k else a + (b - a) * ((len(own) - 1) * p - k)
                    assert x == pytest.approx(want, rel=1e-12) or not np.isfinite(want), (g, p)
        assert len(got) == (6 if ranges > 2 else 3)
    frame = spark.createDataFrame([(g, v) for g, v in rows if g in (0, 3, 9)], "g int, factor_value double")
    shown = lambda df: sorted(map(repr, df.collect()))
    assert shown(factor.winsorize(frame, ["g"], low=0.1, high=0.8)) == shown(factor.winsorize(frame, ["g"], low=0.1, high=0.8, by_ranges=True))


def test_overlaps_list_windows_within_a_long_one(spark):
    rows = [("u", day(1), day(100)), ("u", day(2), day(3)), ("u", day(50), day(60)), ("u", day(101), None), ("u", day(400), day(401)), ("v", day(5), day(5)), ("v", day(6), day(9))]
    got = temporal.overlaps(spark.createDataFrame(rows, "k string, effective_from date, effective_to date"), ["k"]).collect()
    assert {(x["k"], x["effective_from"], x["previous_start"], x["previous_end"]) for x in got} == {("u", day(2), day(1), day(100)), ("u", day(50), day(1), day(100)), ("u", day(400), day(101), dt.date(9999, 12, 31))}
    r = random.Random(2)
    many = [(r.choice("xyz"), day(a), day(a + r.randint(0, 12))) for a in (r.randint(0, 200) for _ in range(120))]
    got = temporal.overlaps(spark.createDataFrame(many, "k string, effective_from date, effective_to date"), ["k"])
    order = {k: sorted((a, b) for x, a, b in many if x == k) for k in "xyz"}
    want = sum(any(b2 >= a for _, b2 in own[:i]) for own in order.values() for i, (a, _) in enumerate(own))
    assert got.count() == want


def test_a_metric_over_folds_is_checked_before_it_runs(spark):
    folds = spark.createDataFrame([(0, day(0), day(9), day(10), day(19)), (1, day(10), day(19), day(20), day(29)), (2, day(100), day(109), day(110), day(119))], "fold_index int, train_start date, train_end date, test_start date, test_end date")
    rows = spark.createDataFrame([(day(i), float(i)) for i in range(40)], "d date, x double")
    mean = lambda df: df.groupBy("fold_index").agg(F.avg("x").alias("m"))
    assert {(r["fold_index"], r["m"]) for r in report.over_folds(folds, rows, "d", mean, "m double").collect()} == {(0, 14.5), (1, 24.5), (2, None)}
    assert {(r["fold_index"], r["m"]) for r in report.over_folds(folds, rows, "d", mean, "m double", "train").collect()} == {(0, 4.5), (1, 14.5), (2, None)}
    with pytest.raises(ValueError, match="gives"):
        report.over_folds(folds, rows, "d", mean, "m long")
    with pytest.raises(ValueError, match="gives"):
        report.over_folds(folds, rows, "d", lambda df: df.agg(F.avg("x").alias("m")), "m double")


def test_alignment_follows_each_setting(spark):
    fine = {"factor_model": "rnd_ev_proxy", "sector_active_band": 0.05, "size_stratification": True, "te_active_l2_cap": 0.05, "max_adv_participation": 0.1, "max_turnover": 0.3, "staggered_sleeves": True, "sleeve_count": 2, "anchor_requested": "quarter_end", "anchor_effective": "quarter_end", "phase_lock_quarter_end": True}
    schema = "run string, factor_model string, sector_active_band double, size_stratification boolean, te_active_l2_cap double, max_adv_participation double, max_turnover double, staggered_sleeves boolean, sleeve_count int, anchor_requested string, anchor_effective string, phase_lock_quarter_end boolean"
    cases = {"fine": {}, "model": {"factor_model": "value"}, "band": {"sector_active_band": 0.0}, "size": {"size_stratification": False}, "te": {"te_active_l2_cap": None}, "adv": {"max_adv_participation": 0.0}, "turnover": {"max_turnover": -1.0}, "sleeves": {"sleeve_count": 1}, "lock": {"anchor_requested": "start_date"}, "no lock": {"anchor_requested": "start_date", "phase_lock_quarter_end": False}}
    rows = [(name, *{**fine, **change}.values()) for name, change in cases.items()]
    each = report.policy_alignment(spark.createDataFrame(rows, schema), ["run"])
    whole = {r["run"]: r["status"] for r in report.status_rollup(each, ["run"]).collect()}
    assert whole == {name: "warning" if name == "lock" else "pass" if name in ("fine", "no lock") else "fail" for name in cases}
    assert each.where("status <> 'pass'").count() == 8 and each.where("run = 'model'").first()["denominator"] == "unknown"


def test_summary_counts_quarters_that_beat_the_benchmark(spark):
    rows = [("m", day(90 * i), 0.02, 0.021, b, 5.0, 2.0) for i, b in enumerate((0.01, 0.03, 0.02, -0.01))]
    periods = spark.createDataFrame(rows, "market string, end_date date, net_return double, gross_return double, benchmark_return double, total double, slippage double")
    spreads = spark.createDataFrame([("m", 0.1), ("m", -0.2), ("m", None)], "market string, spread double")
    got = report.run_summary(periods, ["market"], spreads, spark.createDataFrame([("m", 3, 7, "pass")], "market string, fallback_count int, rejected_candidates int, quality_status string")).first()
    assert (got["active_positive_quarters"], got["active_positive_ratio"], got["total_sum"], got["slippage_sum"]) == (2, 0.5, 20.0, 8.0)
    assert (got["positive_spreads"], got["spreads"], round(got["mean_spread"], 9), got["fallback_count"], got["quality_status"]) == (1, 2, -0.05, 3, "pass")
