from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from factorloom.operators import weights as W


def loop_allocation(base, cap, total):
    out, left, live = dict.fromkeys(base, 0.0), min(total, sum(cap.values())), {i for i in base if cap[i] > 0}
    while live and left > 1e-12:
        whole = sum(base[i] for i in live)
        ask = {i: left * base[i] / whole if whole > 1e-12 else left / len(live) for i in live}
        full = [i for i in live if ask[i] >= cap[i] - 1e-12]
        if not full:
            for i in live:
                out[i] += ask[i]
            return out
        for i in full:
            left -= cap[i]
            out[i] = cap[i]
            live.remove(i)
    return out


def test_capped_allocation(spark):
    r, rows, want = random.Random(3), [], {}
    for case in range(200):
        n, total = r.randint(1, 9), r.choice([0.0, 0.3, 1.0])
        base = {f"s{i}": r.choice([0.0, r.random(), r.random()]) for i in range(n)}
        cap = {i: r.choice([0.0, 0.05, r.random() / 3]) for i in base}
        want |= {(case, i): x for i, x in loop_allocation(base, cap, total).items()}
        rows += [(case, i, base[i], cap[i], total) for i in base]
    df = spark.createDataFrame(rows, "k int, security_id string, b double, c double, t double")
    got = W.capped_allocation(df, ["k"], "b", "c", F.col("t"), "w").collect()
    assert all(abs(x["w"] - want[x["k"], x["security_id"]]) < 1e-9 for x in got) and len(got) == len(want)


PF = ["portfolio_id", "as_of_date"]
DAY = dt.date(2020, 3, 31)


def ranked(spark, counts, liquidity=1e12):
    rows = [("p", DAY, f"{c}{i}", c, 1.0 - i / 10, i + 1, True, liquidity) for c, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "portfolio_id string, as_of_date date, security_id string, country string, factor_value double, rank_in_country int, is_eligible boolean, median_traded_value_krw double")


def plan(spark, targets, requested, cap=0.08):
    return spark.createDataFrame([("p", c, w, requested[c], 20, cap) for c, w in targets.items()], "portfolio_id string, country string, target double, requested int, max_holdings int, max_single double")


def construct(spark, counts, **k):
    targets = plan(spark, {"JP": 1 / 3, "KR": 1 / 3, "US": 1 / 3}, {"JP": 7, "KR": 7, "US": 6})
    rows = ranked(spark, counts)
    chosen = W.select_names(rows, targets, PF)
    budgets = W.country_budgets(chosen, targets, rows.select(*PF).distinct(), PF)
    w = W.allocate(chosen, budgets, PF, **k)
    return w.collect(), W.diagnostics(w, budgets, PF).first()


def test_twenty_names_without_flags(spark):
    w, d = construct(spark, {"JP": 9, "KR": 9, "US": 9})
    assert d["n_holdings"] == 20 and d["reasons"] == "" and d["cash"] == 0.0
    assert max(x["weight"] for x in w) <= 0.08 + 1e-12 and abs(sum(x["weight"] for x in w) - 1) < 1e-9


def test_one_country_only_is_flagged(spark):
    w, d = construct(spark, {"JP": 4})
    assert d["n_holdings"] == 4 and abs(d["cash"] - 0.68) < 1e-9
    assert set(d["reasons"].split("|")) == {"COUNTRY_CAPACITY_BIND_JP", "INSUFFICIENT_NAMES_JP", "INSUFFICIENT_NAMES_KR", "INSUFFICIENT_NAMES_US", "NO_SELECTED_NAMES_KR", "NO_SELECTED_NAMES_US", "TOTAL_UNDER_MAX_HOLDINGS", "UNALLOCATED_CASH_DUE_TO_CAPACITY"}


def test_tracking_error_limit_pulls_towards_the_benchmark(spark):
    far = lambda w: sum((x["weight"] - x["bench"]) ** 2 for x in w) ** 0.5
    free, _ = construct(spark, {"JP": 9, "KR": 9, "US": 9}, alpha=0.9)
    held, d = construct(spark, {"JP": 9, "KR": 9, "US": 9}, alpha=0.9, te_cap=0.02)
    assert far(held) < far(free) and "TE_ACTIVE_L2_CAP_BIND" in d["reasons"]


def test_turnover_chain_equals_single_steps(spark):
    r, rows = random.Random(4), []
    days = [dt.date(2020, m, 28) for m in range(1, 7)]
    for d in days:
        names = r.sample(range(12), 6)
        raw = [r.random() for _ in names]
        rows += [("p", d, f"s{i}", "US", x / sum(raw), 0.5, 1.0) for i, x in zip(names, raw)]
    df = spark.createDataFrame(rows, "portfolio_id string, as_of_date date, security_id string, country string, weight double, cap double, budget double")
    got = {}
    for x in W.turnover_chain(df, ["portfolio_id"], 0.2).collect():
        got.setdefault(x["as_of_date"], {})[x["security_id"]] = x["weight"]
    before = None
    for d in days:
        target = {x[2]: x[4] for x in rows if x[1] == d}
        if before is not None:
            t = spark.createDataFrame([("p", s, w) for s, w in target.items()], "portfolio_id string, security_id string, weight double")
            b = spark.createDataFrame([("p", s, w) for s, w in before.items()], "portfolio_id string, security_id string, weight double")
            step = {x["security_id"]: x["blended"] for x in W.turnover_step(t, b, ["portfolio_id"], 0.2).collect()}
            target = loop_allocation({s: max(0.0, step[s]) for s in target}, dict.fromkeys(target, 0.5), 1.0)
        assert all(abs(got[d].get(s, 0.0) - w) < 1e-9 for s, w in target.items()) and set(got[d]) <= set(target)
        before = got[d]


def test_sleeves(spark):
    days = [dt.date(2020, m, 1) for m in range(1, 6)]
    held = {0: {"a": 1.0}, 1: {"b": 0.5, "a": 0.3}, 2: {}, 3: {"c": 0.8}, 4: {"a": 1.0}}
    w = spark.createDataFrame([("p", days[i], s, x) for i, d in held.items() for s, x in d.items()], "p string, as_of_date date, security_id string, weight double")
    dates = spark.createDataFrame([("p", d) for d in days], "p string, as_of_date date")
    got = {}
    for x in W.sleeves(w, dates, ["p"], 3).collect():
        got.setdefault(x["as_of_date"], {})[x["security_id"]] = x["weight"]
    assert days[2] not in got
    for i in (0, 1, 3, 4):
        window = [held[j] for j in range(max(0, i - 2), i + 1)]
        mean = {s: sum(d.get(s, 0.0) for d in window) / len(window) for s in {s for d in window for s in d}}
        scale = sum(held[i].values()) / sum(mean.values())
        assert got[days[i]].keys() == mean.keys() and all(abs(got[days[i]][s] - x * scale) < 1e-12 for s, x in mean.items())


@pytest.mark.parametrize("wrong", [{"max_holdings": 0}, {"max_single": 0.0}, {"max_single": 1.1}, {"tolerance": 1.0}, {"targets": {}}, {"targets": {"US": 0.5, "KR": 0.4}}, {"targets": {"US": 1.5, "KR": -0.5}}, {"te_cap": -1.0}, {"alpha": -0.1}, {"participation": 0.0}, {"portfolio_value": 0.0}, {"max_turnover": -0.1}])
def test_parameters_out_of_range_are_refused(wrong):
    usual = {"targets": {"US": 0.6, "KR": 0.4}, "max_holdings": 20, "max_single": 0.1}
    W.check_parameters(**usual)
    with pytest.raises(ValueError):
        W.check_parameters(**{**usual, **wrong})


def test_chain_starts_from_blended_weights(spark):
    """A limit, three sleeves, two countries and a date that holds nothing, against a loop over plain dicts."""
    r, rows = random.Random(7), []
    days = [dt.date(2020, m, 28) for m in range(1, 10)]
    for d in days:
        if d.month == 5:
            continue
        for country, budget in (("US", 0.6), ("KR", 0.4)):
            names = r.sample(range(9), 4)
            raw = [r.random() for _ in names]
            rows += [("p", d, f"{country}{i}", country, budget * x / sum(raw), 0.25, budget) for i, x in zip(names, raw)]
    df = spark.createDataFrame(rows, "portfolio_id string, as_of_date date, security_id string, country string, weight double, cap double, budget double")
    dates = spark.createDataFrame([("p", d) for d in days], "portfolio_id string, as_of_date date")
    got = {}
    for x in W.turnover_chain(df, ["portfolio_id"], 0.25, 3, dates).collect():
        got.setdefault(x["as_of_date"], {})[x["security_id"]] = (x["constructed"], x["weight"], x["country"], x["binds"])
    held, ring, bound = {}, [], 0
    for d in days:
        day = [x for x in rows if x[1] == d]
        current, binds = {x[2]: x[4] for x in day}, False
        if held and current:
            names = held.keys() | current.keys()
            turnover = 0.5 * sum(abs(current.get(s, 0) - held.get(s, 0)) for s in names)
            if turnover > 0.25 + 1e-12:
                step = {s: held.get(s, 0) + 0.25 / turnover * (current.get(s, 0) - held.get(s, 0)) for s in names}
                if any(abs(step[s] - current[s]) > 1e-12 for s in current):
                    binds, target = True, current
                    current = {}
                    for country, budget in (("US", 0.6), ("KR", 0.4)):
                        own = {s: max(0.0, step[s]) for s in target if s.startswith(country)}
                        current |= loop_allocation(own, dict.fromkeys(own, 0.25), budget)
        current = {s: w for s, w in current.items() if w > 0}
        ring = [*ring, current][-3:]
        mean = {s: sum(m.get(s, 0) for m in ring) / len(ring) for m in ring for s in m}
        held = {s: x * sum(current.values()) / sum(mean.values()) for s, x in mean.items()} if current else {}
        bound += binds
        assert got.get(d, {}).keys() == held.keys()
        for s, x in held.items():
            a, b, country, flag = got[d][s]
            assert abs(a - current.get(s, 0)) < 1e-9 and abs(b - x) < 1e-9 and country == s[:2] and flag == binds
    assert 2 <= bound < 8 and days[4] not in got
