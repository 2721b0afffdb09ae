from __future__ import annotations

import datetime as dt
import random

import pytest

from factorloom.operators import ledger as L

DAYS = [dt.date(2020, m, 28) for m in (3, 6, 9, 12)]


def inputs(spark, seed=1, empty=None):
    r = random.Random(seed)
    about = {"US:1": ("US", "USD"), "KR:1": ("KR", "KRW"), "JP:1": ("JP", "JPY")}
    prices = [(d, s, *about[s], r.uniform(50, 150)) for d in DAYS for s in about]
    rows = []
    for d in DAYS:
        raw = {s: r.random() for s in about}
        rows += [("p", d, s, x / sum(raw.values())) for s, x in raw.items()] if d != empty else [("p", d, None, None)]
    return (
        spark.createDataFrame(rows, "portfolio_id string, as_of_date date, security_id string, weight double"),
        spark.createDataFrame(prices, "price_date date, security_id string, country string, currency string, price_krw double"),
        rows,
        {(d, s): p for d, s, _, _, p in prices},
    )


def slow(rows, price, nav0, rates):
    """The rule by hand for one portfolio: a dictionary of positions, date by date."""
    cash, pos, out = nav0, {}, []
    for a, b in zip(DAYS, DAYS[1:]):
        nav = cash + sum(q * price[a, s] for s, (q, _) in pos.items())
        want = {s: w for _, d, s, w in rows if d == a and s}
        paid = 0.0
        moves = {s: nav * want.get(s, 0.0) - (pos[s][0] * price[a, s] if s in pos else 0.0) for s in sorted(set(pos) | set(want))}
        for s, x in moves.items():
            if x < -1e-9:
                q, c = pos[s]
                n = min(-x, q * price[a, s])
                gain = max(0.0, (price[a, s] - c) * n / price[a, s])
                cost = n * (rates["commission"] + rates["slippage"] + (0 if s[:2] == "KR" else rates["fx_fee"])) + (n * rates["kr_sell_tax"] if s[:2] == "KR" else 0) + gain * {"US": rates["us_gains_tax"], "JP": rates["jp_gains_tax"], "KR": 0}[s[:2]]
                cash, paid, left = cash + n - cost, paid + cost, q - n / price[a, s]
                pos[s] = (left, c)
                if left <= 1e-12:
                    del pos[s]
        for s, x in moves.items():
            if x > 1e-9:
                q, c = pos.get(s, (0.0, 0.0))
                cost = x * (rates["commission"] + rates["slippage"] + (0 if s[:2] == "KR" else rates["fx_fee"]))
                n = x / price[a, s]
                cash, paid, pos[s] = cash - x - cost, paid + cost, (q + n, (q * c + x) / (q + n))
        end = cash + sum(q * price[b, s] for s, (q, _) in pos.items())
        out.append((a, nav, end, paid))
    return out


@pytest.mark.parametrize("empty", [None, DAYS[2]])
def test_fold_follows_the_rule(spark, empty):
    alloc, prices, rows, price = inputs(spark, empty=empty)
    rates = L.costs(commission=0.0005, fx_fee=0.001)
    got = sorted(L.run_ledger(alloc, prices, ["portfolio_id"], 1e6, {"commission": 0.0005, "fx_fee": 0.001}).where("kind = 'period'").collect(), key=lambda x: x["start_date"])
    want = slow(rows, price, 1e6, rates)
    assert len(got) == 3
    for x, (d, nav, end, paid) in zip(got, want):
        assert x["start_date"] == d and abs(x["start_nav"] - nav) < 1e-6 and abs(x["end_nav"] - end) < 1e-6 and abs(x["total"] - paid) < 1e-6
        assert abs(x["gross_return"] - x["net_return"] - paid / nav) < 1e-12


def test_one_period_as_sets_equals_the_fold(spark):
    alloc, prices, rows, price = inputs(spark, seed=2)
    whole = L.run_ledger(alloc, prices, ["portfolio_id"], 1e6)
    held = whole.where(f"kind = 'holding' and end_date = '{DAYS[1]}'").selectExpr("portfolio_id", "security_id", "quantity", "avg_cost")
    period = whole.where(f"kind = 'period' and end_date = '{DAYS[1]}'").first()
    cash = period["end_nav"] - sum(r["quantity"] * price[DAYS[1], r["security_id"]] for r in held.collect())
    now = prices.where(f"price_date = '{DAYS[1]}'")
    marked = L.mark(held, spark.createDataFrame([("p", cash)], "portfolio_id string, cash double"), now, ["portfolio_id"])
    deltas = L.trade_deltas(marked, alloc.where(f"as_of_date = '{DAYS[1]}'"), marked.select("portfolio_id", "nav").distinct(), ["portfolio_id"])
    t = L.trade_costs(deltas.join(now.select("security_id", "country", "currency", "price_krw"), "security_id").join(held.select("security_id", "avg_cost"), "security_id", "left"))
    sets = {r["security_id"]: (r["side"], round(r["notional"], 6), round(r["total"], 6)) for r in t.collect()}
    fold = {r["security_id"]: (r["side"], round(r["notional"], 6), round(r["total"], 6)) for r in whole.where(f"kind = 'trade' and start_date = '{DAYS[1]}'").collect()}
    assert sets == fold
    rolled = {r["security_id"]: round(r["quantity"], 8) for r in L.roll(held, t, ["portfolio_id"]).collect()}
    assert rolled == {r["security_id"]: round(r["quantity"], 8) for r in whole.where(f"kind = 'holding' and end_date = '{DAYS[2]}'").collect()}


def test_costs_are_checked():
    with pytest.raises(ValueError):
        L.costs(slippage=2.0)
    with pytest.raises(ValueError):
        L.costs(unknown=0.1)


def test_a_missing_price_is_an_error_unless_carried(spark):
    alloc, prices, _, _ = inputs(spark, seed=4)
    gap = prices.where(f"not (price_date = '{DAYS[1]}' and security_id = 'JP:1')")
    with pytest.raises(Exception, match="no price on 2020-06-28 of JP:1"):
        L.run_ledger(alloc, gap, ["portfolio_id"]).collect()
    sides = {r["side"] for r in L.run_ledger(alloc, gap, ["portfolio_id"], carry=True).where(f"kind = 'trade' and start_date = '{DAYS[1]}' and security_id = 'JP:1'").collect()}
    assert len(sides) == 1 and sides.pop().endswith(" carried")
    with pytest.raises(Exception, match="no price on 2020-03-28 of JP:1"):
        L.run_ledger(alloc, prices.where("security_id <> 'JP:1'"), ["portfolio_id"], carry=True).collect()


def test_periods_meet_their_benchmark(spark):
    periods = spark.createDataFrame([(DAYS[0], DAYS[1], 0.1), (DAYS[1], DAYS[2], 0.0), (DAYS[2], DAYS[3], 0.0)], "start_date date, end_date date, net_return double")
    levels = spark.createDataFrame([(DAYS[0], 100.0), (DAYS[1], 105.0), (DAYS[3], 90.0)], "benchmark_date date, level double")
    got = {r["start_date"]: (r["benchmark_return"], r["active_return"]) for r in L.with_benchmark(periods, levels).collect()}
    assert abs(got[DAYS[0]][0] - 0.05) < 1e-12 and abs(got[DAYS[0]][1] - 0.05) < 1e-12 and got[DAYS[1]] == got[DAYS[2]] == (None, None)
