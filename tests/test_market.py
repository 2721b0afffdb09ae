from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from factorloom.functions import casts as X
from factorloom.operators import canonical, factor, filings, money, pit, report, temporal

D = dt.date


def test_windows_hold_both_ends_and_overlaps_are_found(spark):
    w = spark.createDataFrame([("u", "A", D(2026, 1, 1), D(2026, 1, 31), False), ("u", "A", D(2026, 2, 1), None, True), ("u", "B", D(2026, 1, 1), D(2026, 1, 10), False), ("u", "B", D(2026, 1, 10), None, True)], "universe string, security_id string, effective_from date, effective_to date, is_current boolean")
    dates = spark.createDataFrame([(D(2025, 12, 31),), (D(2026, 1, 1),), (D(2026, 1, 31),), (D(2026, 2, 1),)], "as_of_date date")
    got = {(r["as_of_date"], r["security_id"]) for r in temporal.membership_asof(w, dates).collect()}
    assert got == {(d, s) for d in (D(2026, 1, 1), D(2026, 1, 31), D(2026, 2, 1)) for s in "AB"}
    assert [r["security_id"] for r in temporal.overlaps(w, ["universe", "security_id"]).collect()] == ["B"]
    assert temporal.window_errors(w).where("error is not null").count() == 0


def test_walk_forward_has_eleven_folds(spark):
    dates = spark.createDataFrame([(D(y, m, d),) for y in range(2000, 2016) for m, d in ((1, 1), (12, 31))], "as_of_date date")
    folds = temporal.walkforward_folds(dates, "2000-01-01", "2015-12-31").orderBy("fold_index").collect()
    assert [r["fold_index"] for r in folds] == list(range(11)) and folds[0]["test_start"] == D(2005, 1, 1)
    assert temporal.leaking_folds(temporal.walkforward_folds(dates, "2000-01-01", "2015-12-31")).count() == 0
    assert temporal.year_steps("2016-02-29", "2019-01-01", 1) == ["2016-02-29", "2017-02-28", "2018-02-28"]


def test_schedule_keeps_the_anchor_day(spark):
    trading = spark.createDataFrame([("US", D(2020, m, d)) for m in range(1, 13) for d in (1, 15, 28)] + [("US", D(2020, 1, 31)), ("US", D(2020, 7, 31))], "market string, trading_date date")
    span = spark.createDataFrame([("US", D(2020, 1, 31), D(2020, 12, 31))], "market string, start date, end date")
    got = sorted(r["as_of_date"] for r in temporal.rebalance_schedule(span, trading).collect())
    assert got == [D(2020, 1, 31), D(2020, 4, 28), D(2020, 7, 31), D(2020, 10, 28)]


def test_rates(spark):
    fx = spark.createDataFrame([("usd/krw", D(2026, 1, 2), 1300.0), ("USD/KRW", D(2026, 1, 6), 1310.0), ("USD/JPY", D(2026, 1, 2), 150.0)], "pair string, fx_date date, rate double")
    days = spark.createDataFrame([(D(2026, 1, 1),), (D(2026, 1, 5),), (D(2026, 1, 6),)], "d date")
    got = {r["d"]: (r["usd_krw"], r["usd_jpy"]) for r in money.rates_on_or_before(days, fx, "d").collect()}
    assert got == {D(2026, 1, 1): (None, None), D(2026, 1, 5): (1300.0, 150.0), D(2026, 1, 6): (1310.0, 150.0)}
    assert money.duplicate_rates(fx.union(fx.limit(1))).count() == 1


def test_liquidity_gate_and_reasons(spark):
    windows = spark.createDataFrame([("u", s, D(2020, 1, 1), None, True) for s in ("ok", "low", "none", "late", "bad")], "universe string, security_id string, effective_from date, effective_to date, is_current boolean")
    dates = spark.createDataFrame([(D(2026, 3, 31),)], "as_of_date date")
    f = spark.createDataFrame([(s, "us", D(2025, 12, 31), D(2026, 2, 15), 100.0, 1000.0) for s in ("ok", "low", "none")] + [("late", "us", D(2026, 3, 1), D(2026, 3, 20), 1.0, 1.0), ("bad", "us", D(2025, 12, 31), D(2026, 2, 15), None, 0.0), ("ok", "us", D(2026, 3, 1), D(2026, 4, 1), 9.0, 9.0)], "security_id string, country string, period_end date, filing_date date, rd_expense double, sales_ttm double")
    values = {"ok": (400e3, 500e3, 600e3), "low": (200e3, 220e3, 240e3), "bad": (1e9, 1e9, 1e9)}
    prices = spark.createDataFrame([(s, "USD", D(2026, 3, 27 + i), v) for s, vs in values.items() for i, v in enumerate(vs)], "security_id string, currency string, price_date date, traded_value double")
    fx = spark.createDataFrame([("USD/KRW", D(2026, 3, 27 + i), 1300.0) for i in range(3)], "pair string, fx_date date, rate double")
    got = {r["security_id"]: (r["reasons"], r["median_traded_value_krw"]) for r in pit.assemble(windows, dates, f, prices, fx).collect()}
    assert got["ok"] == ([], 650_000_000.0) and got["low"][0] == ["INVESTABILITY_BELOW_THRESHOLD"] and got["none"][0] == ["NO_PRICE_DATA"]
    assert got["late"][0] == ["FILING_LAG_NOT_MET"] and got["bad"][0] == ["MISSING_RD_EXPENSE", "NON_POSITIVE_SALES_TTM"]
    with pytest.raises(ValueError):
        pit.assert_pit(f.withColumn("as_of_date", F.lit(D(2026, 3, 31))))


def test_factor_ties_rank_by_id(spark):
    rows = spark.createDataFrame([("b", "US", 15.0, 100.0), ("a", "US", 30.0, 200.0), ("c", "US", 50.0, 100.0), ("z", "US", 1.0, 0.0), ("n", "US", 1.0, -1.0), ("m", "US", None, 9.0)], "security_id string, country string, rd_expense double, sales_ttm double").withColumn("as_of_date", F.lit(D(2026, 1, 1)))
    got = {r["security_id"]: (r["rank_in_country"], r["eligibility_reason"]) for r in factor.rank_in_country(factor.rnd_sales_factor(rows), ["as_of_date"]).collect()}
    assert got == {"c": (1, "ELIGIBLE"), "a": (2, "ELIGIBLE"), "b": (3, "ELIGIBLE"), "z": (None, "NON_POSITIVE_SALES_TTM"), "n": (None, "NON_POSITIVE_SALES_TTM"), "m": (None, "MISSING_RD_EXPENSE")}


def test_casts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    text = {"1,200.0": 1200.0, "(3.5)": -3.5, "1d": None, "1_0": None, "inf": None, "NaN": None, "1e400": None, "": None, "0": 0.0, ".5": 0.5}
    assert {t: one(X.accounting(F.lit(t))) for t in text} == text
    days = {"20251231": D(2025, 12, 31), "2026/02/10": D(2026, 2, 10), "2026-02-10T09:00": D(2026, 2, 10), "2025-1-1": None, "20251341": None}
    assert {t: one(X.any_date(F.lit(t))) for t in days} == days
    assert one(X.stock_code(F.lit("285A"))) == "285A" and one(X.stock_code(F.lit("285A"), letters=False)) == "0285" and one(X.padded_cik(F.lit("12345678901"))) is None


def test_zero_counts_as_present(spark):
    rows = spark.createDataFrame([("C1", "5930", "2026-02-20", "2025-12-31", "0", "7", "9")], "corp_code string, stock_code string, filing_date string, period_end string, rd_expense string, rnd_expense string, sales string")
    good, lost = canonical.transform_kr(rows, spark.createDataFrame([], "corp_code string, stock_code string"))
    assert good.first()["rd_expense"] == 0.0 and good.first()["security_id"] == "KRX:5930" and lost.count() == 0


def test_cost_of_sales_is_not_sales(spark):
    rows = spark.createDataFrame([("f", 0, "ifrs_CostOfSales", "매출원가", "9000", None), ("f", 1, "ifrs_Revenue", "매출액", "5,000", None), ("f", 2, "dart_RnD", "연구개발비", None, "320")], "f string, pos int, account_id string, account_nm string, amount string, amount_to_date string")
    r = filings.statement_values(rows, ["f"]).first()
    assert (r["rd_expense"], r["sales"]) == (320.0, 5000.0)


def test_keywords_in_context(spark):
    docs = spark.createDataFrame([(1, "One fish, two FISH; red fish"), (2, None), (3, "none")], "doc_id int, text string")
    got = [(r["occurrence"], r["start"], r["snippet"]) for r in filings.keyword_in_context(docs, ["fish"], 4).orderBy("start").collect()]
    assert got == [(0, 4, "One fish, tw"), (1, 14, "two FISH; re"), (2, 24, "red fish")]


def test_parts_add_up_and_frames_compare(spark):
    p = spark.createDataFrame([(D(2026, 1, 1), D(2026, 3, 31), 0.05, 0.06, 0.02), (D(2026, 3, 31), D(2026, 6, 30), 0.01, 0.02, None)], "start_date date, end_date date, net_return double, gross_return double, benchmark_return double")
    fx = spark.createDataFrame([("USD/KRW", D(2026, 1, 1), 1300.0), ("USD/KRW", D(2026, 3, 31), 1330.0), ("USD/KRW", D(2026, 6, 30), 1310.0)], "pair string, fx_date date, rate double")
    a, b = sorted(report.attribution(p, fx).collect(), key=lambda r: r["start_date"])
    assert a["error"] is None and abs(a["net_usd"] + a["net_fx_part"] - 0.05) < 1e-12 and b["error"] == "benchmark missing"
    d = report.frame_diff(p, p.withColumn("net_return", F.col("net_return") + 1e-8), ["start_date"], ["net_return", "benchmark_return"]).collect()
    assert [(r["n_left"], r["n_right"], r["n_matching"]) for r in d] == [(2, 2, 2), (2, 2, 2)]
    with pytest.raises(ValueError):
        report.require_pass(report.data_quality({"empty": p.limit(0)}))


def test_scope_and_gate_raise(spark):
    from factorloom.operators import canonical, report

    specs = spark.createDataFrame([("a", "US"), ("b", "kr")], "security_id string, country string")
    assert canonical.market_scope(specs, ["US", "KR"]).count() == 2
    with pytest.raises(ValueError, match="JP"):
        canonical.market_scope(specs, ["US", "JP"])
    said = spark.createDataFrame([("trades", "pass"), ("report", "fail")], "output string, status string")
    with pytest.raises(ValueError, match="missing outputs: holdings"):
        report.enforce_gate(report.quality_gate(["trades", "holdings"], said))
    with pytest.raises(ValueError, match="not passed: report"):
        report.enforce_gate(report.quality_gate(["trades", "report"], said))
    report.enforce_gate(report.quality_gate(["trades"], said))


def test_report_candidates(spark):
    from factorloom.operators import filings

    rows = [("a", "100", {"rd_expense": "-7"}, {"Research and development cost": "5", "Net Sales TextBlock": "900", "Cost of sales": "800"}), ("b", None, {}, {"R&D expense": "1", "RandD expense": "3", "Operating revenue": "-50", "Sales": "50"}), ("c", "x", None, None)]
    got = {r["filing_id"]: (r["rd_expense"], r["sales"]) for r in filings.report_rd_sales(spark.createDataFrame(rows, "filing_id string, net_sales string, direct map<string,string>, other map<string,string>")).collect()}
    assert got == {"a": (-7.0, 100.0), "b": (3.0, 50.0), "c": (None, None)}


def test_scores_of_models_without_sales(spark):
    from factorloom.operators import factor

    rows = spark.createDataFrame([("x", 10.0, 0.0, 1e9), ("y", 5.0, 100.0, 1e9)], "security_id string, rd_expense double, sales_ttm double, median_traded_value_krw double")
    kept = {(r["security_id"], r["model"]) for r in factor.for_their_models(factor.raw_metrics(rows)).collect()}
    assert {m for s, m in kept if s == "x"} == set(factor.MODELS) - set(factor.NEED_SALES) and {m for s, m in kept if s == "y"} == set(factor.MODELS)


def test_prices_are_pruned_unless_nothing_is_wanted(spark):
    from factorloom.operators import canonical

    prices = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "security_id string, close double")
    wanted = spark.createDataFrame([("a",), ("a",)], "security_id string")
    assert [r["security_id"] for r in canonical.prices_of(prices, wanted).collect()] == ["a"]
    assert canonical.prices_of(prices, wanted.limit(0)).count() == 2


def test_keywords_that_repeat_keep_their_places(spark):
    from factorloom.operators import filings

    text = "ab AB xx aab" + "y" * 50 + "ab"
    got = filings.keyword_in_context(spark.createDataFrame([(1, text), (2, None), (3, "none")], "doc_id long, text string"), ["ab", "x+"], 3).collect()
    want = [(k, m.start(), text[max(0, m.start() - 3) : m.end() + 3]) for k in ("ab", "x+") for m in re.finditer(k, text, re.I)]
    assert sorted((r["keyword"], r["start"], r["snippet"]) for r in got) == sorted(want) and {r["doc_id"] for r in got} == {1}
