"""Queries over performance, integrity and quality tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import pit, report, temporal
from ..sources import tables as V
from . import research

oracle = V.oracle


def periods(spark: SparkSession, sf: str) -> DataFrame:
    """Each market's returns from quarter to quarter: of its mean close, and as benchmark of the mean of all."""
    p = V.prices(spark, sf).withColumn("q", F.last_day(F.add_months(F.trunc("price_date", "quarter"), 2)))
    own = p.groupBy(F.col("country").alias("market"), "q").agg(F.avg("close").alias("m"))
    whole = p.groupBy("q").agg(F.avg("close").alias("b"))
    w = Window.partitionBy("market").orderBy("q")
    r = own.join(whole, "q").select("market", F.col("m").alias("level"), F.lag("q").over(w).alias("start_date"), F.col("q").alias("end_date"), (F.col("m") / F.lag("m").over(w) - 1).alias("net_return"), (F.col("b") / F.lag("b").over(w) - 1).alias("benchmark_return"))
    return r.where("start_date is not null").withColumn("gross_return", F.col("net_return") + 0.001)


PERIODS = """SELECT market, level, start_date, end_date, net_return, net_return + 0.001::DOUBLE AS gross_return, benchmark_return FROM (SELECT market, m AS level, lag(q) OVER w AS start_date, q AS end_date, m / lag(m) OVER w - 1 AS net_return, b / lag(b) OVER w - 1 AS benchmark_return
    FROM (SELECT country AS market, last_day(date_trunc('quarter', price_date)::DATE + INTERVAL 2 MONTH) AS q, avg(close) AS m FROM prices GROUP BY ALL) JOIN (SELECT last_day(date_trunc('quarter', price_date)::DATE + INTERVAL 2 MONTH) AS q, avg(close) AS b FROM prices GROUP BY ALL) USING (q) WINDOW w AS (PARTITION BY market ORDER BY q)) WHERE start_date IS NOT NULL"""


def a15_compound_returns(spark: SparkSession, sf: str) -> DataFrame:
    return periods(spark, sf).groupBy("market", F.year("end_date").alias("y")).agg(F.round(report.compound(F.col("net_return")), 6).alias("net"), F.round(report.compound(F.col("benchmark_return")), 6).alias("benchmark"))


def w9_growth_and_drawdown(spark: SparkSession, sf: str) -> DataFrame:
    return report.growth_and_drawdown(periods(spark, sf), ["market"]).select("market", "end_date", *[F.round(c, 6).alias(c) for c in ("growth", "peak", "drawdown")])


GROWTH = """SELECT *, growth / peak - 1 AS drawdown FROM (SELECT *, greatest(1, max(growth) OVER (PARTITION BY market ORDER BY end_date)) AS peak FROM (SELECT *, product(1 + net_return) OVER (PARTITION BY market ORDER BY end_date) AS growth FROM periods))"""


def r3_a20_run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Of each market, with costs in parts of its level, the spread of its three best names over the others, and what its universe rejects."""
    p = periods(spark, sf).withColumns({"total": F.col("level") * 0.001, "slippage": F.col("level") * 0.0006, "sell_tax": F.col("level") * 0.0004})
    top = F.col("rank_in_country") <= 3
    rows = research.factor_rows(spark, sf).where("rank_in_country is not null")
    spread = F.avg(F.when(top, F.col("factor_value"))) - F.avg(F.when(~top, F.col("factor_value")))
    spreads = rows.groupBy(F.col("country").alias("market"), "as_of_date").agg(spread.alias("spread"))
    universe = research.assembled(spark, sf).groupBy(F.substring("security_id", 1, 2).alias("market"), "as_of_date").agg(F.count_if(F.size("reasons") > 0).alias("out"), F.count_if(F.size("reasons") == 0).alias("n"))
    checks = universe.groupBy("market").agg(F.count_if(F.col("n") < 3).alias("fallback_count"), F.sum("out").alias("rejected_candidates"))
    s = report.run_summary(p, ["market"], spreads, checks)
    shown = ["years", "net", "gross", "benchmark", "active", "max_drawdown", "active_positive_ratio", "net_annualised", "benchmark_annualised", "alpha", "total_sum", "slippage_sum", "sell_tax_sum", "mean_spread"]
    return s.select("market", "periods", "active_positive_quarters", "positive_spreads", "spreads", "fallback_count", "rejected_candidates", *[F.round(c, 6).alias(c) for c in shown])


R3 = """SELECT market, periods, active_positive_quarters, coalesce(positive_spreads, 0) AS positive_spreads, coalesce(spreads, 0) AS spreads, fallback_count, rejected_candidates::BIGINT AS rejected_candidates, round(periods / 4, 6) AS years, round(net, 6) AS net, round(gross, 6) AS gross, round(benchmark, 6) AS benchmark, round(net - benchmark, 6) AS active, round(max_drawdown, 6) AS max_drawdown,
    round(active_positive_quarters / periods, 6) AS active_positive_ratio, round(pow(1 + net, 4 / periods) - 1, 6) AS net_annualised, round(pow(1 + benchmark, 4 / periods) - 1, 6) AS benchmark_annualised, round(pow(1 + net, 4 / periods) - pow(1 + benchmark, 4 / periods), 6) AS alpha,
    round(levels * 0.001::DOUBLE, 6) AS total_sum, round(levels * 0.0006::DOUBLE, 6) AS slippage_sum, round(levels * 0.0004::DOUBLE, 6) AS sell_tax_sum, round(mean_spread, 6) AS mean_spread
    FROM (SELECT market, count(*) AS periods, product(1 + net_return) - 1 AS net, product(1 + gross_return) - 1 AS gross, product(1 + benchmark_return) - 1 AS benchmark, min(drawdown) AS max_drawdown, count(*) FILTER (WHERE net_return > benchmark_return) AS active_positive_quarters, sum(level) AS levels FROM growth GROUP BY market)
    LEFT JOIN (SELECT country AS market, count(*) FILTER (WHERE spread > 0) AS positive_spreads, count(spread) AS spreads, avg(spread) AS mean_spread FROM (
        SELECT country, as_of_date, avg(factor_value) FILTER (WHERE rank_in_country <= 3) - avg(factor_value) FILTER (WHERE rank_in_country > 3) AS spread FROM (SELECT *, row_number() OVER (PARTITION BY as_of_date, country ORDER BY factor_value DESC, security_id) AS rank_in_country FROM factors) GROUP BY ALL) GROUP BY ALL) USING (market)
    LEFT JOIN (SELECT market, count(*) FILTER (WHERE n < 3) AS fallback_count, sum(o) AS rejected_candidates FROM (SELECT security_id[1:2] AS market, as_of_date, count(*) FILTER (WHERE reasons = '') AS n, count(*) FILTER (WHERE reasons <> '') AS o FROM pit GROUP BY ALL) GROUP BY ALL) USING (market)"""


def r1_attribution(spark: SparkSession, sf: str) -> DataFrame:
    fx = V.fx(spark, sf).where("month(fx_date) <> 6 or year(fx_date) <> 1999")
    a = report.attribution(periods(spark, sf), fx)
    return a.select("market", "start_date", "end_date", *[F.round(c, 6).alias(c) for c in ("fx_return", "net_usd", "gross_usd", "benchmark_usd", "net_fx_part", "active_net_krw", "active_net_usd")], "error")


R1 = """SELECT market, start_date, end_date, round(fx, 6) AS fx_return, round((1 + net_return) / (1 + fx) - 1, 6) AS net_usd, round((1 + gross_return) / (1 + fx) - 1, 6) AS gross_usd, round((1 + benchmark_return) / (1 + fx) - 1, 6) AS benchmark_usd, round((1 + net_return) / (1 + fx) * fx, 6) AS net_fx_part,
    round(net_return - benchmark_return, 6) AS active_net_krw, round((net_return - benchmark_return) / (1 + fx), 6) AS active_net_usd, CASE WHEN a IS NULL THEN 'rate missing at the start' WHEN b IS NULL THEN 'rate missing at the end' END AS error
    FROM (SELECT p.*, x.rate AS a, y.rate AS b, y.rate / x.rate - 1 AS fx FROM periods p LEFT JOIN usd x ON x.fx_date = start_date LEFT JOIN usd y ON y.fx_date = end_date)"""


def v6_fold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    dates = V.days(spark, sf).select(F.col("d").alias("as_of_date"))
    folds = temporal.walkforward_folds(dates, "1995-06-30", "2001-10-31", train=2, test=1)
    return report.fold_metrics(folds, periods(spark, sf), ["market"]).select("fold_index", "market", "n", *[F.round(c, 6).alias(c) for c in ("portfolio", "benchmark", "active")])


V6 = """SELECT fold_index, market, n, round(p, 6) AS portfolio, round(b, 6) AS benchmark, round(p - b, 6) AS active FROM (SELECT f::INT AS fold_index, market, count(start_date) FILTER (WHERE hit) AS n, coalesce(product(1 + net_return) FILTER (WHERE hit) - 1, 0) AS p, coalesce(product(1 + benchmark_return) FILTER (WHERE hit) - 1, 0) AS b
    FROM (SELECT *, start_date >= a AND end_date <= b AS hit FROM periods, (SELECT i AS f, (DATE '1997-06-30' + to_years(i::INT))::DATE AS a, ((DATE '1997-06-30' + to_years(i::INT + 1))::DATE - 1) AS b FROM range(0, 4) r(i))) GROUP BY ALL)"""


def v6_fold_callback(spark: SparkSession, sf: str) -> DataFrame:
    """A function of the user's over all folds: the information ratio and hit rate of each market's active returns in the test years."""
    dates = V.days(spark, sf).select(F.col("d").alias("as_of_date"))
    folds = temporal.walkforward_folds(dates, "1995-06-30", "2001-10-31", train=2, test=1)

    def ratio(inside: DataFrame) -> DataFrame:
        active = F.col("net_return") - F.col("benchmark_return")
        each = inside.groupBy("fold_index", "market").agg(F.count("*").alias("n"), F.avg(active).alias("mean"), F.stddev_samp(active).alias("spread"), F.avg((active > 0).cast("double")).alias("hits"))
        return each.select("fold_index", "market", "n", F.round(2 * F.col("mean") / F.nullif("spread", F.lit(0.0)), 5).alias("information_ratio"), F.round("hits", 6).alias("hits"))

    return report.over_folds(folds, periods(spark, sf), "end_date", ratio, "market string, n long, information_ratio double, hits double")


V6_CALLBACK = """SELECT f::INT AS fold_index, market, count(*) AS n, round(2 * avg(x) / nullif(stddev_samp(x), 0), 5) AS information_ratio, round(avg((x > 0)::INT), 6) AS hits FROM (SELECT *, net_return - benchmark_return AS x FROM periods)
    JOIN (SELECT i AS f, (DATE '1997-06-30' + to_years(i::INT))::DATE AS a, ((DATE '1997-06-30' + to_years(i::INT + 1))::DATE - 1) AS b FROM range(0, 4) r(i)) ON end_date BETWEEN a AND b GROUP BY ALL"""


def a14_rd_coverage(spark: SparkSession, sf: str) -> DataFrame:
    expected = V.securities(spark, sf).select("country", "security_id")
    observed = V.fundamentals(spark, sf).where("rd_expense > 150000 and year(period_end) = 1998 and quarter(period_end) = 2")
    return report.coverage_gate(report.coverage(expected, observed), {"US": 0.2, "KR": 0.05}).select("country", "expected", "observed", F.round("ratio", 6).alias("ratio"), "passes")


A14 = """SELECT country, expected, observed, round(observed / expected, 6) AS ratio, observed / expected + 1e-12 >= CASE country WHEN 'US' THEN 0.2 WHEN 'KR' THEN 0.05 ELSE 0 END AS passes FROM (
    SELECT s.country, count(*) AS expected, count(f.security_id) AS observed FROM securities s LEFT JOIN (SELECT DISTINCT security_id FROM fundamentals WHERE rd_expense > 150000 AND year(period_end) = 1998 AND quarter(period_end) = 2) f USING (security_id) GROUP BY s.country)"""


def a17_latest_holdings(spark: SparkSession, sf: str) -> DataFrame:
    """Each sector's last quarter, by country."""
    f = V.fundamentals(spark, sf).join(V.securities(spark, sf).select("security_id", "sector"), "security_id")
    h = f.select("sector", F.col("period_end").alias("as_of_date"), "country", (F.col("sales_ttm") / F.sum("sales_ttm").over(Window.partitionBy("sector", "period_end"))).alias("weight"), F.col("sales_ttm").alias("market_value"))
    return report.latest_holdings(h, ["sector"]).select("sector", "as_of_date", "country", "n", F.round("weight", 6).alias("weight"), F.round("market_value", 2).alias("market_value"))


A17 = """SELECT sector, period_end AS as_of_date, f.country, count(*) AS n, round(sum(sales_ttm) / any_value(t), 6) AS weight, round(sum(sales_ttm), 2) AS market_value FROM (SELECT f.*, sector, sum(sales_ttm) OVER (PARTITION BY sector, period_end) AS t, max(period_end) OVER (PARTITION BY sector) AS last FROM fundamentals f JOIN securities USING (security_id)) f WHERE period_end = last GROUP BY ALL"""


def _selected(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship rows, of which the first five of each country count as selected."""
    return research.factor_rows(spark, sf).withColumn("is_selected", F.col("rank_in_country") <= 5)


def a18_factor_integrity(spark: SparkSession, sf: str) -> DataFrame:
    i = report.factor_integrity(_selected(spark, sf), ["as_of_date"])
    return i.select("as_of_date", "country", "eligible", "selected", *[F.round(c, 6).alias(c) for c in ("median", "selected_mean", "other_mean", "spread", "above_median", "top_quarter")])


A18_CTE = """SELECT *, rank_in_country <= 5 AS s, rank_in_country <= greatest(1, (count(*) OVER (PARTITION BY as_of_date, country) + 3) // 4) AS top, median(factor_value) OVER (PARTITION BY as_of_date) AS med FROM (
    SELECT *, row_number() OVER (PARTITION BY as_of_date, country ORDER BY factor_value DESC, security_id) AS rank_in_country FROM factors)"""
A18 = """SELECT as_of_date, country, count(*) AS eligible, count(*) FILTER (WHERE s) AS selected, round(median(factor_value), 6) AS median, round(avg(factor_value) FILTER (WHERE s), 6) AS selected_mean, round(avg(factor_value) FILTER (WHERE NOT s), 6) AS other_mean,
    round(avg(factor_value) FILTER (WHERE s) - avg(factor_value) FILTER (WHERE NOT s), 6) AS spread, round(avg((factor_value >= med)::INT) FILTER (WHERE s), 6) AS above_median, round(avg(top::INT) FILTER (WHERE s), 6) AS top_quarter FROM flagged GROUP BY GROUPING SETS ((as_of_date), (as_of_date, country))"""


def a19_integrity_summary(spark: SparkSession, sf: str) -> DataFrame:
    i = report.factor_integrity(_selected(spark, sf), ["as_of_date"]).withColumn("y", F.year("as_of_date"))
    return report.integrity_summary(i, ["y"]).select("y", "dates", "positive", *[F.round(c, 6).alias(c) for c in ("mean_spread", "above_median", "top_quarter")])


A19 = f"""SELECT year(as_of_date)::INT AS y, count(*) AS dates, count(*) FILTER (WHERE x > 0) AS positive, round(avg(x), 6) AS mean_spread, round(avg(a), 6) AS above_median, round(avg(t), 6) AS top_quarter FROM (SELECT as_of_date, avg(factor_value) FILTER (WHERE s) - avg(factor_value) FILTER (WHERE NOT s) AS x, avg((factor_value >= med)::INT) FILTER (WHERE s) AS a, avg(top::INT) FILTER (WHERE s) AS t FROM flagged GROUP BY as_of_date) GROUP BY ALL"""


def j15_market_alignment(spark: SparkSession, sf: str) -> DataFrame:
    got = report.market_alignment(periods(spark, sf).where("market <> 'JP' or year(end_date) <> 1998"), ["US", "KR", "JP"])
    return got.select("start_date", "end_date", *[F.round(c, 6).alias(c.lower()) for c in ("US", "KR", "JP")])


J15 = "SELECT start_date, end_date, round(max(net_return) FILTER (WHERE market = 'US'), 6) AS us, round(max(net_return) FILTER (WHERE market = 'KR'), 6) AS kr, round(max(net_return) FILTER (WHERE market = 'JP' AND year(end_date) <> 1998), 6) AS jp FROM periods WHERE market <> 'JP' OR year(end_date) <> 1998 GROUP BY ALL"


def j16_frame_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Fundamentals against a copy of which some rows are off or gone."""
    f = V.fundamentals(spark, sf).select("security_id", "period_end", "rd_expense", "sales_ttm")
    off = f.where("quarter(period_end) <> 2 or security_id not like '%7'").withColumn("sales_ttm", F.when(F.col("security_id").like("%3"), F.col("sales_ttm") * 1.0001 + 1).otherwise(F.col("sales_ttm") + 1e-9))
    return report.frame_diff(f, off, ["security_id", "period_end"], ["rd_expense", "sales_ttm"])


J16 = """SELECT v AS value, count(*) AS n_left, count(*) FILTER (WHERE NOT gone) AS n_right, count(*) FILTER (WHERE NOT gone AND (v = 'rd_expense' OR security_id NOT LIKE '%3')) AS n_matching FROM (SELECT *, quarter(period_end) = 2 AND security_id LIKE '%7' AS gone FROM fundamentals), (VALUES ('rd_expense'), ('sales_ttm')) t(v) GROUP BY v"""


def j17_baseline_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Line counts of each year's quarters as run times, against the years before them."""
    runs = V.fundamentals(spark, sf).groupBy("country", F.year("period_end").alias("y")).agg(F.count("*").cast("double").alias("seconds"))
    base = runs.select("country", (F.col("y") + 1).alias("y"), "seconds")
    return report.baseline_deltas(runs, base, ["country", "y"]).select("country", "y", "seconds", "base_seconds", "delta", F.round("speed_up", 6).alias("speed_up"), "status")


J17 = """SELECT a.country, a.y::INT AS y, a.n AS seconds, b.n AS base_seconds, a.n - b.n AS delta, round((b.n - a.n) / b.n, 6) AS speed_up, CASE WHEN b.n IS NULL THEN 'no_baseline' WHEN a.n <= b.n THEN 'matched_faster' ELSE 'matched_slower' END AS status FROM runs a LEFT JOIN runs b ON a.country = b.country AND a.y = b.y + 1"""


def q1_non_finite(spark: SparkSession, sf: str) -> DataFrame:
    f = V.fundamentals(spark, sf).withColumn("ratio", F.when(F.col("sales_ttm") == 0, F.lit(float("nan"))).otherwise(F.col("rd_expense") / F.greatest("sales_ttm", F.lit(1.0))))
    return report.non_finite_counts(f)


def q1_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their lines, each with a map of measures, some of which are no numbers or infinite."""
    line = V.table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_linenumber", F.col("l_extendedprice").cast("double").alias("p"))
    whole = F.when(F.col("l_quantity") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("p"))
    unit = F.when(F.col("l_quantity") % 7 == 0, F.lit(float("-inf"))).otherwise(F.col("p"))
    row = F.struct("l_linenumber", F.create_map(F.lit("whole"), whole, F.lit("none"), F.lit(None).cast("double")).alias("values"), F.struct(F.array(unit, F.col("p")).alias("parts")).alias("detail"))
    orders = line.groupBy("l_orderkey").agg(F.collect_list(row).alias("lines"), F.max(F.when(F.col("l_linenumber") == 7, F.lit(float("inf"))).otherwise(F.lit(1.0))).alias("top"))
    return report.nested_non_finite(orders)


Q1_NESTED = """SELECT unnest(['lines[].values{}', 'lines[].detail.parts[]', 'top']) AS path, unnest([count(*) FILTER (WHERE l_quantity % 5 = 0), count(*) FILTER (WHERE l_quantity % 7 = 0), count(DISTINCT l_orderkey) FILTER (WHERE l_linenumber = 7)]) AS n FROM lineitem"""


def q2_data_quality(spark: SparkSession, sf: str) -> DataFrame:
    f = V.fundamentals(spark, sf)
    return report.data_quality({"fundamentals": f, "prices": V.prices(spark, sf), "constituents": V.constituents(spark, sf), "negative_sales": f.where("sales_ttm < 0")})


def q4_policy_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as runs: their keys choose models and options, their balances limits, some of which are off."""
    k = F.col("s_suppkey")
    models = F.array(*[F.lit(m) for m in [*report.DENOMINATORS, "book_to_price"]])
    config = V.table(spark, sf, "supplier").select(
        k.alias("portfolio_id"), F.element_at(models, (k % 6 + 1).cast("int")).alias("factor_model"), (F.col("s_acctbal") / 20000).alias("sector_active_band"), (k % 4 != 0).alias("size_stratification"), F.when(k % 9 != 0, 0.05).alias("te_active_l2_cap"),
        (F.lit(0.1) * (k % 10)).alias("max_adv_participation"), (F.col("s_acctbal") / 5000).alias("max_turnover"), (k % 7 != 0).alias("staggered_sleeves"), (k % 5).alias("sleeve_count"),
        F.when(k % 3 == 0, "start_date").otherwise("quarter_end").alias("anchor_requested"), F.lit("quarter_end").alias("anchor_effective"), F.when(k % 11 != 0, k % 2 == 0).alias("phase_lock_quarter_end"),
    )
    return report.policy_alignment(config, ["portfolio_id"])


Q4 = """SELECT k AS portfolio_id, ['sales_ttm', 'sales_size_proxy', 'mktcap_proxy', 'ev_proxy', 'robust_composite', 'unknown'][k % 6 + 1] AS denominator,
    unnest(['model_in_rd_family', 'benchmark_relative_sector_band_enabled', 'size_stratification_enabled', 'te_constraint_enabled', 'adv_participation_constraint_enabled', 'turnover_constraint_enabled', 'staggered_sleeves_enabled', 'phase_lock_workaround_used']) AS rule,
    unnest([CASE WHEN k % 6 = 5 THEN 'fail' ELSE 'pass' END, CASE WHEN b > 0 THEN 'pass' ELSE 'fail' END, CASE WHEN k % 4 = 0 THEN 'fail' ELSE 'pass' END, CASE WHEN k % 9 = 0 THEN 'fail' ELSE 'pass' END, CASE WHEN k % 10 = 0 THEN 'fail' ELSE 'pass' END, CASE WHEN b > 0 THEN 'pass' ELSE 'fail' END,
        CASE WHEN k % 7 = 0 OR k % 5 < 2 THEN 'fail' ELSE 'pass' END, CASE WHEN k % 3 = 0 AND k % 2 = 0 AND k % 11 <> 0 THEN 'warning' ELSE 'pass' END]) AS status FROM (SELECT s_suppkey AS k, s_acctbal AS b FROM supplier)"""


def q5_status_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return report.status_rollup(q4_policy_alignment(spark, sf), ["portfolio_id"])


def p6_accepted_by_country(spark: SparkSession, sf: str) -> DataFrame:
    return pit.accepted(research.assembled(spark, sf)).groupBy("as_of_date", "country").agg(F.count("*").alias("n"), F.round(F.sum("rd_expense"), 2).alias("rd"))


_ALL = [a15_compound_returns, w9_growth_and_drawdown, r3_a20_run_summary, r1_attribution, v6_fold_metrics, v6_fold_callback, a14_rd_coverage, a17_latest_holdings, a18_factor_integrity, a19_integrity_summary, j15_market_alignment, j16_frame_diff, j17_baseline_deltas, q1_non_finite, q1_nested, q2_data_quality, q4_policy_alignment, q5_status_rollup, p6_accepted_by_country]
QUERIES = {f.__name__: f for f in _ALL}
_P, _F = {"periods": PERIODS, "growth": GROWTH}, {**research.PIT, "factors": research.FACTOR, "flagged": A18_CTE}
SQL = {
    "a15_compound_returns": oracle("SELECT market, year(end_date)::INT AS y, round(product(1 + net_return) - 1, 6) AS net, round(product(1 + benchmark_return) - 1, 6) AS benchmark FROM periods GROUP BY ALL", _P),
    "w9_growth_and_drawdown": oracle("SELECT market, end_date, round(growth, 6) AS growth, round(peak, 6) AS peak, round(drawdown, 6) AS drawdown FROM growth", _P),
    "r3_a20_run_summary": oracle(R3, {**_P, **_F}),
    "r1_attribution": oracle(R1, {**_P, "usd": "SELECT * FROM fx WHERE pair = 'USD/KRW' AND (month(fx_date) <> 6 OR year(fx_date) <> 1999)"}),
    "v6_fold_metrics": oracle(V6, _P),
    "v6_fold_callback": oracle(V6_CALLBACK, _P),
    "a14_rd_coverage": oracle(A14),
    "a17_latest_holdings": oracle(A17),
    "a18_factor_integrity": oracle(A18, _F),
    "a19_integrity_summary": oracle(A19, _F),
    "j15_market_alignment": oracle(J15, _P),
    "j16_frame_diff": oracle(J16),
    "j17_baseline_deltas": oracle(J17, {"runs": "SELECT country, year(period_end) AS y, count(*)::DOUBLE AS n FROM fundamentals GROUP BY ALL"}),
    "q1_non_finite": oracle("SELECT unnest(['rd_expense', 'sales_ttm', 'ratio']) AS column_name, unnest([0, 0, count(*) FILTER (WHERE sales_ttm = 0)]) AS n FROM fundamentals"),
    "q1_nested": Q1_NESTED,
    "q2_data_quality": oracle("SELECT o AS output, n AS rows, CASE WHEN n > 0 THEN 'pass' ELSE 'fail' END AS status FROM (SELECT 'fundamentals' AS o, count(*) AS n FROM fundamentals UNION ALL SELECT 'prices', count(*) FROM prices UNION ALL SELECT 'constituents', count(*) FROM constituents UNION ALL SELECT 'negative_sales', count(*) FROM fundamentals WHERE sales_ttm < 0)"),
    "q4_policy_alignment": Q4,
    "q5_status_rollup": f"SELECT portfolio_id, count(*) AS signals, CASE max(CASE status WHEN 'pass' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END) WHEN 0 THEN 'pass' WHEN 1 THEN 'warning' ELSE 'fail' END AS status FROM ({Q4}) GROUP BY portfolio_id",
    "p6_accepted_by_country": oracle("SELECT as_of_date, country, count(*) AS n, round(sum(rd_expense), 2) AS rd FROM accepted GROUP BY ALL", research.PIT),
}
