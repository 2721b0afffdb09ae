"""Queries from the point-in-time universe to weights and the ledger, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import factor, ledger, money, pit, quota, temporal, weights
from ..sources import tables as V
from ..sources.store import saved
from . import portfolio_sql as Q
from .market import AMOUNTS, BENCH, MEMBERS, SCHEDULE_RATES, _last_prices, benchmark

oracle = V.oracle
#: Securities asked for in all, and their shares by country.
TOTAL, TARGETS = 20, {"JP": 0.3, "KR": 0.3, "US": 0.4}
#: Under which the volume cap, the name cap, the pull to the benchmark and the turnover limit each count for some rows.
PORTFOLIO_VALUE = 6e8
REQUESTED = quota.requested_counts(TOTAL, TARGETS)


def assembled(spark: SparkSession, sf: str, dates: DataFrame | None = None) -> DataFrame:
    return pit.assemble(V.constituents(spark, sf), V.schedule(spark, sf) if dates is None else dates, V.fundamentals(spark, sf), V.prices(spark, sf), V.fx(spark, sf))


PIT = {
    "members": MEMBERS,
    "picked": """SELECT m.as_of_date, m.universe, m.security_id, count(*) AS n_filed, count(*) FILTER (WHERE usable) AS n_usable, arg_max(f, (filing_date, period_end)) FILTER (WHERE usable) AS f
        FROM members m JOIN (SELECT *, {'country': upper(country), 'period_end': period_end, 'filing_date': filing_date, 'rd': rd_expense, 'sales': sales_ttm} AS f FROM fundamentals) x USING (security_id),
        LATERAL (SELECT period_end + CASE country WHEN 'us' THEN 45 ELSE 60 END <= as_of_date AS usable) u WHERE filing_date <= as_of_date GROUP BY ALL""",
    "amounts": AMOUNTS,
    "traded": "SELECT as_of_date, security_id, count(*) AS n_prices, count(amount_krw) AS n_valued, median(amount_krw) AS median_krw FROM amounts JOIN schedule ON price_date <= as_of_date AND price_date >= as_of_date - 19 GROUP BY ALL",
    "pit": """SELECT as_of_date, universe, security_id, f.country AS country, f.period_end AS period_end, f.filing_date AS filing_date, f.rd AS rd_expense, f.sales AS sales_ttm, median_krw AS median_traded_value_krw,
        CASE WHEN n_filed IS NULL THEN 'NO_ELIGIBLE_FUNDAMENTALS' WHEN n_usable = 0 THEN 'FILING_LAG_NOT_MET' WHEN f.rd IS NULL OR coalesce(f.sales, 0) <= 0 THEN concat_ws('|', CASE WHEN f.rd IS NULL THEN 'MISSING_RD_EXPENSE' END, CASE WHEN coalesce(f.sales, 0) <= 0 THEN 'NON_POSITIVE_SALES_TTM' END)
        WHEN n_prices IS NULL THEN 'NO_PRICE_DATA' WHEN n_prices < 3 OR n_valued < n_prices THEN 'INVESTABILITY_DATA_ERROR' WHEN median_krw < 5e8 THEN 'INVESTABILITY_BELOW_THRESHOLD' ELSE '' END AS reasons,
        CASE WHEN n_filed > 0 AND n_usable > 0 AND f.rd IS NOT NULL AND n_prices >= 3 AND n_valued = n_prices AND median_krw >= 5e8 THEN '' ELSE 'out' END AS relaxed
        FROM members LEFT JOIN picked USING (as_of_date, universe, security_id) LEFT JOIN traded USING (as_of_date, security_id)""",
    "accepted": "SELECT * FROM pit WHERE reasons = ''",
    "seeds": "SELECT * FROM pit WHERE relaxed = ''",
}


def p1_assemble_universe(spark: SparkSession, sf: str) -> DataFrame:
    a = assembled(spark, sf)
    return a.select("as_of_date", "universe", "security_id", "country", "period_end", "filing_date", "rd_expense", "sales_ttm", F.round("median_traded_value_krw", 2).alias("median_krw"), F.array_join("reasons", "|").alias("reasons"))


def p3_pit_violations(spark: SparkSession, sf: str) -> DataFrame:
    late = pit.pit_violations(V.fundamentals(spark, sf), V.schedule(spark, sf))
    return late.groupBy("as_of_date").agg(F.count("*").alias("n"), F.min("filing_date").alias("first_filed"))


def p6_rejection_counts(spark: SparkSession, sf: str) -> DataFrame:
    """On month ends from the first year on, so that every reason occurs."""
    months = V.days(spark, sf).select(F.last_day("d").alias("as_of_date")).distinct()
    return pit.rejection_counts(assembled(spark, sf, months))


MONTHS = "SELECT DISTINCT last_day(d) AS as_of_date FROM days"


def a1_median_traded_value(spark: SparkSession, sf: str) -> DataFrame:
    got = pit.median_traded_value(V.schedule(spark, sf), V.prices(spark, sf), V.fx(spark, sf))
    return got.select("as_of_date", "security_id", "n_prices", "n_valued", F.round("median_krw", 2).alias("median_krw"))


def w1_pit_select(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.temporal import membership_asof

    return pit.pit_select(membership_asof(V.constituents(spark, sf), V.schedule(spark, sf)), V.fundamentals(spark, sf)).select("as_of_date", "security_id", "n_filed", "n_usable", "period_end", "filing_date", "rd_expense", "sales_ttm")


def factor_rows(spark: SparkSession, sf: str) -> DataFrame:
    return factor.rank_in_country(factor.winsorize(factor.rnd_sales_factor(pit.accepted(assembled(spark, sf))), ["as_of_date"]), ["as_of_date"])


def rank_by_country(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: R&D to sales at every quarter end as it was known then, winsorised, ranked in each country."""
    return factor_rows(spark, sf).select("as_of_date", "country", "security_id", F.round("factor_value", 6).alias("factor_value"), "rank_in_country")


FACTOR = "SELECT *, least(greatest(f, lo), hi) AS factor_value FROM (SELECT *, rd_expense / sales_ttm AS f, quantile_cont(rd_expense / sales_ttm, 0.01) OVER w AS lo, quantile_cont(rd_expense / sales_ttm, 0.99) OVER w AS hi FROM accepted WINDOW w AS (PARTITION BY as_of_date))"
RANKED = "SELECT as_of_date, country, security_id, round(factor_value, 6) AS factor_value, row_number() OVER (PARTITION BY as_of_date, country ORDER BY factor_value DESC, security_id)::INT AS rank_in_country FROM factors"


def g1_factor_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    f = factor.rnd_sales_factor(V.fundamentals(spark, sf))
    return f.groupBy("country", "eligibility_reason").agg(F.count("*").alias("n"), F.round(F.sum("factor_value"), 4).alias("sum_factor"))


def w3_winsorize(spark: SparkSession, sf: str) -> DataFrame:
    f = factor.winsorize(factor.rnd_sales_factor(V.fundamentals(spark, sf)), ["period_end"], low=0.1, high=0.9)
    return f.where("factor_value is not null").select("period_end", "security_id", F.round("factor_value", 8).alias("factor_value"))


def w3_winsorize_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The same bounds by counts of ranges, without a buffer that grows with a group."""
    f = factor.winsorize(factor.rnd_sales_factor(V.fundamentals(spark, sf)), ["period_end"], low=0.1, high=0.9, by_ranges=True)
    return f.where("factor_value is not null").select("period_end", "security_id", F.round("factor_value", 8).alias("factor_value"))


W3 = """SELECT period_end, security_id, round(least(greatest(f, quantile_cont(f, 0.1) OVER w), quantile_cont(f, 0.9) OVER w), 8) AS factor_value FROM (SELECT *, rd_expense / sales_ttm AS f FROM fundamentals WHERE rd_expense IS NOT NULL AND sales_ttm > 0) WINDOW w AS (PARTITION BY period_end)"""


def seed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that any model may use: models that need no sales take rows without positive sales, too."""
    return pit.accepted(pit.assemble(V.constituents(spark, sf), V.schedule(spark, sf), V.fundamentals(spark, sf), V.prices(spark, sf), V.fx(spark, sf), require_sales=False))


def scored_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = seed_rows(spark, sf).join(V.securities(spark, sf).select("security_id", "sector"), "security_id", "left").fillna({"sector": "UNKNOWN"})
    return factor.with_scores(factor.for_their_models(factor.raw_metrics(rows)), ["as_of_date", "model"])


def g3_seed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """For each date, country and model the rows that are seeded, and those of them without sales."""
    rows = factor.for_their_models(factor.raw_metrics(seed_rows(spark, sf)))
    return rows.groupBy("as_of_date", "country", "model").agg(F.count("*").alias("n"), F.count_if(F.coalesce("sales_ttm", F.lit(0.0)) <= 0).alias("n_without_sales"))


G3 = "SELECT as_of_date, country, model, count(*) AS n, count(*) FILTER (WHERE coalesce(sales_ttm, 0) <= 0) AS n_without_sales FROM raws GROUP BY ALL"


SCORES = {
    "base": "SELECT a.*, coalesce(s.sector, 'UNKNOWN') AS sector, greatest(median_traded_value_krw, 1) AS liq, greatest(ln(1 + greatest(median_traded_value_krw, 1) / 1e9), 1e-6) AS scale FROM seeds a LEFT JOIN securities s USING (security_id)",
    "raws": """SELECT * FROM (SELECT *, unnest(['rnd_sales_ttm', 'rnd_sales_size_proxy', 'rnd_mktcap_proxy', 'rnd_ev_proxy', 'rnd_robust_composite']) AS model, unnest([a, b, c, d, (a + b + c + d) / 4]) AS raw FROM (
        SELECT *, rd_expense / greatest(sales_ttm, 1e-9) AS a, rd_expense / greatest(sales_ttm, 1e-9) / scale AS b, rd_expense / liq AS c, rd_expense / (liq * (1 + scale)) AS d FROM base)) WHERE sales_ttm > 0 OR model NOT IN ('rnd_sales_ttm', 'rnd_sales_size_proxy')""",
    "sized": """SELECT *, raw / scale AS adj, max(liq) FILTER (WHERE rn = greatest(n // 3 - 1, 0) + 1) OVER w AS lo, max(liq) FILTER (WHERE rn = greatest((2 * n) // 3 - 1, 0) + 1) OVER w AS hi FROM (
        SELECT *, row_number() OVER (PARTITION BY as_of_date, model, country ORDER BY liq, security_id) AS rn, count(*) OVER (PARTITION BY as_of_date, model, country) AS n FROM raws) WINDOW w AS (PARTITION BY as_of_date, model, country)""",
    "zs": """SELECT *, CASE WHEN liq <= lo THEN 'small' WHEN liq <= hi THEN 'mid' ELSE 'large' END AS size_bucket,
        CASE WHEN stddev_pop(raw) OVER s <= 1e-12 THEN 0 ELSE (raw - avg(raw) OVER s) / stddev_pop(raw) OVER s END AS sector_z, CASE WHEN stddev_pop(adj) OVER c <= 1e-12 THEN 0 ELSE (adj - avg(adj) OVER c) / stddev_pop(adj) OVER c END AS size_z
        FROM sized WINDOW s AS (PARTITION BY as_of_date, model, country, sector), c AS (PARTITION BY as_of_date, model, country)""",
    "scores": "SELECT *, round(CASE model WHEN 'rnd_sales_ttm' THEN 0.7::DOUBLE * sector_z + 0.3::DOUBLE * size_z WHEN 'rnd_sales_size_proxy' THEN 0.4::DOUBLE * sector_z + 0.6::DOUBLE * size_z WHEN 'rnd_mktcap_proxy' THEN 0.3::DOUBLE * sector_z + 0.7::DOUBLE * size_z WHEN 'rnd_ev_proxy' THEN 0.6::DOUBLE * sector_z + 0.4::DOUBLE * size_z ELSE 0.5::DOUBLE * sector_z + 0.5::DOUBLE * size_z END, 10) AS score FROM zs",
}


def g2_raw_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = factor.for_their_models(factor.raw_metrics(seed_rows(spark, sf)))
    return rows.groupBy("as_of_date", "model", "country").agg(F.count("*").alias("n"), F.round(F.log(F.sum("raw")), 6).alias("log_sum"))


def w4_w7_scores(spark: SparkSession, sf: str) -> DataFrame:
    return scored_rows(spark, sf).select("as_of_date", "model", "security_id", "size_bucket", F.round("sector_z", 5).alias("sector_z"), F.round("size_z", 5).alias("size_z"), F.round("score", 5).alias("score"))


def a5_sector_weights(spark: SparkSession, sf: str) -> DataFrame:
    rows = pit.accepted(assembled(spark, sf)).join(V.securities(spark, sf).select("security_id", "sector"), "security_id")
    return factor.sector_weights(rows, ["as_of_date", "country"]).withColumn("weight", F.round("weight", 6))


def g5_proportional_quotas(spark: SparkSession, sf: str) -> DataFrame:
    """Eight places for each year and country, by the securities that filed in each sector."""
    f = V.fundamentals(spark, sf).join(V.securities(spark, sf).select("security_id", "sector"), "security_id")
    g = f.groupBy(F.year("period_end").alias("y"), "country", "sector").agg(F.count_distinct("security_id").alias("n"))
    return quota.proportional_quotas(g, ["y", "country"], "sector", "n", F.lit(8)).select("y", "country", "sector", "n", "quota")


def g6_quota_bounds(spark: SparkSession, sf: str) -> DataFrame:
    f = V.fundamentals(spark, sf).join(V.securities(spark, sf).select("security_id", "sector"), "security_id")
    g = f.groupBy(F.year("period_end").alias("y"), "country", "sector").agg(F.count_distinct("security_id").alias("n"), F.sum("sales_ttm").alias("s"))
    g = g.withColumn("w", F.col("s") / F.sum("s").over(Window.partitionBy("y", "country")))
    return quota.quota_bounds(g, ["y", "country"], "sector", "n", "w", F.lit(8), 0.1).select("y", "country", "sector", "n", "min_quota", "max_quota")


G6 = """SELECT y::INT AS y, country, sector, n, min_quota, max_quota FROM (SELECT *, least(greatest(0, floor(8 * greatest(0.0, w - 0.1::DOUBLE) + 1e-12)), n)::BIGINT AS min_quota, least(greatest(least(floor(8 * greatest(0.0, w - 0.1::DOUBLE) + 1e-12), n), ceil(8 * least(1.0, w + 0.1::DOUBLE) - 1e-12)), n)::BIGINT AS max_quota
    FROM (SELECT *, s / sum(s) OVER (PARTITION BY y, country) AS w FROM (SELECT year(period_end) AS y, f.country, sector, count(DISTINCT security_id) AS n, sum(sales_ttm) AS s FROM fundamentals f JOIN securities USING (security_id) GROUP BY ALL)))"""


def _flagged(spark: SparkSession, sf: str) -> DataFrame:
    return quota.ranked_rows(scored_rows(spark, sf), ["as_of_date", "model"], REQUESTED)


def g9_qepm_rank(spark: SparkSession, sf: str) -> DataFrame:
    """For five models in one plan: scores, sector minima and maxima, size strata, ranks."""
    r = _flagged(spark, sf)
    return r.select("as_of_date", "model", "country", "security_id", F.round("score", 5).alias("score"), "min_quota", "max_quota", "is_picked", "rank_in_country")


def portfolios(spark: SparkSession) -> DataFrame:
    """The grid of markets and caps; with models it makes 100 portfolios. A row for each target country."""
    rows = []
    for market, targets in (("combined", TARGETS), *((c, {c: 1.0}) for c in sorted(TARGETS))):
        for cap in (0.08, 0.1, 0.15, 0.2, 0.25):
            weights.check_parameters(targets, TOTAL, cap)
            for c, n in quota.requested_counts(TOTAL, targets).items():
                rows.append((f"{market}-{cap}", c, targets[c], n, TOTAL, cap))
    return spark.createDataFrame(rows, "plan string, country string, target double, requested int, max_holdings int, max_single double")


PF = ["portfolio_id", "as_of_date"]


def grid(spark: SparkSession) -> DataFrame:
    models = F.explode(F.array(*[F.lit(m) for m in factor.MODELS])).alias("model")
    return portfolios(spark).select("*", models).withColumn("portfolio_id", F.concat_ws("/", "model", "plan"))


def ranked_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked rows of each portfolio: a model's rows for each plan that uses it. Of a date and country no portfolio can choose beyond the first TOTAL, so others go before the rows are fanned out."""
    plans = grid(spark).select("portfolio_id", "model").distinct()
    keep = ["as_of_date", "model", "country", "security_id", "factor_value", "rank_in_country", "is_eligible", "median_traded_value_krw"]
    order = Window.partitionBy("as_of_date", "model", "country").orderBy(F.coalesce("rank_in_country", F.lit(10**9)), F.col("factor_value").desc(), "security_id")
    first = _flagged(spark, sf).select(*keep).where("is_eligible and factor_value is not null").withColumns({"_place": F.row_number().over(order), "n_available": F.count("*").over(Window.partitionBy("as_of_date", "model", "country"))}).where(F.col("_place") <= TOTAL).drop("_place")
    return saved(first, "ranked").join(temporal.dates_side(plans), "model")


def weighted_grid(spark: SparkSession, sf: str, te_cap: float = 0.05) -> tuple[DataFrame, DataFrame]:
    targets = grid(spark).drop("plan", "model")
    ranked = ranked_grid(spark, sf)
    chosen = saved(weights.select_names(ranked, targets, PF), "chosen")
    dates = ranked.select(*PF).distinct()
    budgets = weights.country_budgets(chosen, targets, dates, PF)
    return saved(weights.allocate(chosen, budgets, PF, portfolio_value=PORTFOLIO_VALUE, te_cap=te_cap), "weights"), budgets


def h1_h2_selection(spark: SparkSession, sf: str) -> DataFrame:
    chosen = weights.select_names(ranked_grid(spark, sf), grid(spark).drop("plan", "model"), PF)
    return chosen.groupBy("portfolio_id", "as_of_date", "country").agg(F.count("*").alias("n"), F.sum("rank_in_country").alias("ranks"))


def h8_capped_allocation(spark: SparkSession, sf: str) -> DataFrame:
    """Each quarter's sales shares, none above 3 percent of the whole within a country."""
    f = V.fundamentals(spark, sf).withColumn("cap", F.lit(0.03))
    out = weights.capped_allocation(f, ["period_end", "country"], "sales_ttm", "cap", F.lit(0.6), "weight")
    return out.groupBy("period_end", "country").agg(F.round(F.sum("weight"), 6).alias("total"), F.round(F.max("weight"), 6).alias("most"), F.count_if(F.col("weight") >= 0.03 - 1e-9).alias("n_full"))


def h14_portfolios(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of 100 portfolios on all dates in one plan."""
    w, _ = weighted_grid(spark, sf)
    return w.where("weight > 0").select("portfolio_id", "as_of_date", "security_id", "country", F.round("weight", 6).alias("weight"))


def h11_h12_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    w, b = weighted_grid(spark, sf)
    return weights.diagnostics(w, b, PF).select(*PF, "n_holdings", F.round("invested", 6).alias("invested"), F.round("cash", 6).alias("cash"), "reasons")


def h11_country_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """For each portfolio, date and target country the names asked for, available, selected and held, and their weight."""
    w, b = weighted_grid(spark, sf)
    available = ranked_grid(spark, sf).groupBy(*PF, "country").agg(F.max("n_available").alias("n_available"))
    return weights.country_diagnostics(w, b, available, PF).withColumns({"weight": F.round("weight", 6), "budget": F.round("budget", 6)})


def h10_turnover_step(spark: SparkSession, sf: str) -> DataFrame:
    """From each quarter's sales weights to the next quarter's, with half the turnover at most 5 percent."""
    f = V.fundamentals(spark, sf)
    w = f.withColumn("weight", F.col("sales_ttm") / F.sum("sales_ttm").over(Window.partitionBy("country", "period_end"))).select("country", F.col("period_end").alias("as_of_date"), "security_id", "weight")
    before = w.withColumn("as_of_date", F.last_day(F.add_months("as_of_date", 3)))
    dates = w.select("country", "as_of_date").distinct()
    step = weights.turnover_step(w, before.join(dates, ["country", "as_of_date"], "left_semi"), ["country", "as_of_date"], 0.05)
    return step.select("country", "as_of_date", "security_id", F.round("turnover", 6).alias("turnover"), F.round("blended", 6).alias("blended"))


H10 = """SELECT country, d AS as_of_date, security_id, round(turnover, 6) AS turnover, round(p + CASE WHEN turnover <= 0.05::DOUBLE + 1e-12 THEN 1 ELSE 0.05::DOUBLE / turnover END * (t - p), 6) AS blended FROM (SELECT *, 0.5::DOUBLE * sum(abs(t - p)) OVER (PARTITION BY country, d) AS turnover FROM (
    SELECT coalesce(a.country, b.country) AS country, coalesce(a.d, b.d) AS d, coalesce(a.security_id, b.security_id) AS security_id, coalesce(a.w, 0) AS t, coalesce(b.w, 0) AS p FROM w a FULL JOIN (SELECT country, last_day(d + INTERVAL 3 MONTH) AS d, security_id, w FROM w WHERE (country, last_day(d + INTERVAL 3 MONTH)) IN (SELECT country, d FROM w)) b ON a.country = b.country AND a.d = b.d AND a.security_id = b.security_id))"""


def _quarter_weights(spark: SparkSession, sf: str) -> DataFrame:
    f = V.fundamentals(spark, sf).where("sales_ttm > 0")
    return f.withColumn("weight", F.col("sales_ttm") / F.sum("sales_ttm").over(Window.partitionBy("country", "period_end"))).select("country", F.col("period_end").alias("as_of_date"), "security_id", "weight")


def w10_sleeve_blend(spark: SparkSession, sf: str) -> DataFrame:
    w = _quarter_weights(spark, sf)
    out = weights.sleeves(w, w.select("country", "as_of_date").distinct(), ["country"], 4)
    return out.select("country", "as_of_date", "security_id", F.round("weight", 6).alias("weight"))


W10 = """SELECT country, d AS as_of_date, security_id, round(m / sum(m) OVER (PARTITION BY country, d), 6) AS weight FROM (SELECT t.country, t.d, w.security_id, sum(w.w) AS m FROM (SELECT country, d, row_number() OVER (PARTITION BY country ORDER BY d) AS i FROM (SELECT DISTINCT country, d FROM wp)) t
    JOIN (SELECT wp.*, dense_rank() OVER (PARTITION BY country ORDER BY d) AS j FROM wp) w ON w.country = t.country AND w.j BETWEEN t.i - 3 AND t.i GROUP BY ALL)"""


def _ledger_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Portfolios with their weights as published, and a row without holdings on every other date; and prices in KRW, the last ones on or before each date of the schedule."""
    w, _ = weighted_grid(spark, sf)
    published = w.where("weight > 0").select(*PF, "security_id", F.round("weight", 6).alias("weight"))
    dates = grid(spark).select("portfolio_id").distinct().crossJoin(temporal.dates_side(V.schedule(spark, sf)))
    last = _last_prices(spark, sf).join(V.securities(spark, sf).select("security_id", "country", "currency"), "security_id")
    return dates.join(published, PF, "left").select(*PF, "security_id", "weight"), money.prices_to_krw(last.withColumnRenamed("as_of_date", "price_date"), V.fx(spark, sf), "price_date")


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark in KRW on the schedule's dates."""
    got = money.prices_to_krw(benchmark(spark, sf), V.fx(spark, sf), "benchmark_date")
    return got.select("benchmark_date", F.col("price_krw").alias("level"))


def l8_ledger_periods(spark: SparkSession, sf: str) -> DataFrame:
    """Periods of the ledgers of 100 portfolios, with the benchmark's return; values in tens of millions, as some grow beyond what a double holds in cents."""
    allocations, prices = _ledger_inputs(spark, sf)
    rows = ledger.with_benchmark(ledger.run_ledger(allocations, prices, ["portfolio_id"]).where("kind = 'period'"), _levels(spark, sf))
    return rows.select("portfolio_id", "start_date", "end_date", *[F.round(F.col(c) / 1e7, 4).alias(n) for c, n in (("start_nav", "start_nav"), ("end_nav", "end_nav"), ("total", "total_cost"))], F.round("net_return", 8).alias("net_return"), F.round("benchmark_return", 8).alias("benchmark_return"))


def a16_run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    allocations, prices = _ledger_inputs(spark, sf)
    m = ledger.run_metrics(ledger.run_ledger(allocations, prices, ["portfolio_id"]).where("kind = 'period'"), ["portfolio_id"])
    return m.select("portfolio_id", "periods", F.round(F.col("end_nav") / 1e7, 4).alias("end_nav"), F.round("cumulative_net", 4).alias("cumulative_net"), F.round("cumulative_gross", 4).alias("cumulative_gross"), F.round(F.col("total_sum") / 1e7, 4).alias("total_cost"))


def _chained(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    w, b = weighted_grid(spark, sf)
    return saved(weights.turnover_chain(w, ["portfolio_id"], Q.TURNOVER, Q.SLEEVES, b.select(*PF).distinct()), "chain"), w, b


def h14_turnover_portfolios(spark: SparkSession, sf: str) -> DataFrame:
    """The portfolios in four staggered sleeves, with half the turnover limited from what was held on the date before."""
    chain, _, _ = _chained(spark, sf)
    return chain.select(*PF, "security_id", F.round("constructed", 6).alias("constructed"), F.round("weight", 6).alias("weight"), "binds")


def h12_turnover_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """What is constructed in the chain, and every reason that counted, the turnover limit among them."""
    chain, w, b = _chained(spark, sf)
    return weights.diagnostics(w, b, PF, chain).select(*PF, "n_holdings", F.round("invested", 6).alias("invested"), "reasons")


#: The ledger as a recursion over dates. What is held is a map of quantity and average cost by security.
LEDGER = {
    "dts": "SELECT as_of_date AS d, lead(as_of_date) OVER (ORDER BY as_of_date) AS e, row_number() OVER (ORDER BY as_of_date) AS i FROM schedule",
    "px": """SELECT as_of_date AS d, map_from_entries(list((security_id, close * CASE currency WHEN 'KRW' THEN 1.0::DOUBLE WHEN 'USD' THEN usd_krw ELSE usd_krw / usd_jpy END))) AS p FROM (
        SELECT s.security_id, s.currency, s.as_of_date, p.close FROM (SELECT security_id, currency, as_of_date FROM securities, schedule) s ASOF JOIN prices p ON p.security_id = s.security_id AND p.price_date <= s.as_of_date) JOIN schedule_rates ON d = as_of_date GROUP BY ALL""",
    "tg": "SELECT portfolio_id, as_of_date AS d, map_from_entries(list((security_id, round(weight, 6)))) AS t FROM weighted WHERE weight > 0 GROUP BY ALL",
    "steps": "SELECT portfolio_id, i, d, e, coalesce(t, MAP([]::VARCHAR[], []::DOUBLE[])) AS t, a.p AS p, b.p AS pe FROM (SELECT DISTINCT portfolio_id FROM grid) CROSS JOIN dts LEFT JOIN tg USING (portfolio_id, d) JOIN px a USING (d) JOIN px b ON b.d = e WHERE e IS NOT NULL",
}
RUN = """, run AS (
    SELECT portfolio_id, 0::BIGINT AS i, NULL::DATE AS d, NULL::DATE AS e, 1e7::DOUBLE AS cash, MAP([]::VARCHAR[], []::STRUCT(q DOUBLE, c DOUBLE)[]) AS held, 0::DOUBLE AS nav, 0::DOUBLE AS end_nav, 0::DOUBLE AS total FROM (SELECT DISTINCT portfolio_id FROM grid)
    UNION ALL
    SELECT portfolio_id, i, d, e, cash, held, nav, cash + coalesce(list_sum(list_transform(map_entries(held), lambda x: x.value.q * pe[x.key])), 0) AS end_nav, total FROM (
        SELECT portfolio_id, i, d, e, pe, nav, cash + coalesce(list_sum(list_transform(tr, lambda x: x.flow - x.pay)), 0) AS cash, coalesce(list_sum(list_transform(tr, lambda x: x.pay)), 0) AS total,
            map_from_entries(list_transform(list_filter(tr, lambda x: x.q > 1e-12), lambda x: {'k': x.s, 'v': {'q': x.q, 'c': x.c}})) AS held FROM (
            SELECT * EXCLUDE (tr), list_transform(tr, lambda x: {'s': x.s, 'flow': CASE WHEN x.sell THEN x.n ELSE -x.n END, 'q': CASE WHEN x.sell THEN x.q - x.n / x.pr ELSE x.q + x.n / x.pr END, 'c': CASE WHEN x.sell OR x.n = 0 THEN x.c ELSE (x.q * x.c + x.n) / (x.q + x.n / x.pr) END,
                'pay': x.n * 0.001::DOUBLE + CASE WHEN x.sell AND x.s[1:2] = 'KR' THEN x.n * 0.0015::DOUBLE ELSE 0 END + CASE WHEN x.sell THEN greatest(0, (x.pr - x.c) * x.n / x.pr) * CASE x.s[1:2] WHEN 'JP' THEN 0.2::DOUBLE WHEN 'US' THEN 0.22::DOUBLE ELSE 0 END ELSE 0 END}) AS tr FROM (
                SELECT * EXCLUDE (tr), list_transform(tr, lambda x: {'s': x.s, 'pr': x.pr, 'q': x.q, 'c': x.c, 'sell': x.delta < 0, 'n': CASE WHEN abs(x.delta) <= 1e-9 THEN 0 WHEN x.delta < 0 THEN least(-x.delta, x.q * x.pr) ELSE x.delta END}) AS tr FROM (
                    SELECT * EXCLUDE (held), list_transform(list_distinct(list_concat(map_keys(held), map_keys(t))), lambda s: {'s': s, 'pr': p[s], 'q': coalesce(held[s].q, 0), 'c': coalesce(held[s].c, 0), 'delta': nav * coalesce(t[s], 0) - coalesce(held[s].q, 0) * p[s]}) AS tr FROM (
                        SELECT s.*, r.held, r.cash, r.cash + coalesce(list_sum(list_transform(map_entries(r.held), lambda x: x.value.q * s.p[x.key])), 0) AS nav FROM run r JOIN steps s ON s.portfolio_id = r.portfolio_id AND s.i = r.i + 1))))))
"""
L8 = RUN + """SELECT portfolio_id, run.d AS start_date, run.e AS end_date, round(nav / 1e7, 4) AS start_nav, round(end_nav / 1e7, 4) AS end_nav, round(end_nav / nav - 1, 8) AS net_return, round(total / 1e7, 4) AS total_cost, round((be.close * re.usd_krw) / (bs.close * rs.usd_krw) - 1, 8) AS benchmark_return
    FROM run LEFT JOIN (SELECT * FROM bench WHERE country = 'US') bs ON bs.benchmark_date = run.d LEFT JOIN (SELECT * FROM bench WHERE country = 'US') be ON be.benchmark_date = run.e LEFT JOIN schedule_rates rs ON rs.d = run.d LEFT JOIN schedule_rates re ON re.d = run.e WHERE i > 0"""
A16 = RUN + """SELECT portfolio_id, count(*) AS periods, round(arg_max(end_nav, i) / 1e7, 4) AS end_nav, round(arg_max(end_nav, i) / 1e7 - 1, 4) AS cumulative_net, round((arg_max(end_nav, i) + sum(total)) / 1e7 - 1, 4) AS cumulative_gross, round(sum(total) / 1e7, 4) AS total_cost FROM run WHERE i > 0 GROUP BY ALL"""


def step_positions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Each country's sales-weighted holdings of the quarter before, and prices at every quarter end."""
    held = _quarter_weights(spark, sf)
    closes = V.prices(spark, sf).withColumn("q", F.last_day(F.add_months(F.trunc("price_date", "quarter"), 2))).groupBy("security_id", "q").agg(F.max_by("close", "price_date").alias("price_krw"))
    before = held.join(closes.withColumnRenamed("q", "as_of_date"), ["security_id", "as_of_date"]).select("country", F.last_day(F.add_months("as_of_date", 3)).alias("as_of_date"), "security_id", (1e6 * F.col("weight") / F.col("price_krw")).alias("quantity"), F.col("price_krw").alias("avg_cost"))
    return before, closes.select("security_id", F.col("q").alias("as_of_date"), "price_krw")


def step_trades(spark: SparkSession, sf: str) -> DataFrame:
    before, now = step_positions(spark, sf)
    key = ["country", "as_of_date"]
    marked = before.join(now, ["security_id", "as_of_date"]).withColumn("value", F.col("quantity") * F.col("price_krw"))
    nav = marked.groupBy(*key).agg(F.sum("value").alias("nav"))
    deltas = ledger.trade_deltas(marked, _quarter_weights(spark, sf).join(now, ["security_id", "as_of_date"], "left_semi"), nav, key)
    about = V.securities(spark, sf).select("security_id", "currency")
    t = deltas.join(now, ["security_id", "as_of_date"]).join(marked.select(*key, "security_id", "avg_cost"), [*key, "security_id"], "left").join(about, "security_id").withColumn("country", F.upper("country"))
    return ledger.trade_costs(t, {"commission": 0.0005, "fx_fee": 0.001})


def l1_l6_ledger_step(spark: SparkSession, sf: str) -> DataFrame:
    """One rebalance of each country's sales-weighted portfolio at every quarter end, from the holdings of the quarter before."""
    out = step_trades(spark, sf)
    return out.select("country", "as_of_date", "security_id", "side", F.round("notional", 4).alias("notional"), F.round("gain", 4).alias("gain"), F.round("total", 4).alias("total"))


L1 = """SELECT upper(d.country) AS country, d.d AS as_of_date, security_id, side, round(notional, 4) AS notional, round(gain, 4) AS gain, round(notional * 0.0005::DOUBLE + notional * 0.001::DOUBLE + CASE WHEN d.country <> 'kr' THEN notional * 0.001::DOUBLE ELSE 0 END
        + CASE WHEN side = 'SELL' AND d.country = 'kr' THEN notional * 0.0015::DOUBLE ELSE 0 END + gain * CASE d.country WHEN 'jp' THEN 0.2::DOUBLE WHEN 'us' THEN 0.22::DOUBLE ELSE 0 END, 4) AS total FROM (
    SELECT *, CASE WHEN side = 'SELL' THEN greatest(0, (price - cost) * notional / price) ELSE 0 END AS gain FROM (
        SELECT *, CASE WHEN delta < 0 THEN 'SELL' ELSE 'BUY' END AS side, CASE WHEN delta < 0 THEN least(-delta, value) ELSE delta END AS notional FROM (
            SELECT coalesce(m.country, t.country) AS country, coalesce(m.d, t.d) AS d, coalesce(m.security_id, t.security_id) AS security_id, coalesce(t.w, 0) * nav - coalesce(value, 0) AS delta, coalesce(value, 0) AS value, cost, coalesce(m.price, t.price) AS price
            FROM marked m FULL JOIN (SELECT wp.*, price FROM wp JOIN closes c ON c.security_id = wp.security_id AND c.q = wp.d) t ON m.country = t.country AND m.d = t.d AND m.security_id = t.security_id JOIN nav n ON n.country = coalesce(m.country, t.country) AND n.d = coalesce(m.d, t.d))
        WHERE abs(delta) > 1e-9)) d"""
L1_VIEWS = {
    "wp": "SELECT country, period_end AS d, security_id, sales_ttm / sum(sales_ttm) OVER (PARTITION BY country, period_end) AS w FROM fundamentals WHERE sales_ttm > 0",
    "closes": "SELECT security_id, last_day(date_trunc('quarter', price_date)::DATE + INTERVAL 2 MONTH) AS q, arg_max(close, price_date) AS price FROM prices GROUP BY ALL",
    "marked": "SELECT b.*, n.price, quantity * n.price AS value FROM (SELECT country, last_day(d + INTERVAL 3 MONTH) AS d, wp.security_id, 1e6 * w / price AS quantity, price AS cost FROM wp JOIN closes c ON c.security_id = wp.security_id AND c.q = d) b JOIN closes n ON n.security_id = b.security_id AND n.q = b.d",
    "nav": "SELECT country, d, sum(value) AS nav FROM marked GROUP BY ALL",
}

def _recursive(body: str, more: dict[str, str] = {"bench": BENCH, "schedule_rates": SCHEDULE_RATES, **LEDGER}) -> str:
    views = {**PIT, **SCORES, **Q.RANKING, **Q.WEIGHTS, **more}
    return oracle(body, views).replace("WITH ", "WITH RECURSIVE ", 1).replace("\n, run AS", ",\nrun AS", 1)


_ALL = [
    p1_assemble_universe, p3_pit_violations, p6_rejection_counts, a1_median_traded_value, w1_pit_select, rank_by_country, g1_factor_eligibility, w3_winsorize, w3_winsorize_ranges, g2_raw_metrics, w4_w7_scores,
    a5_sector_weights, g3_seed_rows, g5_proportional_quotas, g6_quota_bounds, g9_qepm_rank, h1_h2_selection, h8_capped_allocation, h14_portfolios, h11_h12_diagnostics, h10_turnover_step, w10_sleeve_blend,
    h14_turnover_portfolios, h12_turnover_diagnostics, h11_country_diagnostics, l8_ledger_periods, a16_run_metrics, l1_l6_ledger_step,
]
QUERIES = {f.__name__: f for f in _ALL}
SQL = {
    "p1_assemble_universe": oracle("SELECT as_of_date, universe, security_id, country, period_end, filing_date, rd_expense, sales_ttm, round(median_traded_value_krw, 2) AS median_krw, reasons FROM pit", PIT),
    "p3_pit_violations": oracle("SELECT as_of_date, count(*) AS n, min(filing_date) AS first_filed FROM fundamentals JOIN schedule ON filing_date > as_of_date GROUP BY ALL"),
    "p6_rejection_counts": oracle("SELECT as_of_date, universe, reason, count(*) AS n FROM (SELECT as_of_date, universe, unnest(string_split(reasons, '|')) AS reason FROM pit WHERE reasons <> '') GROUP BY ALL", {"schedule": MONTHS, **PIT}),
    "a1_median_traded_value": oracle("SELECT as_of_date, security_id, n_prices, n_valued, round(median_krw, 2) AS median_krw FROM traded", PIT),
    "w1_pit_select": oracle("SELECT as_of_date, security_id, n_filed, n_usable, f.period_end AS period_end, f.filing_date AS filing_date, f.rd AS rd_expense, f.sales AS sales_ttm FROM picked", PIT),
    "rank_by_country": oracle(RANKED, {**PIT, "factors": FACTOR}),
    "g1_factor_eligibility": oracle("SELECT country, CASE WHEN rd_expense IS NULL THEN 'MISSING_RD_EXPENSE' WHEN sales_ttm <= 0 THEN 'NON_POSITIVE_SALES_TTM' ELSE 'ELIGIBLE' END AS eligibility_reason, count(*) AS n, round(sum(CASE WHEN rd_expense IS NOT NULL AND sales_ttm > 0 THEN rd_expense / sales_ttm END), 4) AS sum_factor FROM fundamentals GROUP BY ALL"),
    "w3_winsorize": oracle(W3),
    "w3_winsorize_ranges": oracle(W3),
    "g2_raw_metrics": oracle("SELECT as_of_date, model, country, count(*) AS n, round(ln(sum(raw)), 6) AS log_sum FROM raws GROUP BY ALL", {**PIT, **SCORES}),
    "w4_w7_scores": oracle("SELECT as_of_date, model, security_id, size_bucket, round(sector_z, 5) AS sector_z, round(size_z, 5) AS size_z, round(score, 5) AS score FROM scores", {**PIT, **SCORES}),
    "a5_sector_weights": oracle("SELECT as_of_date, country, sector, round(l / sum(l) OVER (PARTITION BY as_of_date, country), 6) AS weight FROM (SELECT as_of_date, country, sector, sum(liq) AS l FROM base WHERE reasons = '' GROUP BY ALL)", {**PIT, **SCORES}),
    "g3_seed_rows": oracle(G3, {**PIT, **SCORES}),
    "g5_proportional_quotas": oracle(Q.G5, Q.G5_VIEWS),
    "g6_quota_bounds": oracle(G6),
    "g9_qepm_rank": oracle(Q.G9, {**PIT, **SCORES, **Q.RANKING}),
    "h1_h2_selection": oracle(Q.H1, {**PIT, **SCORES, **Q.RANKING, **Q.WEIGHTS}),
    "h8_capped_allocation": oracle(Q.H8),
    "h14_portfolios": oracle(Q.H14, {**PIT, **SCORES, **Q.RANKING, **Q.WEIGHTS}),
    "h11_h12_diagnostics": oracle(Q.H11, {**PIT, **SCORES, **Q.RANKING, **Q.WEIGHTS}),
    "h10_turnover_step": oracle(H10, {"w": "SELECT country, period_end AS d, security_id, sales_ttm / sum(sales_ttm) OVER (PARTITION BY country, period_end) AS w FROM fundamentals"}),
    "w10_sleeve_blend": oracle(W10, L1_VIEWS),
    "l1_l6_ledger_step": oracle(L1, L1_VIEWS),
    "h11_country_diagnostics": oracle(Q.H11_COUNTRY, {**PIT, **SCORES, **Q.RANKING, **Q.WEIGHTS}),
    "h14_turnover_portfolios": _recursive(Q.H14_CHAIN, Q.CHAIN),
    "h12_turnover_diagnostics": _recursive(Q.H12_CHAIN, Q.CHAIN),
    "l8_ledger_periods": _recursive(L8),
    "a16_run_metrics": _recursive(A16),
}
