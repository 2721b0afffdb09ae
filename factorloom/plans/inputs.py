"""Queries over lists, generated inputs and joins around them, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import canonical, filings, report, temporal, weights
from ..sources import generate, store
from ..sources import tables as V
from . import feeds, reports

oracle = V.oracle


def _seeded(spark: SparkSession, sf: str) -> DataFrame:
    return V.securities(spark, sf).withColumn("rank_seed", (F.col("k") % 50 + 1).cast("int"))


def s1_security_list(spark: SparkSession, sf: str) -> DataFrame:
    """Securities as CSV files, read again for one country."""
    s = V.securities(spark, sf)
    path = store.work_dir(spark, "lists")
    rows = s.select("security_id", F.when(F.col("k") % 11 == 0, " ").otherwise(F.col("universe")).alias("universe"), "country", F.when(F.col("k") % 7 == 0, "no").otherwise("Yes").alias("is_current"), F.when(F.col("k") % 2 == 0, F.col("sector")).alias("icb_proxy_level1"), F.when(F.col("k") % 3 == 0, "native").otherwise("").alias("native_taxonomy_label"), F.concat(F.lit("t"), F.col("k").cast("string")).alias("ticker"), F.col("k").alias("ordinal"))
    rows.write.option("header", True).csv(path)
    return generate.read_security_list(spark, path, "KR", "KRW")


S1 = """SELECT security_id, universe, country, currency, CASE WHEN k % 2 = 0 THEN sector WHEN k % 3 = 0 THEN 'native' ELSE 'UNKNOWN' END AS sector, 't' || k AS ticker, (row_number() OVER (ORDER BY k))::INT AS rank_seed FROM securities WHERE country = 'KR' AND k % 7 <> 0 AND k % 11 <> 0"""


def s13_generate_fundamentals(spark: SparkSession, sf: str) -> DataFrame:
    return generate.fundamentals(V.securities(spark, sf), V.schedule(spark, sf))


S13 = """SELECT security_id, lower(country) AS country, as_of_date, as_of_date - CASE country WHEN 'US' THEN 60 ELSE 75 END AS filing_date, as_of_date - CASE country WHEN 'US' THEN 150 ELSE 170 END AS period_end,
    60 + CASE country WHEN 'US' THEN 0 WHEN 'KR' THEN 12.5::DOUBLE ELSE 7.5::DOUBLE END + (h % 180)::DOUBLE AS rd_expense, 700 + ((h // 97) % 2200)::DOUBLE AS sales_ttm
    FROM (SELECT security_id, country, as_of_date, ('0x' || substr(sha256(security_id || '|' || country || '|' || as_of_date || '|rnd-sales'), 1, 16))::UBIGINT AS h FROM securities, schedule)"""


def s14_generate_prices(spark: SparkSession, sf: str) -> DataFrame:
    return generate.prices(_seeded(spark, sf), V.schedule(spark, sf)).select("security_id", "price_date", F.round("close", 6).alias("close"), "traded_value")


S14 = """SELECT security_id, price_date, round((CASE country WHEN 'US' THEN 25 WHEN 'KR' THEN 20000 ELSE 2500 END + k % 50 + 1) * (1 + 0.015::DOUBLE * i) * CASE WHEN lag_ THEN 1 ELSE 0.99::DOUBLE END, 6) AS close, 8e8 + 2.5e7 * (k % 50 + 1) AS traded_value FROM securities,
    (SELECT price_date, arg_min(i, as_of_date) AS i, bool_or(l = 0) AS lag_ FROM (SELECT as_of_date, as_of_date - l AS price_date, l, i FROM (SELECT as_of_date, row_number() OVER (ORDER BY as_of_date) - 1 AS i FROM schedule), (VALUES (0), (7), (14)) v(l)) GROUP BY price_date)"""


def s15_generate_rates(spark: SparkSession, sf: str) -> DataFrame:
    days = V.days(spark, sf).withColumnRenamed("d", "as_of_date").where(F.dayofweek("as_of_date") == 6)
    return generate.rates_and_levels(days)


S15 = """SELECT d AS as_of_date, 1300.0::DOUBLE + i AS usd_krw, round(150 - 0.1::DOUBLE * i, 6) AS usd_jpy, 1000 + 22.5::DOUBLE * i AS level FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM days WHERE dayofweek(d) = 5)"""


def s16_open_constituents(spark: SparkSession, sf: str) -> DataFrame:
    return generate.open_constituents(V.securities(spark, sf), "1996-03-31").select("universe", "security_id", "effective_from", "is_current")


def c21_transform_us(spark: SparkSession, sf: str) -> DataFrame:
    points = filings.metric_intersection(feeds._facts(spark, sf), "1998-01-01", "1998-12-31").withColumnRenamed("cik", "security_id")
    return canonical.transform_us(points).select("security_id", "country", "period_end", "as_of_date", "effective_from", F.round("rd_expense", 2).alias("rd_expense"), F.round("sales_ttm", 2).alias("sales_ttm"), "is_current")


def c28_core_universe(spark: SparkSession, sf: str) -> DataFrame:
    specs = V.securities(spark, sf).select("security_id", F.concat(F.lit("br."), F.col("k").cast("string")).alias("ticker"))
    symbols = V.table(spark, sf, "customer").select(F.concat(F.lit(" BR-"), F.col("c_custkey").cast("string")).alias("symbol")).where("c_mktsegment = 'BUILDING'")
    return canonical.core_universe(specs, symbols, "core")


def j9_price_symbol_prune(spark: SparkSession, sf: str) -> DataFrame:
    """Prices of securities that filed early in the first year only."""
    filed = V.fundamentals(spark, sf).where("filing_date < date'1995-05-20'").select("security_id").distinct()
    return canonical.prices_of(V.prices(spark, sf), filed).groupBy("security_id").agg(F.count("*").alias("n"))


def v2_month_end_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Month ends of the first years and the schedule, together."""
    span = V.days(spark, sf).groupBy().agg(F.min("d").alias("a"), F.add_months(F.min("d"), 24).alias("b"))
    return temporal.month_end_targets(span, V.schedule(spark, sf))


def a22_allocation_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of one security and date added up, and dates whose weights are over 1."""
    w = reports.V.fundamentals(spark, sf)
    sums = weights.merged_allocations(w.select("country", F.col("period_end").alias("as_of_date"), "security_id", (F.col("sales_ttm") / 1e8).alias("weight")), ["country"])
    return weights.allocation_totals(sums, ["country"]).withColumn("total", F.round("total", 6))


def h3_country_budgets(spark: SparkSession, sf: str) -> DataFrame:
    """Each year's filers as selected names: budgets of three countries under a cap of 0.4 percent a name."""
    f = V.fundamentals(spark, sf).select(F.upper("country").alias("country"), F.year("period_end").alias("as_of_date"), "security_id").distinct().withColumn("portfolio_id", F.lit("p"))
    targets = spark.createDataFrame([("p", c, w, 5, 20, 0.004) for c, w in (("JP", 0.3), ("KR", 0.3), ("US", 0.4))], "portfolio_id string, country string, target double, requested int, max_holdings int, max_single double")
    b = weights.country_budgets(f, targets, f.select("portfolio_id", "as_of_date").distinct(), ["portfolio_id", "as_of_date"])
    return b.select("as_of_date", "country", "n_selected", F.round("budget", 6).alias("budget"))


H3 = """SELECT y AS as_of_date, country, n AS n_selected, round(a + greatest(0, least(room, rest - coalesce(sum(room) OVER (PARTITION BY y ORDER BY country ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))), 6) AS budget FROM (
    SELECT *, greatest(0, n * 0.004::DOUBLE - a) AS room, greatest(0, 1 - sum(a) OVER (PARTITION BY y)) AS rest FROM (SELECT y, country, n, least(t, n * 0.004::DOUBLE) AS a FROM (
        SELECT y.y, t.country, t.t::DOUBLE AS t, count(DISTINCT security_id) AS n FROM (SELECT DISTINCT year(period_end)::INT AS y FROM fundamentals) y JOIN (VALUES ('JP', 0.3), ('KR', 0.3), ('US', 0.4)) t(country, t) ON true
        LEFT JOIN fundamentals f ON year(period_end) = y.y AND upper(f.country) = t.country GROUP BY ALL)))"""


def r2_walkforward_report(spark: SparkSession, sf: str) -> DataFrame:
    return report.walkforward_report(reports.v6_fold_metrics(spark, sf)).withColumn("active", F.round("active", 5))


def q3_missing_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Securities without R&D in one year."""
    seen = V.fundamentals(spark, sf).where("year(period_end) = 1997 and quarter(period_end) = 1 and rd_expense is not null")
    return report.missing_anchors(seen, V.securities(spark, sf))


def w4_sector_deviation(spark: SparkSession, sf: str) -> DataFrame:
    """Population and sample deviation of each sector's quarterly sales."""
    f = V.fundamentals(spark, sf).join(V.securities(spark, sf).select("security_id", "sector"), "security_id")
    return f.groupBy("sector", "period_end").agg(F.count("*").alias("n"), F.round(F.stddev_pop("sales_ttm"), 4).alias("pop"), F.round(F.stddev_samp("sales_ttm"), 4).alias("samp"), F.round(F.percentile("sales_ttm", 0.3), 4).alias("q30"))


_ALL = [s1_security_list, s13_generate_fundamentals, s14_generate_prices, s15_generate_rates, s16_open_constituents, c21_transform_us, c28_core_universe, j9_price_symbol_prune, v2_month_end_targets, a22_allocation_merge, h3_country_budgets, r2_walkforward_report, q3_missing_anchors, w4_sector_deviation]
QUERIES = {f.__name__: f for f in _ALL}
SQL = {
    "s1_security_list": oracle(S1),
    "s13_generate_fundamentals": oracle(S13),
    "s14_generate_prices": oracle(S14),
    "s15_generate_rates": oracle(S15),
    "s16_open_constituents": oracle("SELECT universe, security_id, DATE '1996-03-31' - 365 AS effective_from, true AS is_current FROM securities"),
    "c21_transform_us": oracle(f"SELECT cik AS security_id, 'us' AS country, period_end, filing_date AS as_of_date, filing_date AS effective_from, rd_expense, sales_ttm, true AS is_current FROM ({feeds.J11})", {**feeds._N, "a6": feeds.A6}),
    "c28_core_universe": oracle("SELECT security_id, 'br.' || k AS ticker, 'core' AS universe FROM securities WHERE k IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
    "j9_price_symbol_prune": oracle("SELECT security_id, count(*) AS n FROM prices WHERE security_id IN (SELECT security_id FROM fundamentals WHERE filing_date < DATE '1995-05-20') GROUP BY ALL"),
    "v2_month_end_targets": oracle("SELECT as_of_date FROM (SELECT DISTINCT last_day((a + to_months(i::INT))::DATE) AS as_of_date, b FROM (SELECT min(d) AS a, (min(d) + INTERVAL 24 MONTH)::DATE AS b FROM days), range(0, 25) r(i)) WHERE as_of_date <= b UNION SELECT as_of_date FROM schedule"),
    "a22_allocation_merge": oracle("SELECT country, period_end AS as_of_date, round(sum(sales_ttm / 1e8), 6) AS total, sum(sales_ttm / 1e8) > 1 + 1e-12 AS is_over, 0::BIGINT AS n_negative FROM fundamentals GROUP BY ALL"),
    "h3_country_budgets": oracle(H3),
    "r2_walkforward_report": oracle(f"SELECT fold_index, market, round(portfolio - benchmark, 5) AS active, portfolio > benchmark AS beats FROM ({reports.V6})", reports._P),
    "q3_missing_anchors": oracle("SELECT security_id FROM securities WHERE security_id NOT IN (SELECT security_id FROM fundamentals WHERE year(period_end) = 1997 AND quarter(period_end) = 1 AND rd_expense IS NOT NULL)"),
    "w4_sector_deviation": oracle("SELECT sector, period_end, count(*) AS n, round(stddev_pop(sales_ttm), 4) AS pop, round(stddev_samp(sales_ttm), 4) AS samp, round(quantile_cont(sales_ttm, 0.3), 4) AS q30 FROM fundamentals JOIN securities USING (security_id) GROUP BY ALL"),
}
