"""The point-in-time universe: what was known, and investable, on each rebalance date. All dates go in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .money import amounts_to_krw
from .temporal import active, dates_side, membership_asof

# Days from the end of a period until its filing may be used, and the screen's defaults.
FILING_LAG_DAYS = {"US": 45, "KR": 60, "JP": 60}
THRESHOLD_KRW, LOOKBACK_DAYS, MIN_OBSERVATIONS = 500_000_000.0, 20, 3


def lag_days(country: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in FILING_LAG_DAYS.items() for x in pair]), F.upper(country))


def pit_violations(fundamentals: DataFrame, dates: DataFrame) -> DataFrame:
    """Rows filed after a date on which they are asked for."""
    late = F.col("filing_date") > F.col("as_of_date")
    return fundamentals.join(dates_side(dates.select("as_of_date")), late).select("as_of_date", "security_id", "period_end", "filing_date")


def assert_pit(fundamentals: DataFrame, as_of_col: str = "as_of_date") -> DataFrame:
    """fundamentals; raises if any row is filed after its own date."""
    late = fundamentals.where(F.col("filing_date") > F.col(as_of_col)).orderBy(as_of_col, "security_id").limit(20).collect()
    if late:
        raise ValueError("filed after the date: " + "; ".join(f"{r['security_id']} {r['filing_date']}" for r in late))
    return fundamentals


def pit_select(members: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """For each member and date: n_filed, n_usable and the last usable filing by (filing_date, period_end, ordinal).

    Members come first so that the join is on security_id, and dates only bound it; one aggregate picks the last row."""
    keys = ["as_of_date", "universe", "security_id"]
    ordinal = F.col("ordinal") if "ordinal" in fundamentals.columns else F.lit(0).cast("long")
    own = ["country", "period_end", "filing_date", "rd_expense", "sales_ttm"]
    windowed = {"effective_from", "effective_to"} <= set(fundamentals.columns)
    known = active(F.col("as_of_date"), F.col("effective_from"), F.col("effective_to")) if windowed else F.lit(True)
    f = fundamentals.select("security_id", *own, ordinal.alias("ordinal"), *["effective_from", "effective_to"] * windowed)
    joined = members.select(*keys).join(f, "security_id").where((F.col("filing_date") <= F.col("as_of_date")) & known)
    usable = F.date_add("period_end", lag_days(F.col("country"))) <= F.col("as_of_date")
    row = F.struct("filing_date", "period_end", "ordinal", "country", "rd_expense", "sales_ttm")
    return joined.groupBy(*keys).agg(F.count("*").alias("n_filed"), F.count_if(usable).alias("n_usable"), F.max(F.when(usable, row)).alias("last")).select(*keys, "n_filed", "n_usable", "last.*").drop("ordinal")


def median_traded_value(dates: DataFrame, prices: DataFrame, fx: DataFrame, lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """(as_of_date, security_id, n_prices, n_valued, median_krw) of the days from as_of - (lookback - 1) to as_of.

    Dates are dealt by the months that their windows touch, so that a day's amount meets only dates near it."""
    valued = amounts_to_krw(prices.select("security_id", "currency", "price_date", "traded_value"), fx).withColumn("_month", F.trunc("price_date", "MM"))
    first = F.date_sub("as_of_date", lookback - 1)
    months = F.explode(F.sequence(F.trunc(first, "MM"), F.trunc("as_of_date", "MM"), F.expr("interval 1 month")))
    near = dates_side(dates.select("as_of_date").distinct().withColumn("_month", months))
    hits = valued.join(near, "_month").where((F.col("price_date") <= F.col("as_of_date")) & (F.col("price_date") >= first))
    return hits.groupBy("as_of_date", "security_id").agg(F.count("*").alias("n_prices"), F.count("amount_krw").alias("n_valued"), F.percentile("amount_krw", 0.5).alias("median_krw"))


def assemble(windows: DataFrame, dates: DataFrame, fundamentals: DataFrame, prices: DataFrame, fx: DataFrame, require_sales: bool = True, threshold: float = THRESHOLD_KRW, lookback: int = LOOKBACK_DAYS, min_observations: int = MIN_OBSERVATIONS) -> DataFrame:
    """A row for each member on each date, with ``reasons``: empty if it is accepted, else what the first failing stage says."""
    members = membership_asof(windows, dates)
    chosen = members.join(pit_select(members, fundamentals), ["as_of_date", "universe", "security_id"], "left")
    both = chosen.join(median_traded_value(dates, prices, fx, lookback), ["as_of_date", "security_id"], "left")
    no_sales = (F.coalesce("sales_ttm", F.lit(0.0)) <= 0) if require_sales else F.lit(False)
    fields = F.array_compact(F.array(F.when(F.col("rd_expense").isNull(), "MISSING_RD_EXPENSE"), F.when(no_sales, "NON_POSITIVE_SALES_TTM")))
    # fixed values: reason codes
    short = (F.col("n_prices") < min_observations) | (F.col("n_valued") < F.col("n_prices"))
    reasons = (
        F.when(F.col("n_filed").isNull(), F.array(F.lit("NO_ELIGIBLE_FUNDAMENTALS")))
        .when(F.col("n_usable") == 0, F.array(F.lit("FILING_LAG_NOT_MET")))
        .when(F.size(fields) > 0, fields)
        .when(F.col("n_prices").isNull(), F.array(F.lit("NO_PRICE_DATA")))
        .when(short, F.array(F.lit("INVESTABILITY_DATA_ERROR")))
        .when(F.col("median_krw") < threshold, F.array(F.lit("INVESTABILITY_BELOW_THRESHOLD")))
        .otherwise(F.array().cast("array<string>"))
    )
    return both.select("as_of_date", "universe", "security_id", F.upper("country").alias("country"), "period_end", "filing_date", "rd_expense", "sales_ttm", F.col("median_krw").alias("median_traded_value_krw"), reasons.alias("reasons"))


def accepted(assembled: DataFrame) -> DataFrame:
    """One row for each date and security, whatever universes it is in."""
    return assembled.where(F.size("reasons") == 0).drop("reasons", "universe").dropDuplicates(["as_of_date", "security_id"])


def rejection_counts(assembled: DataFrame) -> DataFrame:
    return assembled.select("as_of_date", "universe", F.explode("reasons").alias("reason")).groupBy("as_of_date", "universe", "reason").agg(F.count("*").alias("n"))
