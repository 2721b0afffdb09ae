"""Inputs made by rule from a list of securities and a schedule, for dry runs of the whole chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.temporal import dates_side

from ..functions import casts as X

# By country what is added to R&D, the days from filing and period end to the date, and the base price.
RULES = {"US": (0.0, 60, 150, 25.0), "KR": (12.5, 75, 170, 20000.0), "JP": (7.5, 75, 170, 2500.0)}


def _of(i: int, country: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for c, v in RULES.items() for x in (c, v[i])]), country)


def hash64(text: Column) -> Column:
    """The first 64 bits of SHA-256 as a number without sign."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def fundamentals(securities: DataFrame, schedule: DataFrame) -> DataFrame:
    """R&D and sales of each security at each date, from a hash of its id, country and the date."""
    both = securities.select("security_id", "country").crossJoin(dates_side(schedule.select("as_of_date")))
    h = hash64(F.concat_ws("|", "security_id", "country", F.col("as_of_date").cast("string"), F.lit("rnd-sales")))
    b = both.withColumn("_h", h)
    rd = 60 + _of(0, F.col("country")) + (F.col("_h") % 180).cast("double")
    days = lambda i: F.date_sub("as_of_date", _of(i, F.col("country")).cast("int"))
    exact = F.expr("cast((_h div 97) % 2200 as double)")
    return b.select("security_id", F.lower("country").alias("country"), "as_of_date", days(1).alias("filing_date"), days(2).alias("period_end"), rd.alias("rd_expense"), (700 + exact).alias("sales_ttm"))


def prices(securities: DataFrame, schedule: DataFrame) -> DataFrame:
    """Closes on each date and one and two weeks before; securities have rank_seed. 1.5 percent a quarter, one percent less off the schedule."""
    order = Window.orderBy("as_of_date")  # dates only: some tens of rows
    numbered = schedule.select("as_of_date").distinct().withColumn("i", F.row_number().over(order) - 1)
    days = numbered.select("as_of_date", "i", F.explode(F.array(F.lit(0), F.lit(7), F.lit(14))).alias("lag"))
    days = days.groupBy(F.expr("date_sub(as_of_date, lag)").alias("price_date")).agg(F.min_by("i", "as_of_date").alias("i"), F.max((F.col("lag") == 0)).alias("on"))
    both = securities.select("security_id", "country", "currency", "rank_seed").crossJoin(dates_side(days))
    close = (_of(3, F.col("country")) + F.col("rank_seed")) * (1 + 0.015 * F.col("i")) * F.when(F.col("on"), 1.0).otherwise(0.99)
    return both.select("security_id", "country", "currency", "price_date", F.round(close, 6).alias("close"), (8e8 + 2.5e7 * F.col("rank_seed")).alias("traded_value"))


def rates_and_levels(schedule: DataFrame) -> DataFrame:
    """USD/KRW, USD/JPY and a benchmark level by the number of the date."""
    n = schedule.select("as_of_date").distinct().withColumn("i", F.row_number().over(Window.orderBy("as_of_date")) - 1)
    return n.select("as_of_date", (1300.0 + F.col("i")).alias("usd_krw"), F.round(150 - 0.1 * F.col("i"), 6).alias("usd_jpy"), (1000 + 22.5 * F.col("i")).alias("level"))


LIST_SCHEMA = "security_id string, universe string, country string, is_current string, icb_proxy_level1 string, native_taxonomy_label string, ticker string, ordinal long"


def read_security_list(spark: SparkSession, path: str, country: str, currency: str) -> DataFrame:
    """Current rows of a country from CSV files with a header, with their sector and running rank_seed."""
    rows = spark.read.schema(LIST_SCHEMA).option("header", True).csv(path)
    current = rows.where((F.upper(F.trim("country")) == country) & X.boolean(F.col("is_current")) & X.blank_to_null(F.col("security_id")).isNotNull() & X.blank_to_null(F.col("universe")).isNotNull())
    sector = F.coalesce(X.blank_to_null(F.col("icb_proxy_level1")), X.blank_to_null(F.col("native_taxonomy_label")), F.lit("UNKNOWN"))
    seed = F.row_number().over(Window.partitionBy("universe").orderBy("ordinal", "security_id"))
    return current.select("security_id", "universe", "country", F.lit(currency).alias("currency"), sector.alias("sector"), "ticker", seed.alias("rank_seed"))


def open_constituents(securities: DataFrame, start: str) -> DataFrame:
    """One open window for each security, from a year before the start."""
    return securities.select("universe", "security_id", F.date_sub(F.lit(start).cast("date"), 365).alias("effective_from"), F.lit(None).cast("date").alias("effective_to"), F.lit(True).alias("is_current"))
