"""Market tables that are views over the star schema, as Spark plans and, for the oracles, as SQL.

Sums of money are sums of whole cents, so that they are the same in whatever order rows come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START = "1995-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One for each supplier."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_regionkey") % 3).alias("r"))
    s = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.withColumn("country", F.when(F.col("r") == 0, "US").when(F.col("r") == 1, "KR").otherwise("JP"))
    return s.select(
        F.format_string("%s:%05d", "country", "s_suppkey").alias("security_id"),
        F.col("s_suppkey").alias("k"),
        "country",
        F.when(F.col("country") == "US", "USD").when(F.col("country") == "KR", "KRW").otherwise("JPY").alias("currency"),
        F.concat(F.lit("S"), F.col("s_suppkey") % 4).alias("sector"),
        F.concat(F.lit("uni_"), F.lower("country")).alias("universe"),
    )


def _cents() -> F.Column:
    return F.round(F.col("l_extendedprice") * 100).cast("long")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One for each security and day with shipments."""
    days = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_shipdate").cast("date").alias("price_date"))
    sums = days.agg(F.sum(_cents()).alias("cents"), F.sum("l_quantity").cast("long").alias("quantity"))
    scale = F.when(F.col("currency") == "KRW", 8000).when(F.col("currency") == "USD", 8).otherwise(1000)
    return sums.join(securities(spark, sf_dir), "k").select(
        "security_id", "country", "currency", "price_date", (F.expr("(20000 * cents + quantity) div (2 * quantity)") / 1e6).alias("close"), (F.col("cents") * scale / 100).alias("traded_value")
    )


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("d")).distinct()


def fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """USD/KRW on every day; USD/JPY has gaps."""
    n = F.datediff("d", F.lit(START))
    both = F.array(
        F.struct(F.lit("USD/KRW").alias("pair"), (1300 + F.pmod(n, F.lit(120))).cast("double").alias("rate")),
        F.struct(F.lit("USD/JPY").alias("pair"), (150 - 0.1 * F.pmod(n, F.lit(50))).alias("rate")),
    )
    return days(spark, sf_dir).select(F.col("d").alias("fx_date"), n.alias("n"), F.inline(both)).where("pair = 'USD/KRW' OR n % 41 <> 0").select("pair", "fx_date", F.round("rate", 6).alias("rate"))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One for each security and quarter with shipments, filed 30 to 89 days after it ends."""
    quarter = F.trunc(F.col("l_shipdate").cast("date"), "quarter").alias("q")
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k"), quarter).agg(F.sum(_cents()).alias("sales"), F.sum(_cents() * F.round(F.col("l_discount") * 100).cast("long")).alias("rd"))
    m = F.pmod(F.col("k") + 4 * F.year("q") + F.quarter("q"), F.lit(17)) == 0
    z = F.pmod(F.col("k") + 4 * F.year("q") + F.quarter("q"), F.lit(23)) == 0
    end = F.last_day(F.add_months("q", 2))
    return sums.join(securities(spark, sf_dir), "k").select(
        "security_id",
        F.lower("country").alias("country"),
        end.alias("period_end"),
        F.date_add(end, (30 + F.pmod(7 * F.col("k"), F.lit(60))).cast("int")).alias("filing_date"),
        F.when(~m, F.expr("(rd + 50) div 100") / 100).alias("rd_expense"),
        F.when(z, 0.0).otherwise(F.col("sales") / 100).alias("sales_ttm"),
    )


def constituents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership windows; every fifth security leaves for half a year."""
    open_ = lambda a: F.struct(F.lit(a).cast("date").alias("effective_from"), F.lit(None).cast("date").alias("effective_to"))
    left = F.array(F.struct(F.lit(START).cast("date").alias("effective_from"), F.lit("1999-12-31").cast("date").alias("effective_to")), open_("2000-07-01"))
    windows = F.when(F.col("k") % 5 == 0, left).otherwise(F.array(open_(START)))
    return securities(spark, sf_dir).select("universe", "security_id", F.inline(windows)).withColumn("is_current", F.col("effective_to").isNull())


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ends of all quarters that have shipments."""
    return days(spark, sf_dir).select(F.last_day(F.add_months(F.trunc("d", "quarter"), 2)).alias("as_of_date")).distinct()


SQL = {
    "securities": """SELECT format('{}:{:05d}', country, k) AS security_id, k, country, CASE country WHEN 'US' THEN 'USD' WHEN 'KR' THEN 'KRW' ELSE 'JPY' END AS currency,
        'S' || (k % 4) AS sector, 'uni_' || lower(country) AS universe
        FROM (SELECT s_suppkey AS k, CASE n_regionkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'KR' ELSE 'JP' END AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
    "prices": """SELECT security_id, country, currency, price_date, ((20000 * cents::BIGINT + quantity) // (2 * quantity))::DOUBLE / 1e6 AS close,
        (cents * CASE currency WHEN 'KRW' THEN 8000 WHEN 'USD' THEN 8 ELSE 1000 END)::DOUBLE / 100 AS traded_value
        FROM (SELECT l_suppkey AS k, l_shipdate::DATE AS price_date, sum(round(l_extendedprice * 100)::BIGINT) AS cents, sum(l_quantity)::BIGINT AS quantity FROM lineitem GROUP BY ALL) JOIN securities USING (k)""",
    "days": "SELECT DISTINCT l_shipdate::DATE AS d FROM lineitem",
    "fx": """SELECT pair, d AS fx_date, round(rate, 6) AS rate FROM (
        SELECT 'USD/KRW' AS pair, d, (1300 + (d - DATE '1995-01-01') % 120)::DOUBLE AS rate FROM days UNION ALL
        SELECT 'USD/JPY', d, 150 - 0.1::DOUBLE * ((d - DATE '1995-01-01') % 50) FROM days WHERE (d - DATE '1995-01-01') % 41 <> 0)""",
    "fundamentals": """SELECT security_id, lower(country) AS country, period_end, (period_end + (30 + (7 * k) % 60)::INT)::DATE AS filing_date,
        CASE WHEN (k + 4 * year(q) + quarter(q)) % 17 <> 0 THEN ((rd + 50) // 100)::DOUBLE / 100 END AS rd_expense,
        CASE WHEN (k + 4 * year(q) + quarter(q)) % 23 = 0 THEN 0.0::DOUBLE ELSE sales::DOUBLE / 100 END AS sales_ttm
        FROM (SELECT k, q, last_day(q + INTERVAL 2 MONTH) AS period_end, sum(cents) AS sales, sum(cents * pct) AS rd
              FROM (SELECT l_suppkey AS k, date_trunc('quarter', l_shipdate::DATE)::DATE AS q, round(l_extendedprice * 100)::BIGINT AS cents, round(l_discount * 100)::BIGINT AS pct FROM lineitem) GROUP BY ALL)
        JOIN securities USING (k)""",
    "constituents": """SELECT universe, security_id, f AS effective_from, t AS effective_to, t IS NULL AS is_current FROM securities JOIN (
        VALUES (true, DATE '1995-01-01', DATE '1999-12-31'), (true, DATE '2000-07-01', NULL), (false, DATE '1995-01-01', NULL)) w(fifth, f, t) ON fifth = (k % 5 = 0)""",
    "schedule": "SELECT DISTINCT last_day(date_trunc('quarter', d)::DATE + INTERVAL 2 MONTH) AS as_of_date FROM days",
}


def oracle(body: str, more: dict[str, str] | None = None) -> str:
    """body as SQL over the star schema: the views go before it, then more."""
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in {**SQL, **(more or {})}.items()) + "\n" + body
