"""Queries over membership, calendars, exchange rates and benchmarks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import money, temporal
from ..sources import tables as V

oracle = V.oracle


def j1_membership_asof(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.membership_asof(V.constituents(spark, sf), V.schedule(spark, sf))


MEMBERS = """SELECT DISTINCT as_of_date, universe, security_id FROM constituents JOIN schedule
    ON effective_from <= as_of_date AND (effective_to IS NULL OR as_of_date <= effective_to)"""


def j2_month_end_membership(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.month_end_membership(V.constituents(spark, sf)).groupBy("as_of_date", "universe").agg(F.count("*").alias("n"))


J2 = """SELECT as_of_date, universe, count(*) AS n FROM constituents JOIN (
    SELECT last_day(m::DATE) AS as_of_date FROM (SELECT unnest(generate_series(date_trunc('month', min(effective_from)), max(coalesce(effective_to, effective_from)), INTERVAL 1 MONTH)) AS m,
        min(effective_from) AS a, max(coalesce(effective_to, effective_from)) AS b FROM constituents) WHERE last_day(m::DATE) BETWEEN a AND b) d
    ON effective_from <= as_of_date AND (effective_to IS NULL OR as_of_date <= effective_to) GROUP BY ALL"""


def _map_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Identifier rows; the ticker of every seventh passes to another id in July 1998."""
    s = V.securities(spark, sf)
    day = lambda x: F.lit(x).cast("date")
    own = s.select("country", "security_id", F.concat(F.lit("I"), F.col("k").cast("string")).alias("issuer_id"), F.concat(F.lit(" t"), F.col("k").cast("string")).alias("ticker"), F.format_string("%04d", "k").alias("stock_code"), day("1995-01-01").alias("effective_from"), F.when(F.col("k") % 7 == 0, day("1998-06-30")).alias("effective_to"))
    new = s.where("k % 7 = 0").select("country", F.concat("security_id", F.lit("N")).alias("security_id"), F.lit("").alias("issuer_id"), F.concat(F.lit("T"), F.col("k").cast("string")).alias("ticker"), F.lit(None).cast("string").alias("stock_code"), day("1998-07-01").alias("effective_from"), F.lit(None).cast("date").alias("effective_to"))
    return own.unionByName(new)


MAP_ROWS = """SELECT country, security_id, 'I' || k AS issuer_id, ' t' || k AS ticker, format('{:04d}', k) AS stock_code, DATE '1995-01-01' AS effective_from, CASE WHEN k % 7 = 0 THEN DATE '1998-06-30' END AS effective_to FROM securities
    UNION ALL SELECT country, security_id || 'N', '', 'T' || k, NULL, DATE '1998-07-01', NULL FROM securities WHERE k % 7 = 0"""
MASTER = """SELECT DISTINCT upper(trim(country)) AS market, key_type, upper(trim(raw)) AS raw_key, id AS security_id, effective_from AS valid_from, effective_to AS valid_to FROM (
    SELECT country, security_id AS id, effective_from, effective_to, unnest(['security_id', 'issuer_id', 'ticker', 'stock_code']) AS key_type, unnest([security_id, issuer_id, ticker, stock_code]) AS raw FROM map_rows) WHERE trim(raw) <> ''"""


def j3_security_master(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.security_master(_map_rows(spark, sf))


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    s = V.securities(spark, sf)
    each = s.select(F.col("country").alias("market"), F.lit("ticker").alias("key_type"), F.concat(F.lit("T"), F.col("k").cast("string")).alias("raw_key"))
    return each.crossJoin(temporal.dates_side(V.schedule(spark, sf).select(F.col("as_of_date").alias("on_date"))))


def j4_resolve_security(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.resolve_security(_requests(spark, sf), temporal.security_master(_map_rows(spark, sf)))


J4 = """SELECT market, key_type, raw_key, on_date, arg_min(security_id, valid_from) FILTER (WHERE valid_from <= on_date AND (valid_to IS NULL OR on_date <= valid_to)) AS security_id
    FROM (SELECT country AS market, 'ticker' AS key_type, 'T' || k AS raw_key, as_of_date AS on_date FROM securities, schedule) LEFT JOIN master USING (market, key_type, raw_key) GROUP BY ALL"""


def _stretched(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of ids that end in 0 reach into later ones, and every window of ids that end in 5 has short ones inside."""
    w = V.constituents(spark, sf).select("universe", "security_id", "effective_from", "effective_to")
    long = w.withColumn("effective_to", F.when(F.col("security_id").endswith("0") & F.col("effective_to").isNotNull(), F.lit("2000-08-01").cast("date")).otherwise(F.col("effective_to")))
    day = lambda n: F.date_add("effective_from", n)
    inner = w.where("security_id like '%5'").select("universe", "security_id", F.explode(F.array(*[F.struct(day(a).alias("a"), day(b).alias("b")) for a, b in ((10, 12), (20, 30), (25, 27))])).alias("x"))
    return long.unionByName(inner.select("universe", "security_id", F.col("x.a").alias("effective_from"), F.col("x.b").alias("effective_to")))


def j5_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Every window that overlaps one ahead of it, neighbours or not."""
    return temporal.overlaps(_stretched(spark, sf), ["universe", "security_id"]).select("universe", "security_id", "effective_from", F.col("effective_to"), "previous_start", "previous_end")


def j5_key_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """The same for the keys of the security master, where every fourteenth ticker passes on before its window has ended."""
    m = temporal.security_master(_map_rows(spark, sf)).withColumn("valid_to", F.when(F.col("raw_key").endswith("4") & F.col("valid_to").isNotNull(), F.lit("1998-12-31").cast("date")).otherwise(F.col("valid_to")))
    return temporal.overlaps(m, ["market", "key_type", "raw_key"], "valid_from", "valid_to").select("market", "key_type", "raw_key", "security_id", "valid_from", "previous_start", "previous_end")


def _pairs(src: str, keys: str, start: str, end: str, shown: str) -> str:
    """All pairs of windows of a key: the furthest of those ahead of each, where it reaches it."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    ahead = f"(b.{start}, coalesce(b.{end}, DATE '9999-12-31')) < (a.{start}, coalesce(a.{end}, DATE '9999-12-31'))"
    cols = ", ".join(f"a.{c}" for c in shown.split(", "))
    return f"SELECT {cols}, max((coalesce(b.{end}, DATE '9999-12-31'), b.{start}))[2] AS previous_start, max((coalesce(b.{end}, DATE '9999-12-31'), b.{start}))[1] AS previous_end FROM {src} a JOIN {src} b ON {on} AND {ahead} GROUP BY ALL HAVING a.{start} <= max(coalesce(b.{end}, DATE '9999-12-31'))"


STRETCHED = """SELECT universe, security_id, effective_from, CASE WHEN security_id LIKE '%0' AND effective_to IS NOT NULL THEN DATE '2000-08-01' ELSE effective_to END AS effective_to FROM constituents
    UNION ALL SELECT universe, security_id, effective_from + x[1], effective_from + x[2] FROM (SELECT *, unnest([[10, 12], [20, 30], [25, 27]]) AS x FROM constituents WHERE security_id LIKE '%5')"""
MASTER_LONG = "SELECT * REPLACE (CASE WHEN raw_key LIKE '%4' AND valid_to IS NOT NULL THEN DATE '1998-12-31' ELSE valid_to END AS valid_to) FROM master"


def j6_asof_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The exchange rate of every line item's day: one key for all rows, dealt into ranges."""
    days = V.table(spark, sf, "lineitem").select(F.lit("USD/KRW").alias("pair"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_shipdate").cast("date").alias("d"))
    fx = V.fx(spark, sf).where("dayofmonth(fx_date) % 5 = 0")
    got = temporal.asof_backward(days, fx, ["pair"], "d", "fx_date", ["rate"], ranges=16)
    return got.groupBy("d", "asof_date").agg(F.count("*").alias("n"), F.sum("k").alias("orders"), F.round(F.max("rate"), 6).alias("rate"))


J6_RANGES = "SELECT d, fx_date AS asof_date, count(*) AS n, sum(k)::BIGINT AS orders, round(max(rate), 6) AS rate FROM (SELECT l_orderkey AS k, l_shipdate::DATE AS d FROM lineitem) ASOF LEFT JOIN (SELECT * FROM fx WHERE pair = 'USD/KRW' AND day(fx_date) % 5 = 0) f ON f.fx_date <= d GROUP BY ALL"


def c7_window_errors(spark: SparkSession, sf: str) -> DataFrame:
    w = V.constituents(spark, sf).withColumn("is_current", F.col("is_current") | F.col("security_id").endswith("5"))
    return temporal.window_errors(w).select("security_id", "effective_from", "effective_to", "is_current", "error")


C7 = """SELECT security_id, effective_from, effective_to, is_current, CASE WHEN effective_to < effective_from THEN 'ends_before_start' WHEN is_current AND effective_to IS NOT NULL THEN 'current_but_closed' WHEN NOT is_current AND effective_to IS NULL THEN 'past_but_open' END AS error
    FROM (SELECT security_id, effective_from, effective_to, is_current OR suffix(security_id, '5') AS is_current FROM constituents)"""


def _last_prices(spark: SparkSession, sf: str) -> DataFrame:
    ids = V.securities(spark, sf).select("security_id").crossJoin(temporal.dates_side(V.schedule(spark, sf)))
    return temporal.asof_backward(ids, V.prices(spark, sf), ["security_id"], "as_of_date", "price_date", ["close"])


def j6_asof_backward(spark: SparkSession, sf: str) -> DataFrame:
    return _last_prices(spark, sf)


J6 = """SELECT s.security_id, s.as_of_date, p.price_date AS asof_date, p.close FROM (SELECT security_id, as_of_date FROM securities, schedule) s
    ASOF LEFT JOIN prices p ON p.security_id = s.security_id AND p.price_date <= s.as_of_date"""


def j7_asof_exact(spark: SparkSession, sf: str) -> DataFrame:
    days = V.days(spark, sf).select(F.lit("USD/JPY").alias("pair"), F.col("d").alias("on_date"))
    return temporal.asof_exact(days, V.fx(spark, sf), ["pair"], "on_date", "fx_date", ["rate"])


J7 = "SELECT 'USD/JPY' AS pair, d AS on_date, rate, rate IS NULL AS missing FROM days LEFT JOIN fx ON pair = 'USD/JPY' AND fx_date = d"


def _trading(spark: SparkSession, sf: str) -> DataFrame:
    return V.prices(spark, sf).select(F.col("country").alias("market"), F.col("price_date").alias("trading_date")).distinct()


def _months(spark: SparkSession, sf: str) -> DataFrame:
    """Month ends from the one before the first shipment on, for each market."""
    m = V.days(spark, sf).select(F.explode(F.array(F.last_day("d"), F.last_day(F.add_months("d", -1)))).alias("target_date")).distinct()
    return V.securities(spark, sf).select(F.col("country").alias("market")).distinct().crossJoin(temporal.dates_side(m))


def j8_trading_day_adjust(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.trading_day_adjust(_months(spark, sf), _trading(spark, sf))


TRADING = "SELECT DISTINCT country AS market, price_date AS trading_date FROM prices"
J8 = """SELECT market, target_date, coalesce(max(trading_date) FILTER (WHERE trading_date <= target_date), min(trading_date)) AS adjusted
    FROM (SELECT DISTINCT last_day(d) AS target_date FROM days UNION SELECT DISTINCT last_day((d - INTERVAL 1 MONTH)::DATE) FROM days) JOIN trading ON true GROUP BY ALL"""


def v1_rebalance_schedule(spark: SparkSession, sf: str) -> DataFrame:
    trading = _trading(spark, sf)
    span = trading.groupBy("market").agg(F.lit("1995-01-31").cast("date").alias("start"), F.max("trading_date").alias("end"))
    return temporal.rebalance_schedule(span, trading)


V1 = """SELECT market, adjusted AS as_of_date FROM (SELECT market, target, coalesce(max(trading_date) FILTER (WHERE trading_date <= target), min(trading_date)) AS adjusted FROM (
        SELECT market, (DATE '1995-01-31' + to_months(3 * i::INT))::DATE AS target FROM (SELECT market, max(trading_date) AS e FROM trading GROUP BY market), range(0, 60) r(i) WHERE (DATE '1995-01-31' + to_months(3 * i::INT))::DATE <= e)
    JOIN trading USING (market) GROUP BY ALL) QUALIFY lag(adjusted) OVER (PARTITION BY market ORDER BY target) IS DISTINCT FROM adjusted"""


def v3_required_dates(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.required_dates(V.schedule(spark, sf))


def w11_period_pairs(spark: SparkSession, sf: str) -> DataFrame:
    days = V.prices(spark, sf).select("country", F.col("price_date").alias("as_of_date")).distinct()
    return temporal.period_pairs(days, ["country"])


def v4_walkforward_folds(spark: SparkSession, sf: str) -> DataFrame:
    dates = V.days(spark, sf).select(F.col("d").alias("as_of_date"))
    return temporal.walkforward_folds(dates, "1996-02-29", "2001-10-31", train=2, test=1).select("fold_index", "train_start", "train_end", "test_start", "test_end", "n_train", "n_test")


V4 = """SELECT (row_number() OVER (ORDER BY s) - 1)::INT AS fold_index, s AS train_start, m - 1 AS train_end, m AS test_start, e AS test_end, n_train, n_test FROM (
    SELECT s, m, e, count(*) FILTER (WHERE d < m) AS n_train, count(*) FILTER (WHERE d >= m) AS n_test
    FROM (SELECT s, (s + INTERVAL 2 YEAR)::DATE AS m, ((s + INTERVAL 3 YEAR)::DATE - 1) AS e FROM (VALUES (DATE '1996-02-29'), (DATE '1997-02-28'), (DATE '1998-02-28'), (DATE '1999-02-28'), (DATE '2000-02-28'), (DATE '2001-02-28')) v(s))
    JOIN days ON d BETWEEN s AND e WHERE e <= DATE '2001-10-31' GROUP BY ALL) WHERE n_train > 0 AND n_test > 0"""


def v5_leaking_folds(spark: SparkSession, sf: str) -> DataFrame:
    dates = V.days(spark, sf).select(F.col("d").alias("as_of_date"))
    folds = temporal.walkforward_folds(dates, "1996-02-29", "2001-10-31", train=2, test=1)
    return folds.select("fold_index", (F.col("last_train") < F.col("first_test")).alias("is_clean"), F.datediff("first_test", "last_train").alias("gap_days"))


V5 = """SELECT (row_number() OVER (ORDER BY s) - 1)::INT AS fold_index, a < b AS is_clean, (b - a)::INT AS gap_days FROM (SELECT s, max(d) FILTER (WHERE d < m) AS a, min(d) FILTER (WHERE d >= m) AS b
    FROM (SELECT s, (s + INTERVAL 2 YEAR)::DATE AS m, ((s + INTERVAL 3 YEAR)::DATE - 1) AS e FROM (VALUES (DATE '1996-02-29'), (DATE '1997-02-28'), (DATE '1998-02-28'), (DATE '1999-02-28'), (DATE '2000-02-28'), (DATE '2001-02-28')) v(s))
    JOIN days ON d BETWEEN s AND e WHERE e <= DATE '2001-10-31' GROUP BY ALL) WHERE a IS NOT NULL AND b IS NOT NULL"""


def a21_duplicate_rates(spark: SparkSession, sf: str) -> DataFrame:
    fx = V.fx(spark, sf)
    again = fx.where(F.day("fx_date") == 13).withColumn("pair", F.lower("pair"))
    return money.duplicate_rates(fx.unionByName(again))


def f1_rate_previous(spark: SparkSession, sf: str) -> DataFrame:
    found = money.rates_on_or_before(V.days(spark, sf), V.fx(spark, sf), "d")
    return found.select("d", F.round("usd_krw", 6).alias("usd_krw"), F.round("usd_jpy", 6).alias("usd_jpy"))


RATES = """SELECT d, k.rate AS usd_krw, j.rate AS usd_jpy FROM days ASOF LEFT JOIN (SELECT * FROM fx WHERE pair = 'USD/KRW') k ON k.fx_date <= d ASOF LEFT JOIN (SELECT * FROM fx WHERE pair = 'USD/JPY') j ON j.fx_date <= d"""


def f2_f4_return_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Returns from one trading day of a security to its next, in KRW and in parts."""
    p = V.prices(spark, sf)
    w = Window.partitionBy("security_id").orderBy("price_date")
    pairs = p.select("security_id", "currency", F.col("price_date").alias("s"), F.lead("price_date").over(w).alias("e"), (F.lead("close").over(w) / F.col("close") - 1).alias("local")).where("e is not null")
    rates = money.rates_on_or_before(V.days(spark, sf), V.fx(spark, sf), "d")
    at = lambda x: rates.select(F.col("d").alias(x), F.col("usd_krw").alias(f"{x}_krw"), F.col("usd_jpy").alias(f"{x}_jpy"))
    both = pairs.join(at("s"), "s").join(at("e"), "e")
    moved = money.fx_return(F.col("currency"), (F.col("s_krw"), F.col("s_jpy")), (F.col("e_krw"), F.col("e_jpy")))
    out = both.withColumn("fx", moved).select("security_id", F.col("s").alias("start_date"), *money.decomposed(F.col("local"), F.col("fx")), money.in_krw(F.col("local"), F.col("fx")).alias("krw_return"))
    return out.select("security_id", "start_date", *[F.round(c, 6).alias(c) for c in ("local_part", "fx_part", "interaction", "total", "krw_return")])


F2 = """SELECT security_id, s AS start_date, round(local, 6) AS local_part, round(fx, 6) AS fx_part, round(local * fx, 6) AS interaction, round(local + fx + local * fx, 6) AS total, round((1 + local) * (1 + fx) - 1, 6) AS krw_return FROM (
    SELECT security_id, s, local, CASE currency WHEN 'KRW' THEN 0.0::DOUBLE WHEN 'USD' THEN b.usd_krw / a.usd_krw - 1 ELSE (b.usd_krw / b.usd_jpy) / (a.usd_krw / a.usd_jpy) - 1 END AS fx FROM (
        SELECT security_id, currency, price_date AS s, lead(price_date) OVER w AS e, lead(close) OVER w / close - 1 AS local FROM prices WINDOW w AS (PARTITION BY security_id ORDER BY price_date)) p
    JOIN rates a ON a.d = s JOIN rates b ON b.d = e)"""


def f5_amount_to_krw(spark: SparkSession, sf: str) -> DataFrame:
    out = money.amounts_to_krw(V.prices(spark, sf), V.fx(spark, sf))
    return out.select("security_id", "price_date", F.round("amount_krw", 2).alias("amount_krw"))


AMOUNTS = """SELECT security_id, price_date, traded_value * CASE currency WHEN 'KRW' THEN 1.0::DOUBLE WHEN 'USD' THEN k.rate ELSE k.rate / j.rate END AS amount_krw
    FROM prices LEFT JOIN fx k ON k.pair = 'USD/KRW' AND k.fx_date = price_date LEFT JOIN fx j ON j.pair = 'USD/JPY' AND j.fx_date = price_date"""


def f6_price_to_krw(spark: SparkSession, sf: str) -> DataFrame:
    return money.prices_to_krw(V.prices(spark, sf), V.fx(spark, sf), "price_date").select("security_id", "price_date", F.round("price_krw", 6).alias("price_krw"))


F6 = """SELECT security_id, price_date, round(close * CASE currency WHEN 'KRW' THEN 1.0::DOUBLE WHEN 'USD' THEN usd_krw ELSE usd_krw / usd_jpy END, 6) AS price_krw FROM prices JOIN rates ON d = price_date"""


def benchmark(spark: SparkSession, sf: str, country: str = "US") -> DataFrame:
    """The mean close of a country's prices in the twenty days before each quarter end."""
    near = (F.col("price_date") <= F.col("as_of_date")) & (F.col("price_date") > F.date_sub("as_of_date", 20))
    p = V.prices(spark, sf).where(F.col("country") == country).join(temporal.dates_side(V.schedule(spark, sf)), near)
    return p.groupBy(F.col("as_of_date").alias("benchmark_date")).agg(F.round(F.avg("close"), 4).alias("close")).select(F.lit("B1").alias("benchmark_id"), "benchmark_date", "close", F.lit("USD").alias("currency"))


BENCH = """SELECT country, as_of_date AS benchmark_date, round(avg(close), 4) AS close FROM prices JOIN schedule ON price_date <= as_of_date AND price_date > as_of_date - 20 GROUP BY ALL"""
PERIODS = "SELECT as_of_date AS start_date, lead(as_of_date) OVER (ORDER BY as_of_date) AS end_date FROM schedule QUALIFY end_date IS NOT NULL"


def periods(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.period_pairs(V.schedule(spark, sf).withColumn("one", F.lit(1)), ["one"]).drop("one")


def f9_benchmark_return(spark: SparkSession, sf: str) -> DataFrame:
    got = money.period_returns_krw(periods(spark, sf), benchmark(spark, sf).where("month(benchmark_date) <> 9 or year(benchmark_date) <> 1999"), V.fx(spark, sf))
    return got.select("start_date", "end_date", F.round("benchmark_return", 6).alias("benchmark_return"))


F9_CTE = """SELECT start_date, end_date, (b.close / a.close) * (rb.usd_krw / ra.usd_krw) - 1 AS benchmark_return FROM periods LEFT JOIN b1 a ON a.benchmark_date = start_date LEFT JOIN b1 b ON b.benchmark_date = end_date
    LEFT JOIN schedule_rates ra ON ra.d = start_date LEFT JOIN schedule_rates rb ON rb.d = end_date"""
SCHEDULE_RATES = "SELECT as_of_date AS d, k.rate AS usd_krw, j.rate AS usd_jpy FROM schedule ASOF LEFT JOIN (SELECT * FROM fx WHERE pair = 'USD/KRW') k ON k.fx_date <= as_of_date ASOF LEFT JOIN (SELECT * FROM fx WHERE pair = 'USD/JPY') j ON j.fx_date <= as_of_date"


def _returns(spark: SparkSession, sf: str) -> DataFrame:
    """Of each sector the mean daily close of its US names and of all its names, as returns."""
    p = V.prices(spark, sf).join(V.securities(spark, sf).select("security_id", "sector"), "security_id")
    daily = p.groupBy(F.col("sector").alias("benchmark_id"), "price_date").agg(F.avg(F.when(F.col("country") == "US", F.col("close"))).alias("a"), F.avg("close").alias("b")).where("a is not null")
    w = Window.partitionBy("benchmark_id").orderBy("price_date")
    return daily.select("benchmark_id", "price_date", (F.col("a") / F.lag("a").over(w) - 1).alias("official"), (F.col("b") / F.lag("b").over(w) - 1).alias("proxy"))


RETURNS = """SELECT benchmark_id, price_date, a / lag(a) OVER w - 1 AS official, b / lag(b) OVER w - 1 AS proxy FROM (SELECT sector AS benchmark_id, price_date, avg(close) FILTER (WHERE p.country = 'US') AS a, avg(close) AS b
    FROM prices p JOIN securities s USING (security_id) GROUP BY ALL HAVING a IS NOT NULL) WINDOW w AS (PARTITION BY benchmark_id ORDER BY price_date)"""
QUALITY = """SELECT benchmark_id, count(*) AS n, corr(official, proxy) AS correlation, stddev_samp(proxy - official) * sqrt(252) AS tracking_error FROM returns WHERE official IS NOT NULL AND proxy IS NOT NULL GROUP BY ALL HAVING count(*) >= 2"""


def f8_proxy_quality(spark: SparkSession, sf: str) -> DataFrame:
    q = money.proxy_quality(_returns(spark, sf), ["benchmark_id"])
    return q.select("benchmark_id", "n", F.round("correlation", 6).alias("correlation"), F.round("tracking_error", 6).alias("tracking_error"), "is_good")


def f7_benchmark_select(spark: SparkSession, sf: str) -> DataFrame:
    """Sectors as benchmarks; S0 lacks an official series."""
    r = _returns(spark, sf)
    official = r.where("benchmark_id <> 'S0'").select("benchmark_id", "price_date", F.col("official").alias("r"))
    chosen = money.select_benchmark(official, r.select("benchmark_id", "price_date", F.col("proxy").alias("r")), money.proxy_quality(r, ["benchmark_id"]))
    return chosen.groupBy("benchmark_id", "status").agg(F.count("*").alias("n"), F.round(F.sum("r"), 6).alias("sum_return"))


F7 = """SELECT benchmark_id, CASE WHEN benchmark_id <> 'S0' THEN 'official_selected' WHEN any_value(q.n) IS NULL THEN 'proxy_fallback_missing_quality_inputs' WHEN any_value(correlation) >= 0.95 AND any_value(tracking_error) <= 0.05 THEN 'proxy_fallback_used' ELSE 'proxy_quality_guardrail_breached' END AS status,
    count(*) AS n, round(sum(CASE WHEN benchmark_id <> 'S0' THEN official ELSE proxy END), 6) AS sum_return FROM returns LEFT JOIN quality q USING (benchmark_id) GROUP BY benchmark_id"""


def f10_source_priority(spark: SparkSession, sf: str) -> DataFrame:
    p = V.prices(spark, sf).withColumn("source", F.when(F.pmod(F.dayofyear("price_date"), F.lit(3)) == 0, " Vendor ").otherwise("backup"))
    got = money.source_priority(p.where("country <> 'JP' or source = 'backup'"), ["vendor", "backup"], ["country"])
    return got.groupBy("country", "quality_flag").agg(F.count("*").alias("n"), F.round(F.sum("close"), 2).alias("sum_close"))


F10 = """SELECT country, CASE country WHEN 'JP' THEN 'fallback' ELSE 'primary' END AS quality_flag, count(*) AS n, round(sum(close), 2) AS sum_close FROM prices WHERE (dayofyear(price_date) % 3 = 0) = (country <> 'JP') GROUP BY ALL"""


def _with_volume(spark: SparkSession, sf: str) -> DataFrame:
    return V.prices(spark, sf).withColumn("volume", F.round(F.col("traded_value") / F.col("close") / 8))


def f11_price_grid(spark: SparkSession, sf: str) -> DataFrame:
    grid = money.price_grid(_with_volume(spark, sf), temporal.required_dates(V.schedule(spark, sf)))
    return grid.select("security_id", "required_date", "asof_date", F.round("close", 6).alias("close"), F.round("traded_value", 6).alias("traded_value"))


F11 = """SELECT security_id, required_date, price_date AS asof_date, close, round(greatest(close * greatest(volume, 1.0::DOUBLE), close), 6) AS traded_value FROM (
    SELECT g.security_id, required_date, price_date, close, volume, count(close) OVER (PARTITION BY g.security_id) AS hits, count(*) OVER (PARTITION BY g.security_id) AS n
    FROM (SELECT security_id, required_date FROM (SELECT DISTINCT security_id FROM prices), required) g ASOF LEFT JOIN (SELECT *, round(traded_value / close / 8) AS volume FROM prices) p ON p.security_id = g.security_id AND p.price_date <= required_date) WHERE hits = n"""
REQUIRED = "SELECT DISTINCT unnest([as_of_date, as_of_date - 7, as_of_date - 14]) AS required_date FROM schedule"


def f12_fx_grid(spark: SparkSession, sf: str) -> DataFrame:
    dates = temporal.required_dates(V.schedule(spark, sf))
    got = money.rates_on_or_before(dates, V.fx(spark, sf), "required_date")
    return got.select("required_date", F.round("usd_krw", 6).alias("usd_krw"), F.round("usd_jpy", 6).alias("usd_jpy"))


F12 = """SELECT required_date, round(k.rate, 6) AS usd_krw, round(j.rate, 6) AS usd_jpy FROM required ASOF LEFT JOIN (SELECT * FROM fx WHERE pair = 'USD/KRW') k ON k.fx_date <= required_date ASOF LEFT JOIN (SELECT * FROM fx WHERE pair = 'USD/JPY') j ON j.fx_date <= required_date"""

_ALL = [
    j1_membership_asof, j2_month_end_membership, j3_security_master, j4_resolve_security, j5_overlaps, j5_key_overlaps, c7_window_errors, j6_asof_backward, j6_asof_ranges, j7_asof_exact, j8_trading_day_adjust,
    v1_rebalance_schedule, v3_required_dates, w11_period_pairs, v4_walkforward_folds, v5_leaking_folds, a21_duplicate_rates, f1_rate_previous, f2_f4_return_parts, f5_amount_to_krw,
    f6_price_to_krw, f7_benchmark_select, f8_proxy_quality, f9_benchmark_return, f10_source_priority, f11_price_grid, f12_fx_grid,
]
QUERIES = {f.__name__: f for f in _ALL}
SQL = {
    "j1_membership_asof": oracle(MEMBERS),
    "j2_month_end_membership": oracle(J2),
    "j3_security_master": oracle(MASTER, {"map_rows": MAP_ROWS}),
    "j4_resolve_security": oracle(J4, {"map_rows": MAP_ROWS, "master": MASTER}),
    "j5_overlaps": oracle(_pairs("stretched", "universe, security_id", "effective_from", "effective_to", "universe, security_id, effective_from, effective_to"), {"stretched": STRETCHED}),
    "j5_key_overlaps": oracle(_pairs("long", "market, key_type, raw_key", "valid_from", "valid_to", "market, key_type, raw_key, security_id, valid_from"), {"map_rows": MAP_ROWS, "master": MASTER, "long": MASTER_LONG}),
    "j6_asof_ranges": oracle(J6_RANGES),
    "c7_window_errors": oracle(C7),
    "j6_asof_backward": oracle(J6),
    "j7_asof_exact": oracle(J7),
    "j8_trading_day_adjust": oracle(J8, {"trading": TRADING}),
    "v1_rebalance_schedule": oracle(V1, {"trading": TRADING}),
    "v3_required_dates": oracle(REQUIRED),
    "w11_period_pairs": oracle("SELECT country, start_date, end_date FROM (SELECT country, price_date AS start_date, lead(price_date) OVER (PARTITION BY country ORDER BY price_date) AS end_date FROM (SELECT DISTINCT country, price_date FROM prices)) WHERE end_date IS NOT NULL"),
    "v4_walkforward_folds": oracle(V4),
    "v5_leaking_folds": oracle(V5),
    "a21_duplicate_rates": oracle("SELECT pair, fx_date, 2::BIGINT AS n FROM fx WHERE day(fx_date) = 13"),
    "f1_rate_previous": oracle("SELECT d, round(usd_krw, 6) AS usd_krw, round(usd_jpy, 6) AS usd_jpy FROM rates", {"rates": RATES}),
    "f2_f4_return_parts": oracle(F2, {"rates": RATES}),
    "f5_amount_to_krw": oracle("SELECT security_id, price_date, round(amount_krw, 2) AS amount_krw FROM amounts", {"amounts": AMOUNTS}),
    "f6_price_to_krw": oracle(F6, {"rates": RATES}),
    "f7_benchmark_select": oracle(F7, {"returns": RETURNS, "quality": QUALITY}),
    "f8_proxy_quality": oracle("SELECT benchmark_id, n, round(correlation, 6) AS correlation, round(tracking_error, 6) AS tracking_error, correlation >= 0.95 AND tracking_error <= 0.05 AS is_good FROM quality", {"returns": RETURNS, "quality": QUALITY}),
    "f9_benchmark_return": oracle("SELECT start_date, end_date, round(benchmark_return, 6) AS benchmark_return FROM f9", {"bench": BENCH, "b1": "SELECT * FROM bench WHERE country = 'US' AND (month(benchmark_date) <> 9 OR year(benchmark_date) <> 1999)", "periods": PERIODS, "schedule_rates": SCHEDULE_RATES, "f9": F9_CTE}),
    "f10_source_priority": oracle(F10),
    "f11_price_grid": oracle(F11, {"required": REQUIRED}),
    "f12_fx_grid": oracle(F12, {"required": REQUIRED}),
}
