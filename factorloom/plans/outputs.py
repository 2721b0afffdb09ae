"""Queries over the price store's layouts, filing windows, names, gates and written outputs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import canonical, filings, ledger, money, report, temporal
from ..sources import store
from ..sources import tables as V
from . import market, reports, research

oracle = V.oracle
#: Years of the window that is served from the store.
FIRST, LAST = 1996, 1999


def _series(spark: SparkSession, sf: str) -> DataFrame:
    p = V.prices(spark, sf)
    return p.select(F.translate("security_id", ":", ".").alias("ticker"), "price_date", "close", F.round(F.col("traded_value") / 1000).alias("volume"), F.substring("security_id", 4, 5).cast("int").alias("k"))


def _layouts(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """The new layout, which lacks 1998 of every third ticker, and the old one of every second."""
    p = _series(spark, sf)
    new, old = store.work_dir(spark, "store"), store.work_dir(spark, "windows")
    store.write_price_partitions(p.where(f"k % 3 <> 0 or year(price_date) <> {FIRST + 2}").drop("k"), new)
    store.write_price_windows(p.where("k % 2 = 0").drop("k"), old)
    return new, store.read_price_windows(spark, old)


_WINDOW = f"""SELECT replace(security_id, ':', '.') AS ticker, price_date, close, round(traded_value / 1000) AS volume, substr(security_id, 4)::INT AS k FROM prices WHERE year(price_date) BETWEEN {FIRST} AND {LAST}"""
_ORIGIN = f"""SELECT w.*, CASE WHEN years = {LAST - FIRST + 1} THEN 'v2' WHEN k % 2 = 0 THEN 'v1' END AS origin FROM window_rows w
    JOIN (SELECT ticker, count(DISTINCT year(price_date)) FILTER (WHERE k % 3 <> 0 OR year(price_date) <> {FIRST + 2}) AS years FROM window_rows GROUP BY ticker) USING (ticker)"""
_STORE = {"window_rows": _WINDOW, "served": _ORIGIN}


def s4_price_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The older layout, written and read."""
    old = store.work_dir(spark, "windows")
    rows = _series(spark, sf).drop("k").withColumn("close", F.when(F.day("price_date") != 9, F.col("close"))).withColumn("volume", F.when(F.day("price_date") == 8, -1.0).otherwise(F.col("volume")))
    store.write_price_windows(rows, old)
    return store.read_price_windows(spark, old)


S4 = "SELECT replace(security_id, ':', '.') AS ticker, price_date, close, CASE WHEN day(price_date) = 8 THEN 0 ELSE round(traded_value / 1000) END AS volume FROM prices WHERE day(price_date) <> 9"


def s5_fresh_files(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of the store by ticker and year, as files written on their last day, that are at most 500 days old on a day."""
    parts = _series(spark, sf).groupBy("ticker", F.year("price_date").alias("year")).agg(F.max("price_date").cast("timestamp").alias("modified"))
    return store.fresh(parts, "2000-06-30", 500).select("ticker", "year", F.col("modified").cast("date").alias("modified"))


S5 = "SELECT replace(security_id, ':', '.') AS ticker, year(price_date)::INT AS year, max(price_date) AS modified FROM prices GROUP BY ALL HAVING max(price_date) >= DATE '2000-06-30' - 500"


def s7_served_prices(spark: SparkSession, sf: str) -> DataFrame:
    new, old = _layouts(spark, sf)
    got = store.serve(spark, new, old, FIRST, LAST)
    return got.groupBy("ticker", "origin").agg(F.count("*").alias("n"), F.round(F.sum("close"), 2).alias("sum_close"), F.round(F.sum("volume"), 0).alias("sum_volume"))


S7 = "SELECT ticker, origin, count(*) AS n, round(sum(close), 2) AS sum_close, round(sum(volume), 0) AS sum_volume FROM served WHERE origin IS NOT NULL GROUP BY ALL"


def s7_migration_counters(spark: SparkSession, sf: str) -> DataFrame:
    new, old = _layouts(spark, sf)
    return store.migration_counters(spark, new, old, FIRST, LAST)


S7_COUNTERS = """SELECT unnest(['v2_hit', 'v1_fallback', 'repair_success', 'repair_failure']) AS event, unnest([a, b, c, b - c]) AS n FROM (
    SELECT count(DISTINCT ticker) FILTER (WHERE origin = 'v2') AS a, count(DISTINCT ticker) FILTER (WHERE origin = 'v1') AS b, (SELECT count(*) FROM (SELECT ticker FROM served WHERE origin = 'v1' GROUP BY ticker HAVING count(DISTINCT year(price_date)) = 4)) AS c FROM served)"""


def s9_filing_window(spark: SparkSession, sf: str) -> DataFrame:
    """Events as listings in files by month; every fiftieth line is cut off and so no listing."""
    e = V.table(spark, sf, "events")
    path = store.work_dir(spark, "filing_index")
    listings = e.select(F.col("ts").cast("date").alias("day"), F.concat(F.lit("D"), F.col("event_id").cast("string")).alias("docID"), F.col("user_id").cast("string").alias("secCode"), F.col("event_id").alias("pos"))
    store.write_filing_index(listings.where("pos % 50 <> 0"), path)
    broken = listings.where("pos % 50 = 0").select(F.date_format("day", "yyyy-MM").alias("month"), F.substring(F.to_json(F.struct("day", "docID")), 1, 12).alias("value"))
    broken.write.mode("append").partitionBy("month").text(path)
    first = e.agg(F.min("ts").cast("date").alias("d")).first()["d"]
    import datetime as dt

    return store.read_filing_window(spark, path, str(first + dt.timedelta(days=3)), str(first + dt.timedelta(days=12)), "day date, docID string, secCode string, pos long")


S9 = "SELECT ts::DATE AS day, 'D' || event_id AS docID, user_id::VARCHAR AS secCode, event_id AS pos FROM events, (SELECT min(ts)::DATE AS d FROM events) WHERE ts::DATE BETWEEN d + 3 AND d + 12 AND event_id % 50 <> 0"


def s11_fact_files(spark: SparkSession, sf: str) -> DataFrame:
    """Fundamentals as tab-separated lines in UTF-16, some too short or with quotes."""
    f = V.fundamentals(spark, sf)
    cells = [F.lit('"rd"'), F.lit("R&D"), F.col("security_id"), F.lit("current"), F.lit("yes"), F.col("period_end").cast("string"), F.lit("JPY"), F.lit("1"), F.coalesce(F.col("rd_expense").cast("decimal(20,2)").cast("string"), F.lit("-"))]
    line = F.when(F.month("period_end") == 3, F.concat_ws("\t", *cells[:5])).otherwise(F.concat_ws("\t", *cells))
    path = store.work_dir(spark, "facts")
    f.select(line.alias("value")).write.option("encoding", "UTF-16LE").option("quote", "").option("escapeQuotes", "false").option("sep", "\x01").csv(path)
    got = store.read_fact_files(spark, path)
    return got.select("element", "context", F.col("period").cast("date").alias("period_end"), F.col("value").try_cast("double").alias("rd_expense"))


S11 = "SELECT 'rd' AS element, security_id AS context, period_end, rd_expense FROM fundamentals WHERE month(period_end) <> 3"


def a10_report_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Fundamentals as reports: R&D in a direct field or under a label, sales among labels of costs and text blocks."""
    f = V.fundamentals(spark, sf)
    rd, sales = F.col("rd_expense").cast("decimal(20,2)").cast("string"), F.col("sales_ttm").cast("decimal(20,2)").cast("string")
    even, text = F.month("period_end") % 2 == 0, lambda c: F.coalesce(c, F.lit("-"))
    some = lambda test, x: F.when(test, x).otherwise("-")
    direct = F.create_map(F.lit("rd_expense"), some(even, text(rd)), F.lit("R_and_D"), F.lit("9e15"))
    other = F.create_map(
        F.lit("Research and Development Expenses"), some(~even, text(rd)), F.lit("ResearchAndDevelopmentExpense TextBlock"), F.lit("9e15"), F.lit("Net sales (total)"), sales,
        F.lit("Cost of Sales"), F.lit("9e15"), F.lit("Revenue, other"), F.when(F.quarter("period_end") == 3, F.concat(F.lit("-"), F.lit("9e9"))).otherwise("n/a"), F.lit(""), F.lit("9e15"),
    )
    got = filings.report_rd_sales(f.select(F.concat_ws("/", "security_id", F.col("period_end").cast("string")).alias("filing_id"), F.lit("1").alias("net_sales"), direct.alias("direct"), other.alias("other")))
    return got


A10 = """SELECT security_id || '/' || period_end AS filing_id, rd_expense, CASE WHEN quarter(period_end) = 3 AND sales_ttm <= 9e9 THEN -9e9::DOUBLE WHEN sales_ttm > 1 THEN sales_ttm ELSE 1 END AS sales FROM fundamentals"""


def j12_filers(spark: SparkSession, sf: str) -> DataFrame:
    """Securities with the filer key of their ticker; the list has blanks, words and repeats."""
    c = V.table(spark, sf, "customer")
    cik = F.when(F.col("c_custkey") % 5 == 0, "n/a").when(F.col("c_custkey") % 7 == 0, "").otherwise((F.col("c_custkey") * 11).cast("string"))
    rows = c.select(F.concat(F.lit(" t"), (F.col("c_custkey") % 500).cast("string")).alias("ticker"), cik.alias("cik"), F.col("c_custkey").alias("ordinal"))
    specs = V.securities(spark, sf).select("security_id", F.concat(F.lit("T"), F.col("k").cast("string")).alias("ticker"))
    return filings.filers(specs, rows, "ticker", "cik")


J12 = """SELECT security_id, 'T' || k AS ticker, cik FROM securities JOIN (SELECT c_custkey % 500 AS k, lpad((arg_max(c_custkey * 11, c_custkey))::VARCHAR, 10, '0') AS cik FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 GROUP BY ALL) USING (k)"""


def s2_index_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of a segment as an index snapshot in CSV files."""
    path = store.work_dir(spark, "snapshot")
    c = V.table(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'")
    c.select(F.when(F.col("c_custkey") % 9 == 0, " ").otherwise(F.concat(F.lit(" br-"), (F.col("c_custkey") % 300).cast("string"))).alias("Symbol"), F.lit("x").alias("Name")).write.option("header", True).csv(path)
    return canonical.index_symbols(spark, path, "Symbol")


def c28_market_scope(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.market_scope(V.securities(spark, sf), ["US", "KR"]).groupBy("country", "universe").agg(F.count("*").alias("n"))


def c4_canonical_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark rows as text, some without a close or with a word as a date."""
    b = market.benchmark(spark, sf)
    m = F.month("benchmark_date")
    text = b.select(
        F.col("benchmark_date").cast("string").alias("as_of_date"), F.concat(F.lit(" "), F.col("benchmark_id")).alias("benchmark_id"), F.lit("US").alias("country"), F.when(m == 9, "soon").otherwise(F.date_format("benchmark_date", "yyyy/MM/dd")).alias("benchmark_date"),
        F.when(m != 6, F.col("close").cast("string")).alias("close"), F.lit("usd").alias("currency"), F.col("benchmark_date").cast("string").alias("effective_from"), F.lit("").alias("effective_to"), F.lit("1").alias("is_current"),
    )
    return canonical.canonical(text, "benchmark").select("as_of_date", "benchmark_id", "country", "benchmark_date", "close", "currency", F.array_join("errors", "|").alias("errors"))


C4 = """SELECT benchmark_date AS as_of_date, 'B1' AS benchmark_id, 'us' AS country, CASE WHEN month(benchmark_date) <> 9 THEN benchmark_date END AS benchmark_date, CASE WHEN month(benchmark_date) <> 6 THEN close END AS close, 'USD' AS currency,
    CASE month(benchmark_date) WHEN 9 THEN 'benchmark_date' WHEN 6 THEN 'close' ELSE '' END AS errors FROM bench WHERE country = 'US'"""


def c25_price_provenance(spark: SparkSession, sf: str) -> DataFrame:
    p = canonical.with_provenance(V.prices(spark, sf), F.concat(F.lit(" Vendor-"), F.col("country"), F.lit(" ")), F.when(F.col("close") > 1000, "HIGH ").otherwise("Low"))
    return p.groupBy("source", "quality_flag").agg(F.count("*").alias("n"), F.round(F.sum("close"), 2).alias("sum_close"))


def f12_benchmark_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark's last close on or before every required date."""
    dates = temporal.required_dates(V.schedule(spark, sf)).withColumn("benchmark_id", F.lit("B1"))
    got = temporal.asof_backward(dates, market.benchmark(spark, sf), ["benchmark_id"], "required_date", "benchmark_date", ["close", "currency"])
    return got.select("required_date", F.col("asof_date").alias("benchmark_date"), "close", "currency")


F12 = "SELECT required_date, benchmark_date, close, CASE WHEN close IS NOT NULL THEN 'USD' END AS currency FROM required ASOF LEFT JOIN (SELECT * FROM bench WHERE country = 'US') b ON b.benchmark_date <= required_date"


def l1_marked_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Each country's holdings of the quarter before at this quarter's prices; some have none."""
    before, now = research.step_positions(spark, sf)
    cash = before.select("country", "as_of_date").distinct().withColumn("cash", F.lit(1000.0))
    prices = now.where("security_id not like '%7'")
    got = ledger.mark(before, cash, prices, ["country", "as_of_date"], dates=["as_of_date"])
    return got.select("country", "as_of_date", "security_id", F.round("value", 2).alias("value"), F.round("nav", 2).alias("nav"), "missing_price")


L1 = """SELECT country, d AS as_of_date, security_id, round(quantity * coalesce(n.price, 0), 2) AS value, round(1000 + sum(quantity * coalesce(n.price, 0)) OVER (PARTITION BY country, d), 2) AS nav, n.price IS NULL AS missing_price
    FROM (SELECT country, last_day(d + INTERVAL 3 MONTH) AS d, wp.security_id, 1e6 * w / price AS quantity FROM wp JOIN closes c ON c.security_id = wp.security_id AND c.q = d) b LEFT JOIN (SELECT security_id, q AS d, price FROM closes WHERE security_id NOT LIKE '%7') n USING (security_id, d)"""


def l5_l6_rolled_holdings(spark: SparkSession, sf: str) -> DataFrame:
    """Holdings after each country's rebalance, with average cost and weight."""
    before, now = research.step_positions(spark, sf)
    trades = research.step_trades(spark, sf).withColumn("country", F.lower("country"))
    key = ["country", "as_of_date"]
    rolled = ledger.roll(before, trades, key).join(now, ["security_id", "as_of_date"]).withColumn("value", F.col("quantity") * F.col("price_krw"))
    marked = rolled.join(rolled.groupBy(*key).agg(F.sum("value").alias("nav")), key)
    return ledger.snapshots(marked, key).select(*key, "security_id", F.round("value", 2).alias("value"), F.round("avg_cost", 6).alias("avg_cost"), F.round("weight", 8).alias("weight"))


L5 = """SELECT country, d AS as_of_date, security_id, round(q * price, 2) AS value, round(cost, 6) AS avg_cost, round(q * price / sum(q * price) OVER (PARTITION BY country, d), 8) AS weight FROM (
    SELECT country, d, security_id, price, CASE WHEN delta > 0 THEN value + delta ELSE value - least(-delta, value) END / price AS q,
        CASE WHEN delta > 0 THEN (coalesce(value, 0) / price * coalesce(cost, 0) + delta) / ((coalesce(value, 0) + delta) / price) ELSE cost END AS cost
    FROM (SELECT country, d, security_id, cost, price, value, CASE WHEN abs(delta) > 1e-9 THEN delta ELSE 0 END AS delta FROM deltas)) WHERE q > 1e-12"""
DELTAS = """SELECT coalesce(m.country, t.country) AS country, coalesce(m.d, t.d) AS d, coalesce(m.security_id, t.security_id) AS security_id, coalesce(t.w, 0) * nav - coalesce(value, 0) AS delta, coalesce(value, 0) AS value, cost, coalesce(m.price, t.price) AS price
    FROM marked m FULL JOIN (SELECT wp.*, price FROM wp JOIN closes c ON c.security_id = wp.security_id AND c.q = wp.d) t ON m.country = t.country AND m.d = t.d AND m.security_id = t.security_id JOIN nav n ON n.country = coalesce(m.country, t.country) AND n.d = coalesce(m.d, t.d)"""


def k2_ledger_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Holdings with ticker, code and name as CSV files, read again; the list lacks every ninth security."""
    specs = V.securities(spark, sf).where("k % 9 <> 0").select("security_id", F.concat(F.lit("T"), F.col("k").cast("string")).alias("ticker"), F.when(F.col("k") % 2 == 0, F.format_string("%04d", "k")).alias("stock_code"), F.concat(F.lit("Name "), F.col("k").cast("string")).alias("stock_name"))
    path = store.work_dir(spark, "holdings")
    ledger.with_names(research._quarter_weights(spark, sf), specs).write.option("header", True).option("emptyValue", "").csv(path)
    back = spark.read.option("header", True).schema("country string, as_of_date date, security_id string, weight double, ticker string, stock_code string, stock_name string").csv(path)
    return back.select("as_of_date", "security_id", F.round("weight", 8).alias("weight"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("ticker", "stock_code", "stock_name")])


K2 = """SELECT d AS as_of_date, security_id, round(w, 8) AS weight, CASE WHEN k % 9 <> 0 THEN 'T' || k ELSE '' END AS ticker, CASE WHEN k % 9 <> 0 AND k % 2 = 0 THEN format('{:04d}', k) ELSE '' END AS stock_code, CASE WHEN k % 9 <> 0 THEN 'Name ' || k ELSE '' END AS stock_name FROM wp JOIN securities USING (security_id)"""


def k3_written_report(spark: SparkSession, sf: str) -> DataFrame:
    """A run's tables as JSON lines, read again: dates are ISO and nulls are kept."""
    path = store.work_dir(spark, "report")
    f = V.fundamentals(spark, sf).select("security_id", "period_end", "rd_expense")
    store.write_report(spark, {"fundamentals": f, "periods": reports.periods(spark, sf).select("market", "start_date", "end_date")}, path)
    lines = spark.read.text(f"{path}/fundamentals").select(F.lit("fundamentals").alias("part"), "value").union(spark.read.text(f"{path}/periods").select(F.lit("periods").alias("part"), "value"))
    return lines.groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("value").rlike(r'"(period_end|end_date)":"\d{4}-\d\d-\d\d"')).alias("n_iso"), F.count_if(F.col("value").contains("null")).alias("n_null"))


K3 = "SELECT 'fundamentals' AS part, count(*) AS n, count(*) AS n_iso, count(*) FILTER (WHERE rd_expense IS NULL) AS n_null FROM fundamentals UNION ALL SELECT 'periods', count(*), count(*), 0 FROM run_periods"


def k3_document(spark: SparkSession, sf: str) -> DataFrame:
    """A run's document with config, nested metrics and the quarters of each market, read again."""
    path = store.work_dir(spark, "document")
    p = reports.periods(spark, sf)
    by = p.groupBy("market").agg(F.count("*").alias("n"), F.round(F.sum("net_return"), 6).alias("net"))
    metrics = by.agg(F.sum("n").alias("periods"), F.map_from_entries(F.collect_list(F.struct("market", "net"))).alias("net"))
    store.write_document({"model": "rnd_sales_ttm", "limits": {"turnover": 0.5}}, metrics, {"quarters": p.select("market", "end_date", F.round("net_return", 6).alias("net"))}, path)
    fields = "config struct<model: string, limits: struct<turnover: double>>, metrics struct<periods: bigint, net: map<string, double>>, tables struct<quarters: array<struct<market: string, end_date: date, net: double>>>"
    d = spark.read.schema(fields).option("wholetext", True).json(path)
    each = d.select("config", "metrics", F.explode("tables.quarters").alias("q"))
    return each.groupBy("config.model", F.col("config.limits.turnover").alias("turnover"), "metrics.periods", F.col("q.market").alias("market"), F.element_at("metrics.net", F.col("q.market")).alias("net")).agg(F.count("*").alias("n"), F.max("q.end_date").alias("last"))


K3_DOCUMENT = "SELECT 'rnd_sales_ttm' AS model, 0.5::DOUBLE AS turnover, (sum(count(*)) OVER ())::BIGINT AS periods, market, round(sum(net_return), 6) AS net, count(*) AS n, max(end_date) AS last FROM run_periods GROUP BY market"


def k4_file_checksums(spark: SparkSession, sf: str) -> DataFrame:
    """Length and digest of files of names, one for each region."""
    n = V.table(spark, sf, "nation")
    path = store.work_dir(spark, "names")
    names = n.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "\n").alias("value"))
    names.repartition("n_regionkey").write.partitionBy("n_regionkey").text(path)
    files = store.file_checksums(spark, f"{path}/*/part-*")
    return files.select(F.regexp_extract("path", r"n_regionkey=(\d+)", 1).cast("int").alias("region"), "length", "sha256")


K4 = "SELECT n_regionkey::INT AS region, strlen(t) AS length, sha256(t) AS sha256 FROM (SELECT n_regionkey, string_agg(n_name, chr(10) ORDER BY n_name) || chr(10) AS t FROM nation GROUP BY ALL)"


def _usd(spark: SparkSession, sf: str, p: DataFrame) -> DataFrame:
    """Of each period the return of USD in KRW."""
    spans = p.select("start_date", "end_date").distinct()
    at = lambda side: money.rates_on_or_before(spans.select(f"{side}_date"), V.fx(spark, sf), f"{side}_date").select(f"{side}_date", F.col("usd_krw").alias(side))
    return spans.join(at("start"), "start_date").join(at("end"), "end_date").select("start_date", "end_date", (F.col("end") / F.col("start") - 1).alias("usd_krw_return"))


def r4_analysis_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The tables of each market's run, written, read and put side by side."""
    p = reports.periods(spark, sf).withColumn("total", F.col("gross_return") - F.col("net_return"))
    path = store.work_dir(spark, "analysis")
    tables = report.analysis_tables(p, _usd(spark, sf, p), ["market"])
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    krw, usd, fx = (spark.read.schema(df.schema).parquet(f"{path}/{name}") for name, df in tables.items())
    on = ["market", "start_date", "end_date"]
    both = krw.select(*on, "active_net").join(usd.select(*on, "net_usd", "benchmark_usd", F.col("active_net").alias("active_usd")), on).join(fx.select(*on, "net_fx", "benchmark_fx", "usd_krw_return"), on)
    return both.select(*on, *[F.round(c, 6).alias(c) for c in both.columns if c not in on])


R4 = """SELECT market, start_date, end_date, round(net - bench, 6) AS active_net, round(nu, 6) AS net_usd, round(bu, 6) AS benchmark_usd, round(nu - bu, 6) AS active_usd, round(net - nu, 6) AS net_fx, round(bench - bu, 6) AS benchmark_fx, round(x, 6) AS usd_krw_return FROM (
    SELECT *, (1 + net) / (1 + x) - 1 AS nu, (1 + bench) / (1 + x) - 1 AS bu FROM (SELECT market, start_date, end_date, net_return AS net, benchmark_return AS bench, e.rate / s.rate - 1 AS x FROM run_periods
        ASOF JOIN (SELECT * FROM fx WHERE pair = 'USD/KRW') s ON s.fx_date <= start_date ASOF JOIN (SELECT * FROM fx WHERE pair = 'USD/KRW') e ON e.fx_date <= end_date))"""


def q6_quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Required outputs of a run: one is missing and one is empty."""
    got = report.data_quality({"fundamentals": V.fundamentals(spark, sf), "constituents": V.constituents(spark, sf), "late": V.fundamentals(spark, sf).where("filing_date < period_end")})
    return report.quality_gate(["fundamentals", "constituents", "late", "trades"], got)


Q6 = """SELECT * FROM (VALUES ('fundamentals', true, 'pass', true), ('constituents', true, 'pass', true), ('trades', false, NULL, false)) v(output, "exists", status, passes)
    UNION ALL SELECT 'late', true, CASE WHEN count(*) > 0 THEN 'pass' ELSE 'fail' END, count(*) > 0 FROM fundamentals WHERE filing_date < period_end"""


def q7_stage_telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and seconds of three stages of a run; seconds differ, so only that they were taken is in the result."""
    base = store.work_dir(spark, "stages")
    stages = {"prices": V.prices(spark, sf), "fundamentals": V.fundamentals(spark, sf), "fx": V.fx(spark, sf)}
    rows = [report.timed(df, name, f"{base}/{name}") for name, df in stages.items()]
    whole = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return whole.select("stage", "rows", (F.col("seconds") > 0).alias("is_timed"))


Q7 = "SELECT 'prices' AS stage, count(*) AS rows, true AS is_timed FROM prices UNION ALL SELECT 'fundamentals', count(*), true FROM fundamentals UNION ALL SELECT 'fx', count(*), true FROM fx"


def h13_invalid_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer as a portfolio with targets by its orders' priorities, checked before anything is planned; some sums and caps are wrong."""
    from ..operators import weights

    o = V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("portfolio_id"), F.substring("o_orderpriority", 1, 1).alias("country")).agg(F.count("*").alias("n"))
    total = o.groupBy("portfolio_id").agg(F.sum("n").alias("t"))
    share = F.col("n") / F.col("t") * F.when(F.col("portfolio_id") % 11 == 0, 1.5).otherwise(1.0)
    targets = o.join(total, "portfolio_id").select("portfolio_id", "country", share.alias("target"), F.when(F.col("portfolio_id") % 13 == 0, 0).otherwise(20).alias("max_holdings"), F.when(F.col("portfolio_id") % 17 == 0, 1.2).otherwise(0.1).alias("max_single"))
    return weights.invalid_targets(targets, ["portfolio_id"]).select("portfolio_id", F.array_join("problems", "|").alias("problems"))


H13 = """SELECT portfolio_id, concat_ws('|', CASE WHEN portfolio_id % 11 = 0 THEN 'targets_sum' END, CASE WHEN portfolio_id % 13 = 0 THEN 'max_holdings' END, CASE WHEN portfolio_id % 17 = 0 THEN 'max_single' END) AS problems
    FROM (SELECT DISTINCT o_custkey AS portfolio_id FROM orders) WHERE portfolio_id % 11 = 0 OR portfolio_id % 13 = 0 OR portfolio_id % 17 = 0"""

_ALL = [
    s2_index_symbols, s4_price_windows, s5_fresh_files, s7_served_prices, s7_migration_counters, s9_filing_window, s11_fact_files, a10_report_scan, j12_filers, c4_canonical_benchmark, c25_price_provenance, c28_market_scope,
    f12_benchmark_grid, l1_marked_positions, l5_l6_rolled_holdings, k2_ledger_tables, k3_written_report, k3_document, k4_file_checksums, r4_analysis_tables, q6_quality_gate, q7_stage_telemetry, h13_invalid_targets,
]
QUERIES = {f.__name__: f for f in _ALL}
SQL = {
    "s2_index_symbols": "SELECT DISTINCT 'BR.' || (c_custkey % 300) AS symbol FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_custkey % 9 <> 0",
    "s4_price_windows": oracle(S4),
    "s5_fresh_files": oracle(S5),
    "s7_served_prices": oracle(S7, _STORE),
    "s7_migration_counters": oracle(S7_COUNTERS, _STORE),
    "s9_filing_window": S9,
    "s11_fact_files": oracle(S11),
    "a10_report_scan": oracle(A10),
    "j12_filers": oracle(J12),
    "c4_canonical_benchmark": oracle(C4, {"bench": market.BENCH}),
    "c25_price_provenance": oracle("SELECT 'vendor-' || lower(country) AS source, CASE WHEN close > 1000 THEN 'high' ELSE 'low' END AS quality_flag, count(*) AS n, round(sum(close), 2) AS sum_close FROM prices GROUP BY ALL"),
    "c28_market_scope": oracle("SELECT country, universe, count(*) AS n FROM securities WHERE country IN ('US', 'KR') GROUP BY ALL"),
    "f12_benchmark_grid": oracle(F12, {"bench": market.BENCH, "required": market.REQUIRED}),
    "l1_marked_positions": oracle(L1, research.L1_VIEWS),
    "l5_l6_rolled_holdings": oracle(L5, {**research.L1_VIEWS, "deltas": DELTAS}),
    "k2_ledger_tables": oracle(K2, research.L1_VIEWS),
    "k3_written_report": oracle(K3, {"run_periods": reports.PERIODS}),
    "k3_document": oracle(K3_DOCUMENT, {"run_periods": reports.PERIODS}),
    "k4_file_checksums": K4,
    "r4_analysis_tables": oracle(R4, {"run_periods": reports.PERIODS}),
    "q6_quality_gate": oracle(Q6),
    "q7_stage_telemetry": oracle(Q7),
    "h13_invalid_targets": H13,
}
