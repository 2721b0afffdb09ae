"""Exchange rates, benchmark choice and price grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .temporal import asof_backward


def rates_by_date(fx: DataFrame) -> DataFrame:
    """(fx_date, usd_krw, usd_jpy, jpy_krw); the last row of a pair and date counts if fx has an ordinal, else there is one."""
    last = F.max_by("rate", "ordinal") if "ordinal" in fx.columns else F.max("rate")
    of = lambda pair, name: F.max(F.when(F.col("pair") == pair, F.col("rate"))).alias(name)
    each = fx.groupBy(F.upper("pair").alias("pair"), "fx_date").agg(last.alias("rate"))
    return each.groupBy("fx_date").agg(of("USD/KRW", "usd_krw"), of("USD/JPY", "usd_jpy"), of("JPY/KRW", "jpy_krw"))


def duplicate_rates(fx: DataFrame) -> DataFrame:
    return fx.groupBy(F.upper("pair").alias("pair"), "fx_date").agg(F.count("*").alias("n")).where("n > 1")


def rate_to_krw(currency: Column, usd_krw: Column, usd_jpy: Column, jpy_krw: Column | None = None) -> Column:
    """Null for an unsupported currency or a missing rate."""
    cross = usd_krw / F.nullif(usd_jpy, F.lit(0.0))
    yen = cross if jpy_krw is None else F.coalesce(jpy_krw, cross)
    return F.when(currency == "KRW", F.lit(1.0)).when(currency == "USD", usd_krw).when(currency == "JPY", yen)


def amounts_to_krw(rows: DataFrame, fx: DataFrame, amount: str = "traded_value", on: str = "price_date") -> DataFrame:
    """rows with amount_krw by the rates of the very day; null where they are missing."""
    rates = rates_by_date(fx).withColumnRenamed("fx_date", on)
    rate = rate_to_krw(F.upper("currency"), F.col("usd_krw"), F.col("usd_jpy"), F.col("jpy_krw"))
    return rows.join(rates, on, "left").withColumn("amount_krw", F.col(amount) * rate).drop("usd_krw", "usd_jpy", "jpy_krw")


def rates_on_or_before(dates: DataFrame, fx: DataFrame, on: str) -> DataFrame:
    """(on, usd_krw, usd_jpy): for each date the last known rate of each pair."""
    pairs = dates.select(F.col(on)).distinct().select(on, F.explode(F.array(F.lit("USD/KRW"), F.lit("USD/JPY"))).alias("pair"))
    found = asof_backward(pairs, fx.select(F.upper("pair").alias("pair"), "fx_date", "rate"), ["pair"], on, "fx_date", ["rate"])
    of = lambda pair, name: F.max(F.when(F.col("pair") == pair, F.col("rate"))).alias(name)
    return found.groupBy(on).agg(of("USD/KRW", "usd_krw"), of("USD/JPY", "usd_jpy"))


def prices_to_krw(rows: DataFrame, fx: DataFrame, on: str, price: str = "close") -> DataFrame:
    """rows with price_krw by the last rates on or before the day."""
    rates = rates_on_or_before(rows.select(on), fx, on)
    return rows.join(rates, on).withColumn("price_krw", F.col(price) * rate_to_krw(F.upper("currency"), F.col("usd_krw"), F.col("usd_jpy"))).drop("usd_krw", "usd_jpy")


def fx_return(currency: Column, start: tuple[Column, Column], end: tuple[Column, Column]) -> Column:
    """start and end: usd_krw and usd_jpy. 0 for KRW; null for an unsupported currency."""
    return rate_to_krw(currency, *end) / F.nullif(rate_to_krw(currency, *start), F.lit(0.0)) - 1


def in_krw(local: Column, fx: Column) -> Column:
    return (1 + local) * (1 + fx) - 1


def decomposed(local: Column, fx: Column) -> list[Column]:
    return [local.alias("local_part"), fx.alias("fx_part"), (local * fx).alias("interaction"), (local + fx + local * fx).alias("total")]


def period_returns_krw(periods: DataFrame, benchmark: DataFrame, fx: DataFrame) -> DataFrame:
    """periods (start_date, end_date) with the benchmark's return in KRW; null if it has no close at an end, or one of 0 at the start."""
    known = lambda side: benchmark.select(F.col("benchmark_date").alias(f"{side}_date"), F.col("close").alias(f"{side}_close"), F.upper("currency").alias(f"{side}_currency"))
    rates = lambda side: rates_on_or_before(periods.select(F.col(f"{side}_date")), fx, f"{side}_date").withColumnsRenamed({"usd_krw": f"{side}_krw", "usd_jpy": f"{side}_jpy"})
    both = periods
    for side in ("start", "end"):
        both = both.join(known(side), f"{side}_date", "left").join(rates(side), f"{side}_date", "left")
    local = F.col("end_close") / F.nullif(F.col("start_close"), F.lit(0.0)) - 1
    moved = fx_return(F.col("start_currency"), (F.col("start_krw"), F.col("start_jpy")), (F.col("end_krw"), F.col("end_jpy")))
    return both.select(*periods.columns, in_krw(local, moved).alias("benchmark_return"))


def proxy_quality(pairs: DataFrame, keys: list[str], min_correlation: float = 0.95, max_error: float = 0.05, per_year: int = 252) -> DataFrame:
    """pairs: official and proxy returns of one day. n, correlation, tracking_error and is_good by keys.

    The correlation comes from sums, as corr fails on constant input; without variance it is 1 if both are the same, else 0."""
    n, a, b = F.count("*"), F.col("official"), F.col("proxy")
    means = pairs.where(a.isNotNull() & b.isNotNull()).groupBy(*keys).agg(n.alias("n"), F.avg(a).alias("ma"), F.avg(b).alias("mb"))
    centred = pairs.where(a.isNotNull() & b.isNotNull()).join(means, keys).withColumns({"x": a - F.col("ma"), "y": b - F.col("mb"), "active": b - a})
    sums = centred.groupBy(*keys).agg(F.first("n").alias("n"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") ** 2).alias("xx"), F.sum(F.col("y") ** 2).alias("yy"), F.max(F.abs(F.col("x") - F.col("y"))).alias("gap"), F.stddev_samp("active").alias("s"))
    flat = (F.col("xx") <= 1e-24) | (F.col("yy") <= 1e-24)
    r = F.when(flat, F.when(F.col("gap") <= 1e-12, 1.0).otherwise(0.0)).otherwise(F.col("xy") / F.sqrt(F.when(flat, 1.0).otherwise(F.col("xx") * F.col("yy"))))
    out = sums.where("n >= 2").select(*keys, "n", r.alias("correlation"), (F.col("s") * F.sqrt(F.lit(float(per_year)))).alias("tracking_error"))
    return out.withColumn("is_good", (F.col("correlation") >= min_correlation) & (F.col("tracking_error") <= max_error))


def select_benchmark(official: DataFrame, proxy: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """Of each benchmark_id the official series if it has rows, else the proxy; status says how it was chosen."""
    both = official.withColumn("is_official", F.lit(True)).unionByName(proxy.withColumn("is_official", F.lit(False)))
    whole = Window.partitionBy("benchmark_id")
    chosen = both.withColumn("has", F.max("is_official").over(whole)).where(F.col("has") == F.col("is_official")).drop("has")
    if quality is not None:
        chosen = chosen.join(quality.select("benchmark_id", "is_good"), "benchmark_id", "left")
    else:
        chosen = chosen.withColumn("is_good", F.lit(None).cast("boolean"))
    status = F.when(F.col("is_official"), "official_selected").when(F.col("is_good").isNull(), "proxy_fallback_missing_quality_inputs").when(F.col("is_good"), "proxy_fallback_used").otherwise("proxy_quality_guardrail_breached")
    return chosen.withColumn("status", status).drop("is_official", "is_good")


def source_priority(rows: DataFrame, priority: list[str], groups: list[str] | None = None) -> DataFrame:
    """The rows of the first source that has any, chosen once for each group (or the whole feed); quality_flag marks fallbacks."""
    if len(set(priority)) != len(priority):
        raise ValueError("sources are repeated")
    groups = groups or []
    ranks = F.create_map(*[x for i, s in enumerate(priority) for x in (F.lit(s.lower()), F.lit(i))])
    ranked = rows.withColumn("_rank", F.element_at(ranks, F.lower(F.trim("source")))).where("_rank is not null")
    best = ranked.groupBy(*groups).agg(F.min("_rank").alias("_best"))
    joined = ranked.join(best, groups) if groups else ranked.crossJoin(F.broadcast(best))  # one row
    return joined.where("_rank = _best").withColumn("quality_flag", F.when(F.col("_best") == 0, "primary").otherwise("fallback")).drop("_rank", "_best")


def price_grid(prices: DataFrame, required: DataFrame) -> DataFrame:
    """For each security and required date the last close and volume on or before it; securities that miss any date are left out."""
    ids, n = prices.select("security_id").distinct(), required.select("required_date").distinct()
    grid = ids.join(F.broadcast(n), how="cross") if n.limit(100_001).count() <= 100_000 else ids.crossJoin(n)
    found = asof_backward(grid, prices, ["security_id"], "required_date", "price_date", ["close", "volume"])
    whole = Window.partitionBy("security_id")
    full = found.withColumn("_hits", F.count("close").over(whole)).withColumn("_all", F.count("*").over(whole)).where("_hits = _all").drop("_hits", "_all")
    value = F.greatest(F.col("close") * F.greatest(F.coalesce("volume", F.lit(0.0)), F.lit(1.0)), F.col("close"))
    return full.select("security_id", "required_date", "asof_date", F.round("close", 6).alias("close"), value.alias("traded_value"))
