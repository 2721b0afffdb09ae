"""Factor values, winsorising, scores and ranks across a date's securities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import saved

BILLION = 1_000_000_000.0
# Models with their weights of the sector score and the size score.
MODELS = {"rnd_sales_ttm": (0.7, 0.3), "rnd_sales_size_proxy": (0.4, 0.6), "rnd_mktcap_proxy": (0.3, 0.7), "rnd_ev_proxy": (0.6, 0.4), "rnd_robust_composite": (0.5, 0.5)}
NEED_SALES = ("rnd_sales_ttm", "rnd_sales_size_proxy")


def rnd_sales_factor(rows: DataFrame) -> DataFrame:
    """rows with factor_value, is_eligible and eligibility_reason."""
    reason = F.when(F.col("rd_expense").isNull(), "MISSING_RD_EXPENSE").when(F.col("sales_ttm").isNull(), "MISSING_SALES_TTM").when(F.col("sales_ttm") <= 0, "NON_POSITIVE_SALES_TTM").otherwise("ELIGIBLE")
    known = rows.withColumn("eligibility_reason", reason).withColumn("is_eligible", F.col("eligibility_reason") == "ELIGIBLE")
    return known.withColumn("factor_value", F.when(F.col("is_eligible"), F.col("rd_expense") / F.col("sales_ttm")))


#: Ranges that a pass of exact_quantiles counts.
RANGES = 1024


def exact_quantiles(rows: DataFrame, groups: list[str], value: str, at: list[float], ranges: int = RANGES) -> DataFrame:
    """(groups, q): for each group the array of its linear-interpolated quantiles, at position (n - 1) * p.

    Selection by repeated counts: the values between a rank's bounds are counted in ranges of equal width, and the least and
    largest value of the range that holds the rank are its next bounds, until they are one value. A pass is an
    aggregate with as many rows as there are groups, ranks and ranges; no buffer holds a group. Values are finite."""
    known = rows.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_v"))
    whole = known.groupBy(*groups).agg(F.count("*").alias("_n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    place = lambda p: (F.col("_n") - 1) * F.lit(float(p))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(p)), F.ceil(place(p))) for p in at])))
    live = saved(whole.select(*groups, "_n", F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("below"), "lo", "hi"), "ranks")
    done = live.where("lo = hi")
    key = [*groups, "_n", "rank"]
    while not (live := live.where("lo < hi")).isEmpty():
        within = known.join(live, groups).where(F.col("_v").between(F.col("lo"), F.col("hi")))
        # halves first, as a width may be beyond the largest double
        slot = F.least(F.lit(ranges - 1), F.floor((F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * ranges))
        counted = within.groupBy(*key, "below", slot.alias("slot")).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = F.col("below") + F.sum("n").over(Window.partitionBy(*key).orderBy("slot"))
        chosen = counted.withColumn("_upto", upto).where((F.col("_upto") > F.col("rank")) & (F.col("_upto") - F.col("n") <= F.col("rank")))
        live = saved(chosen.select(*key, (F.col("_upto") - F.col("n")).alias("below"), "lo", "hi"), "ranks")
        done = done.unionByName(live.where("lo = hi"))
    found = done.groupBy(*groups, "_n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "lo"))).alias("_of"))

    def between(p: float) -> Column:
        low, high = F.floor(place(p)), F.ceil(place(p))
        a, b = F.element_at("_of", low), F.element_at("_of", high)
        return F.when(low == high, a).otherwise((high - place(p)) * a + (place(p) - low) * b)

    return found.select(*groups, F.array(*[between(p) for p in at]).alias("q"))


def winsorize(rows: DataFrame, groups: list[str], value: str = "factor_value", low: float = 0.01, high: float = 0.99, by_ranges: bool = False) -> DataFrame:
    """value clamped to its exact quantiles in each group. They come from an aggregate that is joined back, so no group is sorted as a window; for groups whose distinct values don't fit a task, by_ranges counts ranges instead (see exact_quantiles)."""
    if not 0 <= low < high <= 1:
        raise ValueError("quantiles must be in order between 0 and 1")
    if by_ranges:
        bounds = exact_quantiles(rows, groups, value, [low, high]).withColumnRenamed("q", "_q")
    else:
        bounds = rows.where(F.col(value).isNotNull()).groupBy(*groups).agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("_q"))
    clamped = F.least(F.greatest(F.col(value), F.col("_q")[0]), F.col("_q")[1])
    return rows.join(bounds, groups, "left").withColumn(value, F.when(F.col(value).isNotNull(), clamped)).drop("_q")


def rank_in_country(rows: DataFrame, groups: list[str]) -> DataFrame:
    """1 for the largest factor; ties by security_id; null where not eligible."""
    order = Window.partitionBy(*groups, "country", "is_eligible").orderBy(F.col("factor_value").desc(), "security_id")
    return rows.withColumn("rank_in_country", F.when(F.col("is_eligible"), F.row_number().over(order)))


def raw_metrics(rows: DataFrame, models: list[str] | None = None) -> DataFrame:
    """rows once for each model, with ``raw``; rows that lack what a model needs are left out. median_traded_value_krw is the liquidity."""
    rd, liquidity = F.col("rd_expense"), F.greatest("median_traded_value_krw", F.lit(1.0))
    scale = F.greatest(F.log1p(liquidity / BILLION), F.lit(1e-6))
    ratio = rd / F.greatest("sales_ttm", F.when(F.col("sales_ttm").isNotNull(), 1e-9))
    by_size, by_cap, by_ev = ratio / scale, rd / liquidity, rd / (liquidity * (1 + scale))
    parts = F.filter(F.array(by_cap, by_ev, ratio, by_size), lambda x: x.isNotNull())
    mean = F.aggregate(parts, F.lit(0.0), lambda a, b: a + b) / F.size(parts)
    values = dict(zip(MODELS, (ratio, by_size, by_cap, by_ev, mean)))
    each = F.array(*[F.struct(F.lit(m).alias("model"), values[m].alias("raw")) for m in models or MODELS])
    return rows.where(rd.isNotNull()).select("*", F.inline(each)).where("raw is not null")


def sector_weights(rows: DataFrame, keys: list[str], liquidity: str = "median_traded_value_krw") -> DataFrame:
    """(keys, sector, weight): each sector's share of the liquidity of its group; a security counts with 1 at least."""
    sums = rows.groupBy(*keys, "sector").agg(F.sum(F.greatest(liquidity, F.lit(1.0))).alias("_l"))
    return sums.select(*keys, "sector", (F.col("_l") / F.sum("_l").over(Window.partitionBy(*keys))).alias("weight"))


def for_their_models(rows: DataFrame) -> DataFrame:
    """rows of raw_metrics without those that their model can't use: models on sales need positive ones, the others only R&D."""
    return rows.where((F.coalesce("sales_ttm", F.lit(0.0)) > 0) | ~F.col("model").isin(*NEED_SALES))


def zscore(value: Column, keys: list[str]) -> Column:
    """By population mean and deviation; 0 if all are the same."""
    w = Window.partitionBy(*keys)
    std = F.stddev_pop(value).over(w)
    return F.when(std <= 1e-12, 0.0).otherwise((value - F.avg(value).over(w)) / F.nullif(std, F.lit(0.0)))


def with_scores(rows: DataFrame, groups: list[str]) -> DataFrame:
    """rows of raw_metrics with sector_z, size_z, size_bucket and score. groups: date and, if there are many, model or portfolio."""
    country = [*groups, "country"]
    liquidity = F.greatest("median_traded_value_krw", F.lit(1.0))
    adjusted = F.col("raw") / F.greatest(F.log1p(liquidity / BILLION), F.lit(1e-6))
    by_size = Window.partitionBy(*country).orderBy("_liq", "security_id")
    whole = Window.partitionBy(*country)
    ranked = rows.withColumns({"_liq": liquidity, "_adj": adjusted}).withColumns({"_rn": F.row_number().over(by_size), "_n": F.count("*").over(whole)})
    cut = lambda k: F.max(F.when(F.col("_rn") == F.greatest(F.expr(k) - 1, F.lit(0)) + 1, F.col("_liq"))).over(whole)
    sized = ranked.withColumns({"_low": cut("_n div 3"), "_high": cut("(2 * _n) div 3")})
    bucket = F.when(F.col("_liq") <= F.col("_low"), "small").when(F.col("_liq") <= F.col("_high"), "mid").otherwise("large")
    scored = sized.withColumns({"size_bucket": bucket, "sector_z": zscore(F.col("raw"), [*country, "sector"]), "size_z": zscore(F.col("_adj"), country)})
    weights = lambda i: F.element_at(F.create_map(*[x for m, w in MODELS.items() for x in (F.lit(m), F.lit(w[i]))]), F.col("model"))
    # ten decimals: where one value dwarfs the others, their scores differ by less than the order of sums decides
    score = F.round(weights(0) * F.col("sector_z") + weights(1) * F.col("size_z"), 10)
    return scored.withColumn("score", score).drop("_liq", "_adj", "_rn", "_n", "_low", "_high")
