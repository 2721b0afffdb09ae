"""Quotas and picks. What a loop would do greedily, one group after another, is a clamp of running sums here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def requested_counts(total: int, targets: dict[str, float]) -> dict[str, int]:
    """Whole counts for a handful of countries: floors, then one more each by largest remainder, ties by name."""
    raw = {c: total * w for c, w in targets.items()}
    counts = {c: int(x) for c, x in raw.items()}
    for c in sorted(raw, key=lambda c: (counts[c] - raw[c], c))[: total - sum(counts.values())]:
        counts[c] += 1
    return counts


def running(value: Column, keys: list[str], order: list[Column]) -> Column:
    """The sum of value over the rows ahead."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def proportional_quotas(groups: DataFrame, keys: list[str], name: str, size: str, total: Column) -> DataFrame:
    """groups with ``quota``: total shared by size. Floors, at least 1 each if there are enough; what is over is taken from the largest, what is short goes by remainder."""
    whole = Window.partitionBy(*keys)
    g = groups.withColumns({"_t": total.cast("long"), "_n": F.count("*").over(whole), "_s": F.sum(size).over(whole)})
    g = g.withColumn("_raw", F.col("_t") * (F.col(size) / F.col("_s"))).withColumn("_f", F.floor("_raw"))
    g = g.withColumn("_q", F.when((F.col("_f") == 0) & (F.col("_t") >= F.col("_n")), 1).otherwise(F.col("_f")))
    g = g.withColumn("_over", F.sum("_q").over(whole) - F.col("_t"))
    spare = F.greatest(F.lit(0), F.col("_q") - 1)
    cut = F.greatest(F.lit(0), F.least(spare, F.col("_over") - running(spare, keys, [F.col("_q").desc(), F.col(name)])))
    more = F.row_number().over(Window.partitionBy(*keys).orderBy((F.col("_raw") - F.col("_q")).desc(), name)) <= -F.col("_over")
    quota = F.when(F.col("_t") <= 0, 0).when(F.col("_over") > 0, F.col("_q") - cut).otherwise(F.col("_q") + more.cast("long"))
    return g.withColumn("quota", quota.cast("long")).drop("_t", "_n", "_s", "_raw", "_f", "_q", "_over")


def quota_bounds(groups: DataFrame, keys: list[str], name: str, size: str, weight: str, total: Column, band: float) -> DataFrame:
    """groups with min_quota and max_quota: total times weight, less and plus the band; minima that together exceed total are cut, the largest first."""
    band = max(0.0, min(band, 1.0))
    low = F.floor(total * F.greatest(F.lit(0.0), F.col(weight) - band) + 1e-12)
    high = F.ceil(total * F.least(F.lit(1.0), F.col(weight) + band) - 1e-12)
    g = groups.withColumn("_low", F.least(F.greatest(F.lit(0), low), F.col(size)))
    g = g.withColumn("max_quota", F.least(F.greatest(F.col("_low"), high), F.col(size)).cast("long"))
    over = F.sum("_low").over(Window.partitionBy(*keys)) - total
    cut = F.greatest(F.lit(0), F.least(F.col("_low"), over - running(F.col("_low"), keys, [F.col("_low").desc(), F.col(name).desc()])))
    return g.withColumn("min_quota", (F.col("_low") - cut).cast("long")).drop("_low")


def ranked_rows(scored: DataFrame, keys: list[str], requested: dict[str, int], band: float = 0.1, stratify: bool = True) -> DataFrame:
    """scored with ``is_picked`` and rank_in_country: picked rows first, each part by score.

    keys: date, and model or portfolio. Of a country with more rows than are asked for, each sector gives its minimum
    (by size bucket if stratify), the best others fill up to the sector's maximum, and leftovers what is still missing."""
    country = [*keys, "country"]
    sector, bucket = [*country, "sector"], [*country, "sector", "size_bucket"]
    best = [F.col("score").desc(), F.col("security_id")]
    ask = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in requested.items() for x in pair]), F.col("country")), F.lit(0))
    rows = scored.withColumns({"_ask": ask, "_have": F.count("*").over(Window.partitionBy(*country))})
    liquidity = F.greatest("median_traded_value_krw", F.lit(1.0))
    sectors = rows.groupBy(*sector).agg(F.count("*").alias("_size"), F.sum(liquidity).alias("_liq"), F.first("_ask").alias("_ask"))
    sectors = sectors.withColumn("_w", F.col("_liq") / F.sum("_liq").over(Window.partitionBy(*country)))
    sectors = quota_bounds(sectors, country, "sector", "_size", "_w", F.col("_ask"), band)
    buckets = rows.groupBy(*bucket).agg(F.count("*").alias("_in")).join(sectors.select(*sector, "min_quota", "_size"), sector)
    buckets = proportional_quotas(buckets, sector, "size_bucket", "_in", F.col("min_quota")).select(*bucket, "quota")
    r = rows.join(sectors.select(*sector, "min_quota", "max_quota", "_size"), sector).join(buckets, bucket)
    in_sector, in_bucket = F.row_number().over(Window.partitionBy(*sector).orderBy(*best)), F.row_number().over(Window.partitionBy(*bucket).orderBy(*best))
    r = r.withColumns({"_rs": in_sector, "_rb": in_bucket})
    whole_sector = F.lit(not stratify) | (F.col("min_quota") >= F.col("_size"))
    r = r.withColumn("_first", F.when(whole_sector, F.col("_rs") <= F.col("min_quota")).otherwise(F.col("_rb") <= F.col("quota")))
    # buckets may hold less than the minimum together: the sector's best others make it up
    r = r.withColumn("_got", F.sum(F.col("_first").cast("long")).over(Window.partitionBy(*sector)))
    rest = F.row_number().over(Window.partitionBy(*sector, "_first").orderBy(*best))
    r = r.withColumn("_first", F.col("_first") | (rest <= F.col("min_quota") - F.col("_got")))
    # fill by score below the sectors' maxima, then leftovers
    r = r.withColumn("_taken", F.sum(F.col("_first").cast("long")).over(Window.partitionBy(*country)))
    r = r.withColumn("_mine", F.sum(F.col("_first").cast("long")).over(Window.partitionBy(*sector)))
    r = r.withColumn("_free", ~F.col("_first") & (F.row_number().over(Window.partitionBy(*sector, "_first").orderBy(*best)) <= F.col("max_quota") - F.col("_mine")))
    r = r.withColumn("_fill", F.col("_free") & (F.row_number().over(Window.partitionBy(*country, "_free").orderBy(*best)) <= F.col("_ask") - F.col("_taken")))
    r = r.withColumn("_now", F.col("_first") | F.col("_fill"))
    r = r.withColumn("_n", F.sum(F.col("_now").cast("long")).over(Window.partitionBy(*country)))
    left = ~F.col("_now") & (F.row_number().over(Window.partitionBy(*country, "_now").orderBy(*best)) <= F.col("_ask") - F.col("_n"))
    picked = (F.col("_ask") > 0) & (F.col("_have") > F.col("_ask")) & (F.col("_now") | left)
    r = r.withColumn("is_picked", picked)
    final = F.row_number().over(Window.partitionBy(*country).orderBy(F.col("is_picked").desc(), *best))
    drop = ["_ask", "_have", "_size", "_rs", "_rb", "_first", "_got", "_taken", "_mine", "_free", "_fill", "_now", "_n", "quota"]
    return r.withColumns({"rank_in_country": final, "is_eligible": F.lit(True), "factor_value": F.col("score")}).drop(*drop)
