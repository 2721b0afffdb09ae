"""Target weights for every portfolio and date in one plan.

Rows are grouped by pf, the portfolio's and date's columns. A group has as many rows as a date has eligible names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quota import running
from .temporal import dates_side

EPS = 1e-12


def check_parameters(targets: dict[str, float], max_holdings: int, max_single: float, tolerance: float = 0.02, alpha: float = 0.2, participation: float = 0.1, portfolio_value: float = 1e10, te_cap: float = 0.0, max_turnover: float | None = None) -> None:
    """Raises where portfolios are planned if a parameter is out of its range or the targets don't sum to 1."""
    wrong = [
        (max_holdings <= 0, "max_holdings must be positive"),
        (not 0 < max_single <= 1, "max_single must be above 0 and at most 1"),
        (not 0 <= tolerance < 1, "tolerance must be from 0 to below 1"),
        (not targets, "no country targets"),
        (any(x < 0 for x in targets.values()), "country targets must not be negative"),
        (bool(targets) and abs(sum(targets.values()) - 1) > EPS, "country targets must sum to 1"),
        (te_cap < 0, "te_cap must not be negative"),
        (alpha < 0, "alpha must not be negative"),
        (participation <= 0, "participation must be positive"),
        (portfolio_value <= 0, "portfolio_value must be positive"),
        (max_turnover is not None and max_turnover < 0, "max_turnover must not be negative"),
    ]
    if said := [text for bad, text in wrong if bad]:
        raise ValueError("; ".join(said))


def invalid_targets(targets: DataFrame, portfolio: list[str]) -> DataFrame:
    """(portfolio, problems) of a table of targets (country, target, max_holdings, max_single) whose rows break the same rules; none if all is well."""
    sums = targets.groupBy(*portfolio).agg(F.sum("target").alias("t"), F.min("target").alias("least"), F.min("max_holdings").alias("n"), F.min("max_single").alias("low"), F.max("max_single").alias("high"))
    said = F.array_compact(F.array(
        F.when(F.abs(F.col("t") - 1) > EPS, "targets_sum"), F.when(F.col("least") < 0, "target_negative"), F.when(F.col("n") <= 0, "max_holdings"), F.when((F.col("low") <= 0) | (F.col("high") > 1), "max_single"),
    ))
    return sums.withColumn("problems", said).where(F.size("problems") > 0).select(*portfolio, "problems")


def negative_weights(weights: DataFrame, portfolio: list[str]) -> DataFrame:
    """Previous weights below 0, which no construction may start from."""
    return weights.where("weight < 0").select(*portfolio, "security_id", "weight")


def select_names(ranked: DataFrame, targets: DataFrame, pf: list[str]) -> DataFrame:
    """Rows of ranked that are selected. targets: pf's portfolio columns, country, target, requested, max_holdings.

    The first requested of each target country by rank, then the best of the others across countries up to max_holdings."""
    on = [c for c in targets.columns if c in pf] + ["country"]
    rows = ranked.where("is_eligible and factor_value is not null").join(dates_side(targets), on)  # one row for each country of a portfolio
    rank = F.coalesce("rank_in_country", F.lit(10**9))
    rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*pf, "country").orderBy(rank, F.col("factor_value").desc(), "security_id")))
    rows = rows.withColumn("_core", F.col("_rn") <= F.col("requested"))
    spare = F.row_number().over(Window.partitionBy(*pf, "_core").orderBy(rank, F.col("factor_value").desc(), "country", "security_id"))
    rows = rows.withColumns({"_spare": spare, "_have": F.sum(F.col("_core").cast("long")).over(Window.partitionBy(*pf))})
    return rows.where(F.col("_core") | (F.col("_spare") <= F.col("max_holdings") - F.col("_have"))).drop("_rn", "_core", "_spare", "_have")


def country_budgets(selected: DataFrame, targets: DataFrame, dates: DataFrame, pf: list[str], tolerance: float = 0.02) -> DataFrame:
    """For each portfolio, date and target country: n_selected, capacity, budget and flags. targets also has max_single.

    A country gets its target or what its names can hold; what is left goes to spare capacity in order of name."""
    portfolio = [c for c in targets.columns if c in pf]
    n = selected.groupBy(*pf, "country").agg(F.count("*").alias("n_selected"))
    all_countries = dates.select(*pf).distinct().join(dates_side(targets), portfolio)
    b = all_countries.join(n, [*pf, "country"], "left").withColumn("n_selected", F.coalesce("n_selected", F.lit(0)))
    b = b.withColumn("capacity", F.col("n_selected") * F.col("max_single")).withColumn("_first", F.least("target", "capacity"))
    b = b.withColumn("_left", F.greatest(F.lit(0.0), 1 - F.sum("_first").over(Window.partitionBy(*pf)))).withColumn("_room", F.greatest(F.lit(0.0), F.col("capacity") - F.col("_first")))
    more = F.greatest(F.lit(0.0), F.least(F.col("_room"), F.col("_left") - running(F.col("_room"), pf, [F.col("country")])))
    b = b.withColumn("budget", F.col("_first") + more)
    unmet = (F.col("budget") < F.greatest(F.lit(0.0), F.col("target") - tolerance) - EPS) | (F.col("budget") > F.least(F.lit(1.0), F.col("target") + tolerance) + EPS)
    flags = F.array(
        F.when(F.col("n_selected") == 0, F.concat(F.lit("NO_SELECTED_NAMES_"), "country")),
        F.when((F.col("n_selected") > 0) & (F.col("capacity") < F.col("target")), F.concat(F.lit("COUNTRY_CAPACITY_BIND_"), "country")),
        F.when((F.col("n_selected") > 0) & unmet, F.concat(F.lit("COUNTRY_TOLERANCE_UNMET_"), "country")),
        F.when(F.col("n_selected") < F.col("requested"), F.concat(F.lit("INSUFFICIENT_NAMES_"), "country")),
        F.when(F.col("_left") - F.sum("_room").over(Window.partitionBy(*pf)) > EPS, F.lit("UNALLOCATED_CASH_DUE_TO_CAPACITY")),
        F.when(F.sum("n_selected").over(Window.partitionBy(*pf)) < F.col("max_holdings"), F.lit("TOTAL_UNDER_MAX_HOLDINGS")),
    )
    return b.withColumn("flags", F.array_compact(flags)).drop("_first", "_left", "_room")


def capped_allocation(rows: DataFrame, keys: list[str], base: str, cap: str, total: Column, out: str, tie: str = "security_id") -> DataFrame:
    """rows with ``out``: total shared in proportion to base, none above its cap, what a capped row can't take going to the others.

    Rows whose base is 0 share equally what is left when all others are full. In order of cap by base, the rows that fill
    up come first, so running sums tell where that ends: no loop."""
    whole = Window.partitionBy(*keys)
    b, c = F.greatest(F.col(base), F.lit(0.0)), F.greatest(F.col(cap), F.lit(0.0))
    r = rows.withColumns({"_b": b, "_c": c}).withColumn("_t", F.least(total, F.sum("_c").over(whole)))
    r = r.withColumn("_two", (F.col("_b") <= 0).cast("int")).withColumn("_w", F.when(F.col("_two") == 1, F.lit(1.0)).otherwise(F.col("_b")))
    first_caps = F.sum(F.when(F.col("_two") == 0, F.col("_c")).otherwise(0.0)).over(whole)
    r = r.withColumn("_t", F.greatest(F.lit(0.0), F.when(F.col("_two") == 1, F.col("_t") - first_caps).otherwise(F.least(F.col("_t"), first_caps))))
    phase = [*keys, "_two"]
    order = [F.col("_c") / F.col("_w"), F.col(tie)]
    r = r.withColumns({"_cb": running(F.col("_c"), phase, order), "_wb": running(F.col("_w"), phase, order), "_ws": F.sum("_w").over(Window.partitionBy(*phase))})
    level = (F.col("_t") - F.col("_cb")) / F.nullif(F.col("_ws") - F.col("_wb"), F.lit(0.0))
    r = r.withColumn("_full", F.coalesce(level * F.col("_w") >= F.col("_c") - EPS, F.lit(True)))
    sums = Window.partitionBy(*phase)
    full = lambda x: F.sum(F.when(F.col("_full"), F.col(x)).otherwise(0.0)).over(sums)
    rest = (F.col("_t") - full("_c")) / F.nullif(F.col("_ws") - full("_w"), F.lit(0.0))
    share = F.when(F.col("_t") <= 0, 0.0).when(F.col("_full"), F.col("_c")).otherwise(F.greatest(F.lit(0.0), rest * F.col("_w")))
    return r.withColumn(out, share).drop("_b", "_c", "_t", "_two", "_w", "_cb", "_wb", "_ws", "_full")


def allocate(selected: DataFrame, budgets: DataFrame, pf: list[str], alpha: float = 0.2, participation: float = 0.1, portfolio_value: float = 1e10, te_cap: float = 0.0) -> DataFrame:
    """selected with bench, cap, weight and row_flags: benchmark share tilted by the factor's z-score, capped by name and by trading volume, and shrunk to the benchmark if it strays further than te_cap (0: no limit)."""
    country = [*pf, "country"]
    w = Window.partitionBy(*country)
    r = selected.join(budgets.select(*country, "budget"), country)
    liquidity = F.col("median_traded_value_krw")
    given = F.col("benchmark_proxy_weight") if "benchmark_proxy_weight" in selected.columns else F.lit(None).cast("double")
    seed = F.greatest(F.coalesce(F.when(given > 0, given), liquidity, F.lit(1.0)), F.lit(1.0))
    std = F.stddev_pop("factor_value").over(w)
    z = F.when(std > EPS, (F.col("factor_value") - F.avg("factor_value").over(w)) / F.nullif(std, F.lit(0.0))).otherwise(0.0)
    adv = F.when(liquidity > 0, F.least(F.col("max_single"), participation * liquidity / portfolio_value)).otherwise(F.col("max_single"))
    r = r.withColumn("_s", seed).withColumn("_share", F.col("_s") / F.sum("_s").over(w)).withColumns({"_z": z, "cap": F.greatest(F.lit(0.0), adv)})
    r = r.withColumns({"_raw": F.greatest(F.lit(0.0), F.col("_share") * (1 + alpha * F.col("_z"))), "bench": F.col("budget") * F.col("_share")})
    r = capped_allocation(r, country, "_raw", "cap", F.col("budget"), "weight")
    flags = [F.when(F.col("cap") < F.col("max_single") - EPS, F.lit("ADV_CAP_BIND")), F.when(F.col("cap") <= 0, F.concat(F.lit("ZERO_CAP_"), "country"))]
    if te_cap > 0:
        r = r.withColumn("_l2", F.sqrt(F.sum((F.col("weight") - F.col("bench")) ** 2).over(Window.partitionBy(*pf))))
        strays = F.col("_l2") > te_cap + EPS
        r = r.withColumn("_pull", F.greatest(F.lit(0.0), F.col("bench") + (F.col("weight") - F.col("bench")) * te_cap / F.nullif("_l2", F.lit(0.0))))
        r = capped_allocation(r, country, "_pull", "cap", F.col("budget"), "_near")
        r = r.withColumn("weight", F.when(strays, F.col("_near")).otherwise(F.col("weight")))
        flags.append(F.when(strays, F.lit("TE_ACTIVE_L2_CAP_BIND")))
    return r.withColumn("row_flags", F.array_compact(F.array(*flags))).drop("_s", "_share", "_z", "_raw", "_l2", "_pull", "_near")


def diagnostics(weighted: DataFrame, budgets: DataFrame, pf: list[str], chain: DataFrame | None = None) -> DataFrame:
    """For each portfolio and date: n_holdings, invested, cash and the sorted distinct reasons, joined by |. With the chain its constructed weights are what is held, and TURNOVER_CAP_BIND is among the reasons."""
    if chain is not None:
        own = chain.where("constructed > 0").select(*pf, "security_id", F.col("constructed").alias("weight"), F.when(F.col("binds"), F.array(F.lit("TURNOVER_CAP_BIND"))).otherwise(F.array().cast("array<string>")).alias("row_flags"))
        weighted = own.unionByName(weighted.select(*pf, "security_id", F.lit(0.0).alias("weight"), "row_flags"))
    held = weighted.groupBy(*pf).agg(F.count_if(F.col("weight") > 0).alias("n_holdings"), F.sum("weight").alias("invested"), F.array_distinct(F.flatten(F.collect_set("row_flags"))).alias("_r"))
    flags = budgets.groupBy(*pf).agg(F.array_distinct(F.flatten(F.collect_set("flags"))).alias("_f"))
    d = flags.join(held, pf, "left").withColumns({"n_holdings": F.coalesce("n_holdings", F.lit(0)), "invested": F.coalesce("invested", F.lit(0.0))})
    cash = F.greatest(F.lit(0.0), 1 - F.col("invested"))
    none = F.array().cast("array<string>")
    return d.select(*pf, "n_holdings", "invested", F.when(cash < EPS, 0.0).otherwise(cash).alias("cash"), F.array_join(F.array_sort(F.array_distinct(F.concat(F.coalesce("_r", none), "_f"))), "|").alias("reasons"))


def country_diagnostics(weighted: DataFrame, budgets: DataFrame, available: DataFrame, pf: list[str]) -> DataFrame:
    """For each portfolio, date and target country: requested, n_available (of the table available: pf, country, n_available), n_selected, n_holdings, weight and the budget it was given."""
    on = [*pf, "country"]
    held = weighted.groupBy(*on).agg(F.count_if(F.col("weight") > 0).alias("n_holdings"), F.sum("weight").alias("weight"))
    d = budgets.select(*on, "requested", "n_selected", "budget").join(available.select(*on, "n_available"), on, "left").join(held, on, "left")
    return d.select(*on, "requested", F.coalesce("n_available", F.lit(0)).alias("n_available"), "n_selected", F.coalesce("n_holdings", F.lit(0)).alias("n_holdings"), F.coalesce("weight", F.lit(0.0)).alias("weight"), "budget")


def turnover_step(target: DataFrame, previous: DataFrame, pf: list[str], limit: float) -> DataFrame:
    """(pf, security_id, target, previous, blended): towards the target as far as the limit on half the sum of changes lets it."""
    both = target.select(*pf, "security_id", F.col("weight").alias("target")).join(previous.select(*pf, "security_id", F.col("weight").alias("previous")), [*pf, "security_id"], "full_outer")
    both = both.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("target", "previous")})
    turnover = 0.5 * F.sum(F.abs(F.col("target") - F.col("previous"))).over(Window.partitionBy(*pf))
    limit = max(0.0, min(limit, 2.0))
    part = F.when((turnover <= limit + EPS) | (turnover <= EPS), 1.0).otherwise(limit / F.nullif(turnover, F.lit(0.0)))
    return both.withColumn("turnover", turnover).withColumn("blended", F.col("previous") + part * (F.col("target") - F.col("previous")))


def merged_allocations(rows: DataFrame, portfolio: list[str]) -> DataFrame:
    """(portfolio, as_of_date, security_id, weight): weights of one security and date added up."""
    return rows.groupBy(*portfolio, "as_of_date", "security_id").agg(F.sum("weight").alias("weight"))


def allocation_totals(merged: DataFrame, portfolio: list[str]) -> DataFrame:
    """For each date the total, whether it is over 1, and how many weights are negative."""
    return merged.groupBy(*portfolio, "as_of_date").agg(F.sum("weight").alias("total"), (F.sum("weight") > 1 + EPS).alias("is_over"), F.count_if(F.col("weight") < 0).alias("n_negative"))


def sleeves(weights: DataFrame, dates: DataFrame, portfolio: list[str], k: int = 4) -> DataFrame:
    """(portfolio, as_of_date, security_id, weight): the mean of the last k dates' weights, scaled to the current sum. A date without holdings stays without, but counts as one of the k.

    A weight is sent to the k dates that it counts for; nothing is filled in."""
    order = Window.partitionBy(*portfolio).orderBy("as_of_date")
    numbered = dates.select(*portfolio, "as_of_date").distinct().withColumn("_i", F.row_number().over(order))
    own = weights.join(numbered, [*portfolio, "as_of_date"]).select(*portfolio, "security_id", "weight", "_i")
    spread = own.withColumn("_j", F.explode(F.sequence(F.col("_i"), F.col("_i") + k - 1)))
    summed = spread.groupBy(*portfolio, F.col("_j").alias("_i"), "security_id").agg(F.sum("weight").alias("_sum"))
    now = own.groupBy(*portfolio, "_i").agg(F.sum("weight").alias("_now"))
    mean = summed.join(numbered, [*portfolio, "_i"]).join(now, [*portfolio, "_i"]).withColumn("_mean", F.col("_sum") / F.least(F.lit(k), F.col("_i")))
    scaled = F.col("_mean") * F.col("_now") / F.sum("_mean").over(Window.partitionBy(*portfolio, "as_of_date"))
    return mean.select(*portfolio, "as_of_date", "security_id", scaled.alias("weight"))


def _capped(base: pd.Series, cap: pd.Series, total: float) -> pd.Series:
    """capped_allocation of one group, for the chain of dates."""
    out, left = pd.Series(0.0, base.index), min(total, cap.clip(lower=0).sum())
    for part, weight in ((base[base > 0], base[base > 0]), (base[base <= 0], pd.Series(1.0, base[base <= 0].index))):
        order = (cap[part.index] / weight).sort_values(kind="stable").index
        room = weight.sum()
        for i in order:
            out[i] = max(0.0, min(cap[i], left * weight[i] / room if room > 0 else 0.0))
            left, room = left - out[i], room - weight[i]
    return out


def turnover_chain(weighted: DataFrame, portfolio: list[str], limit: float, k: int = 1, dates: DataFrame | None = None) -> DataFrame:
    """(portfolio, as_of_date, security_id, country, constructed, weight, binds): a fold along the dates of each portfolio.

    weighted: the output of allocate. A date's constructed weights start from what was held, the date before's blended
    weights, and go towards their target as far as the limit on half the turnover lets them; what that leaves is shared
    below the caps within each country's budget, and binds tells that the limit counted. The blended weights are the mean
    of the last k dates' constructed ones, scaled to the current sum (k = 1: the constructed ones themselves). A date of
    ``dates`` without rows holds nothing, counts as one of the k, and the next one starts afresh.

    The state is one vector of blended and k of constructed weights of a portfolio, some hundreds of names; portfolios run
    side by side."""
    limit = max(0.0, min(limit, 2.0))
    types = {f.name: f.dataType.simpleString() for f in weighted.schema.fields}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in portfolio), "as_of_date date, security_id string, country string, constructed double, weight double, binds boolean"])
    rows = weighted.select(*portfolio, "as_of_date", "security_id", "country", "weight", "cap", "budget")
    if dates is not None:
        rows = dates.select(*portfolio, "as_of_date").distinct().join(rows, [*portfolio, "as_of_date"], "left")

    def constructed(day: pd.DataFrame, held: pd.Series) -> tuple[pd.Series, bool]:
        target = day["weight"].astype(float)
        if not len(held) or not len(target):
            return target, False
        a, b = target.align(held, fill_value=0.0)
        turnover = 0.5 * (a - b).abs().sum()
        blended = a if turnover <= limit + EPS or turnover <= EPS else b + limit / turnover * (a - b)
        if not ((blended[target.index] - target).abs() > EPS).any():
            return target, False
        return pd.concat([_capped(blended[g.index].clip(lower=0), g["cap"].astype(float), float(g["budget"].iloc[0])) for _, g in day.groupby("country")]), True

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        held, ring, out, country = pd.Series(dtype=float), [], [], {}
        for date, day in rows.sort_values(["as_of_date", "security_id"]).groupby("as_of_date", sort=True):
            day = day.dropna(subset=["security_id"]).set_index("security_id")
            country.update(day["country"])
            current, binds = constructed(day, held)
            current = current[current > 0]
            ring = [*ring, current][-k:]
            blended = current
            if k > 1 and len(current):
                mean = pd.concat(ring).groupby(level=0).sum() / len(ring)
                blended = mean * (current.sum() / mean.sum())
            both = pd.DataFrame({"constructed": current, "weight": blended}).fillna(0.0)
            if len(both):
                out.append(both.rename_axis("security_id").reset_index().assign(**{c: rows[c].iloc[0] for c in portfolio}, as_of_date=date, country=[country[s] for s in both.index], binds=binds))
            held = blended
        names = [*portfolio, "as_of_date", "security_id", "country", "constructed", "weight", "binds"]
        return pd.concat(out)[names] if out else pd.DataFrame(columns=names)

    return rows.groupBy(*portfolio).applyInPandas(chain, schema)
