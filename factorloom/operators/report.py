"""Performance, attribution, integrity and quality tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .temporal import dates_side


def compound(r: Column) -> Column:
    return F.product(1 + r) - 1


def growth_and_drawdown(periods: DataFrame, keys: list[str], value: str = "net_return", order: str = "end_date") -> DataFrame:
    """periods with growth, its peak so far (1 at least) and drawdown."""
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    g = periods.withColumn("growth", F.product(1 + F.col(value)).over(so_far))
    g = g.withColumn("peak", F.greatest(F.lit(1.0), F.max("growth").over(so_far)))
    return g.withColumn("drawdown", F.col("growth") / F.col("peak") - 1)


def annualised(cumulative: Column, periods: Column, per_year: int = 4) -> Column:
    """Null without periods, or where all is lost."""
    base = 1 + cumulative
    return F.when((periods > 0) & (base > 0), F.pow(base, per_year / periods) - 1)


#: What a period costs, as far as its rows have it.
COSTS = ("total", "slippage", "sell_tax", "realised_gains_tax")


def run_summary(periods: DataFrame, keys: list[str], spreads: DataFrame | None = None, checks: DataFrame | None = None) -> DataFrame:
    """One row for each run. periods: net_return, gross_return, benchmark_return and any of COSTS.

    Cumulative and annualised returns, alpha, the largest drawdown; the quarters whose active net return is above 0, how
    many there are and their share; the costs' sums. spreads (keys, spread): the factor's spread on each date that has one,
    of which the positive ones, all and the mean are told. checks (keys, fallback_count, rejected_candidates,
    quality_status) are joined as they are."""
    g = growth_and_drawdown(periods, keys)
    active = F.col("net_return") - F.col("benchmark_return")
    s = g.groupBy(*keys).agg(
        F.count("*").alias("periods"),
        compound(F.col("net_return")).alias("net"),
        compound(F.col("gross_return")).alias("gross"),
        F.when(F.count("benchmark_return") == F.count("*"), compound(F.col("benchmark_return"))).alias("benchmark"),
        F.min("drawdown").alias("max_drawdown"),
        F.count_if(active > 0).alias("active_positive_quarters"),
        *[F.sum(c).alias(f"{c}_sum") for c in COSTS if c in periods.columns],
    )
    s = s.withColumns({"net_annualised": annualised(F.col("net"), F.col("periods")), "benchmark_annualised": annualised(F.col("benchmark"), F.col("periods"))})
    s = s.withColumns({"years": F.col("periods") / 4, "active": F.col("net") - F.col("benchmark"), "alpha": F.col("net_annualised") - F.col("benchmark_annualised"), "active_positive_ratio": F.col("active_positive_quarters") / F.col("periods")})
    if spreads is not None:
        known = spreads.where(F.col("spread").isNotNull()).groupBy(*keys).agg(F.count_if(F.col("spread") > 0).alias("positive_spreads"), F.count("*").alias("spreads"), F.avg("spread").alias("mean_spread"))
        s = s.join(known, keys, "left").fillna(0, ["positive_spreads", "spreads"])
    return s if checks is None else s.join(checks, keys, "left")


def attribution(periods: DataFrame, fx: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """periods with USD returns and the part of each that exchange rates made; error says what is missing or doesn't add up. Rates must be of the very dates."""
    usd = fx.where(F.upper("pair") == "USD/KRW").groupBy("fx_date").agg(F.max("rate").alias("rate"))
    p = periods
    for side in ("start", "end"):
        p = p.join(usd.select(F.col("fx_date").alias(f"{side}_date"), F.col("rate").alias(f"_{side}")), f"{side}_date", "left")
    p = p.withColumn("fx_return", F.col("_end") / F.nullif("_start", F.lit(0.0)) - 1)
    gaps = []
    for kind in ("net", "gross", "benchmark"):
        p = p.withColumn(f"{kind}_usd", (1 + F.col(f"{kind}_return")) / F.nullif(1 + F.col("fx_return"), F.lit(0.0)) - 1)
        p = p.withColumn(f"{kind}_fx_part", (1 + F.col(f"{kind}_usd")) * F.col("fx_return"))
        gaps.append(F.abs(F.col(f"{kind}_return") - F.col(f"{kind}_usd") - F.col(f"{kind}_fx_part")))
    p = p.withColumns({"active_net_krw": F.col("net_return") - F.col("benchmark_return"), "active_net_usd": F.col("net_usd") - F.col("benchmark_usd")})
    error = F.when(F.col("benchmark_return").isNull(), "benchmark missing").when(F.col("_start").isNull(), "rate missing at the start").when(F.col("_end").isNull(), "rate missing at the end").when(F.greatest(*gaps) > tolerance, "parts do not add up")
    return p.withColumn("error", error).drop("_start", "_end")


def fold_metrics(folds: DataFrame, periods: DataFrame, keys: list[str]) -> DataFrame:
    """For each fold and key the compound returns of the periods that lie within the test; 0 if there are none. A missing benchmark counts as 0."""
    inside = (F.col("start_date") >= F.col("test_start")) & (F.col("end_date") <= F.col("test_end"))
    hits = periods.join(dates_side(folds.select("fold_index", "test_start", "test_end")), inside)
    got = hits.groupBy("fold_index", *keys).agg(F.count("*").alias("n"), compound(F.col("net_return")).alias("portfolio"), compound(F.coalesce("benchmark_return", F.lit(0.0))).alias("benchmark"))
    all_of_them = folds.select("fold_index").crossJoin(periods.select(*keys).distinct())
    out = all_of_them.join(got, ["fold_index", *keys], "left").fillna({"n": 0, "portfolio": 0.0, "benchmark": 0.0})
    return out.withColumn("active", F.col("portfolio") - F.col("benchmark"))


def over_folds(folds: DataFrame, rows: DataFrame, date: str, metric: Callable[[DataFrame], DataFrame], schema: str, part: str = "test") -> DataFrame:
    """What a user's function makes of the rows of each fold, all folds in one plan.

    metric gets rows with fold_index, each once for every fold whose part (train or test) holds its date, and groups by
    fold_index. schema: the result's columns besides fold_index as DDL, checked before anything runs. A fold of which
    metric has no row has one of nulls."""
    if part not in ("train", "test"):
        raise ValueError("a fold has a train and a test part")
    bounds = folds.select("fold_index", F.col(f"{part}_start").alias("_a"), F.col(f"{part}_end").alias("_b"))
    out = metric(rows.join(dates_side(bounds), F.col(date).between(F.col("_a"), F.col("_b"))).drop("_a", "_b"))
    wanted = {f.name: f.dataType.simpleString() for f in T._parse_datatype_string(schema).fields} | {"fold_index": dict(folds.dtypes)["fold_index"]}
    if dict(out.dtypes) != wanted:
        raise ValueError(f"the metric gives {dict(out.dtypes)}, not {wanted}")
    return folds.select("fold_index").join(out, "fold_index", "left")


def latest_holdings(holdings: DataFrame, keys: list[str]) -> DataFrame:
    """By country: how many names, weight and value on the last date."""
    last = holdings.groupBy(*keys).agg(F.max("as_of_date").alias("as_of_date"))
    return holdings.join(last, [*keys, "as_of_date"]).groupBy(*keys, "as_of_date", "country").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.sum("market_value").alias("market_value"))


def factor_integrity(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows: country, factor_value, rank_in_country, is_selected. By date, and by date and country (null for all): counts, means, spread, the shares of the selected at or above the median and in the top quarter of ranks."""
    per_country = Window.partitionBy(*keys, "country")
    r = rows.withColumn("_top", F.col("rank_in_country") <= F.greatest(F.lit(1), F.floor((F.count("*").over(per_country) + 3) / 4)))
    medians = r.groupBy(*keys).agg(F.percentile("factor_value", 0.5).alias("_median"))
    r = r.join(medians, keys)
    s = F.col("is_selected")
    each = [
        F.count("*").alias("eligible"), F.count_if(s).alias("selected"), F.percentile("factor_value", 0.5).alias("median"),
        F.avg(F.when(s, F.col("factor_value"))).alias("selected_mean"), F.avg(F.when(~s, F.col("factor_value"))).alias("other_mean"),
        F.avg(F.when(s, (F.col("factor_value") >= F.col("_median")).cast("double"))).alias("above_median"), F.avg(F.when(s, F.col("_top").cast("double"))).alias("top_quarter"),
    ]
    both = r.groupBy(*keys).agg(*each).withColumn("country", F.lit(None).cast("string")).unionByName(r.groupBy(*keys, "country").agg(*each))
    return both.withColumn("spread", F.col("selected_mean") - F.col("other_mean"))


def integrity_summary(integrity: DataFrame, keys: list[str]) -> DataFrame:
    return integrity.where("country is null").groupBy(*keys).agg(F.count("*").alias("dates"), F.avg("spread").alias("mean_spread"), F.count_if(F.col("spread") > 0).alias("positive"), F.avg("above_median").alias("above_median"), F.avg("top_quarter").alias("top_quarter"))


def market_alignment(periods: DataFrame, markets: list[str], value: str = "net_return") -> DataFrame:
    """A row for each period with a column for each market, null where a market has none."""
    return periods.groupBy("start_date", "end_date").pivot("market", markets).agg(F.first(value))


def baseline_deltas(runs: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """runs (seconds) against a baseline row of the same keys: delta, ratio and status."""
    b = baseline.select(*keys, F.col("seconds").alias("base_seconds"))
    j = runs.join(b, keys, "left").withColumn("delta", F.col("seconds") - F.col("base_seconds"))
    ratio = (F.col("base_seconds") - F.col("seconds")) / F.nullif(F.col("base_seconds"), F.lit(0.0))
    return j.withColumn("speed_up", ratio).withColumn("status", F.when(F.col("base_seconds").isNull(), "no_baseline").when(F.col("delta") <= 0, "matched_faster").otherwise("matched_slower"))


def coverage(expected: DataFrame, observed: DataFrame, key: str = "country", ident: str = "security_id") -> DataFrame:
    """By key: distinct ids expected, those observed among them, and their share; 1 if none are expected."""
    seen = observed.select(ident).distinct().withColumn("_seen", F.lit(True))
    got = expected.select(key, ident).distinct().join(seen, ident, "left").groupBy(key).agg(F.count("*").alias("expected"), F.count("_seen").alias("observed"))
    return got.withColumn("ratio", F.when(F.col("expected") == 0, 1.0).otherwise(F.col("observed") / F.greatest(F.col("expected"), F.lit(1))))


def coverage_gate(covered: DataFrame, minimum: dict[str, float], key: str = "country") -> DataFrame:
    """covered with the minimum of its key (0 if none is set) and whether it is met."""
    least = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in minimum.items() for x in pair]), F.col(key)), F.lit(0.0))
    return covered.withColumn("minimum", least).withColumn("passes", F.col("ratio") + 1e-12 >= F.col("minimum"))


def missing_anchors(observed: DataFrame, anchors: DataFrame, ident: str = "security_id") -> DataFrame:
    return anchors.select(ident).distinct().join(observed.select(ident), ident, "left_anti")


def non_finite_counts(df: DataFrame) -> DataFrame:
    """(column_name, n): NaN and infinite values of each numeric column."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    one = df.agg(*[F.count_if(bad(c)).alias(c) for c in numeric])
    return one.unpivot([], numeric, "column_name", "n")


def _not_finite(kind: T.DataType) -> list[tuple[str, Callable[[Column], Column]]]:
    """For each number with a fraction that a type holds: its path, and how many of a value's are not finite. [] stands for elements, {} for a map's values, {key} for its keys."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return [("", lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))]
    each = lambda of: lambda values: F.coalesce(F.aggregate(values, F.lit(0).cast("long"), lambda n, x: n + of(x)), F.lit(0).cast("long"))
    if isinstance(kind, T.StructType):
        return [(f".{f.name}{path}", lambda c, name=f.name, of=of: of(c.getField(name))) for f in kind.fields for path, of in _not_finite(f.dataType)]
    if isinstance(kind, T.ArrayType):
        return [(f"[]{path}", each(of)) for path, of in _not_finite(kind.elementType)]
    if isinstance(kind, T.MapType):
        keys = [(f"{{key}}{path}", lambda c, of=of: each(of)(F.map_keys(c))) for path, of in _not_finite(kind.keyType)]
        return keys + [(f"{{}}{path}", lambda c, of=of: each(of)(F.map_values(c))) for path, of in _not_finite(kind.valueType)]
    return []


def nested_non_finite(df: DataFrame) -> DataFrame:
    """(path, n): NaN and infinite values of every number with a fraction, in structs, arrays and maps of any depth. Expressions made from the schema, summed in one pass."""
    leaves = [(f"{f.name}{path}", of(F.col(f"`{f.name}`"))) for f in df.schema.fields for path, of in _not_finite(f.dataType)]
    if not leaves:
        return df.sparkSession.createDataFrame([], "path string, n long")
    one = df.agg(F.array(*[F.struct(F.lit(path).alias("path"), F.coalesce(F.sum(n), F.lit(0).cast("long")).alias("n")) for path, n in leaves]).alias("each"))
    return one.select(F.inline("each"))


def data_quality(counts: dict[str, DataFrame]) -> DataFrame:
    """For each named output its rows and status: an empty output fails."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("output"), "rows") for name, df in counts.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("status", F.when(F.col("rows") > 0, "pass").otherwise("fail"))


SEVERITY = {"pass": 0, "warning": 1, "fail": 2}


def status_rollup(signals: DataFrame, keys: list[str]) -> DataFrame:
    """The worst status by keys."""
    level = F.element_at(F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair]), F.col("status"))
    worst = signals.groupBy(*keys).agg(F.max(F.coalesce(level, F.lit(2))).alias("_w"), F.count("*").alias("signals"))
    return worst.withColumn("status", F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), F.col("_w") + 1)).drop("_w")


def require_pass(report: DataFrame) -> DataFrame:
    """report; raises if any row has not passed."""
    bad = report.where("status <> 'pass'").limit(20).collect()
    if bad:
        raise ValueError("not passed: " + "; ".join(str(r.asDict()) for r in bad))
    return report


def walkforward_report(folds: DataFrame) -> DataFrame:
    """Of each fold and market the active return over its benchmark and whether it beats it."""
    return folds.select("fold_index", "market", (F.col("portfolio") - F.col("benchmark")).alias("active"), (F.col("portfolio") > F.col("benchmark")).alias("beats"))


def quality_gate(required: list[str], report: DataFrame) -> DataFrame:
    """(output, exists, status, passes) of each required output. report: output and status."""
    spark = report.sparkSession
    wanted = spark.createDataFrame([(x,) for x in required], "output string")
    found = wanted.join(report.select("output", "status"), "output", "left").withColumn("exists", F.col("status").isNotNull())
    return found.select("output", "exists", "status", (F.lower(F.trim("status")).eqNullSafe("pass")).alias("passes"))


def enforce_gate(gate: DataFrame) -> None:
    """Raises if a required output is missing, and else if one has not passed."""
    bad = gate.where("not passes").limit(100).collect()
    missing = sorted(r["output"] for r in bad if not r["exists"])
    if missing or bad:
        raise ValueError("missing outputs: " + ", ".join(missing) if missing else "not passed: " + ", ".join(sorted(r["output"] for r in bad)))


def analysis_tables(periods: DataFrame, rates: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """Tables of a run: quarterly returns in KRW and in USD, and what exchange rates add. rates: start_date, end_date and usd_krw_return.

    periods: keys, start_date, end_date, net_return, gross_return, benchmark_return and total (costs), in KRW."""
    on = ["start_date", "end_date"]
    p = periods.join(rates.select(*on, "usd_krw_return"), on, "left")
    usd = lambda c: (1 + F.col(c)) / F.nullif(1 + F.col("usd_krw_return"), F.lit(0.0)) - 1
    base = p.withColumns({f"{k}_usd": usd(f"{k}_return") for k in ("net", "gross", "benchmark")})
    return {
        "quarterly_krw": base.select(*keys, *on, "net_return", "gross_return", "benchmark_return", (F.col("net_return") - F.col("benchmark_return")).alias("active_net"), (F.col("gross_return") - F.col("benchmark_return")).alias("active_gross"), "total"),
        "quarterly_usd": base.select(*keys, *on, "net_usd", "gross_usd", "benchmark_usd", (F.col("net_usd") - F.col("benchmark_usd")).alias("active_net"), (F.col("gross_usd") - F.col("benchmark_usd")).alias("active_gross"), "usd_krw_return"),
        "fx_contribution": base.select(*keys, *on, (F.col("net_return") - F.col("net_usd")).alias("net_fx"), (F.col("benchmark_return") - F.col("benchmark_usd")).alias("benchmark_fx"), "usd_krw_return"),
    }


def timed(df: DataFrame, stage: str, path: str) -> DataFrame:
    """Writes df to path; a row (stage, rows, seconds) of what that took. Rows are counted by the write itself."""
    import time

    from pyspark.sql import Observation

    seen, began = Observation(), time.perf_counter()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    return df.sparkSession.createDataFrame([(stage, int(seen.get["rows"]), time.perf_counter() - began)], "stage string, rows long, seconds double")


#: Models of the R&D family with their denominators.
DENOMINATORS = {"rnd_sales_ttm": "sales_ttm", "rnd_sales_size_proxy": "sales_size_proxy", "rnd_mktcap_proxy": "mktcap_proxy", "rnd_ev_proxy": "ev_proxy", "rnd_robust_composite": "robust_composite"}


def policy_alignment(config: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, denominator, rule, status): a row for each check of a run's settings.

    config: factor_model, sector_active_band, size_stratification, te_active_l2_cap, max_adv_participation, max_turnover,
    staggered_sleeves, sleeve_count, anchor_requested, anchor_effective and phase_lock_quarter_end. A control that is off or
    unknown fails; a phase lock that has moved the anchor from the start date to quarter ends is a warning."""
    on = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    holds = {
        "model_in_rd_family": F.coalesce(F.col("factor_model").isin(list(DENOMINATORS)), F.lit(False)),
        "benchmark_relative_sector_band_enabled": on("sector_active_band"),
        "size_stratification_enabled": yes("size_stratification"),
        "te_constraint_enabled": on("te_active_l2_cap"),
        "adv_participation_constraint_enabled": on("max_adv_participation"),
        "turnover_constraint_enabled": on("max_turnover"),
        "staggered_sleeves_enabled": yes("staggered_sleeves") & F.coalesce(F.col("sleeve_count") >= 2, F.lit(False)),
    }
    locked = F.coalesce((F.col("anchor_requested") == "start_date") & (F.col("anchor_effective") == "quarter_end") & F.col("phase_lock_quarter_end"), F.lit(False))
    rows = [F.struct(F.lit(rule).alias("rule"), F.when(ok, "pass").otherwise("fail").alias("status")) for rule, ok in holds.items()]
    rows.append(F.struct(F.lit("phase_lock_workaround_used").alias("rule"), F.when(locked, "warning").otherwise("pass").alias("status")))
    denominator = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in DENOMINATORS.items() for x in pair]), F.col("factor_model")), F.lit("unknown"))
    return config.select(*keys, denominator.alias("denominator"), F.inline(F.array(*rows)))


def frame_diff(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], rel: float = 1e-9, abs_: float = 1e-6) -> DataFrame:
    """(value, n_left, n_right, n_matching): how far two result sets agree, one row for each value column."""
    l = left.select(*keys, F.lit(True).alias("_l"), *[F.col(v).alias(f"l_{v}") for v in values])
    r = right.select(*keys, F.lit(True).alias("_r"), *[F.col(v).alias(f"r_{v}") for v in values])
    j = l.join(r, keys, "full_outer")
    both = F.col("_l") & F.col("_r")
    near = lambda v: (F.abs(F.col(f"l_{v}") - F.col(f"r_{v}")) <= F.greatest(rel * F.greatest(F.abs(F.col(f"l_{v}")), F.abs(F.col(f"r_{v}"))), F.lit(abs_))) | (F.col(f"l_{v}").isNull() & F.col(f"r_{v}").isNull())
    one = j.agg(*[F.struct(F.count("_l").alias("n_left"), F.count("_r").alias("n_right"), F.count_if(both & near(v)).alias("n_matching")).alias(v) for v in values])
    return one.select(F.inline(F.array(*[F.struct(F.lit(v).alias("value"), F.col(f"{v}.n_left").alias("n_left"), F.col(f"{v}.n_right").alias("n_right"), F.col(f"{v}.n_matching").alias("n_matching")) for v in values])))


def content_digest(df: DataFrame) -> DataFrame:
    """(rows, digest): the same in whatever order the rows come."""
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("digest"))
