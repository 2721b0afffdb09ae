"""Membership windows, as-of lookups and calendars.

Sides that are only dates (rebalance dates, month ends) have some hundreds of rows; they are joined by ranges. Where
both sides are large, an as-of lookup is one shuffle: both sides are stacked and the last value is carried forward.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import saved

#: A date side up to this many rows is broadcast; a larger one is left to the planner. Rows are one date each.
MAX_DATES = 100_000
OPEN_END = "9999-12-31"


def dates_side(dates: DataFrame) -> DataFrame:
    """dates, with a broadcast hint if it is small: at most MAX_DATES rows are counted to find out. Also for other sides of short rows, as plans and targets."""
    return F.broadcast(dates) if dates.limit(MAX_DATES + 1).count() <= MAX_DATES else dates


def active(on: Column, start: Column, end: Column) -> Column:
    """Both ends belong to a window; a null end is open."""
    return (start <= on) & (end.isNull() | (on <= end))


def membership_asof(windows: DataFrame, dates: DataFrame) -> DataFrame:
    """(as_of_date, universe, security_id) of every member on every date."""
    hit = active(F.col("as_of_date"), F.col("effective_from"), F.col("effective_to"))
    return windows.join(dates_side(dates.select("as_of_date")), hit).select("as_of_date", "universe", "security_id").distinct()


def month_ends(start: Column, end: Column) -> Column:
    """The month ends from start to end, as an array of dates."""
    months = F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month"))
    return F.filter(F.transform(months, F.last_day), lambda d: (d >= start) & (d <= end))


def month_end_membership(windows: DataFrame) -> DataFrame:
    """Members at each month end of the time that the windows span."""
    span = windows.agg(F.min("effective_from").alias("a"), F.max(F.coalesce("effective_to", "effective_from")).alias("b"))
    return membership_asof(windows, span.where("a is not null").select(F.explode(month_ends(F.col("a"), F.col("b"))).alias("as_of_date")))


def month_end_targets(span: DataFrame, schedule: DataFrame) -> DataFrame:
    """The month ends of a span (a, b), one row, and the schedule's dates, together."""
    return span.select(F.explode(month_ends(F.col("a"), F.col("b"))).alias("as_of_date")).union(schedule.select("as_of_date")).distinct()


def overlaps(windows: DataFrame, keys: list[str], start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """Every window that begins before one of those ahead of it has ended, with the window that reaches furthest of them: previous_start and previous_end.

    One sweep in order of start and end with the running maximum of the ends and whose it is, so a long window also
    meets those that lie wholly in it and are not its neighbours. Both ends belong to a window; a null end is open."""
    last = F.coalesce(end, F.lit(OPEN_END).cast("date"))
    ahead = Window.partitionBy(*keys).orderBy(start, last).rowsBetween(Window.unboundedPreceding, -1)
    furthest = F.max(F.struct(last.alias("e"), F.col(start).alias("s"))).over(ahead)
    met = windows.withColumn("_furthest", furthest).where(F.col(start) <= F.col("_furthest.e"))
    return met.withColumns({"previous_start": F.col("_furthest.s"), "previous_end": F.col("_furthest.e")}).drop("_furthest")


def window_errors(windows: DataFrame) -> DataFrame:
    """windows with ``error``: an end before the start, or a current mark that disagrees with an open end."""
    end = F.col("effective_to")
    said = F.when(end < F.col("effective_from"), "ends_before_start").when(F.col("is_current") & end.isNotNull(), "current_but_closed").when(~F.col("is_current") & end.isNull(), "past_but_open")
    return windows.withColumn("error", said)


def security_master(rows: DataFrame, market: str = "country") -> DataFrame:
    """(market, key_type, raw_key, security_id, valid_from, valid_to) for each of four keys that isn't blank."""
    kinds = ["security_id", "issuer_id", "ticker", "stock_code"]
    melted = rows.select(F.upper(F.trim(market)).alias("market"), F.col("security_id").alias("id"), "effective_from", "effective_to", *[F.col(k).cast("string").alias(k) for k in kinds])
    long = melted.unpivot(["market", "id", "effective_from", "effective_to"], kinds, "key_type", "raw")
    key = F.upper(F.trim("raw"))
    return long.where(key != "").select("market", "key_type", key.alias("raw_key"), F.col("id").alias("security_id"), F.col("effective_from").alias("valid_from"), F.col("effective_to").alias("valid_to")).distinct()


def resolve_security(requests: DataFrame, master: DataFrame) -> DataFrame:
    """requests (market, key_type, raw_key, on_date) with security_id: of the earliest window that holds the date, or null."""
    keys = ["market", "key_type", "raw_key"]
    hits = requests.join(master, keys, "left").where(F.col("valid_from").isNull() | active(F.col("on_date"), F.col("valid_from"), F.col("valid_to")))
    found = hits.groupBy(*keys, "on_date").agg(F.min_by("security_id", "valid_from").alias("security_id"))
    return requests.select(*keys, "on_date").distinct().join(found, [*keys, "on_date"], "left")


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], left_date: str, right_date: str, values: list[str], ranges: int | None = None) -> DataFrame:
    """left with the values of the last right row of its keys on or before its date, and that row's date as ``asof_date``; null if there is none.

    One shuffle on the keys, whatever the sizes. Of right rows with one date the one that sorts last counts. For few or
    hot keys: with ranges, rows are dealt into so many ranges of key and date instead, a row for each key and range tells
    what it leaves to the next, and no task has more than a range."""
    own = [c for c in left.columns if c not in keys]
    row = F.struct(F.col(right_date).alias("asof_date"), *[F.col(v) for v in values])
    a = left.select(*keys, F.col(left_date).alias("_d"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(row.alias("r")).schema["r"].dataType).alias("_row"), F.struct(*own).alias("_own"))
    b = right.groupBy(*keys, right_date).agg(F.max(row).alias("_row")).select(*keys, F.col(right_date).alias("_d"), F.lit(0).alias("_side"), "_row")
    both = a.unionByName(b, allowMissingColumns=True)
    if ranges is None:
        order = Window.partitionBy(*keys).orderBy("_d", "_side").rowsBetween(Window.unboundedPreceding, 0)
        carried = both.withColumn("_row", F.last("_row", ignorenulls=True).over(order)).where("_side = 1")
        return carried.select(*keys, "_own.*", "_row.*")
    # equal dates of a key may be cut between left rows, which a hash puts in order; the right row comes before them all
    dealt = both.withColumn("_salt", F.when(F.col("_side") == 1, F.xxhash64("_own"))).repartitionByRange(ranges, *keys, "_d", "_side", "_salt")
    dealt = saved(dealt.withColumn("_part", F.spark_partition_id()), "ranges")
    within = Window.partitionBy(*keys, "_part").orderBy("_d", "_side").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    leaves = dealt.groupBy(*keys, "_part").agg(F.max_by("_row", F.when(F.col("_side") == 0, F.col("_d"))).alias("_last"))
    gets = leaves.withColumn("_before", F.last("_last", ignorenulls=True).over(before)).select(*keys, "_part", "_before")
    met = dealt.withColumn("_row", F.last("_row", ignorenulls=True).over(within)).where("_side = 1").join(gets, [*keys, "_part"], "left")
    return met.withColumn("_row", F.coalesce("_row", "_before")).select(*keys, "_own.*", "_row.*")


def asof_exact(left: DataFrame, right: DataFrame, keys: list[str], left_date: str, right_date: str, values: list[str]) -> DataFrame:
    """As asof_backward, from the same day only; ``missing`` marks rows without."""
    same = right.select(*keys, F.col(right_date).alias(left_date), *values, F.lit(True).alias("_hit"))
    return left.join(same, [*keys, left_date], "left").withColumn("missing", F.col("_hit").isNull()).drop("_hit")


def trading_day_adjust(targets: DataFrame, trading: DataFrame) -> DataFrame:
    """targets (market, target_date) with adjusted: the last trading day on or before it, else the market's first."""
    first = trading.groupBy("market").agg(F.min("trading_date").alias("first"))
    last = asof_backward(targets, trading, ["market"], "target_date", "trading_date", [])
    return last.join(first, "market", "left").select("market", "target_date", F.coalesce("asof_date", "first").alias("adjusted"))


def rebalance_schedule(span: DataFrame, trading: DataFrame, months: int = 3) -> DataFrame:
    """span: market, start, end. Every quarter from start, by its own day of the month or the month's last, as trading days; repeats go."""
    targets = span.select("market", F.explode(F.sequence("start", "end", F.expr(f"interval {months} months"))).alias("target_date"))
    order = Window.partitionBy("market").orderBy("target_date")
    adjusted = trading_day_adjust(targets, trading).withColumn("before", F.lag("adjusted").over(order))
    return adjusted.where("before is null or before <> adjusted").select("market", F.col("adjusted").alias("as_of_date"))


def required_dates(dates: DataFrame, lags: tuple[int, ...] = (0, 7, 14)) -> DataFrame:
    return dates.select(F.explode(F.array(*[F.date_sub("as_of_date", n) for n in lags])).alias("required_date")).distinct()


def period_pairs(dates: DataFrame, keys: list[str]) -> DataFrame:
    """(start_date, end_date) of rebalance dates that follow each other."""
    order = Window.partitionBy(*keys).orderBy("as_of_date")
    return dates.select(*keys, F.col("as_of_date").alias("start_date"), F.lead("as_of_date").over(order).alias("end_date")).where("end_date is not null")


def year_steps(start: str, end: str, years: int) -> list[str]:
    """start and the days that follow by so many years, up to end. After 29 February clamps to 28 it stays there."""
    import datetime as dt

    out, day, last = [], dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    while day <= last:
        out.append(day.isoformat())
        day = day.replace(year=day.year + years, day=28) if (day.month, day.day) == (2, 29) and (day.year + years) % 4 else day.replace(year=day.year + years)
    return out


def walkforward_folds(dates: DataFrame, start: str, end: str, train: int = 5, test: int = 1) -> DataFrame:
    """dates: as_of_date. (fold_index, train_start, train_end, test_start, test_end, n_train, n_test); folds without dates on either side are left out and take no number."""
    spark = dates.sparkSession
    starts = spark.createDataFrame([(d,) for d in year_steps(start, end, test)], "s string").select(F.col("s").cast("date").alias("train_start"))
    mid = F.add_months("train_start", 12 * train)
    folds = starts.select("train_start", F.date_sub(mid, 1).alias("train_end"), mid.alias("test_start"), F.date_sub(F.add_months(mid, 12 * test), 1).alias("test_end")).where(F.col("test_end") <= F.lit(end).cast("date"))
    hit = dates.select("as_of_date").distinct().join(dates_side(folds), F.col("as_of_date").between(F.col("train_start"), F.col("test_end")))
    early = F.col("as_of_date") <= F.col("train_end")
    counted = hit.groupBy(*folds.columns).agg(F.sum(early.cast("long")).alias("n_train"), F.sum((~early).cast("long")).alias("n_test"), F.max(F.when(early, F.col("as_of_date"))).alias("last_train"), F.min(F.when(~early, F.col("as_of_date"))).alias("first_test"))
    return counted.where("n_train > 0 and n_test > 0").withColumn("fold_index", (F.row_number().over(Window.orderBy("train_start")) - 1).cast("int"))


def leaking_folds(folds: DataFrame) -> DataFrame:
    """Folds whose training dates reach into the test."""
    return folds.where("last_train >= first_test")
