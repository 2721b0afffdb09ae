"""The rebalance ledger: one period as set operations over all portfolios, and the fold over a portfolio's dates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12
# Default rates of costs and taxes.
COSTS = {"commission": 0.0, "slippage": 0.001, "fx_fee": 0.0, "kr_sell_tax": 0.0015, "jp_gains_tax": 0.20, "us_gains_tax": 0.22}


def costs(**given: float) -> dict[str, float]:
    rates = COSTS | given
    if rates.keys() != COSTS.keys() or not all(0 <= x <= 1 for x in rates.values()):
        raise ValueError("costs are " + ", ".join(COSTS) + ", each from 0 to 1")
    return rates


def mark(positions: DataFrame, cash: DataFrame, prices: DataFrame, portfolio: list[str], dates: list[str] | None = None) -> DataFrame:
    """positions with price_krw, value and nav, the portfolio's cash and values; missing_price marks rows without a price. dates: columns of positions and prices on which they meet besides the security, where prices are of several dates."""
    on = ["security_id", *(dates or [])]
    p = positions.join(prices.select(*on, "price_krw"), on, "left").withColumn("missing_price", F.col("price_krw").isNull())
    p = p.withColumn("value", F.col("quantity") * F.coalesce("price_krw", F.lit(0.0)))
    nav = p.groupBy(*portfolio).agg(F.sum("value").alias("held"))
    totals = cash.join(nav, portfolio, "left").select(*portfolio, (F.col("cash") + F.coalesce("held", F.lit(0.0))).alias("nav"))
    return p.join(totals, portfolio)


def trade_deltas(positions: DataFrame, targets: DataFrame, nav: DataFrame, portfolio: list[str]) -> DataFrame:
    """(portfolio, security_id, target_value, value, delta, side) of what is to be traded; no target means sell all."""
    keys = [*portfolio, "security_id"]
    both = positions.select(*keys, "value").join(targets.select(*keys, "weight"), keys, "full_outer").join(nav, portfolio)
    both = both.withColumns({"target_value": F.col("nav") * F.coalesce("weight", F.lit(0.0)), "value": F.coalesce("value", F.lit(0.0))})
    both = both.withColumn("delta", F.col("target_value") - F.col("value")).where(F.abs("delta") > 1e-9)
    return both.withColumn("side", F.when(F.col("delta") < 0, "SELL").otherwise("BUY")).select(*keys, "target_value", "value", "delta", "side")


def trade_costs(trades: DataFrame, rates: dict[str, float] | None = None) -> DataFrame:
    """trades (side, country, currency, delta, value, price_krw, avg_cost) with notional, quantity, gain, each cost and total."""
    r = costs(**(rates or {}))
    sell = F.col("side") == "SELL"
    t = trades.withColumn("notional", F.when(sell, F.least(F.abs("delta"), F.col("value"))).otherwise(F.col("delta")))
    t = t.withColumn("quantity", F.col("notional") / F.nullif("price_krw", F.lit(0.0)))
    gain = F.when(sell, F.greatest(F.lit(0.0), (F.col("price_krw") - F.col("avg_cost")) * F.col("quantity"))).otherwise(0.0)
    tax = F.when(F.col("country") == "JP", r["jp_gains_tax"]).when(F.col("country") == "US", r["us_gains_tax"]).otherwise(0.0)
    t = t.withColumn("gain", gain).withColumns(
        {
            "commission": F.col("notional") * r["commission"],
            "slippage": F.col("notional") * r["slippage"],
            "fx_fee": F.when(F.col("currency") == "KRW", 0.0).otherwise(F.col("notional") * r["fx_fee"]),
            "sell_tax": F.when(sell & (F.col("country") == "KR"), F.col("notional") * r["kr_sell_tax"]).otherwise(0.0),
            "gains_tax": F.col("gain") * tax,
        }
    )
    return t.withColumn("total", F.col("commission") + F.col("slippage") + F.col("fx_fee") + F.col("sell_tax") + F.col("gains_tax"))


def roll(positions: DataFrame, trades: DataFrame, portfolio: list[str]) -> DataFrame:
    """(portfolio, security_id, quantity, avg_cost) after trades; buying moves the average cost, selling doesn't."""
    keys = [*portfolio, "security_id"]
    both = positions.select(*keys, F.col("quantity").alias("q"), "avg_cost").join(trades.select(*keys, "side", F.col("quantity").alias("dq"), "notional"), keys, "full_outer")
    q, dq = F.coalesce("q", F.lit(0.0)), F.coalesce("dq", F.lit(0.0))
    buy = F.col("side") == "BUY"
    new = F.when(buy, q + dq).otherwise(q - dq)
    cost = F.when(buy, (q * F.coalesce("avg_cost", F.lit(0.0)) + F.col("notional")) / F.nullif(q + dq, F.lit(0.0))).otherwise(F.col("avg_cost"))
    return both.select(*keys, new.alias("quantity"), cost.alias("avg_cost")).where(F.col("quantity") > EPS)


def snapshots(marked: DataFrame, portfolio: list[str]) -> DataFrame:
    return marked.withColumn("weight", F.when(F.col("nav") == 0, 0.0).otherwise(F.col("value") / F.nullif("nav", F.lit(0.0))))


_LEDGER = "kind string, start_date date, end_date date, security_id string, side string, country string, currency string, quantity double, price_krw double, notional double, avg_cost double, market_value double, weight double, commission double, slippage double, fx_fee double, sell_tax double, gain double, gains_tax double, total double, start_nav double, end_nav double, gross_return double, net_return double"


def run_ledger(allocations: DataFrame, prices: DataFrame, portfolio: list[str], initial_nav: float = 1e7, rates: dict[str, float] | None = None, carry: bool = False) -> DataFrame:
    """Trades, holdings and periods of each portfolio as rows of one table, told apart by kind.

    allocations: portfolio, as_of_date, security_id (null on a date without holdings), weight. prices: price_date,
    security_id, country, currency, price_krw on the schedule's dates. A portfolio's rows are its own names on its own
    dates: prices are joined to what it ever holds before they are dealt out, so a task sees no others. A name without
    a price on a date that needs one is an error; with carry its last price counts, its trades say so by ``carried`` in
    side, and only a name that never had a price is an error."""
    r = costs(**(rates or {}))
    dates = allocations.select(*portfolio, F.col("as_of_date").alias("price_date")).distinct()
    names = allocations.where("security_id is not null").select(*portfolio, "security_id").distinct()
    known = names.join(prices.select("price_date", "security_id", "country", "currency", "price_krw"), "security_id").join(dates, [*portfolio, "price_date"])
    side_a = allocations.select(*portfolio, F.lit("w").alias("what"), F.col("as_of_date").alias("d"), "security_id", F.lit(None).cast("string").alias("country"), F.lit(None).cast("string").alias("currency"), F.col("weight").alias("x"))
    side_b = known.select(*portfolio, F.lit("p").alias("what"), F.col("price_date").alias("d"), "security_id", "country", "currency", F.col("price_krw").alias("x"))
    types = {f.name: f.dataType.simpleString() for f in allocations.schema.fields}

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        own = {c: rows[c].iloc[0] for c in portfolio}
        priced, weights, about = {}, {}, {}
        for x in rows[(rows["what"] == "p") & rows["x"].notna()].itertuples():
            priced.setdefault(x.d, {})[x.security_id] = x.x
            about.setdefault(x.security_id, (x.country, x.currency))
        for x in rows[rows["what"] == "w"].itertuples():
            day = weights.setdefault(x.d, {})
            if x.security_id is not None and x.x == x.x:
                day[x.security_id] = day.get(x.security_id, 0.0) + x.x
        days, cash, held, last, out = sorted(weights), initial_nav, {}, {}, []

        def priced_on(day, names) -> None:
            last.update(priced.get(day, {}))
            if lacking := sorted(s for s in names if s not in (last if carry else priced.get(day, {}))):
                raise ValueError(f"no price on {day} of {', '.join(lacking)}")

        for start, end in zip(days, days[1:]):
            priced_on(start, held.keys() | weights[start].keys())
            values = {s: q * last[s] for s, (q, _) in held.items()}
            nav, target = cash + sum(values.values()), weights[start]
            deltas = {s: nav * target.get(s, 0.0) - values.get(s, 0.0) for s in sorted(held.keys() | target.keys())}
            sums = dict.fromkeys(("commission", "slippage", "fx_fee", "sell_tax", "gains_tax"), 0.0)
            for sell in (True, False):
                for s, delta in deltas.items():
                    if abs(delta) <= 1e-9 or (delta < 0) != sell:
                        continue
                    price, (country, currency), (q, cost) = last[s], about[s], held.get(s, (0.0, 0.0))
                    notional = min(-delta, q * price) if sell else delta
                    if price <= 0 or notional <= 0:
                        continue
                    moved = notional / price
                    gain = max(0.0, (price - cost) * moved) if sell else 0.0
                    paid = {
                        "commission": notional * r["commission"],
                        "slippage": notional * r["slippage"],
                        "fx_fee": notional * r["fx_fee"] if currency != "KRW" else 0.0,
                        "sell_tax": notional * r["kr_sell_tax"] if sell and country == "KR" else 0.0,
                        "gains_tax": gain * {"JP": r["jp_gains_tax"], "US": r["us_gains_tax"]}.get(country, 0.0),
                    }
                    total = sum(paid.values())
                    cash += (notional if sell else -notional) - total
                    left = q - moved if sell else q + moved
                    held[s] = (left, cost if sell else (q * cost + notional) / left)
                    if left <= EPS:
                        del held[s]
                    sums = {k: v + paid[k] for k, v in sums.items()}
                    fresh = s in priced.get(start, {})
                    out.append({"kind": "trade", "start_date": start, "end_date": end, "security_id": s, "side": ("SELL" if sell else "BUY") + ("" if fresh else " carried"), "country": country, "currency": currency, "quantity": moved, "price_krw": price, "notional": notional, "gain": gain, "total": total, **paid})
            priced_on(end, held.keys())
            values = {s: q * last[s] for s, (q, _) in held.items()}
            end_nav = cash + sum(values.values())
            for s, v in values.items():
                out.append({"kind": "holding", "start_date": start, "end_date": end, "security_id": s, "country": about[s][0], "currency": about[s][1], "quantity": held[s][0], "avg_cost": held[s][1], "price_krw": last[s], "market_value": v, "weight": v / end_nav if end_nav else 0.0})
            total = sum(sums.values())
            out.append({"kind": "period", "start_date": start, "end_date": end, "start_nav": nav, "end_nav": end_nav, "net_return": end_nav / nav - 1, "gross_return": (end_nav + total) / nav - 1, "total": total, **sums})
        frame = pd.DataFrame(out, columns=[x.split()[0] for x in _LEDGER.split(", ")])
        for c in reversed(portfolio):
            frame.insert(0, c, own[c])
        return frame

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in portfolio), _LEDGER])
    return side_a.unionByName(side_b).groupBy(*portfolio).applyInPandas(fold, schema)


def with_benchmark(periods: DataFrame, levels: DataFrame) -> DataFrame:
    """periods (start_date, end_date) with the benchmark's return and the active one; null where a level is missing. levels: benchmark_date, level."""
    at = lambda side: levels.select(F.col("benchmark_date").alias(f"{side}_date"), F.col("level").alias(f"_{side}"))
    both = periods.join(at("start"), "start_date", "left").join(at("end"), "end_date", "left")
    both = both.withColumn("benchmark_return", F.col("_end") / F.nullif("_start", F.lit(0.0)) - 1).drop("_start", "_end")
    return both.withColumn("active_return", F.col("net_return") - F.col("benchmark_return")).select(*periods.columns, "benchmark_return", "active_return")


def with_names(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """Ledger rows with ticker, stock_code and stock_name of their security; blanks where the list lacks it or a field."""
    names = ["ticker", "stock_code", "stock_name"]
    first = specs.groupBy("security_id").agg(F.max(F.struct(*names)).alias("_n"))
    found = rows.join(first, "security_id", "left")
    return found.select(*rows.columns, *[F.coalesce(F.col(f"_n.{c}").cast("string"), F.lit("")).alias(c) for c in names])


def run_metrics(periods: DataFrame, portfolio: list[str], initial_nav: float = 1e7) -> DataFrame:
    """Totals of a run; the benchmark's return is null if any period lacks it, and cumulative gross is end plus costs over start."""
    kinds = ["commission", "slippage", "fx_fee", "sell_tax", "gains_tax", "total"]
    has = "benchmark_return" in periods.columns
    extra = [F.when(F.count("benchmark_return") == F.count("*"), F.product(1 + F.col("benchmark_return")) - 1).alias("benchmark_cumulative")] if has else []
    sums = periods.groupBy(*portfolio).agg(F.count("*").alias("periods"), F.max_by("end_nav", "end_date").alias("end_nav"), *[F.sum(c).alias(f"{c}_sum") for c in kinds], *extra)
    return sums.withColumns({"cumulative_net": F.col("end_nav") / initial_nav - 1, "cumulative_gross": (F.col("end_nav") + F.col("total_sum")) / initial_nav - 1})
