"""Set-based quotas and picks against loops over the same rules on random input."""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from factorloom.operators import quota


def loop_quotas(total, sizes):
    if total <= 0:
        return dict.fromkeys(sizes, 0)
    share = {g: total * (n / sum(sizes.values())) for g, n in sizes.items()}
    out = {g: int(x) for g, x in share.items()}
    if total >= len(sizes):
        out = {g: max(1, q) for g, q in out.items()}
    start = dict(out)
    while sum(out.values()) > total:
        for g in sorted(start, key=lambda g: (-start[g], g)):
            while out[g] > 1 and sum(out.values()) > total:
                out[g] -= 1
        break
    short = total - sum(out.values())
    for g in sorted(sizes, key=lambda g: (out[g] - share[g], g))[: max(0, short)]:
        out[g] += 1
    return out


def test_proportional_quotas(spark):
    r, rows, want = random.Random(1), [], {}
    for case in range(250):
        sizes = {f"g{i}": r.randint(1, 12) for i in range(r.randint(1, 6))}
        total = r.randint(0, sum(sizes.values()))
        want |= {(case, g): q for g, q in loop_quotas(total, sizes).items()}
        rows += [(case, g, n, total) for g, n in sizes.items()]
    df = spark.createDataFrame(rows, "case int, g string, n int, total int")
    got = {(x["case"], x["g"]): x["quota"] for x in quota.proportional_quotas(df, ["case"], "g", "n", F.col("total")).collect()}
    assert got == want


def loop_pick(rows, ask, band, stratify):
    """rows of one country: (id, sector, bucket, liquidity, score)."""
    import math

    rank = lambda x: (-x[4], x[0])
    if ask <= 0 or len(rows) <= ask:
        return set()
    sectors = defaultdict(list)
    for x in sorted(rows, key=rank):
        sectors[x[1]].append(x)
    liquidity = {s: sum(max(x[3], 1.0) for x in xs) for s, xs in sectors.items()}
    low, high = {}, {}
    for s, xs in sectors.items():
        w = liquidity[s] / sum(liquidity.values())
        low[s] = min(max(0, math.floor(ask * max(0.0, w - band) + 1e-12)), len(xs))
        high[s] = min(max(low[s], math.ceil(ask * min(1.0, w + band) - 1e-12)), len(xs))
    over = sum(low.values()) - ask
    for s in sorted(low, key=lambda s: (low[s], s), reverse=True):
        cut = max(0, min(low[s], over))
        low[s], over = low[s] - cut, over - cut
    picked = []
    for s, xs in sectors.items():
        if not stratify or low[s] >= len(xs):
            picked += xs[: low[s]]
            continue
        buckets = defaultdict(list)
        for x in xs:
            buckets[x[2]].append(x)
        mine = [x for b, q in loop_quotas(low[s], {b: len(v) for b, v in buckets.items()}).items() for x in buckets[b][:q]]
        mine += [x for x in xs if x not in mine][: low[s] - len(mine)]
        picked += mine[: low[s]]
    for x in sorted(rows, key=rank):
        if len(picked) < ask and x not in picked and sum(p[1] == x[1] for p in picked) < high[x[1]]:
            picked.append(x)
    picked += [x for x in sorted(rows, key=rank) if x not in picked][: ask - len(picked)]
    return {x[0] for x in picked[:ask]}


def test_ranked_rows(spark):
    r, rows, want = random.Random(2), [], {}
    for case in range(60):
        for country in ("US", "KR"):
            own = [(f"{country}{i:02d}", r.choice("AAABBC"), r.choice(["small", "mid", "large"]), r.choice([0.5, 10.0, 300.0]), round(r.gauss(0, 1), 1)) for i in range(r.randint(3, 25))]
            rows += [(case, country, *x) for x in own]
            picked = loop_pick(own, {"US": 8, "KR": 5}[country], 0.1, True)
            order = sorted(own, key=lambda x: (x[0] not in picked, -x[4], x[0]))
            want |= {(case, x[0]): (i, x[0] in picked) for i, x in enumerate(order, 1)}
    df = spark.createDataFrame(rows, "as_of_date int, country string, security_id string, sector string, size_bucket string, median_traded_value_krw double, score double")
    got = quota.ranked_rows(df, ["as_of_date"], {"US": 8, "KR": 5}).collect()
    assert {(x["as_of_date"], x["security_id"]): (x["rank_in_country"], x["is_picked"]) for x in got} == want


def test_requested_counts():
    assert quota.requested_counts(20, {"US": 1 / 3, "KR": 1 / 3, "JP": 1 / 3}) == {"US": 6, "KR": 7, "JP": 7}
    assert quota.requested_counts(3, {"a": 1.0}) == {"a": 3}
