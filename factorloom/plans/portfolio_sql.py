"""SQL of the quota, ranking and weight queries, in steps of common table expressions."""

from __future__ import annotations

AHEAD = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def quotas(src: str, keys: str, name: str, size: str, total: str) -> str:
    """src with quota: total shared by size."""
    return f"""SELECT * EXCLUDE (_raw, _c, _q, _over), (CASE WHEN {total} <= 0 THEN 0 WHEN _over > 0 THEN _q - greatest(0, least(greatest(0, _q - 1), _over - coalesce(sum(greatest(0, _q - 1)) OVER (PARTITION BY {keys} ORDER BY _q DESC, {name} {AHEAD}), 0)))
        ELSE _q + (row_number() OVER (PARTITION BY {keys} ORDER BY _raw - _q DESC, {name}) <= -_over)::INT END)::BIGINT AS quota
        FROM (SELECT *, sum(_q) OVER (PARTITION BY {keys}) - {total} AS _over FROM (SELECT *, CASE WHEN floor(_raw) = 0 AND {total} >= _c THEN 1 ELSE floor(_raw) END AS _q
            FROM (SELECT *, {total} * ({size} / sum({size}) OVER (PARTITION BY {keys})) AS _raw, count(*) OVER (PARTITION BY {keys}) AS _c FROM {src})))"""


def capped(src: str, keys: str, base: str, cap: str, total: str, out: str, tie: str = "security_id") -> str:
    """src with out: total shared in proportion to base below cap."""
    return f"""SELECT * EXCLUDE (_b, _c, _two, _w, _t0, _k1, _t, _cb, _wb, _ws, _full), CASE WHEN _t <= 0 THEN 0 WHEN _full THEN _c ELSE greatest(0, (_t - sum(CASE WHEN _full THEN _c ELSE 0 END) OVER p) / nullif(_ws - sum(CASE WHEN _full THEN _w ELSE 0 END) OVER p, 0) * _w) END AS {out} FROM (
        SELECT *, coalesce((_t - _cb) / nullif(_ws - _wb, 0) * _w >= _c - 1e-12, true) AS _full FROM (
            SELECT *, coalesce(sum(_c) OVER (p ORDER BY _c / _w, {tie} {AHEAD}), 0) AS _cb, coalesce(sum(_w) OVER (p ORDER BY _c / _w, {tie} {AHEAD}), 0) AS _wb, sum(_w) OVER p AS _ws FROM (
                SELECT *, greatest(0, CASE WHEN _two = 1 THEN _t0 - _k1 ELSE least(_t0, _k1) END) AS _t FROM (
                    SELECT *, least({total}, sum(_c) OVER (PARTITION BY {keys})) AS _t0, coalesce(sum(_c) FILTER (WHERE _two = 0) OVER (PARTITION BY {keys}), 0) AS _k1 FROM (
                        SELECT *, greatest({base}, 0) AS _b, greatest({cap}, 0) AS _c, CASE WHEN {base} > 0 THEN 0 ELSE 1 END AS _two, CASE WHEN {base} > 0 THEN {base} ELSE 1 END AS _w FROM {src})))
            WINDOW p AS (PARTITION BY {keys}, _two)))
        WINDOW p AS (PARTITION BY {keys}, _two)"""


K, C = "as_of_date, model", "as_of_date, model, country"
S, B = f"{C}, sector", f"{C}, sector, size_bucket"
BEST = "ORDER BY score DESC, security_id"
RANKING = {
    "asked": f"SELECT *, CASE country WHEN 'US' THEN 8 ELSE 6 END AS ask, count(*) OVER (PARTITION BY {C}) AS have FROM scores",
    "sectors": f"""SELECT *, low - greatest(0, least(low, sum(low) OVER (PARTITION BY {C}) - ask - coalesce(sum(low) OVER (PARTITION BY {C} ORDER BY low DESC, sector DESC {AHEAD}), 0))) AS min_quota FROM (
        SELECT *, least(greatest(low, ceil(ask * least(1.0, w + 0.1::DOUBLE) - 1e-12)), n)::BIGINT AS max_quota FROM (SELECT *, least(greatest(0, floor(ask * greatest(0.0, w - 0.1::DOUBLE) + 1e-12)), n)::BIGINT AS low FROM (
            SELECT *, l / sum(l) OVER (PARTITION BY {C}) AS w FROM (SELECT {S}, any_value(ask) AS ask, count(*) AS n, sum(liq) AS l FROM asked GROUP BY ALL))))""",
    "strata": f"SELECT a.*, min_quota FROM (SELECT {B}, count(*) AS m FROM asked GROUP BY ALL) a JOIN sectors USING ({S})",
    "buckets": quotas("strata", S, "size_bucket", "m", "min_quota"),
    "step1": f"""SELECT *, CASE WHEN min_quota >= n THEN rs <= min_quota ELSE rb <= quota END AS f0 FROM (SELECT a.*, s.min_quota, s.max_quota, s.n, quota, row_number() OVER (PARTITION BY {', '.join('a.' + c for c in S.split(', '))} {BEST}) AS rs, row_number() OVER (PARTITION BY {', '.join('a.' + c for c in B.split(', '))} {BEST}) AS rb
        FROM asked a JOIN sectors s USING ({S}) JOIN buckets b USING ({B}))""",
    "step2": f"SELECT *, f0 OR row_number() OVER (PARTITION BY {S}, f0 {BEST}) <= min_quota - count(*) FILTER (WHERE f0) OVER (PARTITION BY {S}) AS f1 FROM step1",
    "step3": f"SELECT *, NOT f1 AND row_number() OVER (PARTITION BY {S}, f1 {BEST}) <= max_quota - count(*) FILTER (WHERE f1) OVER (PARTITION BY {S}) AS free FROM step2",
    "step4": f"SELECT *, f1 OR (free AND row_number() OVER (PARTITION BY {C}, free {BEST}) <= ask - count(*) FILTER (WHERE f1) OVER (PARTITION BY {C})) AS f2 FROM step3",
    "step5": f"SELECT *, ask > 0 AND have > ask AND (f2 OR row_number() OVER (PARTITION BY {C}, f2 {BEST}) <= ask - count(*) FILTER (WHERE f2) OVER (PARTITION BY {C})) AS is_picked FROM step4",
    "ranked": f"SELECT *, (row_number() OVER (PARTITION BY {C} ORDER BY is_picked DESC, score DESC, security_id))::INT AS rank_in_country FROM step5",
}
P = "portfolio_id, as_of_date"
PC = f"{P}, country"
WEIGHTS = {
    "plans": """SELECT m || '-' || cap AS plan, country, target::DOUBLE AS target, requested, cap::DOUBLE AS max_single FROM (VALUES ('combined', 'JP', 0.3, 6), ('combined', 'KR', 0.3, 6), ('combined', 'US', 0.4, 8), ('JP', 'JP', 1.0, 20), ('KR', 'KR', 1.0, 20), ('US', 'US', 1.0, 20)) v(m, country, target, requested),
        (VALUES ('0.08'), ('0.1'), ('0.15'), ('0.2'), ('0.25')) c(cap)""",
    "grid": "SELECT model || '/' || plan AS portfolio_id, model, plans.* FROM plans, (SELECT unnest(['rnd_sales_ttm', 'rnd_sales_size_proxy', 'rnd_mktcap_proxy', 'rnd_ev_proxy', 'rnd_robust_composite']) AS model)",
    "cand": f"SELECT *, rn <= requested AS core FROM (SELECT g.portfolio_id, as_of_date, country, security_id, score AS factor_value, rank_in_country, liq, target, requested, max_single, row_number() OVER (PARTITION BY g.portfolio_id, as_of_date, country ORDER BY rank_in_country, score DESC, security_id) AS rn FROM ranked r JOIN grid g USING (model, country))",
    "chosen": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {P}, core ORDER BY rank_in_country, factor_value DESC, country, security_id) AS spare, count(*) FILTER (WHERE core) OVER (PARTITION BY {P}) AS got FROM cand) WHERE core OR spare <= 20 - got",
    "days_of": "SELECT DISTINCT portfolio_id, as_of_date FROM ranked JOIN (SELECT DISTINCT portfolio_id, model FROM grid) USING (model)",
    "budget0": f"SELECT d.portfolio_id, d.as_of_date, g.country, g.target, g.requested, g.max_single, coalesce(n, 0) AS n_selected, coalesce(n, 0) * g.max_single AS capacity FROM days_of d JOIN grid g USING (portfolio_id) LEFT JOIN (SELECT {PC}, count(*) AS n FROM chosen GROUP BY ALL) c USING ({PC})",
    "budgets": f"""SELECT *, a + greatest(0, least(room, rest - coalesce(sum(room) OVER (PARTITION BY {P} ORDER BY country {AHEAD}), 0))) AS budget FROM (SELECT *, greatest(0, capacity - a) AS room, greatest(0, 1 - sum(a) OVER (PARTITION BY {P})) AS rest FROM (SELECT *, least(target, capacity) AS a FROM budget0))""",
    "tilted": f"""SELECT *, greatest(0, share * (1 + 0.2::DOUBLE * z)) AS raw, budget * share AS bench, greatest(0, least(max_single, 0.1::DOUBLE * liq / 6e8)) AS cap FROM (SELECT c.*, budget, liq / sum(liq) OVER w AS share, CASE WHEN stddev_pop(factor_value) OVER w > 1e-12 THEN (factor_value - avg(factor_value) OVER w) / stddev_pop(factor_value) OVER w ELSE 0 END AS z
        FROM chosen c JOIN budgets USING ({PC}) WINDOW w AS (PARTITION BY {', '.join('c.' + x for x in PC.split(', '))}))""",
    "first_weights": capped("tilted", PC, "raw", "cap", "budget", "weight1"),
    "pulled": f"SELECT *, greatest(0, bench + (weight1 - bench) * 0.05::DOUBLE / nullif(l2, 0)) AS pull FROM (SELECT *, sqrt(sum((weight1 - bench) ** 2) OVER (PARTITION BY {P})) AS l2 FROM first_weights)",
    "near_weights": capped("(SELECT *, coalesce(pull, 0) AS pull0 FROM pulled)", PC, "pull0", "cap", "budget", "near"),
    "weighted": "SELECT *, CASE WHEN l2 > 0.05::DOUBLE + 1e-12 THEN near ELSE weight1 END AS weight FROM near_weights",
    "flags": f"""SELECT DISTINCT {P}, flag FROM (
        SELECT {P}, unnest([CASE WHEN n_selected = 0 THEN 'NO_SELECTED_NAMES_' || country END, CASE WHEN n_selected > 0 AND capacity < target THEN 'COUNTRY_CAPACITY_BIND_' || country END, CASE WHEN n_selected > 0 AND (budget < greatest(0, target - 0.02::DOUBLE) - 1e-12 OR budget > least(1, target + 0.02::DOUBLE) + 1e-12) THEN 'COUNTRY_TOLERANCE_UNMET_' || country END,
            CASE WHEN n_selected < requested THEN 'INSUFFICIENT_NAMES_' || country END, CASE WHEN rest - sum(room) OVER (PARTITION BY {P}) > 1e-12 THEN 'UNALLOCATED_CASH_DUE_TO_CAPACITY' END, CASE WHEN sum(n_selected) OVER (PARTITION BY {P}) < 20 THEN 'TOTAL_UNDER_MAX_HOLDINGS' END]) AS flag FROM budgets
        UNION ALL SELECT {P}, unnest([CASE WHEN cap < max_single - 1e-12 THEN 'ADV_CAP_BIND' END, CASE WHEN cap <= 0 THEN 'ZERO_CAP_' || country END, CASE WHEN l2 > 0.05::DOUBLE + 1e-12 THEN 'TE_ACTIVE_L2_CAP_BIND' END]) FROM weighted) WHERE flag IS NOT NULL""",
}
G5 = f"SELECT y::INT AS y, country, sector, n, quota FROM ({quotas('sizes', 'y, country', 'sector', 'n', '8')})"
G5_VIEWS = {"sizes": "SELECT year(period_end) AS y, f.country, sector, count(DISTINCT security_id) AS n FROM fundamentals f JOIN securities USING (security_id) GROUP BY ALL"}
G9 = "SELECT as_of_date, model, country, security_id, round(score, 5) AS score, min_quota, max_quota, is_picked, rank_in_country FROM ranked"
H1 = f"SELECT {PC}, count(*) AS n, sum(rank_in_country)::BIGINT AS ranks FROM chosen GROUP BY ALL"
H8 = "SELECT period_end, country, round(sum(weight), 6) AS total, round(max(weight), 6) AS most, count(*) FILTER (WHERE weight >= 0.03::DOUBLE - 1e-9) AS n_full FROM (" + capped("fundamentals", "period_end, country", "sales_ttm", "0.03::DOUBLE", "0.6::DOUBLE", "weight") + ") GROUP BY ALL"
H14 = f"SELECT portfolio_id, as_of_date, security_id, country, round(weight, 6) AS weight FROM weighted WHERE weight > 0"
H11 = f"""SELECT portfolio_id, as_of_date, coalesce(h, 0) AS n_holdings, round(coalesce(i, 0), 6) AS invested, round(CASE WHEN 1 - coalesce(i, 0) < 1e-12 THEN 0 ELSE 1 - coalesce(i, 0) END, 6) AS cash, coalesce(r, '') AS reasons
    FROM (SELECT DISTINCT {P} FROM budgets) LEFT JOIN (SELECT {P}, count(*) FILTER (WHERE weight > 0) AS h, sum(weight) AS i FROM weighted GROUP BY ALL) USING ({P}) LEFT JOIN (SELECT {P}, string_agg(flag, '|' ORDER BY flag) AS r FROM flags GROUP BY ALL) USING ({P})"""
H11_COUNTRY = f"""SELECT {PC}, requested, coalesce(n_available, 0) AS n_available, n_selected, coalesce(h, 0) AS n_holdings, round(coalesce(w, 0), 6) AS weight, round(budget, 6) AS budget FROM budgets
    LEFT JOIN (SELECT portfolio_id, as_of_date, country, count(*) AS n_available FROM ranked JOIN grid USING (model, country) GROUP BY ALL) USING ({PC}) LEFT JOIN (SELECT {PC}, count(*) FILTER (WHERE weight > 0) AS h, sum(weight) AS w FROM weighted GROUP BY ALL) USING ({PC})"""

#: Half the turnover from one date to the next, and the dates whose constructed weights are blended.
TURNOVER, SLEEVES = 0.5, 4
#: The chain as a recursion over the dates. held: the blended weights by security; ring: the last constructed ones.
CHAIN = {
    "chain_steps": f"""SELECT portfolio_id, as_of_date AS d, row_number() OVER (PARTITION BY portfolio_id ORDER BY as_of_date) AS i, rs FROM days_of
        LEFT JOIN (SELECT {P}, list(struct_pack(s := security_id, c := country, w := weight, cap := cap, b := budget) ORDER BY security_id) AS rs FROM weighted GROUP BY ALL) USING ({P})""",
}
_ALLOCATED = capped("bound", "portfolio_id, c", "bl", "cap", "b", "alloc", "s")
CHAIN_RUN = f""", run AS (
    SELECT portfolio_id, 0::BIGINT AS i, NULL::DATE AS d, MAP([]::VARCHAR[], []::DOUBLE[]) AS held, []::MAP(VARCHAR, DOUBLE)[] AS ring, false AS binds FROM (SELECT DISTINCT portfolio_id FROM days_of)
    UNION ALL
    SELECT * FROM (
        WITH now AS (SELECT s.*, r.held, r.ring, 0.5::DOUBLE * coalesce(list_sum(list_transform(list_distinct(list_concat(map_keys(r.held), list_transform(coalesce(rs, []), lambda x: x.s))),
                lambda k: abs(coalesce(list_sum(list_transform(list_filter(rs, lambda x: x.s = k), lambda x: x.w)), 0) - coalesce(r.held[k], 0)))), 0) AS turnover FROM run r JOIN chain_steps s ON s.portfolio_id = r.portfolio_id AND s.i = r.i + 1),
        each AS (SELECT portfolio_id, held, turnover, x.s AS s, x.c AS c, x.w AS w, x.cap AS cap, x.b AS b FROM (SELECT portfolio_id, held, turnover, unnest(rs) AS x FROM now)),
        blends AS (SELECT *, CASE WHEN cardinality(held) = 0 OR turnover <= {TURNOVER}::DOUBLE + 1e-12 THEN w ELSE coalesce(held[s], 0) + {TURNOVER}::DOUBLE / turnover * (w - coalesce(held[s], 0)) END AS bl FROM each),
        bound AS (SELECT *, bool_or(abs(bl - w) > 1e-12) OVER (PARTITION BY portfolio_id) AS moved FROM blends),
        made AS (SELECT portfolio_id, any_value(moved) AS binds, map_from_entries(list(struct_pack(k := s, v := x) ORDER BY s) FILTER (WHERE x > 0)) AS cur FROM (SELECT portfolio_id, moved, s, CASE WHEN moved THEN alloc ELSE w END AS x FROM ({_ALLOCATED})) GROUP BY portfolio_id),
        kept AS (SELECT n.portfolio_id, i, d, coalesce(m.binds, false) AS binds, coalesce(cur, MAP([]::VARCHAR[], []::DOUBLE[])) AS cur, list_concat(ring, [coalesce(cur, MAP([]::VARCHAR[], []::DOUBLE[]))])[-{SLEEVES}:] AS ring FROM now n LEFT JOIN made m ON m.portfolio_id = n.portfolio_id),
        means AS (SELECT *, list_transform(list_distinct(flatten(list_transform(ring, lambda m: map_keys(m)))), lambda k: struct_pack(k := k, v := list_sum(list_transform(ring, lambda m: coalesce(m[k], 0))) / len(ring))) AS mean FROM kept)
        SELECT portfolio_id, i, d, CASE WHEN cardinality(cur) = 0 THEN cur ELSE map_from_entries(list_transform(mean, lambda x: struct_pack(k := x.k, v := x.v * list_sum(map_values(cur)) / list_sum(list_transform(mean, lambda y: y.v))))) END AS held, ring, binds FROM means))
"""
H14_CHAIN = CHAIN_RUN + """SELECT portfolio_id, d AS as_of_date, e.key AS security_id, round(coalesce(ring[-1][e.key], 0), 6) AS constructed, round(e.value, 6) AS weight, binds FROM (SELECT *, unnest(map_entries(held)) AS e FROM run WHERE i > 0)"""
H12_CHAIN = CHAIN_RUN + """SELECT portfolio_id, d AS as_of_date, cardinality(ring[-1]) AS n_holdings, round(coalesce(list_sum(map_values(ring[-1])), 0), 6) AS invested, concat_ws('|', nullif(before, ''), CASE WHEN binds THEN 'TURNOVER_CAP_BIND' END, nullif(after, '')) AS reasons
    FROM run LEFT JOIN (SELECT portfolio_id, as_of_date AS d, string_agg(flag, '|' ORDER BY flag) FILTER (WHERE flag < 'TURNOVER_CAP_BIND') AS before, string_agg(flag, '|' ORDER BY flag) FILTER (WHERE flag > 'TURNOVER_CAP_BIND') AS after FROM flags GROUP BY ALL) USING (portfolio_id, d) WHERE i > 0"""
