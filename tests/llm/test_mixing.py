from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from factorloom.llm import mixing as M


def slow_rates(t, p, goal, ridge, top=None):
    """The same minimum by many plain projected steps."""
    t, p, w, total = np.array(t, float), np.array(p), np.ones(len(t)), sum(t)
    for _ in range(8_000):
        miss = (t * w) @ p / total - goal
        w = np.clip(w - (p @ miss + ridge * (w - 1)) / (1 + ridge), 0, top)
    return np.where(t > 0, w, 1.0)


def members(spark, n=60, seed=1):
    r = np.random.default_rng(seed)
    p, t = r.dirichlet([0.5, 0.3, 0.2], n), r.integers(0, 500, n)
    rows = [(i, i, int(t[i]), *map(float, p[i])) for i in range(n)]
    return rows, t, p, spark.createDataFrame(rows, "rid long, doc_id long, n_tokens long, p_high double, p_low double, p_toxic double")


def test_rates_minimise_and_meet_targets(spark):
    rows, t, p, df = members(spark)
    for top in (None, 1.0):
        for goal in (np.array([0.8, 0.15, 0.05]), np.array([1.0, 0.0, 0.0])):
            got = {r["doc_id"]: r["rate"] for r in M.fit_rates(df, dict(zip(M.DOMAINS, goal)), max_rate=top, ridge=0.2).collect()}
            assert np.allclose([got[i] for i in range(len(rows))], slow_rates(t, p, goal, 0.2, top), atol=1e-6)
    goal = np.array([0.8, 0.15, 0.05])
    got = {r["doc_id"]: r["rate"] for r in M.fit_rates(df, dict(zip(M.DOMAINS, goal))).collect()}
    shares = (t * [got[i] for i in range(len(rows))]) @ p / t.sum()
    assert np.abs(shares - goal).max() < 1e-6 and min(got.values()) >= 0


def test_targets_out_of_reach_come_as_near_as_they_can(spark):
    rows, t, p, df = members(spark)
    goal = np.array([1.0, 0.0, 0.0])
    for top in (None, 1.0):
        missed = {}
        got = np.array([r["rate"] for r in M.fit_rates(df, dict(zip(M.DOMAINS, goal)), max_rate=top, missed=missed).orderBy("doc_id").collect()])
        miss = (t * got) @ p / t.sum() - goal
        assert np.allclose([missed[k] for k in M.DOMAINS], miss, atol=1e-6) and max(map(abs, missed.values())) > 1e-3
        slope = p @ miss  # of each rate: none can move to lower the squares
        free = (got > 1e-9) & (got < (top or np.inf) - 1e-9) & (t > 0)
        assert np.abs(slope[free]).max(initial=0) < 1e-5 and slope[(got <= 1e-9) & (t > 0)].min(initial=0) > -1e-5
        if top:
            assert slope[(got >= top - 1e-9) & (t > 0)].max(initial=0) < 1e-5


def slow_posteriors(spark, sf, docs=None):
    """Words, weights and sums in plain loops; buckets are only there to keep the table small."""
    rows = [(r["doc_id"], re.sub("[ \t\n\v\f\r]+", " ", r["text"] or "").strip(" ")) for r in (docs or spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "text").collect()]
    known = {}
    for r in M.table_labels(spark, sf).where("domain is not null and doc_id is not null").collect():
        known[r["doc_id"]] = min(r["domain"], known.get(r["doc_id"], r["domain"]))
    words = {i: t.split(" ") if t else [] for i, t in rows}
    features = {i: [*set(w), f" fresh {10 * len(set(w)) // max(1, len(w))}"] for i, w in words.items()}
    n = Counter(known.values())
    share = {k: (n[k] + 1) / (sum(n.values()) + 3) for k in M.DOMAINS}
    every = sorted({f for x in features.values() for f in x})
    hashed = spark.createDataFrame([(f,) for f in every], "f string").selectExpr("f", f"pmod(xxhash64(f), {M.BUCKETS}) as b").collect()
    bucket = {r["f"]: r["b"] for r in hashed}
    seen = defaultdict(Counter)
    for i, k in known.items():
        for f in features.get(i, ()):
            seen[bucket[f]][k] += 1
    model = {}
    for b, c in seen.items():
        total = sum(c.values())
        g = 2 * sum(x * math.log(x / (total * share[k])) for k, x in c.items())
        if g > 4:
            model[b] = (1 - 4 / g, [(1 - 4 / g) * math.log((c[k] / share[k] + M.PRIOR_DOCUMENTS) / (total + M.PRIOR_DOCUMENTS)) for k in M.DOMAINS])
    out = {}
    for i in words:
        hits = [model[bucket[f]] for f in features[i] if bucket[f] in model]
        root = math.sqrt(max(1.0, sum(w for w, _ in hits)))
        s = np.array([math.log(share[k]) + sum(x[j] for _, x in hits) / root for j, k in enumerate(M.DOMAINS)])
        out[i] = (len(words[i]), np.exp(s - s.max()) / np.exp(s - s.max()).sum())
    return out


def test_the_query_over_a_table(spark):
    """With its defaults: posteriors of plain loops, shares within 1 % of their targets, rates of a minimum."""
    sf = "/root/testdata/sf0.01"
    mixed = M.op1_mixing(spark, sf)
    got, want = {r["doc_id"]: r for r in mixed.collect()}, slow_posteriors(spark, sf)
    assert got.keys() == want.keys()
    for i, (n, p) in want.items():
        assert got[i]["n_tokens"] == n and np.allclose([got[i][f"p_{k}"] for k in M.DOMAINS], p, atol=1e-9)
    for k, x in M.shares(mixed).items():
        assert abs(x - M.TARGETS[k]) < 0.01 * M.TARGETS[k]
    t, p, rate = (np.array([f(got[i]) for i in sorted(got)]) for f in (lambda r: r["n_tokens"], lambda r: [r[f"p_{k}"] for k in M.DOMAINS], lambda r: r["rate"]))
    # the nearest rates to 1 that meet the targets are 1 + p . m, cut at 0, for some m: fit m and compare
    live = (rate > 1e-6) & (t > 0)
    m = np.linalg.lstsq(p[live], rate[live] - 1, rcond=None)[0]
    assert np.allclose(np.where(t > 0, np.maximum(0, 1 + p @ m), 1), rate, atol=1e-6)


def corpus(n=400):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        kind = r.choice(["high", "high", "low", "toxic"])
        own = {"high": "fine good calm", "low": "junk&&& spam*** x###", "toxic": "awful nasty vile"}[kind].split()
        rows.append((i, " ".join(r.choice(own + ["the", "of", "and", "to"]) for _ in range(r.randint(5, 60)))))
        if r.random() < 0.6:
            labels.append((i, kind))
    return rows, labels


def test_posteriors_follow_labels(spark):
    rows, labels = corpus()
    kinds = dict(labels)
    got = M.mix(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, domain string")).collect()
    right = [max(M.DOMAINS, key=lambda k: r[f"p_{k}"]) == kinds[r["doc_id"]] for r in got if r["doc_id"] in kinds]
    assert len(got) == len(rows) and sum(right) > 0.95 * len(right)
    assert all(abs(sum(r[f"p_{k}"] for k in M.DOMAINS) - 1) < 1e-9 for r in got)
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(t.split()) for i, t in rows}


def test_resampled_rows(spark, odd, none):
    rows, labels = corpus(200)
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, domain string")
    kept = M.resampled(docs, known, {"high": 1.0, "low": 0.0, "toxic": 0.0}, max_rate=1.0, total=lambda m: m.selectExpr("sum(n_tokens * p_high)").first()[0])
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)
    for df in (odd, none):
        out = M.resampled(df, known, M.TARGETS)
        assert out.columns == df.columns and out.count() <= 4 * max(1, df.count())
        assert M.mix(df, known.limit(0)).count() == df.count()


def test_words_of_a_domain_with_two_labelled_documents_tell(spark):
    rows = [(i, "fine good calm the of") for i in range(40)] + [(i, "junk spam the of and") for i in range(40, 80)] + [(i, "awful vile the of and") for i in range(80, 84)]
    labels = [(i, "high" if i < 40 else "low") for i in range(80)] + [(80, "toxic"), (81, "toxic")]
    model, _ = M.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, domain string"))
    found = {r["bucket"]: (r["l0"], r["l1"], r["l2"]) for r in model.collect()}
    places = [r["b"] for r in spark.createDataFrame([("awful",), ("vile",)], "w string").selectExpr(f"pmod(xxhash64(w), {M.BUCKETS}) as b").collect()]
    assert set(places) <= set(found) and all(found[b][2] > max(found[b][:2]) for b in places)


def test_a_hash_chooses_about_so_many_labelled_rows(spark):
    rows = [(i, f"w{i} same") for i in range(2000)]
    model, prior = M.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, "low") for i in range(2000)], "doc_id long, domain string"), ["low", "high"], max_labelled=500)
    assert 400 < round(math.exp(-prior["high"])) - 2 < 600
