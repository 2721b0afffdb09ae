from __future__ import annotations

import math
import random

import numpy as np

from factorloom.llm import co_training as C


def corpus(n=1500):
    r = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        good = r.random() < 0.6
        words = ["fine", "calm", "sound", "clear"] if good else ["junk&&&", "spam***", "click", "wow"]
        text = " ".join(r.choice(words + ["the", "of", "and"] * 2) for _ in range(r.randint(4, 40)))
        rows.append((i, text, "en", r.choice(["books", "wiki"] if good and r.random() < 0.9 else ["forum", "ads"]), len(text)))
        if r.random() < 0.2:
            labels.append((i, int(good)))
    return rows, labels, {x[0]: int("fine" in x[1] or "calm" in x[1] or "sound" in x[1] or "clear" in x[1]) for x in rows}


def test_unlabelled_rows_are_scored_right(spark):
    rows, labels, truth = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    known = dict(labels)
    got = C.quality_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    out = [r for r in got if r["doc_id"] not in known]
    assert len(got) == len(rows) and sum(r["kept"] == bool(truth[r["doc_id"]]) for r in out) > 0.96 * len(out)
    assert all(0 <= r[c] <= 1 for r in got for c in ("p_text", "p_page", "score"))


def test_views_teach_each_other(spark):
    rows, labels, _ = corpus(600)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    table = C.features(docs, spark.createDataFrame(labels, "doc_id long, quality int")).cache()
    views = C.co_train(table, rounds=1)[-1]
    first, later = (C._totals(table, C._count(v, 0.9), C.BUCKETS + 1) for v in (None, views))
    assert (later >= first).all() and later[:, :, -1].sum() > first[:, :, -1].sum()
    learned = [r for r in table.collect() if r["label"] is not None and not r["checks"]]
    assert first[0, 1, -1] == sum(r["label"] for r in learned)
    assert np.allclose(first, C._totals(table.repartition(9), C._count(None, 0.9), C.BUCKETS + 1))


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (7, None)], "doc_id long, quality int")
    for df in (odd, none):
        assert C.quality_scores(df, labels).count() == df.count()
        assert {r["score"] for r in C.quality_scores(df, labels.limit(0)).collect()} <= {0.5}


def slow_scores(rows, labels, checks, rounds=3, sure=0.95):
    """Co-training in plain loops over dictionaries; scores are only put into the same bins for calibration."""
    known = dict(labels)
    sets = {i: (C.text_features(t), C.page_features(source, lang, n)) for i, t, lang, source, n in rows}
    views, history = None, []
    for _ in range(rounds):
        new = []
        for v in range(2):
            taught = {}
            for i, s in sets.items():
                if i in known:
                    if i not in checks:
                        taught[i] = known[i]
                elif views and (p := views[1 - v][1](views[1 - v][0](s[1 - v]))) >= sure:
                    taught[i] = 1
                elif views and p <= 1 - sure:
                    taught[i] = 0
            n = [sum(y == k for y in taught.values()) + 1 for k in (0, 1)]
            seen = {}
            for i, y in taught.items():
                for f in sets[i][v]:
                    seen.setdefault(f, [0, 0])[y] += 1
            odds = {}
            for f, c in seen.items():
                usual = [x / sum(n) for x in n]
                g = 2 * sum(x * math.log(x / (sum(c) * u)) for x, u in zip(c, usual) if x)
                if g > 2:
                    odds[f] = (1 - 2 / g) * math.log((c[1] / usual[1] + C.PRIOR_DOCUMENTS) / (c[0] / usual[0] + C.PRIOR_DOCUMENTS))

            def score(features, odds=odds):
                words = [odds[f] for f in features if f >= C.MEASURES and odds.get(f, 0)]
                return sum(odds.get(f, 0) for f in features if f < C.MEASURES) + sum(words) / math.sqrt(max(1, len(words)))

            width = 2 * C._REACH / C._BINS
            binned = [(math.sinh((int((math.asinh(score(sets[i][v])) + C._REACH) / width) + 0.5) * width - C._REACH), known[i]) for i in checks]
            unit = math.sqrt(sum(x * x for x, _ in binned) / len(binned)) or 1.0
            a = b = 0.0
            for _ in range(60000):  # plain descent on the same loss
                da, db = 1e-2 * a, 1e-2 * b
                for x, y in binned:
                    miss = 1 / (1 + math.exp(-(a * x / unit + b))) - y
                    da, db = da + miss * x / unit, db + miss
                a, b = a - 0.02 * da, b - 0.02 * db
                if abs(da) + abs(db) < 1e-9:
                    break
            slope, offset = max(0.0, a) / unit, b
            new.append((score, lambda x, slope=slope, offset=offset: 1 / (1 + math.exp(-max(-30, min(30, slope * x + offset))))))
        views = new
        history.append(views)
    return {i: [view[1](view[0](x)) for view, x in zip(views, s)] for i, s in sets.items()}


def test_scores_are_those_of_plain_loops(spark):
    rows, labels, _ = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    table = C.features(docs, marks).cache()
    checks = {r["doc_id"] for r in table.collect() if r["checks"]}
    want = slow_scores(rows, labels, checks)
    prior = math.log((sum(y for _, y in labels) + 1) / (sum(1 - y for _, y in labels) + 1))
    got = {r["doc_id"]: r for r in C.quality_scores(docs, marks).collect()}
    logit = lambda p: math.log(min(1 - 1e-6, max(1e-6, p)) / (1 - min(1 - 1e-6, max(1e-6, p))))
    for i, p in want.items():
        assert abs(got[i]["p_text"] - p[0]) < 1e-4 and abs(got[i]["p_page"] - p[1]) < 1e-4
        whole = 1 / (1 + math.exp(-(logit(p[0]) + logit(p[1]) - prior)))
        assert abs(got[i]["score"] - whole) < 1e-3 and got[i]["kept"] == (got[i]["score"] >= 0.5)


def test_one_half_is_kept_and_repeated_ids_share_their_label(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (2, "c", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {(r["score"], r["kept"]) for r in C.quality_scores(docs, none).collect()} == {(0.5, True)}
    twice = [r for r in C.features(docs, spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, quality int")).collect() if r["doc_id"] == 1]
    assert [r["label"] for r in twice] == [0, 0]


def test_the_query_over_a_table(spark):
    """Ranking of the rows that are not learned from, and all rows."""
    sf = "/root/testdata/sf0.01"
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality in (0, 1)").collect()}
    got = C.op9_quality_classifier(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    checks = {r["doc_id"] for r in C.features(docs, labels).where("checks").collect()}
    held = [(r["score"], quality[r["doc_id"]]) for r in got if r["doc_id"] in checks]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert good and bad and sum((g > b) + (g == b) / 2 for g in good for b in bad) > 0.97 * len(good) * len(bad)


def test_a_hash_chooses_about_so_many_labelled_rows(spark):
    docs = spark.createDataFrame([(i, f"w{i} same words", "s", "en", 9) for i in range(2000)], "doc_id long, text string, source string, lang string, n_chars int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)] + [(None, 1), (5, None)], "doc_id long, quality int")
    few = C.features(docs, labels, max_labelled=500)
    assert few.count() == 2000 and 400 < few.where("label is not null").count() < 600
    assert C.features(docs, labels).where("label is not null").count() == 2000
