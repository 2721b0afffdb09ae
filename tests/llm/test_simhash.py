from __future__ import annotations

import re

import random

import numpy as np
import pytest
import xxhash

from factorloom.llm.components import components
from factorloom.llm.scratch import written
from factorloom.llm.simhash import NEAR_WIDTH, SIMILAR, fingerprint, joining_links, keep_one, marked, near_copies, near_dedup, near_links, op5_simhash_near_dedup, shingle_hashes, similarity, tiled_links


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def labels(values):
    """The least value of each one's component, by comparing all pairs."""
    a = np.array(values, np.int64)
    near = np.bitwise_count(a.view(np.uint64)[:, None] ^ a.view(np.uint64)[None, :]) <= 3
    label = a.copy()
    while ((new := np.where(near, label[None, :], np.iinfo(np.int64).max).min(1)) != label).any():
        label = new
    return dict(zip(a.tolist(), label.tolist()))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "ONE two", "Ä b C d Ü f", "a b c " * 500, "a\x0bb\x0cc\x1cd e f"])
def test_fingerprint(text):
    assert fingerprint(None if text is None else text.encode()) == slow_fingerprint(text)


@pytest.mark.parametrize("options", [{}, {"tile": 16, "longest": 40}, {"tile": 1}, {"tile": 7, "longest": 3}])
def test_links_join_what_all_pairs_join(spark, options):
    r = np.random.default_rng(3)
    found = set()
    for base in r.integers(0, 2**63, 8, dtype=np.uint64):
        for _ in range(200):
            x = int(base)
            for k in r.integers(0, 64, r.integers(0, 7)):
                x ^= 1 << int(k)
            found.add(x)
    values = np.array(sorted(found), np.uint64).view(np.int64).tolist()
    got = {x["node"]: x["label"] for x in components(near_links(spark.createDataFrame([(v,) for v in values], "fp long"), **options)).collect()}
    assert all(got.get(v, v) == label for v, label in labels(values).items())


def all_pairs(run, pop, fp, radius):
    far = np.bitwise_count(fp[:, None] ^ fp[None, :])
    i, j = np.nonzero((far <= radius) & (run[:, None] == run[None, :]))
    return {(a, b): far[a, b] for a, b in zip(i.tolist(), j.tolist()) if a < b}


def joined(n, links):
    label = list(range(n))
    for a, b in links:
        a, b = label[a], label[b]
        label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_tiles_join_all_pairs_and_skip_far_population_counts():
    r = np.random.default_rng(8)
    for tile in (1, 5, 64):
        fp = np.concatenate([r.integers(0, 2**64, 30, dtype=np.uint64), np.uint64(1) << r.integers(0, 64, 40, dtype=np.uint64), ~(np.uint64(1) << r.integers(0, 64, 40, dtype=np.uint64))])
        run, pop = r.integers(0, 3, len(fp)), np.bitwise_count(fp).astype(int)
        order = np.lexsort((pop, run))
        run, pop, fp, compared = run[order], pop[order], fp[order], []
        i, j, far = tiled_links(run, pop, fp[None], 3, tile, None, compared)
        want = all_pairs(run, pop, fp, 3)
        assert all(want[min(a, b), max(a, b)] == d for a, b, d in zip(i.tolist(), j.tolist(), far.tolist()))
        assert joined(len(fp), zip(i.tolist(), j.tolist())) == joined(len(fp), want)
        last = lambda s: min((s + 1) * tile, len(fp)) - 1
        reach = {(s, t) for s in range(-(-len(fp) // tile)) for t in range(s, -(-len(fp) // tile)) if s == t or run[last(s)] == run[t * tile] and pop[t * tile] - pop[last(s)] <= 3}
        assert set(compared) == reach
    m = len(range(0, len(fp), 1))
    assert len(set(compared)) < m * (m + 1) // 2


def test_the_query_over_a_table(spark):
    """All rows of a given table against all pairs of plain fingerprints."""
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    prints = {d: slow_fingerprint(t) for d, t in rows.items()}
    label = labels([int(np.uint64(f).astype(np.int64)) for f in set(prints.values())])
    least = {}
    for d, f in sorted(prints.items()):
        least.setdefault(label[int(np.uint64(f).astype(np.int64))], d)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op5_simhash_near_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == {d: (f"{f:016x}", least[label[int(np.uint64(f).astype(np.int64))]]) for d, f in prints.items()}


def slow_groups(rows, least=SIMILAR):
    """The smallest id of each one's group, by the exact similarity of all pairs of texts."""
    sets = {i: np.unique(shingle_hashes(None if t is None else t.encode(), NEAR_WIDTH)) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if similarity(sets[a], sets[b]) >= least]
    label = dict(zip(ids, ids))
    for a, b in links:
        a, b = label[a], label[b]
        label = {i: min(a, b) if x in (a, b) else x for i, x in label.items()}
    return label


@pytest.mark.parametrize("options", [{}, {"tile": 8, "longest": 10}])
def test_near_copies_are_those_of_all_pairs(spark, options):
    r = np.random.default_rng(4)
    words = [f"w{k}" for k in range(4000)]
    rows = []
    for base in range(25):
        text = [words[k] for k in r.integers(0, 4000, 400)]
        for _ in range(6):
            copy = list(text)
            for k in r.integers(0, 400, [0, 1, 3, 6, 40, 200][_]):
                copy[k] = words[r.integers(0, 4000)]
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000, None), (1001, ""), (1002, "few words only"), (1003, "Few  words\nonly"), (1004, "few words")]
    want = slow_groups(rows)
    got = {x["id"]: x["component_id"] for x in near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), **options).collect()}
    assert got == {i: g for i, g in want.items() if i != g}


def test_a_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    got = components(links).collect()
    assert len(got) == 301 and {r["label"] for r in got} == {0}


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], slow_fingerprint(r["text"])) for r in odd.collect()]
    label = labels([int(np.uint64(f).astype(np.int64)) for _, f in rows])
    least = {}
    for i, f in rows:
        k = label[int(np.uint64(f).astype(np.int64))]
        least[k] = min((x for x in (i, least.get(k)) if x is not None), default=None)
    want = sorted((repr(i), f, repr(least[label[int(np.uint64(f).astype(np.int64))]])) for i, f in rows)
    got = sorted((repr(r["id"]), r["fp"] & 2**64 - 1, repr(r["component_id"])) for r in near_dedup(odd).collect())
    assert got == want
    kept, texts = keep_one(odd), {}
    for r in odd.collect():  # rows of an id are one; of its texts the least counts
        texts[r["doc_id"]] = min(texts.get(r["doc_id"], r["text"]) or "", r["text"] or "") if r["doc_id"] in texts else r["text"]
    assert kept.columns == odd.columns
    left, groups = {r["doc_id"] for r in kept.collect()}, slow_groups([(i, t) for i, t in texts.items() if i is not None])
    assert left - {8} == {None} | {i for i, g in groups.items() if i == g} - {8}
    assert near_dedup(none).count() == 0 and keep_one(none).count() == 0


@pytest.mark.parametrize("seed,options", [(5, {}), (6, {"longest": 20, "tile": 4, "nearest": 1})])
def test_no_link_of_near_copies_is_lost(spark, seed, options):
    """60 groups of 8 texts of 150 words, up to 6 of which are other words: similarities on both sides of 0.8."""
    r, rows = random.Random(seed), []
    words = [f"w{i}" for i in range(5000)]
    for _ in range(60):
        base = [r.choice(words) for _ in range(150)]
        for _ in range(8):
            text = list(base)
            for k in r.sample(range(150), r.randint(0, 6)):
                text[k] = r.choice(words)
            rows.append((len(rows), " ".join(text)))
    want = slow_groups(rows)
    got = {x["id"]: x["component_id"] for x in near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), **options).collect()}
    assert got == {i: g for i, g in want.items() if i != g}


def test_repeats_of_a_shingle_do_not_part_copies(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(0, base + " again and again and again" * 200), (1, base + " again and again and again" * 3), (2, base)]
    got = {x["id"]: x["component_id"] for x in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: g for i, g in slow_groups(rows).items() if i != g} == {1: 0, 2: 0}


def test_refused_pairs_are_no_rows(spark, monkeypatch):
    """150 texts share a passage, so that nearly all pairs are within the radius and below 0.8: no table holds more than some rows for each row and key."""
    from factorloom.llm import simhash

    r, words, rows = random.Random(9), [f"w{i}" for i in range(5000)], []
    passage = [r.choice(words) for _ in range(130)]
    for i in range(150):
        own = [r.choice(words) for _ in range(40 if i % 10 else 3)]
        rows.append((i, " ".join(passage + own)))
    want, sizes = slow_groups(rows), {}

    def counted(df, name):
        made = written(df, name)
        sizes[name] = max(sizes.get(name, 0), made.count())
        return made

    monkeypatch.setattr(simhash, "written", counted)
    got = {x["id"]: x["component_id"] for x in near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == {i: g for i, g in want.items() if i != g} and 0 < len(got) < 75
    assert max(n for name, n in sizes.items()) <= sizes["placed"]


def test_only_texts_that_candidates_need_are_shuffled(spark):
    """1000 texts of which six have near copies, and ids that are not broadcast: what is shuffled is a fraction of the texts."""
    r, words = random.Random(12), [f"{i:x}" for i in range(10**5, 2 * 10**5)]
    rows = [(i, " ".join(r.choice(words) for _ in range(1500))) for i in range(1000)]
    rows += [(2000 + i, text + " more") for i, text in rows[::167]]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "doc_id long, text string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled_bytes(spark)
        got = {x["id"]: x["component_id"] for x in near_copies(docs).collect()}
        assert got == {2000 + i: i for i in range(0, 1000, 167)}
        assert shuffled_bytes(spark) - before < sum(len(x) for _, x in rows) / 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def shuffled_bytes(spark):
    """What all tasks so far have written for shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sum(x.totalShuffleWrite() for x in (lambda seq: [seq.apply(k) for k in range(seq.size())])(sc.statusStore().executorList(False)))


@pytest.mark.parametrize("n,most", [(0, 1 << 20), (1, 1 << 20), (500, 1 << 20), (500, 1), (500, 40)])
def test_marks_lose_no_row(spark, n, most):
    rows = spark.range(-5000, 5000).selectExpr("id", "cast(id AS string) AS text")
    ids = spark.range(n).selectExpr("id * 7 - 1000 AS id")
    got = {x["id"] for x in marked(rows, ids, most).collect()}
    assert got >= {i * 7 - 1000 for i in range(n)} and (most < 1 << 20 or len(got) <= n + 300)


@pytest.mark.parametrize("nearest", [1, 16])
def test_sets_are_compared_as_pairs_are(nearest):
    r = np.random.default_rng(11)
    sets = [np.unique(r.integers(0, 30, r.integers(1, 40)).astype(np.uint64)) for _ in range(90)] + [np.empty(0, np.uint64)]
    n = np.array([len(x) for x in sets])
    rows, zero = np.arange(len(sets)), np.zeros(len(sets), np.int64)
    for label, side in ((rows, None), (rows // 2, None), (rows, rows % 2 == 0)):
        i, j = joining_links(label, zero, zero, n, np.zeros((1, len(sets)), np.uint64), sets, 0, 0.5, 8, side, nearest)
        assert all(similarity(sets[a], sets[b]) >= 0.5 for a, b in zip(i.tolist(), j.tolist()))
        every = [(a, b) for a in rows.tolist() for b in rows[:a].tolist() if similarity(sets[a], sets[b]) >= 0.5 and (side is None or side[a] != side[b])]
        own = [(a, b) for a in rows.tolist() for b in rows[:a].tolist() if label[a] == label[b]]
        assert joined(len(sets), own + list(zip(i.tolist(), j.tolist()))) == joined(len(sets), own + every)
