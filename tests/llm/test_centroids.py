from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest

from factorloom.llm import centroids as C

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows, k=C.CENTROIDS, rounds=C.ROUNDS):
    """[(vec_id, cluster, squared distance)] and centroids, with Python's integers."""
    kept = [(i, [math.floor(256 * float(np.float32(a))) for a in v]) for i, v in rows if v is not None and len(v) == 64 and all(a is not None and math.isfinite(a) for a in v)]
    first = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    now = [v for _, v in first]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for turn in range(rounds + 1):
        each = [min((far(v, c), j) for j, c in enumerate(now)) for _, v in kept]
        if turn < rounds:
            for j in range(len(now)):
                if own := [v for (_, v), (_, at) in zip(kept, each) if at == j]:
                    now[j] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((i, j, d) for (i, _), (d, j) in zip(kept, each)), key=str), now


def compared(spark, rows, **options):
    state, now = C.clustered(spark.createDataFrame(rows, SCHEMA).repartition(3), **options)
    got = sorted(((r["vec_id"], r["cluster"], r["square"]) for r in state.collect()), key=str)
    assert (got, now.tolist()) == slow([r[:2] for r in rows], **options)


def test_no_sphere_gives_way_by_less_than_its_vectors_do():
    r = np.random.default_rng(4)
    for n in (2, 3, 8):
        for _ in range(60):
            old = r.normal(size=(5, n)) * 10
            new = old + r.normal(size=old.shape) * r.choice([0, 0.1, 3, 30], size=(5, 1))
            radius = r.choice([0.0, 0.5, 5.0, 20.0], size=5)
            gives = C.loosening(old, new, radius)
            full = np.sqrt(((new - old) ** 2).sum(1))
            for i in range(5):
                way = r.normal(size=(200, n))
                x = old[i] + way / np.linalg.norm(way, axis=1)[:, None] * radius[i] * r.choice([1.0, 0.7], size=(200, 1))
                for j in range(5):
                    if j != i:
                        nearer = np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)
                        assert (nearer <= gives[i] + 1e-6).all()
                assert gives[i] <= np.delete(full, i).max() + 1e-5
    # behind the move the bound grows, and beside it gives way by less than the drift
    assert C.loosening(np.array([[0.0, 0], [10, 0]]), np.array([[0.0, 0], [14, 0]]), np.array([1.0, 0]))[0] < -2
    assert 0 <= C.loosening(np.array([[0.0, 50], [-2, 0]]), np.array([[0.0, 50], [2, 0]]), np.array([1.0, 0]))[0] < 0.2


def test_equals_brute_force(spark):
    r = np.random.default_rng(9)
    middles = r.normal(size=(12, 64)) * 0.4
    rows = [(i, (middles[i % 12] + r.normal(size=64) * 0.05).tolist(), 0) for i in range(300)]
    compared(spark, rows)
    compared(spark, rows, k=7, rounds=3)
    told = []
    C.clustered(spark.createDataFrame(rows, SCHEMA), k=12, rounds=4, told=told)
    assert told[0] == 1 and told[-1] < 0.5


def test_ties_copies_and_large_components(spark):
    grid = [(i, [float((i >> b) & 1) for b in range(4)] + [0.0] * 60, None) for i in range(16)]
    compared(spark, grid + grid + [(5, grid[5][1], 1)] * 40, k=6)
    r = np.random.default_rng(2)
    compared(spark, [(i, (r.normal(size=64) * 60000).tolist(), 0) for i in range(60)], k=5)
    with pytest.raises(Exception, match="squares don't fit"):
        C.clustered(spark.createDataFrame([(1, [1e30] * 64, 0)], SCHEMA))


def test_odd_rows(spark):
    good = [(i, [i / 100] * 64, 0) for i in range(5)]
    odd = [(10, None, 0), (11, [], 0), (12, [0.5] * 63, 0), (13, [0.5] * 63 + [None], 0), (14, [float("nan")] * 64, 0), (15, [float("inf")] + [0.0] * 63, 0), (None, [0.25] * 64, None), (3, [0.03] * 64, 0), (16, [-0.001] * 64, 0)]
    compared(spark, good + odd)
    compared(spark, good[:1])
    frame = spark.createDataFrame(good + odd, SCHEMA).withColumnsRenamed({"label": "cluster"})
    assert C.with_inertia(*C.clustered(frame)).count() == 8
    state, now = C.clustered(spark.createDataFrame(odd[:6], SCHEMA))
    assert len(now) == 0 and C.with_inertia(state, now).count() == 0


def test_query_equals_sql_and_brute_force(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    names = "vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256"
    got = sorted(map(tuple, C.op13_centroid_clustering(spark, SF).select(*names.split(", ")).collect()))
    assert got == sorted(con.execute(f"SELECT {names} FROM ({C.OP13_SQL})").fetchall())
    each, now = slow(con.execute("SELECT vec_id, embedding FROM embeddings").fetchall())
    assert sorted(x[:3] for x in got) == sorted(each) and sum(d for _, _, d in each) == got[0][4]
    assert {x[1]: x[5] for x in got} == {j: hashlib.sha256(",".join(map(str, now[j])).encode()).hexdigest() for _, j, _ in each}
