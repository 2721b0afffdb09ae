from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import duckdb
import pytest

from factorloom.llm import importance as I

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [crc32(" ".join(words[i : i + k]).encode()) % I.BUCKETS for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def slow(docs, target, percent=I.PERCENT):
    """{id: (n_features, weight, score, rank)} of distinct ids, word by word."""
    raw, wanted = Counter(), Counter()
    for _, text in docs:
        raw.update(features(text)[1])
    for text in target:
        wanted.update(features(text)[1])
    s, t = sum(raw.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s + I.BUCKETS) / ((raw[b] + 1) * (t + I.BUCKETS))))
    out, able = {}, []
    for i, text in docs:
        n, found = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [len(found), weight, score, None]
        if n >= I.LEAST_WORDS:
            able.append((-score, i))
    for rank, (_, i) in enumerate(sorted(able)[: int(percent * len(able) // 100)], 1):
        out[i][3] = rank
    return {i: tuple(x) for i, x in out.items()}


@pytest.mark.parametrize("stretch", [1, 3, 7, 1 << 16])
def test_windows_go_on_across_stretches(monkeypatch, stretch):
    monkeypatch.setattr(I, "STRETCH", stretch)
    r = random.Random(3)
    for _ in range(200):
        text = "".join(r.choice(["a", "B", "é", "9", " ", " ", "-", "\n", "ÀÉ", "日本", "\x00", "İ"]) for _ in range(r.randint(0, 40)))
        n, found = I.Splitter().buckets(text)
        want = features(text)
        assert (n, sorted(found.tolist())) == (want[0], sorted(want[1])), repr(text)


def test_offsets_are_those_of_the_words():
    text = "Größe, ÉTÉ 42-x"
    (words,) = I.Splitter().words(text)
    assert [(w, text[a:b].lower()) for w, (a, b) in words] == [("größe", "größe"), ("ÉtÉ", "été"), ("42", "42"), ("x", "x")]


def test_equals_brute_force(spark):
    r = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 5, 19, 20, 40, 200])))) for i in range(400)] + [(1000, None), (1001, "")]
    target = [" ".join(r.choice(words[:10]) for _ in range(30)) for _ in range(20)] + [None]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = I.weighed(frame, spark.createDataFrame([(x,) for x in target], "text string"), percent=30)
    assert {x["doc_id"]: (x["n_features"], x["weight"], x["score"], x["rank"]) for x in got.collect()} == slow(docs, target, 30)


def test_query_equals_sql_and_brute_force(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = I.op11_importance_resampling(spark, SF).collect()
    want = con.execute(f"SELECT doc_id, n_features, weight, score, rank, n_words FROM ({I.OP11_SQL})").fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    docs, target = con.execute("SELECT doc_id, text FROM documents").fetchall(), [x for (x,) in con.execute("SELECT text FROM benchmark").fetchall()]
    assert {x["doc_id"]: (x["n_features"], x["weight"], x["score"], x["rank"]) for x in got} == slow(docs, target)


def test_odd_rows(spark, odd, none, tmp_path):
    empty = spark.createDataFrame([], "text string")
    got = I.weighed(odd, odd, percent=50).collect()
    assert len(got) == odd.count()
    assert all((r["weight"], r["n_features"], r["rank"]) == (0, 0, None) for r in got if not r["n_words"])
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, sum(r["n_words"] >= I.LEAST_WORDS for r in got) // 2 + 1))
    long = [r for r in got if r["doc_id"] == 7][0]
    assert long["n_words"] == 27000 and long["n_features"] == 3 * 27000 - 3
    assert I.weighed(none, odd).count() == 0 and I.weighed(odd, empty).count() == odd.count()
    odd.write.parquet(f"{tmp_path}/odd")
    drawn = I.resampled(spark.read.parquet(f"{tmp_path}/odd"), odd, percent=50)
    assert drawn.columns == odd.columns and drawn.count() == len([r for r in got if r["rank"]])


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, "word " * 25) for i in range(40)] + [(i, "word " * 25) for i in range(40)]
    got = I.weighed(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("word",)], "text string"), percent=100).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 81))
    assert [(-r["score"], r["doc_id"]) for r in got] == sorted((-r["score"], r["doc_id"]) for r in got)
