from __future__ import annotations

import hashlib
import math

import numpy as np
import sentencepiece

import corpus_pipeline
from factorloom.llm import language_id, mixing, piece_tokens
from factorloom.llm.scratch import documents

from .test_mixing import slow_posteriors
from .test_simhash import slow_groups

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = documents(spark, SF)
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept, columns = docs, docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        was, kept = {r["doc_id"] for r in kept.collect()}, stage(spark, kept, SF).cache()
        assert kept.columns == columns and all(rows[r["doc_id"]] == r for r in kept.collect())
        now = {r["doc_id"] for r in kept.collect()}
        texts = [r["text"] for r in kept.collect()]
        if i == 0:
            told = {r["doc_id"]: r for r in language_id.op7_language_id(spark, SF).collect()}
            assert now == {d for d in was if told[d]["lang_pred"] != "und" and told[d]["score"] >= language_id.CHANCE} and now < was
        if i == 1:
            last = {}
            for d in sorted(was):
                last[rows[d]["text"]] = d
            assert now == set(last.values()) and len(set(texts)) == len(texts)
        if i == 2:
            groups = slow_groups([(d, rows[d]["text"]) for d in was])
            assert now == {d for d in was if groups[d] == d} and now < was
    left = {r["doc_id"] for r in corpus_pipeline.mixed(spark, kept, SF).collect()}
    rates, drawn = slow_rates(spark, kept)
    sure = {d for d in now if abs((rates[d] + drawn[d]) % 1 - 0.5) < 0.5 - 1e-5}
    assert left & sure == {d for d in sure if math.floor(rates[d] + drawn[d])} and len(now - sure) < 3
    library = sentencepiece.SentencePieceProcessor(model_file=piece_tokens.public_model())
    want = set()
    for d in left:
        ids = library.encode(rows[d]["text"])
        want.add((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and len(corpus_pipeline.STAGES) == 5


def slow_rates(spark, kept):
    """({doc_id: rate}, {doc_id: what decides on the rest of a rate}): posteriors of plain loops, and projected gradient steps over all documents."""
    told, targets = slow_posteriors(spark, SF, kept), corpus_pipeline.TARGETS
    ids = sorted(told)
    t = np.array([told[d][0] for d in ids], float)
    p = np.array([told[d][1] for d in ids])
    total = t @ p[:, 0] / targets["high"]
    goal, rate = np.array([targets[k] for k in mixing.DOMAINS]) * total / t.sum(), np.ones(len(ids))
    share = t / t.sum()
    pull = 1 / max(np.linalg.eigvalsh((p * share[:, None]).T @ p).max(), 1e-9)
    for _ in range(60000):  # steps are scaled by each one's tokens, which changes the path, not the minimum
        slope = p @ ((share * rate) @ p - goal) + 1e-3 * (rate - 1)
        rate = np.clip(rate - 0.9 * pull * slope, 0, 1)
    drawn = kept.selectExpr("doc_id", "pmod(xxhash64(doc_id, text), 4294967296) / 4294967296D AS x").collect()
    return {d: x if n else 1.0 for d, x, n in zip(ids, rate, t)}, {r["doc_id"]: r["x"] for r in drawn}


def test_odd_rows(spark, odd, none):
    for df in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, SF)
            assert df.columns == odd.columns
        assert corpus_pipeline.encoded(spark, df, SF).count() == df.count()


def test_what_a_step_writes_for_itself_goes(spark):
    from factorloom.llm import scratch

    before = list(scratch._MADE)
    with scratch.cleared(spark) as kept:
        scratch.written(spark.range(3), "own")
        gone = scratch.last_written()
        table = scratch.written(spark.range(5), "result")
        kept.add(scratch.last_written())
    assert table.count() == 5 and len(scratch._MADE) == len(before) + 1
    path = spark._jvm.org.apache.hadoop.fs.Path(gone)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
