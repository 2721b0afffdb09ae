from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pyarrow as pa
import pytest

from factorloom.llm.exact_dedup import TRIE_BYTES, exact_dedup, keep_distinct, own


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return sorted(
        (repr(i), repr(max((x for x in groups[t or ""] if x is not None), default=None)), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows
    )


def rows_of(df):
    return sorted((repr(r["doc_id"]), repr(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in df.collect())


@pytest.mark.parametrize("limit", [TRIE_BYTES, 4000])
def test_owners_are_those_of_brute_force(spark, limit):
    r = random.Random(5)
    stems = ["", "a", "ab", "abc", "b" * 50, "ab" * 40]
    rows = [(i, r.choice(stems) + r.choice(stems) + r.choice(["", "x", "é", "xy" * 30])) for i in range(3000)]
    found = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), limit=limit)
    assert rows_of(found) == brute(rows)
    kept = [x for x in found.collect() if x["kept"]]
    assert len(kept) == len({t for _, t in rows}) and all(x["doc_id"] == x["keep_id"] for x in kept)


def test_odd_rows(odd):
    assert rows_of(exact_dedup(odd)) == brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    kept = keep_distinct(odd)
    assert kept.columns == odd.columns
    got, all_rows = [tuple(r) for r in kept.collect()], {tuple(r) for r in odd.collect()}
    assert set(got) <= all_rows and len(got) == len({r[1] or "" for r in all_rows})


def test_smallest_id_and_empty_table(spark, none):
    df = spark.createDataFrame([(2, "a"), (1, "a"), (3, "b")], "doc_id long, text string")
    assert {(r["doc_id"], r["keep_id"]) for r in exact_dedup(df, keep="min").collect()} == {(1, 1), (2, 1), (3, 3)}
    assert exact_dedup(none).count() == 0 and keep_distinct(none).count() == 0


def owned(texts, per_batch, limit):
    """(text, rid, size) of the owners, and the text of every row by its owner's, as own() has them."""
    schema = pa.schema([("rid", pa.int64()), ("no_id", pa.bool_()), ("rank", pa.int64()), ("size", pa.int64()), ("key", pa.binary())])
    rows = [(i, False, i, 1, t.encode()) for i, t in enumerate(texts)]
    parts = (rows[i : i + per_batch] for i in range(0, len(rows), per_batch))
    owners, parent = [], {}
    for batch, copies in own((pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*part), schema)], schema=schema) for part in parts), limit):
        parent |= {k: v[0] for k, v in copies.items()}
        owners += [] if batch is None else [(r["key"].decode(), r["rid"], r["size"]) for r in batch.to_pylist()]
    return sorted(owners), parent


def test_a_task_that_spills_twice_keeps_all_rows():
    for texts, per_batch in ((["ax1", "b", "ay2", "c"], 2), (["ax1", "b", "ay2", "c", "ax1", "aw", "d", "ax1"], 2)):
        assert owned(texts, per_batch, 0)[0] == sorted((t, texts.index(t), texts.count(t)) for t in set(texts))
    r = random.Random(7)
    for sort in (None, False, True):
        texts = ["".join(r.choice("ab") for _ in range(r.randint(0, 9))) + "x" * r.choice([0, 40]) for _ in range(600)]
        if sort is not None:
            texts.sort(reverse=sort)
        for per_batch, limit in ((1, 0), (3, 200), (7, 2000)):
            owners, parent = owned(texts, per_batch, limit)
            assert owners == sorted((t, texts.index(t), texts.count(t)) for t in set(texts))
            assert len(owners) + len(parent) == len(texts) and all(texts[a] == texts[b] for a, b in parent.items())
