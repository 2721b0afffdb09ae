"""The table with commits: replays, crashes, splits, compaction, expiry; and the streams that write with it."""

from __future__ import annotations

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from factorloom.sources.commits import CommitTable
from factorloom.streaming import jobs

SCHEMA = "k long, day string, v double, at long"


def latest(batches):
    out = {}
    for rows in batches:
        for k, day, v, at in rows:
            if (k, day) not in out or at > out[k, day][1]:
                out[k, day] = (v, at)
    return out


def shown(df):
    return {(r["k"], r["day"]): (r["v"], r["at"]) for r in df.collect()}


def made(spark, path, **options):
    return CommitTable(spark, f"file://{path}", spark.createDataFrame([], SCHEMA).schema, ["k", "day"], "at", **options)


def batches_of(n):
    r, at, out = random.Random(3), 0, []
    for _ in range(n):
        rows = []
        for _ in range(150):
            at += 1
            rows.append((r.randint(0, 120), f"d{r.randint(0, 2)}", r.random(), at))
        out.append(rows)
    return out


def test_snapshots_splits_replays_and_compaction(spark, tmp_path):
    table, batches = made(spark, tmp_path / "t", bucket_rows=40), batches_of(4)
    assert table.snapshot().count() == 0 and table.versions() == []
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, SCHEMA)
        assert table.upsert(frame, ("s", i)) == i + 1
        assert table.upsert(frame, ("s", i)) == i + 1  # once more
    for v in (1, 2, 3, 4):
        assert shown(table.snapshot(v)) == latest(batches[:v])
    buckets = table.commit_of()["buckets"]
    assert len(buckets) > 4 and sum(b["rows"] for b in buckets) == len(latest(batches)) and sum(2.0 ** -b["bits"] for b in buckets) == 1
    assert table.upsert(spark.createDataFrame([(5, "d0", -1.0, 0)], SCHEMA)) == 5  # too late to count
    assert shown(table.snapshot()) == latest(batches)
    table.compact()
    assert shown(table.snapshot()) == latest(batches) and shown(table.snapshot(2)) == latest(batches[:2])
    assert table.upsert(spark.createDataFrame([], SCHEMA), ("s", 9)) == 7 and table.commit_of()["tags"] == {"s": 9}
    assert table.expire(keep=1) and table.versions() == [7] and shown(table.snapshot()) == latest(batches)
    assert table.expire(keep=1) == []
    with pytest.raises(ValueError):
        table.snapshot(2)


def test_only_the_buckets_of_a_batch_are_written(spark, tmp_path):
    table = made(spark, tmp_path / "t", bucket_rows=20)
    table.upsert(spark.createDataFrame([(k, "d", 0.0, k) for k in range(200)], SCHEMA))
    before = {b["folder"] for b in table.commit_of()["buckets"]}
    table.upsert(spark.createDataFrame([(7, "d", 1.0, 999)], SCHEMA))
    after = {b["folder"] for b in table.commit_of()["buckets"]}
    assert len(before - after) == 1 and table.snapshot().where("v = 1").count() == 1 and table.snapshot().count() == 200


def test_a_writer_that_dies_leaves_the_state_before(spark, tmp_path, monkeypatch):
    table, batches = made(spark, tmp_path / "t", bucket_rows=40), batches_of(3)
    table.upsert(spark.createDataFrame(batches[0], SCHEMA), ("s", 0))

    def dies(commit):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(table, "_log", dies)
        with pytest.raises(RuntimeError):
            table.upsert(spark.createDataFrame(batches[1], SCHEMA), ("s", 1))
    folders = len(glob.glob(f"{tmp_path}/t/data/*"))
    assert folders == 2 and table.versions() == [1] and shown(table.snapshot()) == latest(batches[:1])
    table.upsert(spark.createDataFrame(batches[1], SCHEMA), ("s", 1))
    assert shown(table.snapshot()) == latest(batches[:2])
    table.expire(keep=2)
    assert len(glob.glob(f"{tmp_path}/t/data/*")) == 2
    other = made(spark, tmp_path / "t")
    stale = other.commit_of(1)
    with pytest.raises(RuntimeError, match="another writer"):
        other._log({**stale, "version": 2})


def test_streams_go_on_where_they_were(spark, tmp_path):
    batches = batches_of(4)
    table = made(spark, tmp_path / "t", bucket_rows=60)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for i in (0, 2):
        for rows in batches[i : i + 2]:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        assert jobs.upsert_stream(stream(), table, "in", f"{tmp_path}/state") == i + 2
        assert shown(table.snapshot()) == latest(batches[: i + 2])


def test_matched_filings_come_once_with_the_list_of_their_batch(spark, tmp_path):
    rows = [[("D1", "7203", 1), ("D2", "6758", 2), ("D1", "7203", 1)], [("D2", "6758", 2), ("D3", "6758", 3), ("D4", None, 4)], [("D5", "72030", 5), ("D1", "7203", 1)]]
    for part in rows:
        frame = spark.createDataFrame(part, "docID string, secCode string, n int").selectExpr("docID", "secCode", "timestamp_seconds(n) as submitDateTime")
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("docID string, secCode string, submitDateTime timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    asked = []

    def codes(epoch):
        asked.append(epoch)
        return spark.createDataFrame([("7203",), ("6758",)][: epoch + 1], "stock_code string")

    got = jobs.matched_filings(stream, codes, "m")
    assert {(r["docID"], r["epoch"]) for r in got.where("docID <> 'D5'").collect()} == {("D1", 0), ("D3", 1)} and asked == [0, 1, 2]
    assert got.count() == got.select("docID").distinct().count()
    assert os.path.isdir(f"{tmp_path}/in") and got.agg(F.max("epoch")).first()[0] >= 1
