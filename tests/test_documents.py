"""Headers of price partitions, numbers that are not finite at any depth, and the run's document."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from factorloom.operators import report
from factorloom.sources import store

NAN, INF = float("nan"), float("inf")


def test_each_damage_of_a_header_leaves_its_partition_out(spark, tmp_path):
    names = ["fine", "none", "twice", "version", "provider", "ticker", "name", "year", "window", "text", "empty"]
    prices = spark.createDataFrame([(n, dt.date(y, m, 1), 1.0 if n != "empty" else None, 2.0) for n in names for y in (2001, 2002) for m in (1, 2)], "ticker string, price_date date, close double, volume double")
    store.write_price_partitions(prices, f"{tmp_path}/p", buckets=4)
    h = store.partition_headers(prices, "2001-01-01", "2002-12-31").withColumns({"part_norm": F.col("ticker_norm"), "part_year": F.col("year").cast("int")})
    hurt = F.col("part_year") == 2001
    change = lambda name, c, to: {c: F.when(hurt & (F.col("part_norm") == name), F.lit(to)).otherwise(F.col(c))}
    bad = h
    for name, c, to in (("version", "version", "v1"), ("provider", "provider", None), ("ticker", "ticker", "TICKER"), ("name", "ticker_norm", "nam"), ("year", "year", "2002"), ("window", "end", ""), ("text", "start", "2001-02-30")):
        bad = bad.withColumns(change(name, c, to))
    store.write_headers(bad.where(~(hurt & (F.col("part_norm") == "none"))).unionByName(h.where(hurt & (F.col("part_norm") == "twice"))), f"{tmp_path}/h", buckets=4)
    rows = spark.read.parquet(f"{tmp_path}/p")
    got = {(r["ticker_norm"], r["year"]): r["error"] for r in store.checked_partitions(rows, spark.read.parquet(f"{tmp_path}/h")).collect()}
    told = {"none": "no header", "twice": "several headers", "name": "ticker name", "text": "window"}
    assert got == {(n, y): "no close" if n == "empty" else None if n == "fine" or y == 2002 else told.get(n, n) for n in names for y in (2001, 2002)}
    served = store.read_checked(spark, f"{tmp_path}/p", f"{tmp_path}/h", 2001, 2001)
    assert {r["ticker"] for r in served.collect()} == {"fine"} and store.read_checked(spark, f"{tmp_path}/p", f"{tmp_path}/h", 2002, 2002).count() == 2 * (len(names) - 1)


def test_numbers_that_are_not_finite_are_found_at_any_depth(spark):
    schema = "a double, s struct<x: float, t: struct<y: array<struct<z: double, n: int>>>>, m map<string, array<double>>, k map<double, string>, `odd.name` array<array<double>>, i int"
    rows = [
        (NAN, (INF, ([(NAN, 1), (1.0, 2), (None, 3)],)), {"a": [1.0, -INF], "b": None}, {NAN: "x", 1.0: "y"}, [[NAN], None, [1.0, INF]], 1),
        (1.0, None, None, None, None, None),
        (None, (1.0, None), {}, {}, [], 2),
        (INF, (NAN, ([None, (INF, None)],)), {"c": [NAN, NAN]}, None, [[]], 3),
    ]
    got = {r["path"]: r["n"] for r in report.nested_non_finite(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": 2, "s.x": 2, "s.t.y[].z": 2, "m{}[]": 3, "k{key}": 1, "odd.name[][]": 2}
    assert {r["n"] for r in report.nested_non_finite(spark.createDataFrame([], schema)).collect()} == {0}
    assert report.nested_non_finite(spark.range(3)).count() == 0


def test_a_document_has_config_metrics_and_tables(spark, tmp_path):
    table = spark.createDataFrame([("b", None, dt.date(2020, 1, 2)), ("a", 1.5, dt.date(2020, 1, 1))], "k string, v double, d date")
    metrics = spark.createDataFrame([(1, {"x": [1.0, 2.0]})], "n int, deep map<string, array<double>>")
    store.write_document({"model": "m", "on": True}, metrics, {"t": table, "none": table.limit(0)}, f"{tmp_path}/d")
    (text,) = [r[0] for r in spark.read.text(f"{tmp_path}/d", wholetext=True).collect() if r[0].strip()]
    assert json.loads(text) == {"config": {"model": "m", "on": True}, "metrics": {"n": 1, "deep": {"x": [1.0, 2.0]}}, "tables": {"t": [{"k": "a", "v": 1.5, "d": "2020-01-01"}, {"k": "b", "v": None, "d": "2020-01-02"}], "none": []}}
    deep = spark.createDataFrame([(1, {"x": [1.0, NAN]})], "n int, deep map<string, array<double>>")
    with pytest.raises(ValueError, match=r"metrics: not finite: deep\{\}\[\]"):
        store.write_document({}, deep, {}, f"{tmp_path}/e")
    with pytest.raises(ValueError, match="one row"):
        store.write_document({}, table.select("k"), {}, f"{tmp_path}/f")
    with pytest.raises(ValueError, match="no report"):
        store.write_document({}, metrics, {"t": table}, f"{tmp_path}/g", max_rows=1)


def test_only_catalogued_accounts_of_their_kind_count(spark):
    from factorloom.operators import accounts

    rows = [("a", "CurrentYearInstant", None, 1), ("a", "CurrentYearDuration", "instant", 2), ("a", "x", "Prior Instant", 3), ("a", None, None, 4), ("b", "FilingDateInstant", "", 5), ("a", "FilingDateInstant", "", 6), ("c", "CurrentYearInstant", "", 7), (None, "CurrentYearInstant", "", 8)]
    facts = spark.createDataFrame(rows, "element string, context string, period string, n int")
    kinds = spark.createDataFrame([("a", "instant"), ("a", "instant"), ("b", "filing")], "element string, kind string")
    assert {r["n"] for r in accounts.catalogued(facts, kinds).collect()} == {1, 3, 5} and accounts.catalogued(facts, kinds).count() == 3
    names = [e for x in accounts.ACCOUNTS.values() for e in x]
    assert len(names) == len(set(names)) and accounts.catalogue(spark).count() == len(names)
