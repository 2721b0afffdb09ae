"""Listings matched with stock codes, held against the query's SQL on ids and times that the given tables lack."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from factorloom.operators import filings
from factorloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer part orders lineitem documents embeddings pages benchmark labels conversations".split()
DAY = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize(
    "change",
    [
        ("user_id", "user_id + event_id % 4 * 10000"),  # a code of five places is not the code that its first four make
        ("ts", "if(event_id % 7 < 4, ts, null)"),  # unknown times come last
        ("event_id", "event_id - 50"),
    ],
    ids=["long codes", "unknown times", "negative ids"],
)
def test_matched_documents_equal_sql(spark, tmp_path, change):
    n = 400
    events = spark.range(n).select(F.col("id").alias("event_id"), (F.lit(DAY) + F.make_interval(secs=F.col("id") * 7919 % n)).cast("timestamp_ntz").alias("ts"), (F.col("id") * 37 % 30).alias("user_id"), F.lit("click").alias("event_type"))
    events.withColumn(change[0], F.expr(change[1])).write.parquet(f"{tmp_path}/events.parquet")
    # keys of both lengths, so that a code that is cut meets one that is wanted
    supplier = spark.createDataFrame([(k, 1.0 if k % 3 else -1.0) for k in [*range(30), *range(10000, 10030), *range(20010, 20310, 10)]], "s_suppkey long, s_acctbal double")
    supplier.write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for t in ("events", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(f"SELECT docID, submitDateTime, code FROM ({registry.SQL['j10_match_documents']})").fetchall()
    got = registry.QUERIES["j10_match_documents"](spark, str(tmp_path)).select("docID", "submitDateTime", "code").collect()
    assert want and sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_operator_cuts_codes_and_takes_known_times_first(spark):
    docs = spark.createDataFrame([("a", "72030", None), ("a", "7203", DAY), ("b", "7203", None), ("b", "1", None), ("c", "9", DAY)], "docID string, secCode string, submitDateTime timestamp_ntz")
    codes = spark.createDataFrame([("7203",), ("72031",), ("1",)], "stock_code string")
    got = {tuple(r) for r in filings.match_documents(docs, codes).collect()}
    assert got == {("a", DAY, "7203"), ("b", None, "0001")}
