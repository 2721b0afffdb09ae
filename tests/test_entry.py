"""The contract of the entry module, and a sample of queries against their SQL."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from factorloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["j1_membership_asof", "j4_resolve_security", "v1_rebalance_schedule", "f11_price_grid", "p1_assemble_universe", "rank_by_country", "w4_w7_scores", "w10_sleeve_blend", "l1_l6_ledger_step", "r1_attribution", "a18_factor_integrity", "c13_transform_jp", "a6_latest_facts", "a7_a8_statement_values", "x2_keyword_in_context", "s3_s6_price_store", "st1_filing_stream", "st2_price_upsert"]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["as_of_date", "country", "security_id", "factor_value", "rank_in_country"] and df.count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(registry.SQL) <= set(registry.QUERIES)


def shown(rows):
    return sorted(tuple("" if v is None else repr(v + 0.0) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.SQL[name]})").fetchall()
    assert shown(df.select(*columns).collect()) == shown(want)
