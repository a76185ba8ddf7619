"""Every query with SQL against DuckDB, and the flagship query."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidewright.operators import metering

CATALOGUE = __import__("tidewright.catalogue", fromlist=["x"])


@pytest.mark.parametrize("name", sorted(CATALOGUE.oracle_sql()))
def test_query_matches_sql(spark, small, name):
    con = duckdb.connect()
    for table in "region nation customer supplier part orders lineitem events documents embeddings labels conversations".split():
        con.sql(f"create view {table} as select * from '{small}/{table}.parquet'")
    got, want = CATALOGUE.queries()[name](spark, small).toArrow(), con.sql(CATALOGUE.oracle_sql()[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    plain = lambda t: {c: str(t.schema.field(c).type).replace("large_", "") for c in columns}
    assert plain(got) == plain(want)
    rows = lambda t: sorted(map(repr, zip(*[t.column(c).to_pylist() for c in columns])))
    assert rows(got) == rows(want)


def test_redacted_texts_match_sql(spark, tmp_path):
    """Named secrets, white space that engines differ on, links at the end of a text, and nulls."""
    texts = ["token = abc d", "api_key:x password=y\x0bz", "token\x0b= abc token\u00a0=b", "see https://a.b/c\x0bd e\x7f", "jo@ex.org token=jo@ex.org", "é" * 700 + " token: \U0001f600", "apikey=\\1$2", "", None]
    rows = [(i, t) for i, t in enumerate(texts * 4)] + [(None, "token=a"), (-4, "token=a"), (-3, "b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(CATALOGUE.oracle_sql()["redact_text"]).fetchall()
    got = CATALOGUE.queries()["redact_text"](spark, str(tmp_path)).select("doc_id", "redacted_md5", "preview").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_flagship(spark, small):
    rows = {(r.run, r.stage_id): (r.status, r.reason) for r in entry.entry(spark).collect()}
    assert rows["changed", "load"] == rows["changed", "totals"] == ("reused", "reused")
    assert rows["changed", "urgent"] == ("succeeded", "influences_changed") and rows["fresh", "load"][1] == "fresh"


def test_savings_reproduce_published_percentages(spark):
    """902, 872 and 1,276 tokens: the incremental run avoids 31.66 % of the control run's."""
    ledger = spark.createDataFrame([("incremental", 872.0), ("control", 1276.0)], "scenario string, cost double")
    got = {r.scenario: r.percent for r in metering.savings(ledger, spark.createDataFrame([("control",)], "scenario string")).collect()}
    assert round(got["incremental"], 2) == 31.66


def test_unknown_cost_makes_savings_unknown(spark):
    ledger = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 0.0)], "scenario string, cost double")
    got = {r.scenario: (r.avoided, r.percent, r.calls_avoided) for r in metering.savings(ledger, spark.createDataFrame([("b",)], "scenario string")).collect()}
    assert got["a"] == (None, None, -1) and got["b"][1] is None
