"""Each query against the same text on another engine, and fixtures with known results."""

import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyrow.catalogue import ORACLE, QUERIES
from tallyrow.operators.text import TOKENS, classify
from tallyrow.plans.query import TABLES, Query

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    cells = df[sorted(df.columns)].astype(object).values.tolist()
    return sorted(([None if pd.isna(v) else round(float(v), 6) if not isinstance(v, (str, bool)) else v for v in r] for r in cells), key=lambda r: [str(x) for x in r])


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, other, name):
    got, want = QUERIES[name](spark, SF).toPandas(), other.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize(("text", "decision"), [("rm -rf /", "deny"), ("DROP DATABASE x", "deny"), ("git push --force origin main", "deny"), ("sudo apt update", "allow-once"), ("rm -rf ./node_modules", "allow-once"), ("git push origin feature", "allow-once"), ("npm install", "allow-always")])
def test_risk(spark, text, decision):
    q = Query(f"SELECT {classify('t')} AS d FROM (SELECT '{text}' AS t) AS x")
    assert spark.sql(q.text(0)).first().d == decision


def test_token_patterns_in_order(spark, tmp_path):
    texts = ["see /usr/lib/x.so and src/a.rs", "fe80::1ff:fe23:4567:890a up", "[a](http://x.y/z) http://q.r/s", "deadbeef12 0xff 12345 10.0.0.1 #ffaa00", "--- a/x/y\n+++ b/x/z", "sha256:" + "0f" * 32, "123e4567-e89b-12d3-a456-426614174000 Qm" + "a1" * 22, None, "none"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    alternation = re.compile("(?m)" + "|".join(f"(?P<{k}>{p})" for k, p in TOKENS.items()), re.ASCII)
    for i, t in enumerate(texts):
        for m in alternation.finditer(t or ""):
            kind = next(k for k in TOKENS if m[k] is not None)
            want[i, kind] = want.get((i, kind), 0) + 1
    q = QUERIES["token_patterns"]
    assert {(r.doc_id, r.kind): r.n for r in q(spark, str(tmp_path)).collect()} == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert {(i, k): n for i, k, n in con.execute(q.oracle).fetchall()} == want
    assert {(0, "path"), (1, "ipv6"), (3, "sha"), (3, "ip")} <= set(want) and (6, "number") not in want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_on_own_tables(spark):
    mine = spark.createDataFrame([(1, "a", 5.0), (1, "b", 7.0)], "user_id long, event_type string, value double").withColumn("event_id", F.monotonically_increasing_id())
    assert {r.option_name: r.value for r in QUERIES["first_option"].on(events=mine).collect()} == {"a": 5.0, "b": 7.0}


def test_repeated_ranges_merge(spark):
    """Rows that the windows' order doesn't tell apart; each supplier has two islands, the second of repeats."""
    ranges = [(k, lo, n) for k in range(50) for lo, n in ((1, 3), (2, 4), *[(500, 2)] * 5)]
    mine = spark.createDataFrame(ranges, "l_suppkey long, l_orderkey long, l_linenumber int").repartition(8)
    assert sorted(map(tuple, QUERIES["interval_coalesce"].on(lineitem=mine).collect())) == sorted(r for k in range(50) for r in ((k, 1, 6), (k, 500, 502)))
    assert sorted(map(tuple, QUERIES["interval_remove"].on(lineitem=mine).collect())) == [(k, 1, 6) for k in range(50)]


def test_histogram_keeps_two_digits(spark):
    mine = spark.range(1, 10001).select(F.lit("e").alias("event_type"), (F.col("id") / 100).alias("value"))
    r = QUERIES["histogram_percentiles"].on(events=mine).first()
    assert all(abs(got - want) <= want / 100 for got, want in ((r.p50, 5000), (r.p75, 7500), (r.p95, 9500)))


def test_frecency_decays(spark):
    spark.createDataFrame([(1, 0), (1, 259200000)], "k int, ms long").createOrReplaceTempView("accesses")
    assert spark.sql("SELECT sum(power(2.0, -(259200000 - ms) / 259200000.0)) AS s FROM accesses").first().s == pytest.approx(1.5)
