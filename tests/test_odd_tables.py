"""Queries against their SQL on tables that hold what the supplied small ones lack."""

import datetime as dt
import time

import duckdb
import pytest

from matchspark import catalog
from matchspark.operators import resumes


@pytest.fixture
def compare(spark, tmp_path):
    def run(name, **tables):
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for table, df in tables.items():
            df.write.parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        df = catalog.QUERIES[name](spark, str(tmp_path))
        found = con.execute(catalog.ORACLE_SQL[name])
        order = [d[0] for d in found.description]
        got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
        assert got == sorted(found.fetchall(), key=repr)
        return got

    return run


@pytest.mark.parametrize("name", ["page_text_flat", "page_text_lines"])
def test_references_without_semicolon(spark, compare, name):
    pages = [(1, "<p>a &amp</p>b &quotc&quot; &copy 2 &middot; &am"), (2, "x &amp;&amp y"), (3, "plain")]
    assert len(compare(name, pages=spark.createDataFrame(pages, "page_id long, html string"))) == 3


def test_upsert_of_versions_at_one_time(spark, compare):
    day, later = dt.datetime(1995, 1, 1), dt.datetime(1995, 1, 2)
    orders = spark.createDataFrame([(8, "P", day), (9, "P", day), (10, "P", day)], "o_orderkey long, o_orderstatus string, o_orderdate timestamp")
    lines = [(k, n, s, later) for k, n, states in ((1, 1, "FO"), (2, 1, "OF"), (3, 2, "FFOF"), (4, 1, "F")) for s in states]
    lines = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_linestatus string, l_shipdate timestamp")
    got = compare("upserted_jobs", orders=orders, lineitem=lines.repartition(3))
    assert {r[0]: r[2] for r in got} == {"8": None, "9": None, "10": None, "11": "F"}


def test_score_at_a_half(spark, compare):
    rows = [(k, k, 26970.0 + 6000 * k, "1-URGENT") for k in range(80)]  # 0.04495, 0.05495 and so on
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string")
    got = {r[0]: r[1] for r in compare("match_prompts", orders=orders)}
    assert "Score: 5%" in got[0]


@pytest.mark.parametrize("name, number", [("activity_in_time", 5), ("late_activity", 2)])
def test_deliveries_of_two_months(spark, compare, name, number):
    at = lambda *x: dt.datetime(2024, *x)
    # February's early days are delivered before January's later ones; the newest row is half a second short of an hour
    times = {1: at(1, 3, 5), 2: at(2, 9, 7), 3: at(2, 9, 8), 4: at(1, 20, 5), 5: at(2, 9, 1), 6: at(2, 25, 4, 10), 7: at(2, 25, 10), 8: at(2, 25, 11, 59, 59, 500000), 10: at(1, 3, 5), 20: at(2, 25, 5, 30)}
    events = spark.createDataFrame([(i, t, "view", 1.0) for i, t in times.items()], "event_id long, ts timestamp, event_type string, value double")
    assert len(compare(name, events=events)) == number


def test_queries_of_a_long_list_of_skills(spark):
    names = [f"Skill {k % 1500}" for k in range(3000)]
    parsed = "struct<skills:array<string>,experience:array<struct<role:string>>>"
    df = spark.createDataFrame([(1, (names, [("Data Engineer",), ("data  engineer",)]))], f"resume_id long, parsed {parsed}")
    start = time.monotonic()
    got = resumes.build_search_queries(df)[0].collect()
    assert [r.keywords.split()[:2] for r in got] == [["Data", "Engineer"], ["Skill", "0"]]
    assert time.monotonic() - start < 15
