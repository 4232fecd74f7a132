"""Every query with SQL against DuckDB, on the smallest tables (which have real holes)."""

import math
import os
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

import __spark_entry__
from meterwise.plans import catalog

duckdb = pytest.importorskip("duckdb")


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "NULL"
    if isinstance(x, float):
        return str(round(x, 5) + 0.0)
    return str(x)


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    want = duck.execute(catalog.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(map(tuple, df.collect()), df.columns) == canonical(want.fetchall(), columns)


def test_sweep_covers_the_whole_table(spark, sf, duck):
    first, last = duck.execute("SELECT min(l_shipdate), max(l_shipdate + to_hours(CAST(l_quantity AS BIGINT))) FROM lineitem").fetchone()
    got = sorted(map(tuple, __spark_entry__.queries()["W08_delta_sweep_all"](spark, sf).select("t", "cents").collect()))
    assert got[0][0] == str(first) and got[-1] == (str(last), 0)  # all that began has ended


def test_entry(spark, sf):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["M19_area_fill", "J12_outage_profiles", "M08_net_ensemble", "Q12_hourly_weights"])
def test_rows_only_queries_run(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_outage_profiles_cover_the_whole_table(spark, sf, duck):
    rows = duck.execute("SELECT l_orderkey, l_linenumber, l_shipdate, l_shipdate + to_hours(CAST(l_quantity AS BIGINT)), l_extendedprice * (1 - l_discount), l_returnflag = 'A', l_linestatus = 'F' FROM lineitem").fetchall()
    hour, day, at_ten = timedelta(hours=1), timedelta(days=1), timedelta(hours=10)
    versions = defaultdict(list)
    for key, revision, start, *_ in rows:
        versions[key].append((revision, start - 3 * day))
    floor = lambda t: datetime(t.year, t.month, t.day)
    parts = {c: defaultdict(float) for c in ("approximate", "persistence", "exact")}

    def run(part, start, end, mw):
        while start < end:
            parts[part][start] += mw  # starts and ends are full hours here
            start += hour

    for key, revision, start, end, mw, inactive, planned in rows:
        if inactive:
            continue
        days = [floor(start) + i * day for i in range((floor(end) - floor(start)).days + 2)]
        if revision == max(r for r, _ in versions[key]):
            begin = min(s for k, r, s, *_ in rows if k == key and r == revision)
            for d in days:
                if start <= d - day + at_ten < end and begin <= d - day + at_ten - hour:
                    run("persistence", d, d + day, mw)
                    if not planned:
                        run("approximate", d, d + day, mw)
            if planned:
                run("approximate", start, end, mw)
        for d in days:
            known = [r for r, created in versions[key] if created <= d - day + at_ten]
            if start - 3 * day <= d - day + at_ten and revision == max(known):
                run("exact", max(start, d), min(end, d + day), mw)
    got = {r.t: r for r in catalog.QUERIES["J12_outage_profiles"](spark, sf).collect()}
    first, last = floor(min(r[2] for r in rows)), floor(max(r[3] for r in rows)) + 2 * day
    assert set(got) == {str(first + i * hour) for i in range(int((last - first) / hour))}
    for part, want in parts.items():
        assert {str(t) for t in want} <= set(got)
        for t, r in got.items():
            assert r[part] == pytest.approx(want.get(datetime.fromisoformat(t), 0.0), abs=1e-4), (part, t)


def changed_tables(sf, folder, name, select):
    """The tables of sf under folder, but one made by a select from `old`; and a DuckDB over them."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf):
        os.symlink(f"{sf}/{f}", folder / f)
    os.unlink(folder / f"{name}.parquet")
    con.execute(f"COPY (WITH old AS (SELECT * FROM '{sf}/{name}.parquet') {select}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return con


def test_outages_that_agree_in_number_and_times_all_count(spark, sf, tmp_path):
    con = changed_tables(sf, tmp_path, "lineitem", "SELECT * FROM old UNION ALL SELECT * REPLACE (l_extendedprice + 7 AS l_extendedprice) FROM old WHERE l_partkey % 3 = 0")
    test_query_equals_sql(spark, str(tmp_path), con, "J12_outage_profiles")


def test_fuels_at_a_rounding_tie_equal_sql(spark, sf, tmp_path):
    con = changed_tables(sf, tmp_path, "orders", "SELECT * REPLACE (361788.06375 AS o_totalprice) FROM old")
    test_query_equals_sql(spark, str(tmp_path), con, "M22_whole_table")
