"""Queries on ledgers equal their SQL on a few trades: a book with purchases and a sale, one without trades."""

from datetime import datetime as T

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from bookweave import catalog


def plain(x):
    return round(x + 0.0, 4) if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def few(tmp_path_factory):
    folder = tmp_path_factory.mktemp("few")
    days = [T(1996, 1, 2), T(1996, 1, 4), T(1996, 1, 6), T(1996, 2, 6), T(1996, 3, 12)]
    tables = {
        "customer": {"c_custkey": [1, 2], "c_acctbal": [10.0, 20.0], "c_mktsegment": ["BUILDING", "MACHINERY"]},
        "part": {"p_partkey": [1, 2], "p_brand": ["Brand#11", "Brand#12"], "p_type": ["TIN", "STEEL"]},
        "orders": {"o_orderkey": [1, 2, 3], "o_custkey": [1, 1, 2], "o_orderstatus": ["O", "F", "O"], "o_orderpriority": ["2-HIGH", "2-HIGH", "1-URGENT"], "o_totalprice": [500.0, 50.0, 70.0], "o_orderdate": [T(1996, 1, 2), T(1996, 2, 6), T(1996, 1, 4)]},
        "lineitem": {
            "l_orderkey": [1, 1, 1, 2, 2], "l_partkey": [1, 2, 1, 2, 1], "l_linenumber": pa.array([1, 2, 3, 1, 2], pa.int32()), "l_quantity": [10.0, 5.0, 2.0, 3.0, 4.0],
            "l_extendedprice": [100.0, 60.0, 24.0, 30.0, 60.0], "l_tax": [0.01] * 5, "l_returnflag": ["N", "N", "N", "R", "N"], "l_shipdate": days,
        },
    }
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), folder / f"{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["agg16_fin4_account_summary", "win5_win7_account_path", "win6_dated_lots", "win8_attribution", "win8_reconciliation"])
def test_few_trades(spark, few, name):
    con = duckdb.connect()
    for t in ("customer", "part", "orders", "lineitem"):
        con.sql(f"create view {t} as select * from '{few}/{t}.parquet'")
    want = con.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, few)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = sorted(([plain(dict(zip(want.columns, r))[c]) for c in columns] for r in want.fetchall()), key=str)
    assert rows and sorted(([plain(r[c]) for c in columns] for r in got.collect()), key=str) == rows
