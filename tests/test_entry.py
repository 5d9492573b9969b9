import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ["events", "lineitem", "supplier"]


@pytest.fixture(scope="module")
def db(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_small}/{t}.parquet'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return str(v)
        return "nan" if math.isnan(v) else f"{float(v):.9g}"

    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 50


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() == 35 and len(df.columns) == 94


@pytest.mark.parametrize("name", [
    "packet_summary", "parse_frames", "validate_ip", "schema_diff", "syn_flush", "flow_record",
    "flow_record_directional", "flow_features_cic2017", "bidirectional_flow_key", "stream_flows"])
def test_against_duckdb(spark, db, sf_small, name):
    df = entry.queries()[name](spark, sf_small)
    cur = db.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())
