"""Every query runs over whole tables; those with SQL give DuckDB's rows."""

import glob
import math
import os

import numpy as np
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
CORE = sorted(n for n in QUERIES if not (n[0] == "p" and n[1].isdigit()))


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def compare(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    names = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    if name in ORACLES:
        found = duck.sql(ORACLES[name])
        assert sorted(found.columns) == names
        at = [found.columns.index(c) for c in names]
        assert sorted(map(repr, rows)) == sorted(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())


@pytest.mark.parametrize("name", CORE)
def test_core(spark, data, duck, name):
    compare(spark, data, duck, name)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES)


def test_filters_and_columns_reach_the_scan(spark, data):
    plan = QUERIES["exact_match_filtered"](spark, data)._jdf.queryExecution().toString()
    assert "EqualTo(group,CWSA)" in plan
    plan = QUERIES["ingest_counts"](spark, data)._jdf.queryExecution().toString()
    assert "snippet" not in plan.split("ReadSchema")[-1]


@pytest.mark.parametrize("name", CORE)
def test_plans_scale(spark, data, name):
    """No window over all rows, no product of two tables, no row-at-a-time Python."""
    plan = QUERIES[name](spark, data)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    for line in plan.split("\n"):
        if "Window [" in line:
            assert not line.rstrip().endswith("]") or "], [" in line, line


@pytest.mark.parametrize("layout", ["file", "folder"])
def test_requests_stream_reads_any_layout(spark, tmp_path, layout):
    """One file, or a folder of files whose names say nothing; repeats in other files, late rows, reused ids and missing values."""
    import datetime as dt

    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    times = [dt.datetime(2024, 3, 1, 0, 10), dt.datetime(2024, 3, 1, 0, 50), dt.datetime(2024, 3, 20, 12), dt.datetime(2024, 3, 1, 0, 10), None]
    rows = [(i % 7 if i < 60 else None, ["all", "exact", None][i % 3], times[i % 5]) for i in range(70)]

    def write(rows, path):
        columns = zip(("request_id", "search_type", "requested_at"), zip(*rows), (pa.int64(), pa.string(), pa.timestamp("us")))
        pq.write_table(pa.table({name: pa.array(values, kind) for name, values, kind in columns}), path)

    log = tmp_path / "requests.parquet"
    if layout == "file":
        write(rows, log)
    else:
        log.mkdir()
        for k in range(4):
            write(rows[k * 15 : k * 15 + 25], log / f"part-{k:05}.parquet")
    write([(900, "all", times[0])], tmp_path / "old_requests.parquet")  # a neighbour with a similar name is no part of the log
    con = duckdb.connect()
    con.execute(f"CREATE VIEW requests AS SELECT * FROM '{log}{'/*.parquet' if layout == 'folder' else ''}'")
    compare(spark, str(tmp_path), con, "requests_stream")
