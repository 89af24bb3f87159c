"""Queries against their SQL on small tables that the test data do not hold."""

import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__ as e

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def both(spark, folder, name, rows, table="events", schema=EVENTS):
    """The sorted rows of a query and of its SQL over one table."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    got = e.queries()[name](spark, str(folder))
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
    want = con.execute(e.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    told = [tuple(r) for r in got.select(*columns).collect()]
    return columns, sorted(told, key=str), sorted(want.fetchall(), key=str)


def same(told, wanted):
    assert len(told) == len(wanted)
    for a, b in zip(told, wanted, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9)) for x, y in zip(a, b, strict=True)), (a, b)


def event(k, value=1.0, user=1, kind="a", second=0.0):
    return (k, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second), user, kind, value, None)


@pytest.mark.parametrize("outside", [5, 200])
def test_a_view_with_too_few_events_has_no_dense_region(spark, tmp_path, outside):
    rows = [event(k, 10.0 + k % 90, 1 + k % 40, "ab"[k % 2]) for k in range(100)]
    rows += [event(1000 + k, 10.0, 5000, "abc"[k % 3]) for k in range(outside)]  # users beyond the view; c is never in it
    columns, told, wanted = both(spark, tmp_path, "density_rings", rows)
    same(told, wanted)
    assert len(told) == 2 and (sum(r[columns.index("inside")] for r in told) > 0) == (outside == 5)


def test_a_view_without_events(spark, tmp_path):
    _, told, wanted = both(spark, tmp_path, "density_rings", [event(k, 10.0, 5000) for k in range(9)])
    assert told == wanted == []


@pytest.mark.parametrize("least", [0.0, -2.5, 0.5])
def test_a_geometric_mean_is_of_positive_values(spark, tmp_path, least):
    rows = [event(k, 3.0 + k % 7, kind="ab"[k % 2]) for k in range(1, 60)] + [event(62, least)]
    columns, told, wanted = both(spark, tmp_path, "population_summary", rows)
    same(told, wanted)
    at = columns.index("geometric_mean")
    means = {r[columns.index("sample")]: r[at] for r in told}
    assert means["b"] > 0 and (means["a"] is not None) == (least > 0)


def test_steps_are_between_valid_times(spark, tmp_path):
    # the clock falls by 1e6 each 2500 ids, so that of the last ids is negative
    ids = [*range(4_256_990, 4_257_020), *range(4_259_990, 4_260_030), *range(4_400_000, 4_400_040)]
    rows = [event(k, kind="ab"[i % 2], second=i * 1.5 + (i % 3)) for i, k in enumerate(ids)]
    columns, told, wanted = both(spark, tmp_path, "time_diagnostics", rows)
    same(told, wanted)
    assert [r[columns.index("n")] for r in told] == [55, 55]
    _, told, wanted = both(spark, tmp_path, "time_report", rows)
    same(told, wanted)
