"""Every query with SQL against DuckDB, and the shape of the plans."""

import duckdb
import pytest

from fordway.plans import files, more, registry  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def rows(found, columns):
    return sorted((tuple(r[c] for c in columns) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, sf, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    own = rows((r.asDict() for r in df.collect()), columns)
    got = duck.sql(registry.SQL[name])
    assert sorted(got.columns) == columns
    assert own == rows((dict(zip(got.columns, r, strict=True)) for r in got.fetchall()), columns)


@pytest.mark.parametrize("name", ["point_in_polygon", "spatial_left_join", "spatial_semi", "affected_edges", "nearest_node", "affected_persons", "district_summary"])
def test_no_nested_loops(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_scan_is_pruned(spark, sf):
    plan = registry.QUERIES["tag_filter_in"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(event_type" in plan and "props" not in plan


def test_entry(spark):
    import __spark_entry__

    assert {r.service_type for r in __spark_entry__.entry(spark).collect()} == {"hospital", "fire_station"}
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_draw_sample_of_a_tall_grid(spark, tmp_path):
    """A box of which the width is below a cell's has one strip."""
    assert_equals_sql(spark, tmp_path, "draw_sample", range(7, 150_000, 97))
    assert {r.column for r in files.draw_sample(spark, str(tmp_path)).collect()} == {-1}


def test_web_projection_to_the_poles_and_beyond(spark, tmp_path):
    """To the millimetre at all latitudes; those beyond a pole, of which some have no number, as the SQL has them."""
    assert_equals_sql(spark, tmp_path, "web_projection", {*range(0, 900_000, 997), *range(163_900, 164_100), 6057, 9321, 124_011})
    y = [r.y for r in files.web_projection(spark, str(tmp_path)).collect()]
    assert any(v != v for v in y) and any(v > 1e8 for v in y) and any(v < 0 for v in y)


def assert_equals_sql(spark, folder, name, keys):
    """A query's rows against its SQL's, over customers of these keys."""
    spark.createDataFrame([(int(k),) for k in keys], "c_custkey long").write.parquet(f"{folder}/customer.parquet")
    c = duckdb.connect()
    c.sql(f"create view customer as select * from '{folder}/customer.parquet/*.parquet'")
    df, got = registry.QUERIES[name](spark, str(folder)), c.sql(registry.SQL[name])
    columns = sorted(got.columns)
    assert sorted(df.columns) == columns
    own = rows((r.asDict() for r in df.collect()), columns)
    # as text, since NaN is to equal NaN
    assert repr(own) == repr(rows((dict(zip(got.columns, r, strict=True)) for r in got.fetchall()), columns))
