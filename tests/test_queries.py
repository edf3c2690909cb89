"""Every registered query of the engine's own operators against its SQL."""

import pytest

from quayside import catalog
from quayside.plans import q_pilot, q_records, records_view
from quayside.plans.runtime import materialize
from tests.parity import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture
def con():
    return connect(SF)


@pytest.fixture(scope="module", autouse=True)
def records_made_once(spark):
    """Period records and facts, as the queries make them, once for all that read them."""
    made = {"run_records": materialize(records_view.run_records(spark, SF), "records"), "facts": records_view.facts(spark, SF)}
    with pytest.MonkeyPatch.context() as patch:
        for module in (records_view, q_pilot, q_records):
            for name, frame in made.items():
                patch.setattr(module, name, lambda spark, sf, frame=frame: frame)
        yield


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, con, name):
    assert differences(spark, con, catalog.QUERIES[name], catalog.SQL[name], SF) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_record_functions_of_far_keys(spark, tmp_path):
    """Keys that are shifted far, negative or null: bit for bit what the SQL gives."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"COPY (SELECT k.k + s.s AS o_orderkey, 'F' AS o_orderstatus FROM RANGE(420) k(k), (SELECT UNNEST([0, 1700000000000, 590000000000000, 590000000000000000, -420]) AS s) s UNION ALL SELECT NULL, 'O') TO '{tmp_path}/orders.parquet'")
    con.execute(f"CREATE VIEW orders AS FROM '{tmp_path}/orders.parquet'")
    catalog.QUERIES["record_functions"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/ours")
    con.execute(f"CREATE TABLE theirs AS {catalog.SQL['record_functions']}")
    con.execute(f"CREATE TABLE ours AS FROM '{tmp_path}/ours/*.parquet'")
    for a, b in (("ours", "theirs"), ("theirs", "ours")):
        assert con.execute(f"SELECT COUNT(*) FROM (FROM {a} EXCEPT ALL FROM {b})").fetchone() == (0,)
