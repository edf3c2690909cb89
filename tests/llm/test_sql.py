"""Queries that SQL can express, on the smallest tables."""

import duckdb
import pytest

from quayside.llm import queries, sql
from tests.parity import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_query_equals_sql(spark, name):
    assert differences(spark, connect(SF), queries.QUERIES[name], sql.SQL[name], SF) == ""


def test_licenses_equal_sql_on_planted_notices(spark, tmp_path):
    """Both BSD notices, whole, edited and side by side: query and SQL choose alike."""
    two, three = sql.TEMPLATES["BSD-2-Clause"], sql.TEMPLATES["BSD-3-Clause"]
    texts = [two, three, two + " x y z " + three, three.replace("endorse", "praise"), "w " * 500 + two.replace("binary", "other"), three[: len(three) // 2], "none"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert differences(spark, con, queries.QUERIES["op10_licenses"], sql.SQL["op10_licenses"], str(tmp_path)) == ""
