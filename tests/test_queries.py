"""Queries against their SQL."""

import pytest

import __spark_entry__
from ruleloom.plans.registry import ORACLE_SQL, QUERIES
from tests.util import SF, database, rows

#: The analysis queries share their stages; these are compared here, all of them by the driver.
CHOSEN = [q for q in QUERIES if QUERIES[q].__module__.endswith(("table_queries", "topic_queries", "flow_queries"))] + ["competing_claims", "verify_long_text", "chunked_projection", "funnel", "before_after", "briefing", "compliance_deadlines"]


@pytest.fixture(scope="module")
def db():
    return database()


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, db, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(db.sql(ORACLE_SQL[name]).df())


def test_entry(spark):
    assert set(__spark_entry__.queries()) >= set(QUERIES) and set(__spark_entry__.oracle_sql()) >= set(ORACLE_SQL)
    assert __spark_entry__.entry(spark).columns[0] == "doc_id"


def test_scans_read_few_columns_and_push_filters(spark):
    plan = QUERIES["leftover_anti"](spark, SF)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)" in plan and "ReadSchema: struct<o_orderkey:bigint>" in plan
