"""All registered queries on tables in which one user, one conversation, one trace, one
text and one nation hold a third or more of the rows."""

from pathlib import Path

import duckdb
import pytest

import oracle
from obsframe import catalog

BASE = "/root/testdata/sf0.001"
SKEWED = {
    "events": "SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id, "
              "CASE WHEN event_id % 2 = 0 THEN 'click' ELSE event_type END AS event_type) FROM t",
    "conversations": "SELECT * REPLACE (CASE WHEN conv_id % 3 = 0 THEN 0 ELSE conv_id END AS conv_id, "
                     "CASE WHEN conv_id % 3 = 0 THEN conv_id * 100 + turn ELSE turn END AS turn) FROM t",
    "lineitem": "SELECT * REPLACE (CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_orderkey END AS l_orderkey) FROM t",
    "documents": "SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN 'the same old text' ELSE text END AS text) FROM t",
    "customer": "SELECT * REPLACE (CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE c_nationkey END AS c_nationkey) FROM t",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("skewed")
    connection = duckdb.connect()
    for file in Path(BASE).glob("*.parquet"):
        query = SKEWED.get(file.stem, "SELECT * FROM t").replace("FROM t", f"FROM '{file}'")
        connection.execute(f"COPY ({query}) TO '{path / file.name}' (FORMAT parquet)")
    return str(path)


@pytest.fixture(scope="module")
def database(folder):
    return oracle.connect(folder)


@pytest.fixture(params=["whole", "sliced"])
def mode(request, spark):
    if request.param == "sliced":
        spark.conf.set("spark.obsframe.slices", "12")
    yield request.param
    spark.conf.unset("spark.obsframe.slices")


CHECKED = sorted(n for n in catalog.SQL if not n.startswith("fn_"))


@pytest.mark.parametrize("name", CHECKED)
def test_query_on_skewed_tables(spark, folder, database, mode, name):
    assert oracle.difference(catalog.QUERIES[name](spark, folder), database, catalog.SQL[name]) is None
