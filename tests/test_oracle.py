"""Every registered query against its SQL: once with the plan small tables get, once cut
into slices as large ones are."""

import pytest

import oracle
from obsframe import catalog

FOLDERS = {"whole": "/root/testdata/sf0.01", "sliced": "/root/testdata/sf0.001"}


@pytest.fixture(scope="module")
def databases():
    return {mode: oracle.connect(folder) for mode, folder in FOLDERS.items()}


@pytest.fixture(params=FOLDERS)
def mode(request, spark):
    if request.param == "sliced":
        spark.conf.set("spark.obsframe.slices", "40")
    yield request.param
    spark.conf.unset("spark.obsframe.slices")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, databases, mode, name):
    df = catalog.QUERIES[name](spark, FOLDERS[mode])
    if name in catalog.SQL:
        assert oracle.difference(df, databases[mode], catalog.SQL[name]) is None
    else:
        assert df.count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
