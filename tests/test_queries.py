import os

import pytest

import __spark_entry__ as entry
import compare
from swatchbook.plans.oracle import ORACLE
from swatchbook.plans.queries import REGISTRY

SCALES = ("/root/testdata/sf0.001", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SCALES[0]), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return [compare.connect(sf) for sf in SCALES]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    # At the first scale no product survives the rare-category limit of some queries.
    for sf, connection in zip(SCALES, duck, strict=True):
        want = compare.sql_rows(connection, entry.oracle_sql()[name])
        if want[-1]:
            break
    assert want[-1]
    assert compare.spark_rows(entry.queries()[name](spark, sf)) == want


def test_every_query_has_sql():
    assert REGISTRY.keys() == ORACLE.keys()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["product_id", "description"]
    assert df.count() > 50
