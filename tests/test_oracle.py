"""Every registered query with an SQL twin gives the same rows."""

import pytest

import compare
from panescan import checks

SF = "/root/testdata/sf0.001"
QUERIES, TWINS = checks.load()


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    ok, note = compare.compare(spark, duck, name, QUERIES[name], TWINS.get(name), SF)
    assert ok, note


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["image_id", "class_id", "inter", "pred_n", "true_n", "iou", "dice"]
    assert df.count() > 0
