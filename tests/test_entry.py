import pytest

import __spark_entry__ as entry


def test_names():
    names = entry.queries()
    assert {"p1_found", "p3_found"} <= set(names)
    assert set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", ["p1_found", "p3_found"])
def test_columns(spark, name):
    expected = {"p1_found": ["extraction_id", "field"], "p3_found": ["src", "row_id", "row_no"]}
    found = entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert found.columns == expected[name] and found.distinct().count() == found.count() > 0
