import pytest
from oracle import assert_same, duck

from tamarack import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLE_SQL:
        assert_same(df, duck(SF), catalog.ORACLE_SQL[name])
    else:
        assert df.count() >= 0


def test_entry_point():
    import __spark_entry__ as entry

    assert catalog.FLAGSHIP in entry.queries()
    assert set(catalog.ORACLE_SQL) <= set(entry.queries())
