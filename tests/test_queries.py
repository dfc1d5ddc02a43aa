"""Every query of the library against its SQL, on the smallest tables."""

import pytest
from conftest import SF, same

from factloom.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    if name in catalogue.SQL:
        same(df, catalogue.SQL[name])
    else:
        assert df.count() > 0
