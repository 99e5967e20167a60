"""Every query that SQL can express, against DuckDB."""

import pytest

from quillon import plans

from .oracle import compare


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query(spark, sf, name):
    compare(spark, sf, plans.QUERIES[name], plans.ORACLES[name])
