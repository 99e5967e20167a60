"""The training-data queries that SQL can express, against DuckDB."""

import pytest

from quillon.llm import queries as Q

from ..oracle import compare


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query(spark, sf, name):
    compare(spark, sf, Q.queries()[name], Q.ORACLES[name])
