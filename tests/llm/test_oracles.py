"""Queries with a SQL twin give its rows."""

import pytest

from tidemark.llm.queries import ORACLES, QUERIES

from ..oracle import connect, same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, name):
    d = "/root/testdata/sf0.01"
    same(QUERIES[name](spark, d), ORACLES[name], connect(d))
