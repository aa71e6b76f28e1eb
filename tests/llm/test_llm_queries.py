"""Registered llm queries against their SQL."""

import pytest
from oracle import differences

from kappaloom.llm.oracles import ORACLES
from kappaloom.llm.queries import QUERIES


def test_every_operator_is_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, len(QUERIES) + 1))


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, sf_dir, con, name):
    assert differences(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == []
