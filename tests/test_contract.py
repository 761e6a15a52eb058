"""Every registered query of the library itself against its SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from buslens.plans.queries import REGISTRY
from tools.check_oracle import compare, connect


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(REGISTRY) <= set(contract.queries()) and set(REGISTRY) <= set(contract.oracle_sql())


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.columns == ["capture_id", "seq", "timestamp", "can_id_dec", "signal", "value", "label"]
    assert rows.count() > 0


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_equals_sql(spark, duck, sf_dir, name):
    assert compare(spark, duck, sf_dir, name) == ""
