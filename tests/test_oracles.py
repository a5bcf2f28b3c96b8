"""Every registered query against its SQL twin on the smallest given tables."""

from __future__ import annotations

import pytest

from rolecall.plans import ORACLES, QUERIES
from tests.oracle import TESTDATA, actual, connect, expected

SF_DIR = f"{TESTDATA}/sf0.001"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    result = QUERIES[name](spark, SF_DIR)
    assert actual(result) == expected(con, ORACLES[name])
    types = {row[0]: row[1] for row in con.execute(f"DESCRIBE {ORACLES[name]}").fetchall()}
    assert {column: KINDS.get(kind) for column, kind in result.dtypes} == types
