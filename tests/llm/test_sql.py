"""Every query of the package that SQL can express, next to its SQL."""

import pytest

from tests.compare import check, duck
from vetloom.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert check(spark, duck(SF_DIR), name, QUERIES[name], ORACLES[name], SF_DIR) is None


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda q: int(q[2:].split("_")[0]))] == [f"op{n}" for n in range(1, 14)]
