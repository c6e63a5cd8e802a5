"""Every query with SQL against DuckDB, on the smallest tables; the others must run."""

import harness
import pytest

from voxloom import registry

SF = f"{harness.DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return harness.duck(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLE:
        assert harness.compare(df, registry.ORACLE[name], con) == ""
    else:
        assert df.count() > 0
