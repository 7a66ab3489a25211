import pytest
from oracle import duck, same

from tidemark.llm import queries

ROOT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_duckdb(spark, name):
    same(queries.QUERIES[name](spark, ROOT).toPandas(), duck(ROOT).sql(queries.ORACLES[name]).df())
