"""Every registered query here against its SQL, where it has one."""

import pytest

from marginalia.llm import queries
from tests.conftest import DATA
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, DATA), connect(DATA), queries.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, name):
    found = queries.QUERIES[name](spark, DATA)
    table = {"op10_character_ratio": "pages", "op11_vector_codes": "embeddings"}.get(name, "documents")
    assert found.count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()
