"""Every query of the library against its SQL, and those without SQL for their rows."""

import pytest

from presentia.queries import evaluation, galleries, ingest, jobs, serving
from tests.oracle import duck, same

AREAS = (evaluation, ingest, galleries, serving, jobs)
QUERIES = {k: q for a in AREAS for k, q in a.QUERIES.items()}
SQL = {k: s for a in AREAS for k, s in a.SQL.items()}


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, con, name):
    same(QUERIES[name](spark, sf).toPandas(), con.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
