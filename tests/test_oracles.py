"""Every query of the reference's own operators that SQL can express agrees with DuckDB."""

import pytest

from waymark.plans import catalog

from .conftest import same_rows


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_agrees(name, spark, sf, duck):
    same_rows(catalog.QUERIES[name](spark, sf), duck.sql(catalog.ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_has_rows(name, spark, sf):
    assert catalog.QUERIES[name](spark, sf).limit(1).count() == 1
