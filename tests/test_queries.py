"""Every registered query against its SQL."""

import pytest

from quernstone.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(registry.QUERIES[name], registry.ORACLES[name])


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
