"""The plain Python baseline computes what the queries do."""

import math

import pytest

import baseline
from headlight.plans import catalogue
from tests.conftest import SF


@pytest.mark.parametrize("name", baseline.QUERIES)
def test_same_results(spark, name):
    query, columns = baseline.QUERIES[name]
    want = sorted(query(SF))
    got = sorted(tuple(r) for r in catalogue.QUERIES[name](spark, SF).select(*columns.split()).collect())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(math.isclose(x, y, abs_tol=2e-6) if isinstance(x, float) else x == y for x, y in zip(a, b, strict=True)), (a, b)
