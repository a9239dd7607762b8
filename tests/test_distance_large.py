"""The registered distance queries give a result at any number of distinct rows."""

import pytest

from surveyloom.operators import distance
from surveyloom.plans import catalogue


@pytest.mark.parametrize("name", ["hamming_pairs", "energy_distance", "dcr_nndr", "loo_proximity"])
def test_beyond_large(spark, monkeypatch, name):
    monkeypatch.setattr(distance, "LARGE", 10)
    assert getattr(catalogue, name)(spark, "/root/testdata/sf0.001").count() > 0
