"""The mixture against its true target weights."""

from itertools import islice

import pytest

from surveyloom.llm import mixing


@pytest.mark.parametrize("weights", [[100_000**0.5] + [10_000**0.5] * 19, [1.0, 0.0001, 0.37], [3.0, 2.0**-40, 0.1, 0.7]])
def test_deviation_stays_below_a_block(weights):
    n = 20_000
    count = [0] * len(weights)
    for t, (s, _, phase) in enumerate(islice(mixing.placed([n] * len(weights), weights), n)):
        assert phase == 0
        count[s] += 1
        assert all(abs(c - (t + 1) * w / sum(weights)) < 1 + 1e-9 for c, w in zip(count, weights, strict=True))


def test_each_of_many_sources_has_its_own_weight(spark):
    """600 sources, one of them with two thirds of the rows: each keeps to its own target to within a block."""
    rows = [(i, "hot") for i in range(4800)] + [(10_000 + i, f"site{i % 599}") for i in range(4 * 599)]
    weights = {"hot": 100.0} | {f"site{i}": 1.0 + i % 3 for i in range(599)}
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mixed(docs, weights, block=1).collect()
    assert sorted((r["doc_id"], r["source"]) for r in got) == sorted(rows)
    assert sorted(r["position"] for r in got) == list(range(len(rows)))
    total, count = sum(weights.values()), dict.fromkeys(weights, 0)
    for t, r in enumerate(sorted(got, key=lambda r: r["slot"])[: int(4 / 3 * total)]):  # until the heaviest sites run out
        count[r["source"]] += 1
        assert all(abs(c - (t + 1) * weights[s] / total) < 1 + 1e-9 for s, c in count.items())
    assert count["hot"] > 100
