"""KLL sketches of rates: rank error against exact ranks, and merged parts against the whole."""

import numpy as np
import pytest

from suiteforge.operators import stats


@pytest.mark.parametrize("kind", ["uniform", "ties", "few"])
def test_sketch_ranks_are_close_and_merge(spark, kind):
    draw = np.random.default_rng(3)
    values = {"uniform": draw.random(40_000), "ties": draw.integers(0, 21, 40_000) / 20, "few": draw.random(50)}[kind]
    rows = spark.createDataFrame([(int(k % 4), float(v)) for k, v in enumerate(values)] + [(9, None)], "round long, pass_rate double").repartition(7)
    parts = stats.rate_sketches(rows, by=["round"])
    assert parts.count() == 4  # a round without values has none
    for sketches in (stats.rate_sketches(rows), stats.merge_sketches(parts)):
        found = stats.sketch_percentiles(sketches, (1, 25, 50, 75, 90, 99)).collect()
        assert len(found) == 6 and {r.n for r in found} == {len(values)}
        for r in found:
            low, high = (values < r.value).mean(), (values <= r.value).mean()
            assert low - 0.02 <= r.percentile / 100 <= high + 0.02
    one = stats.sketch_percentiles(parts.where("round = 1")).collect()
    assert {r["round"] for r in one} == {1} and len(one) == len(stats.PERCENTILES)


def test_no_rates_no_sketch(spark):
    rows = spark.createDataFrame([], "pass_rate double")
    assert stats.sketch_percentiles(stats.rate_sketches(rows)).collect() == []
