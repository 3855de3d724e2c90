"""Exact medians by selection, admission in sessions, committed tables."""

import random
import statistics
from collections import deque

import pytest

from attestra.operators import merge
from attestra.streaming import state


@pytest.mark.parametrize("few", [2, 5, 1024])
def test_median(spark, few):
    r = random.Random(few)
    for values in ([], [3], [3, 1], [1e308, -1e308, 5.0, 7.0], [r.choice([0.0, 1.5, -2.25, 7.0]) for _ in range(101)], [r.uniform(-1e6, 1e6) for _ in range(200)], [1.0] * 50 + [1.0 + 2**-52] * 51, [5e-324, 1e-323, 1.5e-323, 2e-323]):
        df = spark.createDataFrame([(None,), (float("nan"),)] + [(float(v),) for v in values], "x double")
        got = merge.exact_median(df, "x", few).first()["median"]
        assert got == (statistics.median(map(float, values)) if values else None)


def plain(rows, most, window):
    held, out = {}, []
    for i, k, t in sorted((x for x in rows if x[2] is not None), key=lambda x: (x[2], x[0])):
        own = held.setdefault(k, deque())
        while own and own[0] <= t - window:
            own.popleft()
        out.append((i, len(own) < most))
        if len(own) < most:
            own.append(t)
    return sorted(out + [(i, False) for i, _, t in rows if t is None])


@pytest.mark.parametrize("most,window", [(1, 60), (3, 60), (3, 600)])
def test_admission_in_sessions(spark, most, window):
    r = random.Random(window)
    rows = [(i, r.choice([1, 1, 1, 2, 3, None]), r.choice([r.randrange(0, 3000), r.randrange(0, 60) * 60])) for i in range(600)]
    rows += [(700 + i, 9, 1000) for i in range(20)] + [(800, 4, None), (801, 5, -120), (802, 5, -60), (803, 5, 0)]
    df = spark.createDataFrame(rows, "id long, k long, s long").selectExpr("id", "k", "timestamp_seconds(s) AS at").repartition(5)
    got = state.admit(df, key="k", time="at", row="id", most=most, window_s=float(window))
    assert sorted(map(tuple, got.collect())) == plain(rows, most, window)
    assert state.admit(df.limit(0), key="k", time="at", row="id", most=most, window_s=1.0).count() == 0
