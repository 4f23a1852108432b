import random
from datetime import datetime, timedelta

import pytest

from lifeloom.operators import intervals as I

T0 = datetime(2024, 1, 1)


def frame(spark, spans):
    rows = [("k", T0 + timedelta(days=a), None if b is None else T0 + timedelta(days=b)) for a, b in spans]
    return spark.createDataFrame(rows, "k string, start timestamp_ntz, end timestamp_ntz")


def days(spans, top=40):
    return {d for a, b in spans for d in range(a, top if b is None else b)}


def result(df, top=40):
    spans = [((r.start - T0).days, None if r.end is None else (r.end - T0).days) for r in df.collect()]
    assert all(not (x[1] is not None and x[1] in {y[0] for y in spans}) for x in spans), "touching intervals are one"
    return days(spans, top)


@pytest.mark.parametrize("seed", range(4))
def test_against_sets_of_days(spark, seed):
    r = random.Random(seed)

    def some():
        return [(a, None if r.random() < 0.1 else a + r.randint(0, 6)) for a in (r.randint(0, 25) for _ in range(r.randint(1, 7)))]

    a, b = some(), some()
    x, y = frame(spark, a), frame(spark, b)
    assert result(I.merge(x, ["k"])) == days(a)
    assert result(I.subtract(x, y, ["k"])) == days(a) - days(b)
    assert result(I.intersect(x, y, ["k"])) == days(a) & days(b)
    covered = [r.fully_covered for r in I.covered(x, y, ["k"]).collect()]
    assert covered == ([days(a) <= days(b)] if days(a) else [])


def test_witnesses_that_leave_a_gap_leave_exactly_the_gap(spark):
    left = I.subtract(frame(spark, [(0, 10)]), frame(spark, [(2, 4), (6, 8)]), ["k"])
    assert result(left) == {0, 1, 4, 5, 8, 9}


def test_zero_length_row_inside_another_counts_only_as_touching_point(spark):
    a, b = frame(spark, [(3, 3)]), frame(spark, [(0, 9)])
    assert I.overlap_join(a, b, ["k"]).count() == 1
    assert I.overlap_join(a, b, ["k"], touching_point=False).count() == 0


def test_closure_of_a_long_chain_and_a_cycle(spark):
    from lifeloom.operators.closure import temporal_closure

    edges = spark.range(120).selectExpr("id AS child", "id + 1 AS parent", "TIMESTAMP_NTZ '2024-01-01' AS start", "CAST(NULL AS TIMESTAMP_NTZ) AS end")
    loop = spark.sql("SELECT 120L AS child, 0L AS parent, TIMESTAMP_NTZ '2024-01-05' AS start, TIMESTAMP_NTZ '2024-01-09' AS end")
    found = {(r.child, r.parent): (r.start.day, r.end) for r in temporal_closure(edges.unionByName(loop)).collect()}
    assert len(found) == 121 * 121 and found[0, 120] == (1, None)
    assert found[120, 119][0] == found[7, 7][0] == 5 and found[7, 7][1].day == 9
