"""Means over windows of days by running sums, against sums over every window."""

import datetime
import random

import pytest

from histloom.plans import signals as P

DAY0 = datetime.date(2020, 2, 20)


def day(n):
    return DAY0 + datetime.timedelta(n)


@pytest.mark.parametrize("width", [0, 3, 40, 365])
def test_window_sums(spark, width):
    rnd = random.Random(width)
    rows = [(day(n), rnd.choice([None, 0.0, 1.5, 7.25]), rnd.choice([None, 2.0, float("inf")]) if n > 200 else 1.0) for n in range(300) if rnd.random() < 0.7]
    rows.append((None, 5.0, 5.0))
    dates = [day(rnd.randrange(-450, 750)) for _ in range(60)] + [None, day(3), day(3)]
    per_day = spark.createDataFrame(rows, "day date, a double, b double").repartition(3)
    found = P.window_sums(spark.createDataFrame([(d,) for d in dates], "date date"), per_day, ["a", "b"], days=width)
    want = set()
    for d in {d for d in dates if d}:
        near = [r for r in rows if r[0] and abs((r[0] - d).days) <= width]
        if near:
            values = [[r[c] for r in near if r[c] is not None] for c in (1, 2)]
            want.add((d, *[x for v in values for x in (sum(v) if v else None, len(v))]))
    got = {tuple(r) for r in found.select("date", "sum_a", "n_a", "sum_b", "n_b").collect()}
    assert got == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "day date, a double")
    dates = spark.createDataFrame([(day(1),)], "date date")
    assert P.window_sums(dates, none, ["a"]).count() == 0
    assert P.window_sums(dates.limit(0), spark.createDataFrame([(day(1), 1.0)], "day date, a double"), ["a"]).count() == 0
