from datetime import date, timedelta

import numpy as np
import pytest

from lithograph.operators import rolling

SHAPE = "name string, day date, total long, shard int"
END = date(2024, 12, 31)


def brute(rows, windows, end):
    out = {}
    for key in {r[0] for r in rows}:
        days = {}
        for k, d, n, *_ in rows:
            if k == key and d is not None and n is not None and d <= end:
                days[d] = days.get(d, 0) + n
        if not days:
            continue
        day = min(days)
        while day <= end:
            out[(key, day)] = tuple(sum(days.get(day - timedelta(i), 0) for i in range(w)) for w in windows)
            day += timedelta(1)
    return out


def got(df, windows):
    return {(r["name"], r["day"]): tuple(r[f"total_{w}"] for w in windows) for r in df.collect()}


@pytest.mark.parametrize("low, high", [(0, 63), (0, 0), (5, 40), (63, 63), (1, 62)])
def test_cover_is_exact(low, high):
    def leaves(node):
        return [node - rolling.SHARD_DAYS] if node >= rolling.SHARD_DAYS else leaves(2 * node) + leaves(2 * node + 1)

    days = sorted(d for n in rolling.cover(low, high) for d in leaves(n))
    assert days == list(range(low, high + 1)) and len(rolling.cover(low, high)) <= 2 * 7


def test_totals_match_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(f"k{rng.integers(4)}", date(2024, 3, 1) + timedelta(int(rng.integers(330))), int(rng.integers(-2, 5)), 9) for _ in range(150)]
    rows += [(None, date(2024, 12, 30), 2, 1), ("late", date(2025, 2, 1), 1, 1), ("k0", None, 5, 1), ("k0", date(2024, 5, 5), None, 1), rows[0]]
    windows = (7, 30, 100)
    df = spark.createDataFrame(rows, SHAPE)
    found = got(rolling.rolling_totals(df, ["name"], windows, END), windows)
    assert found == brute(rows, windows, END)
    row = rolling.rolling_totals(df, ["name"], [7], END).where("name IS NULL").orderBy("day").collect()
    assert [(r.day, r.total_7, r.average_7) for r in row] == [(date(2024, 12, 30), 2, 2 / 7), (END, 2, 2 / 7)]


def test_empty(spark):
    assert rolling.rolling_totals(spark.createDataFrame([], SHAPE), ["name"], [7], END).count() == 0


def test_corrections_touch_only_ancestors(spark):
    rows = [("a", date(2024, 11, 1), 3, 0), ("a", date(2024, 3, 1), 1, 0), ("b", date(2024, 11, 2), 4, 0)]
    fixes = [("a", date(2024, 11, 1), -3, 0), ("a", date(2024, 11, 3), 2, 0), ("c", date(2024, 12, 1), 5, 0)]
    trees = rolling.segment_trees(spark.createDataFrame(rows, SHAPE), ["name"])
    fixed = rolling.correct(trees, spark.createDataFrame(fixes, SHAPE), ["name"])
    expected = rolling.segment_trees(spark.createDataFrame([rows[1], rows[2], ("a", date(2024, 11, 3), 2, 0), fixes[2]], SHAPE), ["name"])
    assert sorted(map(str, fixed.collect())) == sorted(map(str, expected.collect()))
    before = {(r.name, r.shard): dict(zip(r.nodes, r.sums)) for r in trees.collect()}
    changed = {(r.name, r.shard): dict(zip(r.nodes, r.sums)) for r in fixed.collect()}
    same = [k for k in before if before[k] == changed.get(k)]
    assert len(same) == 2
