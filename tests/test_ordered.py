"""Order-based operators against brute force, with one group that holds a third of all rows."""

import random
from statistics import median

import pytest

from tallyforge.operators.ordered import distribution, medians, running, with_group_position, with_position
from tallyforge.operators.ranking import rank_by_value


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    return [(0 if i % 3 == 0 else draw.randrange(1, 40), i, draw.choice([None, *range(50)])) for i in range(3000)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "g int, t int, v int").repartition(7)


def test_position_is_the_place_in_the_whole_order(frame, rows):
    got = {(r.g, r.t): r.position for r in with_position(frame, ["g", "t"]).collect()}
    assert got == {(g, t): i for i, (g, t, _) in enumerate(sorted(rows, key=lambda r: r[:2]), 1)}


def test_group_position_equals_row_number(frame, rows):
    got = {r.t: r.position for r in with_group_position(frame, ["g"], ["t"]).collect()}
    seen, want = {}, {}
    for g, t, _ in sorted(rows, key=lambda r: r[:2]):
        seen[g] = seen.get(g, 0) + 1
        want[t] = seen[g]
    assert got == want


@pytest.mark.parametrize("how", ["sum", "max"])
def test_running_folds_with_missing_values(frame, rows, how):
    got = {r.t: r.out for r in running(frame, ["g"], ["t"], "v", "out", how).collect()}
    state, want = {}, {}
    for g, t, v in sorted(rows, key=lambda r: r[:2]):
        if v is not None:
            state[g] = v if g not in state else (state[g] + v if how == "sum" else max(state[g], v))
        want[t] = state.get(g)
    assert got == want


def test_median_is_exact_for_odd_even_and_hot_groups(frame, rows):
    got = {r.g: r.median for r in medians(frame, ["g"], "v").collect()}
    values = {}
    for g, _, v in rows:
        if v is not None:
            values.setdefault(g, []).append(v)
    assert got == {g: float(median(v)) for g, v in values.items()}


def test_rank_by_value_equals_rank(frame, rows):
    kept = frame.where("v is not null")
    got = {r.t: r.rk for r in rank_by_value(kept, ["g"], "v", "rk").collect()}
    want = {t: 1 + sum(1 for g2, _, v2 in rows if g2 == g and v2 is not None and v2 < v) for g, t, v in rows if v is not None}
    assert got == want


def test_median_of_nearly_equal_values_sorts_few_rows(spark, monkeypatch):
    """99 of 100 rows share a value; what is sorted is one row for each value of a group."""
    from tallyforge.operators import ordered

    rows = spark.range(20_000).selectExpr("id % 3 AS g", "CASE WHEN id % 100 = 0 THEN id ELSE 7 END AS v")
    sorted_rows = []
    whole = ordered.ranged
    monkeypatch.setattr(ordered, "ranged", lambda frame, order: sorted_rows.append(frame.count()) or whole(frame, order))
    got = {r.g: r.median for r in medians(rows, ["g"], "v").collect()}
    assert got == {0: 7.0, 1: 7.0, 2: 7.0}
    assert sorted_rows[0] <= 3 + 200


# ---- null keys and null values, beside windows of another engine ------------------------------------------


@pytest.fixture(scope="module")
def holes():
    draw = random.Random(8)
    key = lambda n: draw.choice([None, *range(n)])
    return [(None if i % 3 == 0 else key(4), key(3) if i % 2 else None, i, key(9)) for i in range(600)] + [(7, None, 1000 + i, None) for i in range(5)]


def beside(spark, holes, got, sql):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("raw", pd.DataFrame(holes, columns=["g", "h", "t", "v"], dtype="Int64"))
    con.execute("CREATE TABLE x AS SELECT g::INT g, h::INT h, t::INT t, v::INT v FROM raw")
    order = lambda rows: sorted(rows, key=lambda r: [(x is not None, x) for x in r])
    assert order([tuple(r) for r in got.collect()]) == order(con.execute(sql).fetchall())


@pytest.fixture(scope="module")
def holed(spark, holes):
    return spark.createDataFrame(holes, "g int, h int, t int, v int").repartition(5)


def test_positions_with_nulls(spark, holes, holed):
    beside(spark, holes, with_position(holed, ["g", "v", "t"]).select("t", "position"),
           "SELECT t, row_number() OVER (ORDER BY g NULLS FIRST, v NULLS FIRST, t) FROM x")
    beside(spark, holes, with_group_position(holed, ["g", "h"], ["v", "t"]).select("g", "h", "t", "position"),
           "SELECT g, h, t, row_number() OVER (PARTITION BY g, h ORDER BY v NULLS FIRST, t) FROM x")
    beside(spark, holes, with_group_position(holed, [], ["v", "t"]).select("t", "position"), "SELECT t, row_number() OVER (ORDER BY v NULLS FIRST, t) FROM x")


@pytest.mark.parametrize("how", ["sum", "max"])
def test_running_with_nulls(spark, holes, holed, how):
    beside(spark, holes, running(holed, ["g", "h"], ["t"], "v", "out", how).select("t", "g", "h", "out"),
           f"SELECT t, g, h, {how}(v) OVER (PARTITION BY g, h ORDER BY t) FROM x")


def test_median_rank_and_distribution_with_nulls(spark, holes, holed):
    beside(spark, holes, medians(holed, ["g", "h"], "v"), "SELECT g, h, median(v)::DOUBLE FROM x WHERE v IS NOT NULL GROUP BY g, h")
    beside(spark, holes, distribution(holed, ["g", "h"], "v").select("g", "h", "count", "total", "max", "median"),
           "SELECT g, h, count(v), sum(v), max(v), median(v)::DOUBLE FROM x GROUP BY g, h")
    beside(spark, holes, rank_by_value(holed, ["g", "h"], "v", "rk").select("t", "rk"), "SELECT t, rank() OVER (PARTITION BY g, h ORDER BY v NULLS FIRST) FROM x")


def test_null_safe_joins_stay_equi_joins(spark, holed):
    plan = with_group_position(holed, ["g", "h"], ["t"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_assets_without_a_key_keep_their_rows(spark):
    from tallyforge.ml.jobs import label_remaining_life

    cycles = spark.createDataFrame([(None, 1), (None, 2), (3, 1)], "asset_id int, current_age int")
    assert sorted((r.asset_id or 0, r.current_age, r.rul) for r in label_remaining_life(cycles).collect()) == [(0, 1, 2), (0, 2, 1), (3, 1, 1)]
