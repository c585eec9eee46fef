import pytest

from runquarry.operators import grid as G


def test_last_name_varies_fastest_and_scalars_are_lists(spark):
    rows = G.combination_grid(spark, {"model": ["A", "B"], "dataset": [1, 2, 3], "seed": 42}).orderBy("position").collect()
    assert [tuple(r)[1:] for r in rows] == [("A", 1, 42), ("A", 2, 42), ("A", 3, 42), ("B", 1, 42), ("B", 2, 42), ("B", 3, 42)]


def test_long_lists_and_frames_give_the_same_grid(spark, monkeypatch):
    values = {"a": spark.createDataFrame([(v,) for v in "zyx"], "v string"), "b": list(range(5))}
    short = G.combination_grid(spark, values)
    want = sorted(tuple(r) for r in short.collect())
    assert want[0] == (0, "x", 0) and len(want) == 15
    monkeypatch.setattr(G, "_MAX_INLINE_VALUES", 2)
    assert sorted(tuple(r) for r in G.combination_grid(spark, values).collect()) == want


def test_empty_list_gives_no_combination(spark):
    assert G.combination_grid(spark, {"a": [1, 2], "b": []}).count() == 0


def test_grid_from_spec(spark):
    spec = spark.createDataFrame([("Model1,Model2", "0-1,2-3,4", "")], "models string, seeds string, unused string")
    rows = {(tuple(r["models"]), tuple(r["seeds"])) for r in G.grid_from_spec(spec, ["models", "seeds", "unused"]).collect()}
    assert rows == {((m,), s) for m in ("Model1", "Model2") for s in (("0", "1"), ("2", "3"), ("4",))}


def test_batches(spark):
    grid = G.combination_grid(spark, {"a": list(range(10))})
    rows = G.grid_batches(grid, batch_size=4, start=1, end=9, step=2).orderBy("position").collect()
    assert [(r["position"], r["batch"]) for r in rows] == [(1, 0), (3, 0), (5, 1), (7, 1), (9, 2)]


def test_missing_entries(spark):
    required = G.combination_grid(spark, {"m": ["a", "b"], "f": [0, 1]})
    df = spark.createDataFrame([("a", 0, None), ("a", 0, 1.0), ("b", 1, None), ("z", 9, 1.0)], "m string, f int, x double")
    # a present row counts whatever its other columns hold; repeated rows and rows outside the grid change nothing
    assert sorted(tuple(r) for r in G.missing_entries(df, ["m", "f"], required).collect()) == [("a", 1), ("b", 0)]


def test_common_combinations(spark):
    df = spark.createDataFrame([("m1", 1, "d"), ("m1", 2, "d"), ("m2", 1, "d"), ("m2", 1, "d"), (None, 5, "d")], "m string, f int, d string")
    assert [tuple(r) for r in G.common_combinations(df, "m", ["f", "d"]).collect()] == [(1, "d")]
    assert G.common_combinations(df.where("m = 'm1'"), "m", ["f"]).count() == 2  # a single value: all are common
    assert G.common_combinations(df.where("f > 1 OR m = 'm2'"), "m", ["f"]).count() == 0


def test_filter_combinations_keeps_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "x int, y string")
    keep = spark.createDataFrame([(1, "a"), (1, "a")], "x int, y string")
    assert G.filter_combinations(df, ["x", "y"], keep).count() == 2


def test_status_tally(spark):
    df = spark.createDataFrame([(True,), (True,), (False,), (None,)], "finished boolean")
    assert tuple(G.status_tally(df).first()) == (4, 2, 1, 1)


@pytest.mark.parametrize("sizes", [(3, 4), (1, 1), (7, 1)])
def test_positions_are_complete(spark, sizes):
    grid = G.combination_grid(spark, {"a": list(range(sizes[0])), "b": list(range(sizes[1]))})
    assert sorted(r["position"] for r in grid.collect()) == list(range(sizes[0] * sizes[1]))
