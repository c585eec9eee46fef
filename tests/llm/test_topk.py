"""Top-k search in groups of blocks: nothing goes through the driver, and results do not depend on how rows are grouped."""

import random

import numpy as np
import pytest

from runquarry.llm import topk


def brute(rows, asked, k):
    want = []
    for q, t in asked:
        order = sorted((-sum(a * b for a, b in zip(t, u)), i) for i, u in rows if i != q)[:k]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(order)]
    return sorted(want)


def test_copies_of_blocks_are_not_broadcast(spark):
    """The planner takes the files' compressed size for that of all copies, so copies of queries once went to the driver."""
    df = spark.createDataFrame([(i, [i % 3, 1, -i]) for i in range(400)], "vec_id bigint, terms array<bigint>")
    best = topk.top_k(df, df.where("vec_id % 20 = 0"), "vec_id", "terms", 5, candidate_rows=20, query_rows=2)
    assert "Broadcast" not in best._jdf.queryExecution().executedPlan().toString()
    assert best.count() == 20 * 5


@pytest.mark.parametrize("largest", [1, 30, 2000, 10**6, 2**30])
def test_widths_lengths_and_ties(spark, monkeypatch, largest):
    """Terms of every width, blocks whose sums have different widths, ties across blocks, and several groups on either side."""
    monkeypatch.setattr(topk, "GROUP_BEST", 40)
    monkeypatch.setattr(topk, "GROUP_BLOCKS", 2)
    monkeypatch.setattr(topk, "MAX_TASKS", 5)
    rng = random.Random(largest)
    rows = [(i * 7919 % 1009 - 300, [rng.choice((0, 0, 1, -1, 2)) for _ in range(rng.randrange(6))]) for i in range(200)]
    rows += [(2000 + i, [rng.randrange(-largest, largest + 1) for _ in range(5)]) for i in range(3)] + [(3000, [0] * 9), (3020, [])]
    asked = [r for r in rows if r[0] % 20 == 0] + [rows[201]]
    df, queries = (spark.createDataFrame(x, "vec_id bigint, terms array<bigint>") for x in (rows, asked))
    for candidate_rows in (30, 4):
        got = topk.top_k(df, queries, "vec_id", "terms", 6, candidate_rows=candidate_rows, query_rows=3).collect()
        assert sorted(tuple(r) for r in got) == brute(rows, asked, 6)
    few = topk.top_k(df.where("vec_id >= 2000"), queries, "vec_id", "terms", 6, candidate_rows=1).collect()
    assert sorted(tuple(r) for r in few) == brute(rows[200:], asked, 6)


def test_best_of_narrow_after_wide_sums():
    """A block with 16-bit sums after one with larger best scores takes no place; an equal score with a smaller id does."""
    asked = topk.Asked(np.array([1]), np.array([1, 1]), np.array([2]), 2)
    asked.add(np.array([[70000, 5, 60000]], dtype=np.int32), np.array([10, 11, 12]))
    asked.add(np.array([[32767, 5]], dtype=np.int16), np.array([3, 4]))
    assert [x.tolist() for x in asked.found] == [[0, 0], [10, 12], [70000, 60000]]
    asked.add(np.array([[99, 60000, 60000]], dtype=np.int32), np.array([1, 2, 20]))  # the first is the query itself
    assert [x.tolist() for x in asked.found] == [[0, 0], [10, 2], [70000, 60000]]
