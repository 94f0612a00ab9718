"""Neighbourhoods in blocks with margins, and joins with neighbours that stay off the driver."""

import math
import random

import pyarrow as pa
import pytest

from cellgrove.operators import evaluation, morphology, segments
from cellgrove.operators.blocks import SIDES, in_blocks, union_marked
from cellgrove.operators.neighbours import with_neighbours

SCHEMA = "i int, r int, c int"


def around(n, seed):
    """Cells on both sides of the edges between blocks, some below 0."""
    rng = random.Random(seed)
    edge = lambda s: rng.choice([-s, 0, s]) + rng.randint(-3, 2)
    return sorted({tuple(edge(s) for s in SIDES) for _ in range(n)})


def moved(x, o):
    return tuple(a + b for a, b in zip(x, o))


def test_buffer_scores_across_blocks(spark):
    test, truth = around(900, 1), around(900, 2)
    best = [min((max(map(abs, d)), sum(x * x for x in d)) for b in truth for d in [tuple(p - q for p, q in zip(a, b))]) for a in test]
    out = evaluation.buffer_scores(spark.createDataFrame(test + test[:9], SCHEMA), spark.createDataFrame(truth, SCHEMA), 2, 0.05)
    for x in out.collect():
        hits = [s for ring, s in best if ring <= x["step"]]
        assert (x["completeness"], x["correctness"], x["accuracy"]) == pytest.approx((len(hits) / len(truth), len(hits) / len(test), sum(math.sqrt(s) * 0.05 for s in hits) / len(hits)))


def test_buffer_scores_without_cells(spark):
    some, none = spark.createDataFrame([(0, 0, 0)], SCHEMA), spark.createDataFrame([], SCHEMA)
    scores = lambda a, b: sorted(map(tuple, evaluation.buffer_scores(a, b, 1, 0.05).collect()))
    assert scores(some, none) == [(k, None, 0.0, None) for k in (0, 1)]
    assert scores(none, some) == [(k, 0.0, None, None) for k in (0, 1)]
    assert scores(none, none) == [(k, None, None, None) for k in (0, 1)]


@pytest.mark.parametrize("kernel", [morphology.ball(2), [(0, 0, 0), (0, 1, 2)]])
def test_closing_across_blocks(spark, kernel):
    within = around(1500, 3)
    seeds = [x for k, x in enumerate(within) if k % 3] + around(50, 4)
    near = {moved(x, o) for x in seeds for o in kernel} & set(within)
    lacking = set(within) - near
    expected = sorted(x for x in near if not any(tuple(a - b for a, b in zip(x, o)) in lacking for o in kernel))
    out = morphology.closed_within(spark.createDataFrame(seeds, SCHEMA), kernel, spark.createDataFrame(within, SCHEMA))
    assert out.dtypes == [(x, "int") for x in "irc"]
    assert sorted(map(tuple, out.collect())) == expected


def test_cells_travel_a_few_times(spark):
    rng = random.Random(5)
    grid = spark.createDataFrame([(rng.randint(0, 9), rng.randint(0, 500), rng.randint(0, 500)) for _ in range(5000)], SCHEMA)
    sent = in_blocks(union_marked(grid), 2, lambda block, at, marks: pa.table({"n": pa.array([len(at)])}), "n long").agg({"n": "sum"}).first()[0]
    assert 5000 < sent < 2 * 5000


def test_neighbours_are_not_sent_to_the_driver(spark):
    """Estimates leave out that a cell stands for each of its neighbours, so they may be far too small."""
    at = spark.range(200).selectExpr("CAST(id % 3 AS INT) AS i", "CAST(id % 7 AS INT) AS r", "CAST(id AS INT) AS c", "CAST(id % 5 AS INT) - 2 AS space_id")
    normals = at.selectExpr("i", "r", "c", "space_id + 3 AS normal")
    for df in (with_neighbours(at, at, 26), segments.adjacency(at), segments.border_votes(at, normals, "space_id"), morphology.closed_within(at, morphology.ball(2), at)):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" not in plan
