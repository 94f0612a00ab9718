"""Queries over whole tables against plain Python."""

import math
import random

import pytest

from cellgrove.operators import morphology
from cellgrove.operators.neighbours import offsets
from cellgrove.plans.whole import QUERIES


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    return [(rng.randint(1, 50), rng.randint(1, 300), rng.randint(1, 300), rng.randint(1, 7), rng.choice([0.0, 0.02, 0.05, 0.08]), rng.randint(1, 5000)) for _ in range(500)]


@pytest.fixture(scope="module")
def sf(spark, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(float(x[0]), *x[1:]) for x in rows], "l_quantity double, l_suppkey long, l_partkey long, l_linenumber int, l_tax double, l_orderkey long").write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame([(k, k % 25) for k in range(1, 200)], "s_suppkey long, s_nationkey int").write.parquet(f"{at}/supplier.parquet")
    return at


def cells(rows, odd=None):
    return {((q - 1) // 5, s // 20, p // 20) for q, s, p, n, *_ in rows if odd is None or n % 2 == odd}


def moved(x, o):
    return tuple(a + b for a, b in zip(x, o))


def number(x):
    return x[0] * 2**42 + x[1] * 2**21 + x[2]


def reached(found, near):
    """Each vertex with the least one linked to it."""
    out = {}
    for x in sorted(found):
        todo = [] if x in out else [x]
        while todo:
            y = todo.pop()
            if y not in out:
                out[y] = x
                todo += near(y)
    return out


def labels(found, k):
    return reached(found, lambda y: [z for o in offsets(k) if (z := moved(y, o)) in found])


@pytest.mark.parametrize("k", [4, 6, 8, 10, 18, 26])
def test_components(k, spark, sf, rows):
    got = {(x["i"], x["r"], x["c"]): x["label"] for x in QUERIES[f"whole_components_{k}"](spark, sf).collect()}
    assert got == {x: number(y) for x, y in labels(cells(rows), k).items()}


def test_buffer_scores(spark, sf, rows):
    test, truth = cells(rows, 1), cells(rows, 0)
    best = [min((max(map(abs, d)), sum(x * x for x in d)) for b in truth for d in [tuple(p - q for p, q in zip(a, b))]) for a in test]
    for x in QUERIES["whole_buffer_scores"](spark, sf).collect():
        hits = [s for ring, s in best if ring <= x["step"]]
        expected = (len(hits) / len(truth), len(hits) / len(test), sum(math.sqrt(s) * 0.05 for s in hits) / len(hits))
        assert (x["completeness"], x["correctness"], x["accuracy"]) == pytest.approx(expected, abs=2e-6)


def test_morphology(spark, sf, rows):
    every, seeds, ball = cells(rows), cells(rows, 1), morphology.ball(2)
    assert set(map(tuple, QUERIES["whole_dilated_disc"](spark, sf).collect())) == {moved(x, o) for x in every for o in morphology.disc(3)}
    near = {moved(x, o) for x in seeds for o in ball} & every
    assert set(map(tuple, QUERIES["whole_closed_ball"](spark, sf).collect())) == {x for x in near if not any(moved(x, o) in every - near for o in ball)}


def test_largest_parts(spark, sf, rows):
    at, parts = labels(cells(rows), 26), {}
    for x, y in at.items():
        parts.setdefault((x[1] // 10 * 2**21 + x[2] // 10, number(y)), []).append(x)
    most = {k: max(len(v) for (j, _), v in parts.items() if j == k) for k, _ in parts}
    expected = {(*x, k, y) for (k, y), v in parts.items() if len(v) == most[k] for x in v}
    assert set(map(tuple, QUERIES["whole_largest_parts"](spark, sf).collect())) == expected


def test_id_clusters(spark, sf):
    links = {}
    for k in range(1, 200):
        for a, b in ((k, k * 7 + k % 25), (k * 7 + k % 25, k)):
            links.setdefault(a, []).append(b)
    assert {x["source"]: x["target"] for x in QUERIES["whole_id_clusters"](spark, sf).collect()} == reached(links, links.get)


def slopes(normal, walls):
    floors, out = {x for x, n in normal.items() if n in (2, 4)}, {}
    for i, r, c in floors:
        found = [-1]
        for _, a, b in offsets(8):
            most = 1 if a and b else 2
            if not any((i, r + d * a, c + d * b) in walls for d in range(1, most + 1)):
                near = [abs(j - i) for j in range(i - 4, i + 5) if (j, r + most * a, c + most * b) in floors]
                found += [min(near)] if near else []
        out[i, r, c] = max(found)
    return out


def test_slopes_stop_at_walls(spark, sf, rows):
    least = {}
    for x in rows:
        at = ((x[0] - 1) // 5, x[1] // 20, x[2] // 20)
        least[at] = min(least.get(at, x[5]), x[5])
    normal = {x: k % 4 + 1 for x, k in least.items()}
    expected = slopes(normal, {x for x, n in normal.items() if n == 3})
    assert expected != slopes(normal, set())
    assert {(x["i"], x["r"], x["c"]): x["slope"] for x in QUERIES["whole_slopes"](spark, sf).collect()} == expected


@pytest.fixture(scope="module")
def dense_rows():
    rng = random.Random(11)
    return [(rng.randint(1, 10), rng.randint(1, 400), rng.randint(1, 400), rng.randint(1, 5000), *rng.choice(["AF", "NF", "NO", "RF", "AO", "RO"])) for _ in range(900)]


@pytest.fixture(scope="module")
def dense(spark, dense_rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("dense"))
    spark.createDataFrame([(float(x[0]), *x[1:]) for x in dense_rows], "l_quantity double, l_suppkey long, l_partkey long, l_orderkey long, l_returnflag string, l_linestatus string").write.parquet(f"{at}/lineitem.parquet")
    return at


def placed(rows):
    return [(((x[0] - 1) // 5, x[1] // 20, x[2] // 20), *x[3:]) for x in rows]


def block(x, side):
    return x[1] // side * 2**21 + x[2] // side + 1


def test_growth_goes_on_to_the_end(spark, dense, dense_rows):
    least, have, layers = {}, {}, 0
    for x, k, *_ in placed(dense_rows):
        least[x] = min(least.get(x, k), k)
    have = {x: -block(x, 10) for x, k in least.items() if k % 7 == 0}
    while new := {x: min(n) for x in least if x not in have and (n := [have[y] for o in offsets(4) if (y := moved(x, o)) in have])}:
        have, layers = have | new, layers + 1
    assert layers > 3
    assert {(x["i"], x["r"], x["c"]): x["label"] for x in QUERIES["whole_grown_layers"](spark, dense).collect()} == have


def test_ids_are_inherited_to_the_end(spark, dense, dense_rows):
    ids, kinds, grid, layers = {}, {}, set(), 0
    for x, k, flag, status in placed(dense_rows):
        room, cls = block(x, 5) if k % 13 == 0 else 0, ["AF", "NF", "NO", "RF", "AO", "RO"].index(flag + status)
        ids.setdefault(x, set()).add(room)
        kinds.setdefault(x, set()).add(cls)
        grid.add((*x, room, cls))
    one = {x: min(v) for x, v in ids.items() if len(v) == 1 and v != {0}}
    left = {x for x, v in ids.items() if v == {0} and (4 in kinds[x] or not kinds[x] & {0, 3})}
    taken = {}
    while new := {x: n for x in left if (n := {one[y] for o in offsets(4) if (y := moved(x, o)) in one})}:
        taken, left, layers = taken | new, left - set(new), layers + 1
        one |= {x: min(n) for x, n in new.items() if len(n) == 1}
    assert layers > 2
    expected = {g for g in grid if g[:3] not in taken} | {(*g[:3], n, {1: 5, 2: 4}.get(g[4], g[4])) for g in grid if g[:3] in taken for n in taken[g[:3]]}
    got = list(map(tuple, QUERIES["whole_inherited_ids"](spark, dense).collect()))
    assert set(got) == expected and len(got) == len(expected)
