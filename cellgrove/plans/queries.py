"""Queries over the derived grids, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrove.functions import scalars, state
from cellgrove.operators import columns, components, evaluation, morphology, neighbours, normals, rays, reconstruct, segments, voxelize
from cellgrove.plans import derived as d

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
CELL = neighbours.CELL
_RES = 0.05
_BOX = f"SELECT min(x) - {_RES} AS ox, min(y) - {_RES} AS oy, min(z) - {_RES} AS oz FROM {d.sql_points()}"


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# ---- points, boxes, meshes


@query(f"WITH b AS ({_BOX}) SELECT DISTINCT CAST(trunc((y - oy) / {_RES}) AS INTEGER) AS i, CAST(trunc((x - ox) / {_RES}) AS INTEGER) AS r, CAST(trunc((z - oz) / {_RES}) AS INTEGER) AS c FROM {d.sql_points()} p, b")
def occupied_cells(spark, sf):
    p = d.points(spark, sf)
    return voxelize.occupied(p, voxelize.grid_of(voxelize.bounds(p), _RES), _RES)


@query(f"WITH b AS ({_BOX}) SELECT CAST(trunc((y - oy) / {_RES}) AS INTEGER) AS i, count(DISTINCT (trunc((x - ox) / {_RES}), trunc((z - oz) / {_RES}))) AS cells, count(*) AS points FROM {d.sql_points()} p, b GROUP BY 1")
def cells_per_height(spark, sf):
    p = d.points(spark, sf)
    at = voxelize.point_cells(p, voxelize.grid_of(voxelize.bounds(p), _RES), _RES)
    per_cell = at.groupBy(*CELL).agg(F.count("*").alias("n"))
    return per_cell.groupBy("i").agg(F.count("*").alias("cells"), F.sum("n").alias("points"))


@query(f"""SELECT {', '.join(f"round({f}({a}), 6) AS {n}_{a}" for a in 'xyz' for f, n in (('min', 'min'), ('max', 'max'), ('avg', 'mean')))},
  CAST(ceil((max(y) + {_RES} - (min(y) - {_RES})) / {_RES}) AS INTEGER) AS ni, CAST(ceil((max(x) + {_RES} - (min(x) - {_RES})) / {_RES}) AS INTEGER) AS nr, CAST(ceil((max(z) + {_RES} - (min(z) - {_RES})) / {_RES}) AS INTEGER) AS nc FROM {d.sql_points()}""")
def grid_extent(spark, sf):
    box = voxelize.bounds(d.points(spark, sf))
    out = box.crossJoin(F.broadcast(voxelize.grid_of(box, _RES).select("ni", "nr", "nc")))
    return _rounded(out, *[f"{n}_{a}" for a in "xyz" for n in ("min", "max", "mean")])


@query(f"WITH p AS (SELECT * FROM {d.sql_points()}), m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM p) SELECT id, round(x, 6) AS x, round(my - (z - mz), 6) AS y, round(mz + (y - my), 6) AS z FROM p, m")
def rotated_points(spark, sf):
    p = d.points(spark, sf)
    return _rounded(voxelize.rotated(p, 90.0, (1.0, 0.0, 0.0), voxelize.bounds(p)), "x", "y", "z")


_TRI = 0.1


def _mesh_sql() -> str:
    moved = {f"{a}{k}": f"({a}{k} - (o{a} + {i} * {_TRI}))" for a, i in (("y", "i"), ("x", "r"), ("z", "c")) for k in "123"}
    cells = ", ".join(f"unnest(range(CAST(floor((least({a}1, {a}2, {a}3) - o{a}) / {_TRI}) AS INTEGER), CAST(ceil((greatest({a}1, {a}2, {a}3) - o{a}) / {_TRI}) AS INTEGER) + 1)) AS {n}" for n, a in (("i", "y"),))
    rest = {n: f"unnest(range(CAST(floor((least({a}1, {a}2, {a}3) - o{a}) / {_TRI}) AS INTEGER), CAST(ceil((greatest({a}1, {a}2, {a}3) - o{a}) / {_TRI}) AS INTEGER) + 1)) AS {n}" for n, a in (("r", "x"), ("c", "z"))}
    axes = " AND ".join(f"({x})" for x in voxelize.triangle_axes())
    n = voxelize.normal_sql()
    return f"""WITH t AS (SELECT * FROM {d.sql_triangles()}), b AS (SELECT {', '.join(f'min(least({a}1, {a}2, {a}3)) - {_TRI} AS o{a}' for a in 'xyz')} FROM t),
      t1 AS (SELECT t.*, b.*, {cells} FROM t, b), t2 AS (SELECT *, {rest['r']} FROM t1), t3 AS (SELECT *, {rest['c']} FROM t2),
      m AS (SELECT id, i, r, c, {', '.join(f'{e} AS {k}' for k, e in moved.items())}, {_TRI / 2} AS h FROM t3),
      hit AS (SELECT id, CAST(i AS INTEGER) AS i, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, ({n[1]}) AS ny, sqrt(({n[0]}) * ({n[0]}) + ({n[1]}) * ({n[1]}) + ({n[2]}) * ({n[2]})) AS len FROM m WHERE {axes}),
      k AS (SELECT i, r, c, CASE WHEN -ny / len > 0.5000000000000001 THEN 1 WHEN ny / len > 0.7071067811865476 THEN 2 ELSE 3 END AS d FROM hit),
      n AS (SELECT i, r, c, count(*) FILTER (d = 1) AS dn, count(*) FILTER (d = 2) AS up, count(*) FILTER (d = 3) AS side FROM k GROUP BY i, r, c)"""


def _triangle_grid(t: DataFrame) -> DataFrame:
    flat = t.select(F.explode(F.array(*[F.struct(*[F.col(f"{a}{k}").alias(a) for a in "xyz"]) for k in "123"])).alias("p")).select("p.*")
    return voxelize.grid_of(voxelize.bounds(flat), _TRI)


@query(_mesh_sql() + " SELECT i, r, c, CASE WHEN side >= dn AND side >= up THEN 3 WHEN 10 * dn >= 3 * (dn + up + side) AND 10 * up >= 3 * (dn + up + side) THEN 4 WHEN dn >= up THEN 1 ELSE 2 END AS normal FROM n")
def mesh_normal_grid(spark, sf):
    t = d.triangles(spark, sf)
    return voxelize.mesh_normals(t, _triangle_grid(t), _TRI)


@query(_mesh_sql() + " SELECT id, count(*) AS cells FROM hit GROUP BY id")
def triangle_cell_counts(spark, sf):
    t = d.triangles(spark, sf)
    return voxelize.triangle_cells(t, _triangle_grid(t), _TRI).groupBy("id").agg(F.count("*").alias("cells"))


@query("SELECT p_partkey, CAST(ceil(p_retailprice / 0.07) AS INTEGER) AS voxels, CAST(ceil(p_size / (0.07 * 0.07)) AS INTEGER) AS area, round_even(p_retailprice, 0) AS even, round(sqrt(2.0) * least(abs(p_partkey % 20 - p_size), abs(p_partkey % 7 - 3)) + abs(abs(p_partkey % 20 - p_size) - abs(p_partkey % 7 - 3)), 6) AS octile, abs(p_partkey % 3 - 1) + abs(p_partkey % 2) = 2 AS diagonal FROM part")
def scalar_functions(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    k = F.col("p_partkey")
    return p.select(
        k,
        scalars.in_voxels(F.col("p_retailprice"), 0.07).alias("voxels"),
        scalars.area_in_voxels(F.col("p_size"), 0.07).alias("area"),
        scalars.half_even(F.col("p_retailprice")).alias("even"),
        F.round(scalars.octile(k % 20, k % 7, F.col("p_size"), F.lit(3)), 6).alias("octile"),
        scalars.is_diagonal(k % 3 - 1, k % 2).alias("diagonal"),
    )


@query(f"WITH p AS (SELECT * FROM {d.sql_points()}) SELECT id, x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.1 AND 0.1 AND z BETWEEN -0.2 AND 0.05 AS inside, round(sqrt(pow(greatest(-0.1 - x, x - 0.1, 0), 2) + pow(greatest(-0.1 - y, y - 0.1, 0), 2) + pow(greatest(-0.2 - z, z - 0.05, 0), 2)), 6) AS distance FROM p")
def box_tests(spark, sf):
    p = d.points(spark, sf)
    lo, hi, at = [F.lit(-0.1), F.lit(-0.1), F.lit(-0.2)], [F.lit(0.1), F.lit(0.1), F.lit(0.05)], [F.col(a) for a in "xyz"]
    return p.select("id", scalars.box_contains(lo, hi, at).alias("inside"), F.round(scalars.box_distance(lo, hi, at), 6).alias("distance"))


# ---- voxel states


def _states(spark, sf):
    rooms = d.grid(spark, sf).groupBy(*CELL, "room_id").agg(F.array_sort(F.collect_set("cls")).alias("classes"))
    return rooms.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("room_id", "classes"))).alias("s"))


def _text(s):
    return F.coalesce(F.array_join(F.array_sort(F.transform(s, lambda x: F.concat(x["room_id"].cast("string"), F.lit(":"), F.array_join(F.array_sort(F.transform(x["classes"], lambda y: y.cast("string"))), "+")))), ","), F.lit("none"))




def _state_sql(rows: str, part: int = d.ALL) -> str:
    return f"""WITH g AS (SELECT * FROM {d.sql_grid(part)}), cells AS (SELECT DISTINCT i, r, c FROM g), x AS ({rows}),
      rooms AS (SELECT i, r, c, room_id, string_agg(DISTINCT CAST(cls AS VARCHAR), '+' ORDER BY CAST(cls AS VARCHAR)) AS cl FROM x GROUP BY i, r, c, room_id),
      t AS (SELECT i, r, c, string_agg(room_id || ':' || cl, ',' ORDER BY room_id || ':' || cl) AS state FROM rooms GROUP BY i, r, c)
      SELECT cells.i, cells.r, cells.c, coalesce(t.state, 'none') AS state FROM cells LEFT JOIN t ON cells.i = t.i AND cells.r = t.r AND cells.c = t.c"""


@query(f"""WITH g AS (SELECT * FROM {d.sql_grid()}) SELECT i, r, c, CAST(count(DISTINCT room_id) AS INTEGER) AS rooms, max(CASE WHEN room_id = 3 THEN 1 ELSE 0 END) = 1 AS has_3, max(CASE WHEN room_id <> 3 THEN 1 ELSE 0 END) = 1 AS has_other, CAST(count(DISTINCT cls) AS INTEGER) AS classes, CAST(count(DISTINCT CASE WHEN room_id = 3 THEN cls END) AS INTEGER) AS classes_of_3 FROM g GROUP BY i, r, c""")
def state_predicates(spark, sf):
    s = F.col("s")
    return _states(spark, sf).select(
        *CELL,
        state.room_count(s).alias("rooms"),
        state.has_room(s, 3).alias("has_3"),
        state.has_other_rooms(s, 3).alias("has_other"),
        F.size(state.all_classes(s)).alias("classes"),
        F.size(state.classes_of(s, 3)).alias("classes_of_3"),
    )


@query(_state_sql("SELECT * FROM g UNION SELECT i, r, c, 3, 4 FROM cells"))
def state_add_room(spark, sf):
    return _states(spark, sf).select(*CELL, _text(state.add_room(F.col("s"), 3, F.array(F.lit(4)))).alias("state"))


@query(_state_sql("SELECT * FROM g WHERE room_id <> 3"))
def state_remove_room(spark, sf):
    return _states(spark, sf).select(*CELL, _text(state.remove_room(F.col("s"), 3)).alias("state"))


@query(_state_sql("SELECT * FROM g WHERE NOT (room_id = 3 AND cls = 0)"))
def state_remove_class(spark, sf):
    return _states(spark, sf).select(*CELL, _text(state.remove_class(F.col("s"), 3, 0)).alias("state"))


@query(_state_sql("SELECT * FROM g WHERE room_id <> 3 UNION SELECT i, r, c, 3, 5 FROM cells"))
def state_change_classes(spark, sf):
    return _states(spark, sf).select(*CELL, _text(state.change_classes(F.col("s"), 3, F.array(F.lit(5)))).alias("state"))


@query(_state_sql(f"SELECT * FROM g UNION SELECT * FROM {d.sql_grid(d.EVEN)} WHERE (i, r, c) IN (SELECT (i, r, c) FROM cells)", d.ODD))
def state_merge(spark, sf):
    both = d.grid(spark, sf, d.ODD).union(d.grid(spark, sf, d.EVEN).join(d.cells(spark, sf, d.ODD), CELL, "left_semi"))
    rooms = both.groupBy(*CELL, "room_id").agg(F.collect_set("cls").alias("classes"))
    return rooms.groupBy(*CELL).agg(F.collect_list(F.struct("room_id", "classes")).alias("s")).select(*CELL, _text(F.col("s")).alias("state"))


@query(f"""WITH g AS (SELECT * FROM {d.sql_grid()}), x AS (SELECT i, r, c, max(CASE WHEN cls = 0 THEN 1 ELSE 0 END) = 1 AS k0, max(CASE WHEN cls = 1 THEN 1 ELSE 0 END) = 1 AS k1, max(CASE WHEN cls = 2 THEN 1 ELSE 0 END) = 1 AS k2, max(CASE WHEN cls = 3 THEN 1 ELSE 0 END) = 1 AS k3, max(CASE WHEN cls = 4 THEN 1 ELSE 0 END) = 1 AS k4, max(CASE WHEN cls = 5 THEN 1 ELSE 0 END) = 1 AS k5 FROM g GROUP BY i, r, c)
  SELECT i, r, c, CASE WHEN k3 AND k0 THEN 6 WHEN k3 AND k4 THEN 7 WHEN k0 AND k4 THEN 8 WHEN k4 THEN 4 WHEN k3 THEN 3 WHEN k0 THEN 0 WHEN k2 THEN 2 WHEN k5 THEN 5 WHEN k1 THEN 1 ELSE -1 END AS shown FROM x""")
def shown_classes(spark, sf):
    return _states(spark, sf).select(*CELL, state.shown_class(state.all_classes(F.col("s"))).alias("shown"))


# ---- evaluation


_G1, _GA, _GB = d.sql_grid(), d.sql_grid(d.ODD), d.sql_grid(d.EVEN)
_MAP = f"""m AS (SELECT a.room_id AS from_id, b.room_id AS to_id, count(*) AS weight FROM (SELECT DISTINCT i, r, c, room_id FROM {_GA}) a JOIN (SELECT DISTINCT i, r, c, room_id FROM {_GB}) b USING (i, r, c) GROUP BY 1, 2)"""
_MUTUAL = f"""{_MAP}, f AS (SELECT from_id, to_id, weight, count(*) OVER (PARTITION BY from_id) AS n FROM (SELECT *, max(weight) OVER (PARTITION BY from_id) AS w FROM m) WHERE weight = w),
  t AS (SELECT from_id, to_id, count(*) OVER (PARTITION BY to_id) AS n FROM (SELECT *, max(weight) OVER (PARTITION BY to_id) AS w FROM m) WHERE weight = w),
  mutual AS (SELECT f.from_id, f.to_id, f.weight FROM f JOIN t USING (from_id, to_id) WHERE f.n = 1 AND t.n = 1)"""


def _mutual(spark, sf):
    a, b = d.grid(spark, sf, d.ODD), d.grid(spark, sf, d.EVEN)
    return a, b, evaluation.mutual_mapping(evaluation.weighted_mapping(a, b))


@query(f"WITH {_MAP} SELECT * FROM m")
def weighted_room_mapping(spark, sf):
    return evaluation.weighted_mapping(d.grid(spark, sf, d.ODD), d.grid(spark, sf, d.EVEN))


@query(f"WITH {_MUTUAL} SELECT * FROM mutual")
def mutual_room_mapping(spark, sf):
    return _mutual(spark, sf)[2]


def _lone_sql(grid: str, key: str) -> str:
    return f"(SELECT count(*) FROM (SELECT DISTINCT i, r, c, room_id FROM {grid}) x WHERE NOT EXISTS (SELECT 1 FROM mutual m WHERE m.{key} = x.room_id))"


@query(f"""WITH {_MUTUAL}, x AS (SELECT (SELECT count(DISTINCT (i, r, c)) FROM {_GA}) AS test_cells, {_lone_sql(_GA, 'from_id')} AS test_errors, (SELECT count(DISTINCT (i, r, c)) FROM {_GB}) AS truth_cells, {_lone_sql(_GB, 'to_id')} AS truth_errors)
  SELECT *, round(greatest(test_errors * 100.0 / test_cells, truth_errors * 100.0 / truth_cells), 6) AS error FROM x""")
def room_mapping_error(spark, sf):
    return _rounded(evaluation.mapping_error(*_mutual(spark, sf)), "error")


@query(f"""WITH {_MUTUAL}, a AS (SELECT DISTINCT g.i, g.r, g.c, g.room_id AS from_id, m.to_id FROM {_GA} g JOIN mutual m ON g.room_id = m.from_id),
  b AS (SELECT DISTINCT g.i, g.r, g.c, g.room_id AS to_id FROM {_GB} g JOIN mutual m ON g.room_id = m.to_id),
  x AS (SELECT (SELECT count(*) FROM a) AS tested, (SELECT count(*) FROM b) AS "true", (SELECT count(*) FROM a JOIN b USING (i, r, c, to_id)) AS hits)
  SELECT tested, "true", hits, round(hits * 100.0 / tested, 6) AS precision, round(hits * 100.0 / "true", 6) AS recall, round(2 * (hits * 100.0 / tested) * (hits * 100.0 / "true") / (hits * 100.0 / tested + hits * 100.0 / "true"), 6) AS f1 FROM x""")
def room_scores(spark, sf):
    return _rounded(evaluation.room_scores(*_mutual(spark, sf)), "precision", "recall", "f1")


_NEAR6 = d.sql_offsets([(0, 0, 0), *neighbours.offsets(6)])


def _share(hits: str, n: str) -> str:
    return f"coalesce(coalesce({hits}, 0) * 100.0 / {n}, 0.0)"


def _f1_sql(p: str, r: str) -> str:
    return f"round(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END, 6)"


def _found_sql(x: str, y: str) -> str:
    return f"SELECT cls, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM {y} y WHERE y.i = x.i AND y.r = x.r AND y.c = x.c AND y.cls = x.cls)) AS hits, count(*) FILTER (EXISTS (SELECT 1 FROM {y} y, {_NEAR6} WHERE y.i = x.i + di AND y.r = x.r + dr AND y.c = x.c + dc AND y.cls = x.cls)) AS near FROM {x} x GROUP BY cls"


@query(f"""WITH a AS (SELECT DISTINCT i, r, c, cls FROM {_GA}), b AS (SELECT DISTINCT i, r, c, cls FROM {_GB}), p AS ({_found_sql('a', 'b')}), q AS ({_found_sql('b', 'a')}),
  s AS (SELECT p.cls, {_share('p.hits', 'p.n')} AS pr, {_share('q.hits', 'q.n')} AS re, {_share('p.near', 'p.n')} AS np, {_share('q.near', 'q.n')} AS nr FROM p LEFT JOIN q USING (cls))
  SELECT cls, round(pr, 6) AS precision, round(re, 6) AS recall, {_f1_sql('pr', 're')} AS f1, round(np, 6) AS near_precision, round(nr, 6) AS near_recall, {_f1_sql('np', 'nr')} AS near_f1 FROM s""")
def class_scores(spark, sf):
    out = evaluation.class_scores(d.grid(spark, sf, d.ODD), d.grid(spark, sf, d.EVEN))
    return _rounded(out, "precision", "recall", "f1", "near_precision", "near_recall", "near_f1")


@query(f"""WITH x AS (SELECT a.normal AS a, b.normal AS b FROM {d.sql_normals(d.ODD)} a FULL JOIN {d.sql_normals(d.EVEN)} b USING (i, r, c)),
  y AS (SELECT CAST(sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS BIGINT) AS hits, CAST(sum(CASE WHEN a IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS tested, CAST(sum(CASE WHEN b IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS "true" FROM x)
  SELECT *, round(hits * 100.0 / tested, 6) AS precision, round(hits * 100.0 / "true", 6) AS recall FROM y""")
def normal_scores(spark, sf):
    return _rounded(evaluation.normal_scores(d.normals(spark, sf, d.ODD), d.normals(spark, sf, d.EVEN)), "precision", "recall")


@query(f"""WITH a AS (SELECT * FROM {d.sql_cells(d.ODD)}), b AS (SELECT * FROM {d.sql_cells(d.EVEN)}),
  n AS (SELECT a.i, a.r, a.c, min([greatest(abs(b.i - a.i), abs(b.r - a.r), abs(b.c - a.c)), (b.i - a.i) * (b.i - a.i) + (b.r - a.r) * (b.r - a.r) + (b.c - a.c) * (b.c - a.c)]) AS m FROM a, (SELECT * FROM (SELECT unnest(range(-2, 3)) AS di), (SELECT unnest(range(-2, 3)) AS dr), (SELECT unnest(range(-2, 3)) AS dc)) o, b WHERE b.i = a.i + di AND b.r = a.r + dr AND b.c = a.c + dc GROUP BY 1, 2, 3),
  s AS (SELECT CAST(unnest(range(3)) AS INTEGER) AS step)
  SELECT step, round(count(m) / (SELECT CAST(count(*) AS DOUBLE) FROM b), 6) AS completeness, round(count(m) / (SELECT CAST(count(*) AS DOUBLE) FROM a), 6) AS correctness, round(sum(sqrt(m[2]) * 0.05) / count(m), 6) AS accuracy FROM s LEFT JOIN n ON n.m[1] <= step GROUP BY step""")
def buffer_scores(spark, sf):
    out = evaluation.buffer_scores(d.cells(spark, sf, d.ODD), d.cells(spark, sf, d.EVEN), 2, 0.05)
    return _rounded(out, "completeness", "correctness", "accuracy")


@query(f"SELECT cls, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM (SELECT DISTINCT i, r, c, cls FROM {_G1}) GROUP BY cls")
def class_distribution(spark, sf):
    return _rounded(evaluation.class_distribution(d.grid(spark, sf)), "percent")


@query(f"SELECT space_id, CASE WHEN space_id < 0 THEN 'T' ELSE 'R' END || CAST(abs(space_id) AS VARCHAR) || CASE WHEN space_id % 3 = 0 THEN 'R' ELSE '' END AS label, count(*) AS cells FROM {d.sql_spaces()} GROUP BY space_id")
def room_labels(spark, sf):
    n = d.spaces(spark, sf).groupBy("space_id").agg(F.count("*").alias("cells"))
    return n.select("space_id", evaluation.room_label(F.col("space_id"), F.col("space_id") % 3 == 0).alias("label"), "cells")


# ---- neighbourhoods, components, columns


for _k in (4, 6, 8, 10, 18, 26):

    def _components(spark, sf, k=_k):
        return components.label_components(d.cells(spark, sf), k).select(*CELL, "label")

    _components.__name__ = f"components_{_k}"
    query(f"WITH RECURSIVE {d.sql_labels(d.sql_cells(), neighbours.offsets(_k))} SELECT i, r, c, label FROM labelled")(_components)


@query(f"SELECT a.i, a.r, a.c, count(b.i) AS n FROM (SELECT x.i, x.r, x.c, di, dr, dc FROM {d.sql_cells()} x, {d.sql_offsets(neighbours.offsets(26))}) a LEFT JOIN {d.sql_cells()} b ON b.i = a.i + di AND b.r = a.r + dr AND b.c = a.c + dc GROUP BY 1, 2, 3")
def neighbour_counts(spark, sf):
    v = d.cells(spark, sf)
    return neighbours.neighbour_count(v, v, 26)


@query(f"""WITH v AS (SELECT DISTINCT i, r, c, room_id FROM {_G1}), b AS (SELECT min(i) AS i0, max(i) AS i1, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM v)
  SELECT v.i, v.r, v.c, v.room_id FROM v, b WHERE (SELECT count(*) FROM v w, {d.sql_offsets(neighbours.offsets(6))} WHERE w.i = v.i + di AND w.r = v.r + dr AND w.c = v.c + dc AND w.room_id = v.room_id)
  < CAST(v.i > i0 AS INTEGER) + CAST(v.i < i1 AS INTEGER) + CAST(v.r > r0 AS INTEGER) + CAST(v.r < r1 AS INTEGER) + CAST(v.c > c0 AS INTEGER) + CAST(v.c < c1 AS INTEGER)""")
def surface_cells(spark, sf):
    return neighbours.surface(d.grid(spark, sf))


_RUNS = "g AS (SELECT i, r, c, i - row_number() OVER (PARTITION BY r, c ORDER BY i) AS g FROM {v}), runs AS (SELECT r, c, min(i) AS top, max(i) AS bottom, count(*) AS height FROM g GROUP BY r, c, g)"


@query(f"WITH {_RUNS.format(v=d.sql_cells())} SELECT * FROM runs")
def vertical_runs(spark, sf):
    return columns.runs(d.cells(spark, sf))


@query(f"WITH {_RUNS.format(v=d.sql_cells())}, n AS (SELECT *, CASE WHEN top - lag(bottom) OVER (PARTITION BY r, c ORDER BY top) > 2 THEN 1 ELSE 0 END AS new FROM runs), k AS (SELECT *, sum(new) OVER (PARTITION BY r, c ORDER BY top) AS k FROM n) SELECT r, c, min(top) AS top, max(bottom) AS bottom, CAST(sum(height) AS BIGINT) AS filled FROM k GROUP BY r, c, k")
def bridged_runs(spark, sf):
    return columns.merged_runs(d.cells(spark, sf), 1)


@query(f"WITH {_RUNS.format(v=d.sql_cells())} SELECT v.i, v.r, v.c FROM {d.sql_cells()} v JOIN runs u ON v.r = u.r AND v.c = u.c AND v.i BETWEEN top AND bottom WHERE height >= 3")
def cells_in_tall_runs(spark, sf):
    return columns.in_runs(d.cells(spark, sf), F.col("height") >= 3)


@query(f"WITH {_RUNS.format(v=d.sql_cells())}, m AS (SELECT * FROM {d.sql_normals()} WHERE normal = 3) SELECT v.i, v.r, v.c FROM {d.sql_cells()} v JOIN runs u ON v.r = u.r AND v.c = u.c AND v.i BETWEEN top AND bottom WHERE EXISTS (SELECT 1 FROM m WHERE m.r = u.r AND m.c = u.c AND m.i BETWEEN top AND bottom)")
def grown_horizontal(spark, sf):
    return columns.grown_vertically(d.normals(spark, sf).where("normal = 3"), d.cells(spark, sf))


@query(f"WITH {_RUNS.format(v=d.sql_cells())} SELECT *, lag(bottom) OVER (PARTITION BY r, c ORDER BY top) AS above FROM runs")
def surfaces_above(spark, sf):
    return columns.surface_above(d.cells(spark, sf))


def _pillar_sql() -> str:
    """The scan itself: each step handles one height of all columns, with the column as a string of normals ('.' is empty)."""
    runs = {k: f"length(regexp_extract(substr(s, i + 1), '^{k}+'))" for k in "124"}
    flat = "list_contains(flat, {0})"
    # step i sees the string s; runs start at i; cells from 1-based position i + 1
    turned = "list_transform(range(0, {n}), lambda k: CASE WHEN list_contains(flat, i + k) THEN substr(s, i + k + 1, 1) ELSE '3' END)"
    head = "substr(s, 1, i)"
    tail = "substr(s, i + {n} + 1)"
    up = f"{head} || substr(s, i + 1, 1) || array_to_string(list_slice({turned.format(n='n2')}, 2, n2), '') || {tail.format(n='n2')}"
    down = f"{head} || array_to_string({turned.format(n='n1')}, '') || {tail.format(n='n1')}"
    both = f"{head} || '2' || array_to_string(list_slice({turned.format(n='n4')}, 2, n4 - 1), '') || '1' || {tail.format(n='n4')}"
    return f"""WITH RECURSIVE n AS (SELECT * FROM {d.sql_normals()}),
      f AS (SELECT n.i, n.r, n.c FROM n, {d.sql_offsets(neighbours.offsets(4))}, n o WHERE o.i = n.i AND o.r = n.r + dr AND o.c = n.c + dc GROUP BY 1, 2, 3 HAVING count(*) = 4),
      col AS (SELECT r, c, array_to_string(list_transform(range(0, {d.LAYERS}), lambda k: coalesce(map_extract(map_from_entries(list((i, CAST(normal AS VARCHAR)))), CAST(k AS INTEGER))[1], '.')), '') AS s FROM n GROUP BY r, c),
      fl AS (SELECT r, c, list(i) AS flat FROM f GROUP BY r, c),
      scan(i, r, c, s, flat) AS (SELECT 0, col.r, col.c, s, coalesce(flat, []) FROM col LEFT JOIN fl ON fl.r = col.r AND fl.c = col.c
        UNION ALL SELECT i + 1, r, c, CASE WHEN n1 > 2 THEN {down} WHEN n2 > 1 THEN {up} WHEN n4 > 1 THEN {both} ELSE s END, flat
        FROM (SELECT *, {runs['1']} AS n1, {runs['2']} AS n2, {runs['4']} AS n4 FROM scan WHERE i < {d.LAYERS}))
      SELECT n.i, n.r, n.c, CAST(substr(s, n.i + 1, 1) AS INTEGER) AS normal FROM n JOIN scan ON scan.r = n.r AND scan.c = n.c WHERE scan.i = {d.LAYERS}"""


@query(_pillar_sql())
def pillars_turned(spark, sf):
    return columns.pillars(d.normals(spark, sf))


@query(f"""WITH n AS (SELECT * FROM {d.sql_normals()}) SELECT n.i, n.r, n.c, CASE WHEN n.normal = 2 AND NOT EXISTS (SELECT 1 FROM n o, {d.sql_offsets(neighbours.offsets(4))} WHERE o.i = n.i AND o.r = n.r + dr AND o.c = n.c + dc AND o.normal = 2) THEN 3 ELSE n.normal END AS normal FROM n""")
def isolated_turned(spark, sf):
    return normals.without_isolated(d.normals(spark, sf))


@query(f"SELECT i, r, c, normal, max(CASE WHEN normal = 1 THEN i END) OVER (PARTITION BY r, c ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above, min(CASE WHEN normal = 1 THEN i END) OVER (PARTITION BY r, c ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS below FROM {d.sql_normals()}")
def next_in_column(spark, sf):
    return reconstruct.lookaround(d.normals(spark, sf), F.col("normal") == 1)


@query(f"""WITH s AS (SELECT i, r, c, space_id FROM {d.sql_spaces()}), {_RUNS.format(v='s')}, n AS (SELECT u.r, u.c, u.top, u.bottom, s.space_id, count(*) AS n FROM runs u JOIN s ON s.r = u.r AND s.c = u.c AND s.i BETWEEN top AND bottom GROUP BY ALL),
  b AS (SELECT *, row_number() OVER (PARTITION BY r, c, top ORDER BY n DESC, space_id) AS k FROM n) SELECT s.i, s.r, s.c, b.space_id FROM s JOIN b ON s.r = b.r AND s.c = b.c AND s.i BETWEEN top AND bottom WHERE k = 1""")
def column_majority(spark, sf):
    return columns.majority_per_run(d.spaces(spark, sf), "space_id")


@query(f"SELECT i, count(*) AS n FROM {d.sql_normals()} WHERE normal IN (2, 4) GROUP BY i")
def floor_incidence(spark, sf):
    return reconstruct.floor_incidence(d.normals(spark, sf))


# ---- morphology, rays


_DISC, _BALL = morphology.disc(2), morphology.ball(2)


def _kernel_sql(v: str, kernel, n: int) -> str:
    return f"SELECT a.i, a.r, a.c FROM {v} a, {d.sql_offsets(kernel)}, {v} b WHERE b.i = a.i + di AND b.r = a.r + dr AND b.c = a.c + dc GROUP BY 1, 2, 3 HAVING count(*) = {n}"


_DENSE = f"(SELECT DISTINCT i // 5 AS i, r, c FROM {d.sql_cells()})"


def _dense(spark, sf):
    return d.cells(spark, sf).withColumn("i", F.floor(F.col("i") / 5).cast("int")).distinct()


@query(_kernel_sql(_DENSE, _DISC, len(_DISC)))
def eroded_disc(spark, sf):
    return morphology.eroded(_dense(spark, sf), _DISC)


@query(f"SELECT DISTINCT i + di AS i, r + dr AS r, c + dc AS c FROM {d.sql_cells()}, {d.sql_offsets(_DISC)}")
def dilated_disc(spark, sf):
    return morphology.dilated(d.cells(spark, sf), _DISC)


@query(f"WITH e AS ({_kernel_sql(_DENSE, _DISC, len(_DISC))}) SELECT DISTINCT i + di AS i, r + dr AS r, c + dc AS c FROM e, {d.sql_offsets(_DISC)}")
def opened_disc(spark, sf):
    return morphology.opened(_dense(spark, sf), _DISC)


@query(f"""WITH w AS (SELECT * FROM {d.sql_cells()}), g AS (SELECT DISTINCT w.i, w.r, w.c FROM {d.sql_cells(d.ODD)} s, {d.sql_offsets(_BALL)}, w WHERE w.i = s.i + di AND w.r = s.r + dr AND w.c = s.c + dc),
  x AS (SELECT * FROM w EXCEPT SELECT * FROM g) SELECT g.* FROM g WHERE NOT EXISTS (SELECT 1 FROM x, {d.sql_offsets(_BALL)} WHERE x.i = g.i + di AND x.r = g.r + dr AND x.c = g.c + dc)""")
def closed_ball(spark, sf):
    return morphology.closed_within(d.cells(spark, sf, d.ODD), _BALL, d.cells(spark, sf))


@query(f"SELECT * FROM {d.sql_cells(d.ODD)} EXCEPT SELECT * FROM {d.sql_cells(d.EVEN)}")
def grid_difference(spark, sf):
    return d.cells(spark, sf, d.ODD).join(d.cells(spark, sf, d.EVEN), CELL, "left_anti")


@query(f"""WITH RECURSIVE s AS (SELECT i, r, c, space_id AS label FROM {d.sql_spaces()} WHERE space_id < 0), f AS MATERIALIZED (SELECT i, r, c FROM {d.sql_spaces()} WHERE space_id > 0),
  g(i, r, c, label) USING KEY (i, r, c) AS (SELECT * FROM s UNION SELECT f.i, f.r, f.c, min(g.label) FROM g, {d.sql_offsets(neighbours.offsets(4))}, f LEFT JOIN recurring.g AS k ON k.i = f.i AND k.r = f.r AND k.c = f.c
    WHERE k.i IS NULL AND f.i = g.i AND f.r = g.r + dr AND f.c = g.c + dc GROUP BY 1, 2, 3)
  SELECT * FROM g""")
def grown_layers(spark, sf):
    s = d.spaces(spark, sf)
    return morphology.grown(s.where("space_id < 0").withColumnRenamed("space_id", "label"), s.where("space_id > 0"), 4)


_DIRS8 = [(b, c) for _, b, c in neighbours.offsets(8)]
_MARCH = "(SELECT a.i, a.r, a.c, dr, dc, d FROM {a} a, (VALUES " + ", ".join(f"({b}, {c}, {2 if b and c else 3})" for b, c in _DIRS8) + ") o(dr, dc, most), (SELECT unnest(range(1, 4)) AS d) s WHERE d <= most)"


@query(f"""WITH n AS (SELECT * FROM {d.sql_normals()}), a AS (SELECT i, r, c FROM n WHERE normal = 1), m AS {_MARCH.format(a='a')},
  h AS (SELECT m.i, m.r, m.c, m.dr, m.dc, m.d, n.normal FROM m JOIN n ON n.i = m.i AND n.r = m.r + m.d * m.dr AND n.c = m.c + m.d * m.dc WHERE n.normal >= 3)
  SELECT i, r, c, CAST(dr AS INTEGER) AS dr, CAST(dc AS INTEGER) AS dc, CAST(min(d) AS INTEGER) AS d, arg_min(normal, d) AS n_normal FROM h GROUP BY i, r, c, dr, dc""")
def first_hits(spark, sf):
    n = d.normals(spark, sf)
    out = rays.first_hits(n.where("normal = 1").select(*CELL), n.where("normal >= 3"), neighbours.offsets(8), 3, 2)
    return out.select(*CELL, "dr", "dc", "d", "n_normal")


@query(f"""WITH g AS (SELECT i, r, c, max(CASE WHEN cls IN (1, 2) THEN 1 ELSE 0 END) AS inside, max(CASE WHEN cls IN (0, 1, 2, 3) THEN 1 ELSE 0 END) AS open FROM {_G1} GROUP BY 1, 2, 3), a AS (SELECT i, r, c FROM g WHERE inside = 1), m AS {_MARCH.format(a='a')},
  h AS (SELECT m.i, m.r, m.c, m.dr, m.dc, min(m.d) AS d, arg_min(g.open, m.d) AS open FROM m JOIN g ON g.i = m.i AND g.r = m.r + m.d * m.dr AND g.c = m.c + m.d * m.dc GROUP BY 1, 2, 3, 4, 5),
  k AS (SELECT DISTINCT CAST(h.i AS INTEGER) AS i, CAST(h.r + s * h.dr AS INTEGER) AS r, CAST(h.c + s * h.dc AS INTEGER) AS c FROM h, (SELECT unnest(range(1, 3)) AS s) WHERE open = 1 AND s < h.d)
  SELECT k.i, k.r, k.c, CASE WHEN EXISTS (SELECT 1 FROM {d.sql_normals()} n WHERE n.i = k.i AND n.r = k.r AND n.c = k.c) THEN 2 ELSE 1 END AS cls FROM k""")
def gap_cells(spark, sf):
    return rays.gaps(d.grid(spark, sf), d.normals(spark, sf), 3, 2)


_ENDS = ", ".join(f"({b * (1 if b and c else 2)}, {c * (1 if b and c else 2)})" for b, c in _DIRS8)


@query(f"""WITH f AS (SELECT i, r, c FROM {d.sql_normals()} WHERE normal IN (2, 4)), w AS (SELECT i, r, c FROM {d.sql_normals()} WHERE normal = 3),
  o AS (SELECT f.i, f.r, f.c, dr, dc, min(abs(g.i - f.i)) AS off FROM f, (VALUES {_ENDS}) o(dr, dc), f g WHERE g.r = f.r + dr AND g.c = f.c + dc AND abs(g.i - f.i) <= 4
    AND NOT EXISTS (SELECT 1 FROM w WHERE w.i = f.i AND w.r = f.r + dr AND w.c = f.c + dc) AND (abs(dr) + abs(dc) = 2 AND abs(dr) = 1 OR NOT EXISTS (SELECT 1 FROM w WHERE w.i = f.i AND 2 * (w.r - f.r) = dr AND 2 * (w.c - f.c) = dc)) GROUP BY 1, 2, 3, 4, 5)
  SELECT f.i, f.r, f.c, coalesce(max(o.off), -1) AS slope FROM f LEFT JOIN o ON f.i = o.i AND f.r = o.r AND f.c = o.c GROUP BY 1, 2, 3""")
def slopes(spark, sf):
    n = d.normals(spark, sf)
    return rays.slope(n.where("normal IN (2, 4)"), 2, 1, 4, n.where("normal = 3"))


# ---- reconstruction


_N = d.sql_normals()


@query(f"""WITH RECURSIVE {d.sql_labels(f"(SELECT i, r, c FROM {_N} WHERE normal IN (1, 4))", neighbours.offsets(6))},
  k AS (SELECT label FROM labelled GROUP BY label HAVING count(DISTINCT (r, c)) >= 2), n AS (SELECT label, CAST(row_number() OVER (ORDER BY label) AS INTEGER) AS room_id FROM k) SELECT i, r, c, room_id FROM labelled JOIN n USING (label)""")
def ceiling_segments(spark, sf):
    return reconstruct.ceilings(d.normals(spark, sf), 2)


_TOP = f"top AS (SELECT room_id, r, c, min(i) AS height FROM {_G1} GROUP BY 1, 2, 3)"


def _top(spark, sf):
    return reconstruct.top_ceiling(d.grid(spark, sf))


@query(f"WITH {_TOP} SELECT * FROM top")
def top_ceilings(spark, sf):
    return _top(spark, sf)


_FLOOR = f"{_TOP}, fl AS (SELECT t.room_id, t.r, t.c, t.height, min(n.i) AS floor FROM top t LEFT JOIN {_N} n ON n.r = t.r AND n.c = t.c AND n.i > t.height AND n.normal IN (2, 4) GROUP BY 1, 2, 3, 4)"


@query(f"WITH {_FLOOR} SELECT * FROM fl")
def first_floors(spark, sf):
    return reconstruct.first_floor(_top(spark, sf), d.normals(spark, sf)).select("room_id", "r", "c", "height", "floor")


def _side(cond_a: str, cond_b: str) -> str:
    return f"(EXISTS (SELECT 1 FROM p q WHERE q.room_id = f.room_id AND {cond_a}) AND EXISTS (SELECT 1 FROM p q WHERE q.room_id = f.room_id AND {cond_b}))"


@query(f"""WITH p AS (SELECT DISTINCT room_id, r, c FROM {_G1} WHERE cls IN (0, 3)), b AS (SELECT room_id, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM p GROUP BY 1),
  f AS (SELECT room_id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c FROM (SELECT room_id, r, unnest(range(c0, c1 + 1)) AS c FROM (SELECT *, unnest(range(r0, r1 + 1)) AS r FROM b)))
  SELECT f.* FROM f WHERE (f.room_id, f.r, f.c) NOT IN (SELECT (room_id, r, c) FROM p) AND ({_side('q.r = f.r AND q.c < f.c', 'q.r = f.r AND q.c > f.c')} OR {_side('q.c = f.c AND q.r < f.r', 'q.c = f.c AND q.r > f.r')}
  OR {_side('q.r - q.c = f.r - f.c AND q.r < f.r', 'q.r - q.c = f.r - f.c AND q.r > f.r')} OR {_side('q.r + q.c = f.r + f.c AND q.r < f.r', 'q.r + q.c = f.r + f.c AND q.r > f.r')})""")
def hole_pixels(spark, sf):
    return reconstruct.hole_pixels(d.grid(spark, sf).where("cls IN (0, 3)"))


@query(f"""WITH {_FLOOR} SELECT f.room_id, f.r + dr AS r, f.c + dc AS c, max(height) AS height, min(floor) AS floor FROM fl f, (VALUES {', '.join(map(str, _DIRS8))}) o(dr, dc) WHERE (f.room_id, f.r + dr, f.c + dc) NOT IN (SELECT (room_id, r, c) FROM fl) GROUP BY 1, 2, 3""")
def wall_pixels(spark, sf):
    return reconstruct.wall_pixels(reconstruct.first_floor(_top(spark, sf), d.normals(spark, sf)))


_SEG = f"""v AS (SELECT *, (CAST(r AS BIGINT) * 2097152 + c) AS vid FROM top), e AS (SELECT a.room_id, a.vid AS va, b.vid AS vb FROM v a, (VALUES {', '.join(map(str, _DIRS8))}) o(dr, dc), v b WHERE b.room_id = a.room_id AND b.r = a.r + dr AND b.c = a.c + dc AND abs(a.height - b.height) <= 1),
  reach(room_id, va, vb) AS (SELECT room_id, vid, vid FROM v UNION SELECT reach.room_id, reach.va, e.vb FROM reach JOIN e ON reach.vb = e.va AND reach.room_id = e.room_id), m AS (SELECT room_id, va, min(vb) AS label FROM reach GROUP BY 1, 2),
  seg AS (SELECT v.room_id, v.r, v.c, v.height, m.label FROM v JOIN m ON v.vid = m.va AND v.room_id = m.room_id)"""


@query(f"WITH RECURSIVE {_TOP}, {_SEG} SELECT * FROM seg")
def floor_segments(spark, sf):
    return reconstruct.floor_segments(_top(spark, sf), 1).select("room_id", "r", "c", "height", "label")


@query(f"WITH RECURSIVE {_TOP}, {_SEG}, inc AS (SELECT i, count(*) AS n FROM {_N} WHERE normal IN (2, 4) GROUP BY i), sc AS (SELECT room_id, label, CAST(sum(coalesce(n, 0)) AS BIGINT) AS score FROM seg LEFT JOIN inc ON inc.i = seg.height GROUP BY 1, 2) SELECT room_id, label, score FROM (SELECT *, max(score) OVER (PARTITION BY room_id) AS m FROM sc) WHERE score = m")
def dominant_floors(spark, sf):
    return reconstruct.dominant_floors(reconstruct.floor_segments(_top(spark, sf), 1), reconstruct.floor_incidence(d.normals(spark, sf)))


@query(f"SELECT i, r, c FROM {_G1} WHERE cls IN (1, 2) GROUP BY 1, 2, 3")
def interior_cells(spark, sf):
    return reconstruct.interior(d.grid(spark, sf))


@query(f"SELECT n.i, n.r, n.c, n.normal FROM {_N} n LEFT JOIN {d.sql_cells(d.EVEN)} g USING (i, r, c) WHERE NOT EXISTS (SELECT 1 FROM {d.sql_cells(d.EVEN)} g WHERE g.i = n.i AND g.r = n.r AND g.c = n.c)")
def roomless_cells(spark, sf):
    return reconstruct.roomless(d.normals(spark, sf), d.grid(spark, sf, d.EVEN))


@query(f"""WITH l AS (SELECT n.* FROM {_N} n WHERE NOT EXISTS (SELECT 1 FROM {d.sql_cells(d.EVEN)} g WHERE g.i = n.i AND g.r = n.r AND g.c = n.c)), t AS (SELECT DISTINCT i, r, c, room_id, cls FROM {_GB} WHERE cls IN (0, 3)),
  k AS (SELECT l.i, l.r, l.c, t.room_id, t.cls, row_number() OVER (PARTITION BY l.i, l.r, l.c ORDER BY abs(t.i - l.i), t.i - l.i, t.room_id, t.cls) AS k FROM l JOIN t ON t.r = l.r AND t.c = l.c AND abs(t.i - l.i) BETWEEN 1 AND 3 WHERE (normal = 1 AND t.i > l.i) OR (normal = 2 AND t.i < l.i) OR normal > 2) SELECT i, r, c, room_id, cls FROM k WHERE k = 1""")
def roomless_assigned(spark, sf):
    g = d.grid(spark, sf, d.EVEN)
    return reconstruct.roomless_assigned(reconstruct.roomless(d.normals(spark, sf), g), g, 3)


@query(f"""WITH g AS (SELECT i, r, c, max(CASE WHEN cls IN (0, 3, 4) THEN 1 ELSE 0 END) AS s, max(CASE WHEN cls = 2 THEN 1 ELSE 0 END) AS o FROM {_G1} GROUP BY 1, 2, 3)
  SELECT DISTINCT g.i, g.r, g.c, 0 AS room_id, CASE WHEN s = 1 THEN x.cls WHEN o = 1 THEN 2 ELSE 1 END AS cls FROM g JOIN {_G1} x USING (i, r, c) WHERE s = 0 OR x.cls IN (0, 3, 4)""")
def merged_rooms(spark, sf):
    return reconstruct.merged_rooms(d.grid(spark, sf))


_BORDER = f"(r IN (0, (SELECT max(r) FROM {d.sql_cells()})) OR c IN (0, (SELECT max(c) FROM {d.sql_cells()})))"
_EMPTY = d.sql_labels(d.sql_empty(d.sql_cells()), neighbours.offsets(4))


@query(f"WITH RECURSIVE {_EMPTY} SELECT i, r, c FROM labelled WHERE label IN (SELECT label FROM labelled WHERE {_BORDER})")
def outside_cells(spark, sf):
    g = d.cells(spark, sf)
    return reconstruct.outside(g, d.empty(spark, g), (0, 0), d.corner(g))


@query(f"""WITH RECURSIVE {_EMPTY}, n AS (SELECT l.label, min(g.room_id) AS lo, max(g.room_id) AS hi FROM labelled l, {d.sql_offsets(neighbours.offsets(4))}, {_G1} g WHERE g.i = l.i AND g.r = l.r + dr AND g.c = l.c + dc AND l.label NOT IN (SELECT label FROM labelled WHERE {_BORDER}) GROUP BY 1)
  SELECT i, r, c, lo AS room_id, 1 AS cls FROM labelled JOIN n USING (label) WHERE lo = hi""")
def enclosed_filled(spark, sf):
    g = d.grid(spark, sf)
    return reconstruct.enclosed_filled(g, d.empty(spark, g), (0, 0), d.corner(g))


@query(f"""WITH g AS (SELECT * FROM {_G1}), k AS (SELECT DISTINCT i, r, c, room_id, cls FROM g WHERE cls IN (0, 3)), t AS (SELECT k.i, k.r, k.c, k.room_id, (SELECT min(f.i) FROM k f WHERE f.r = k.r AND f.c = k.c AND f.room_id = k.room_id AND f.cls = 3 AND f.i > k.i) AS f FROM k WHERE cls = 0),
  b AS (SELECT DISTINCT CAST(unnest(range(i + 1, f)) AS INTEGER) AS i, r, c, room_id FROM t WHERE f > i + 1) SELECT * FROM g UNION ALL SELECT i, r, c, room_id, 1 FROM b WHERE (i, r, c, room_id) NOT IN (SELECT (i, r, c, room_id) FROM g)""")
def with_empty_interior(spark, sf):
    return reconstruct.with_empty_interior(d.grid(spark, sf))


@query(f"""WITH g AS (SELECT DISTINCT i, r, c, room_id FROM {_G1}), n AS (SELECT DISTINCT i, r, c, room_id FROM {_G1} WHERE cls IN (1, 2)) SELECT n.*, 0 AS cls FROM n WHERE (i - 1, r, c, room_id) NOT IN (SELECT (i, r, c, room_id) FROM g) UNION ALL SELECT n.*, 3 AS cls FROM n WHERE (i + 1, r, c, room_id) NOT IN (SELECT (i, r, c, room_id) FROM g)""")
def closed_columns(spark, sf):
    return reconstruct.closed_columns(d.grid(spark, sf))


@query(f"SELECT i, r, c, room_id, cls FROM (SELECT *, count(*) OVER (PARTITION BY i, r, c, room_id) AS n FROM {_G1}) WHERE cls <> 5 OR n = 1")
def openings_dropped(spark, sf):
    return reconstruct.openings_dropped(d.grid(spark, sf))


@query(f"SELECT v.i, v.r, v.c FROM {d.sql_cells()} v WHERE EXISTS (SELECT 1 FROM {d.sql_empty(d.sql_cells())} e, {d.sql_offsets(neighbours.offsets(8))} WHERE e.i = v.i AND e.r = v.r + dr AND e.c = v.c + dc)")
def beside_empty(spark, sf):
    g = d.cells(spark, sf)
    return reconstruct.beside_outside(g, d.empty(spark, g), True)


@query(f"SELECT DISTINCT g.i, g.r, g.c, g.room_id FROM {_G1} g, {d.sql_offsets(neighbours.offsets(4))}, {_G1} n WHERE n.i = g.i AND n.r = g.r + dr AND n.c = g.c + dc AND n.room_id = g.room_id AND n.cls = 2")
def beside_interior(spark, sf):
    return reconstruct.beside_interior(d.grid(spark, sf))


def _stack(cls: int) -> str:
    return f"(WITH w AS (SELECT DISTINCT i, r, c FROM {_G1} WHERE cls = {cls}), q AS (SELECT i, r, c, i - row_number() OVER (PARTITION BY r, c ORDER BY i) AS g FROM w) SELECT r, c, min(i) AS top, max(i) AS bottom FROM q GROUP BY r, c, g)"


@query(f"""SELECT DISTINCT CAST(unnest(range(top, bottom + 1)) AS INTEGER) AS i, r, c, space_id FROM (SELECT t.r, t.c, t.top, t.bottom, s.space_id FROM {d.sql_spaces()} s JOIN {_stack(0)} t ON s.r = t.r AND s.c = t.c AND s.i - 1 = t.bottom
  UNION ALL SELECT t.r, t.c, t.top, t.bottom, s.space_id FROM {d.sql_spaces()} s JOIN {_stack(3)} t ON s.r = t.r AND s.c = t.c AND s.i + 1 = t.top)""")
def ids_to_surfaces(spark, sf):
    return reconstruct.ids_to_surfaces(d.spaces(spark, sf), d.grid(spark, sf))


@query(f"WITH w AS (SELECT DISTINCT i, r, c, room_id FROM {_G1} WHERE cls = 4), q AS (SELECT *, i - row_number() OVER (PARTITION BY r, c, room_id ORDER BY i) AS g FROM w) SELECT i, r, c, room_id FROM (SELECT *, count(*) OVER (PARTITION BY r, c, room_id, g) AS h FROM q) WHERE h < 2")
def low_walls(spark, sf):
    return reconstruct.walls_lower_than(d.grid(spark, sf), 2)


@query(f"WITH {_RUNS.format(v=d.sql_cells())} SELECT CAST(unnest(range(top, bottom + 1)) AS INTEGER) AS i, r, c FROM (SELECT u.r, u.c, top, bottom FROM runs u JOIN {d.sql_spaces()} s ON s.r = u.r AND s.c = u.c AND s.i BETWEEN top AND bottom WHERE height >= 2 AND s.space_id < 0 GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2)")
def transition_columns(spark, sf):
    return reconstruct.transition_columns(d.cells(spark, sf), d.spaces(spark, sf).where("space_id < 0"), 2)


# ---- segments


_S = d.sql_spaces()
_O4 = d.sql_offsets(neighbours.offsets(4))


@query(f"SELECT s.space_id, CAST(sum(CASE WHEN f.i IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS area FROM {_S} s LEFT JOIN (SELECT DISTINCT i, r, c FROM {_G1} WHERE cls = 3) f ON f.i = s.i + 1 AND f.r = s.r AND f.c = s.c GROUP BY 1")
def segment_areas(spark, sf):
    return segments.floor_areas(d.spaces(spark, sf), d.grid(spark, sf).where("cls = 3"))


@query(f"SELECT a.space_id, count(*) AS area FROM {_S} a WHERE NOT EXISTS (SELECT 1 FROM {_S} b WHERE b.space_id = a.space_id AND b.i = a.i + 1 AND b.r = a.r AND b.c = a.c) GROUP BY 1")
def segment_footprints(spark, sf):
    return segments.footprint(d.spaces(spark, sf), "space_id")


@query(f"SELECT x.space_id AS a, y.space_id AS b, count(*) AS contacts FROM {_S} x, {_O4}, {_S} y WHERE y.i = x.i AND y.r = x.r + dr AND y.c = x.c + dc AND x.space_id < y.space_id GROUP BY 1, 2")
def segment_adjacency(spark, sf):
    return segments.adjacency(d.spaces(spark, sf))


_CONTACT = f"k AS (SELECT DISTINCT x.i, x.r, x.c, x.space_id, y.space_id AS room_id FROM {_S} x, {_O4}, {_S} y WHERE y.i = x.i AND y.r = x.r + dr AND y.c = x.c + dc AND x.space_id < 0 AND y.space_id > 0)"


@query(f"WITH {_CONTACT} SELECT space_id, room_id, count(*) AS cells, count(DISTINCT (r, c)) AS width FROM k GROUP BY 1, 2")
def contact_surfaces(spark, sf):
    return segments.contact_cells(d.spaces(spark, sf))


@query(f"WITH {_CONTACT}, n AS (SELECT DISTINCT space_id, room_id FROM k) SELECT space_id, string_agg(CAST(room_id AS VARCHAR), ',' ORDER BY room_id) AS rooms FROM n GROUP BY 1")
def adjacent_rooms(spark, sf):
    return segments.adjacent_rooms(d.spaces(spark, sf)).select("space_id", F.array_join(F.transform("rooms", lambda x: x.cast("string")), ",").alias("rooms"))


@query(f"WITH {_CONTACT}, n AS (SELECT space_id, room_id, count(*) AS n FROM k GROUP BY 1, 2) SELECT space_id, room_id FROM (SELECT *, row_number() OVER (PARTITION BY space_id ORDER BY n DESC, room_id) AS q FROM n) WHERE q = 1")
def dominant_rooms(spark, sf):
    return segments.dominant_room(d.spaces(spark, sf))


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS a, s_suppkey * 7 + s_nationkey AS b FROM supplier), u AS MATERIALIZED (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
  low(a, b) USING KEY (a) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.a, min(low.b) FROM low JOIN u ON u.b = low.a JOIN recurring.low AS k ON k.a = u.a WHERE low.b < k.b GROUP BY u.a) SELECT a AS source, b AS target FROM low""")
def id_clusters(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    return segments.cluster_mapping(s.selectExpr("s_suppkey AS a", "s_suppkey * 7 + s_nationkey AS b"))


@query(f"SELECT i, r, c, CASE WHEN space_id IN (1, 2) THEN 3 ELSE space_id END AS space_id FROM {_S}")
def relabelled(spark, sf):
    return segments.relabelled(d.spaces(spark, sf), spark.createDataFrame([(1, 3), (2, 3)], "source int, target int")).select(*CELL, "space_id")


@query(f"SELECT space_id, CAST(round_even(median(i), 0) AS INTEGER) AS i, CAST(round_even(median(r), 0) AS INTEGER) AS r FROM {_S} GROUP BY 1")
def segment_medians(spark, sf):
    return d.spaces(spark, sf).groupBy("space_id").agg(segments.median(F.col("i")).alias("i"), segments.median(F.col("r")).alias("r"))


@query(f"""WITH RECURSIVE {d.sql_labels(d.sql_cells(), neighbours.offsets(26))}, z AS (SELECT *, r // 10 * 400 + c // 10 AS k FROM labelled), n AS (SELECT k, label, count(*) AS n FROM z GROUP BY 1, 2), t AS (SELECT k, label FROM (SELECT *, max(n) OVER (PARTITION BY k) AS m FROM n) WHERE n = m)
  SELECT z.i, z.r, z.c, CAST(z.k AS INTEGER) AS k, z.label FROM z JOIN t ON z.k = t.k AND z.label = t.label""")
def largest_parts(spark, sf):
    v = components.label_components(d.cells(spark, sf), 26)
    z = v.withColumn("k", F.expr("CAST(r DIV 10 * 400 + c DIV 10 AS INT)"))
    return segments.largest_parts(z, "k").select(*CELL, "k", "label")


# ---- normals from occupancy


@query(f"WITH o AS (SELECT i, r, c FROM {d.sql_cells()} UNION SELECT i + 1, r, c FROM {d.sql_cells()}), {_RUNS.format(v='o')} SELECT o.i, o.r, o.c FROM o JOIN runs u ON o.r = u.r AND o.c = u.c AND o.i BETWEEN top AND bottom WHERE height >= 4")
def horizontal_stacks(spark, sf):
    return normals.horizontal_stacks(d.cells(spark, sf), 4)


@query(f"""WITH s AS (SELECT *, CAST(abs(space_id) * 2 + CASE WHEN space_id < 0 THEN 1 ELSE 0 END AS BIGINT) AS label FROM {_S}), w AS (SELECT *, lag(label) OVER p AS up, lag(i) OVER p AS ui, lead(label) OVER p AS dn FROM s WINDOW p AS (PARTITION BY r, c ORDER BY i)),
  e AS (SELECT label AS lower, up AS upper, i - ui AS d FROM w WHERE up <> label UNION ALL SELECT label, -2, NULL FROM w WHERE up IS NULL UNION ALL SELECT -1, label, NULL FROM w WHERE dn IS NULL)
  SELECT lower, upper, count(*) AS coverage, round(avg(d), 6) AS distance FROM e GROUP BY 1, 2""")
def vertical_adjacency(spark, sf):
    s = d.spaces(spark, sf).withColumn("label", F.expr("CAST(abs(space_id) * 2 + CASE WHEN space_id < 0 THEN 1 ELSE 0 END AS BIGINT)"))
    return _rounded(normals.vertical_graph(s), "distance")


@query(f"""WITH s AS (SELECT *, CAST(abs(space_id) * 2 + CASE WHEN space_id < 0 THEN 1 ELSE 0 END AS BIGINT) AS label FROM {_S}), w AS (SELECT *, lag(label) OVER p AS up FROM s WINDOW p AS (PARTITION BY r, c ORDER BY i)), e AS (SELECT label AS lower, up AS upper, count(*) AS coverage FROM w WHERE up <> label GROUP BY 1, 2)
  SELECT lower, upper, coverage FROM (SELECT *, max(coverage) OVER (PARTITION BY upper) AS m FROM e) WHERE coverage = m""")
def main_segments(spark, sf):
    s = d.spaces(spark, sf).withColumn("label", F.expr("CAST(abs(space_id) * 2 + CASE WHEN space_id < 0 THEN 1 ELSE 0 END AS BIGINT)"))
    return normals.main_above(normals.vertical_graph(s)).select("lower", "upper", "coverage")


@query(f"SELECT n.i, n.r, n.c FROM {_N} n, {_O4}, {_N} o WHERE o.i = n.i AND o.r = n.r + dr AND o.c = n.c + dc GROUP BY 1, 2, 3 HAVING count(*) = 4")
def plane_cells(spark, sf):
    return normals.plane_cells(d.normals(spark, sf))


@query(f"""WITH s AS (SELECT *, space_id AS label FROM {_S}), g AS (SELECT DISTINCT s.i, s.r + dr AS r, s.c + dc AS c, label FROM s, {d.sql_offsets(neighbours.offsets(8))} WHERE (s.i, s.r + dr, s.c + dc, label) NOT IN (SELECT (i, r, c, label) FROM s)), n AS (SELECT i, r, c FROM {_N})
  SELECT label, round(avg(CASE WHEN EXISTS (SELECT 1 FROM n WHERE n.i = g.i + 1 AND n.r = g.r AND n.c = g.c) THEN 1.0 ELSE 0 END), 6) AS below, round(avg(CASE WHEN EXISTS (SELECT 1 FROM n WHERE n.i = g.i - 1 AND n.r = g.r AND n.c = g.c) THEN 1.0 ELSE 0 END), 6) AS above FROM g GROUP BY 1""")
def border_fill(spark, sf):
    s = d.spaces(spark, sf).withColumnRenamed("space_id", "label")
    return _rounded(normals.border_fill(s, d.normals(spark, sf), 1), "below", "above")


@query(f"""WITH s AS (SELECT * FROM {_S}) SELECT s.space_id AS label, CAST(sum(CASE WHEN n.normal IN (2, 4) THEN 1 ELSE 0 END) AS BIGINT) AS up, CAST(sum(CASE WHEN n.normal IN (1, 4) THEN 1 ELSE 0 END) AS BIGINT) AS down, CAST(sum(CASE WHEN n.normal = 3 THEN 1 ELSE 0 END) AS BIGINT) AS horizontal
  FROM s, {d.sql_offsets(neighbours.offsets(6))}, {_N} n, s t WHERE n.i = s.i + di AND n.r = s.r + dr AND n.c = s.c + dc AND t.i = n.i AND t.r = n.r AND t.c = n.c AND t.space_id <> s.space_id GROUP BY 1""")
def contact_votes(spark, sf):
    s = d.spaces(spark, sf).withColumnRenamed("space_id", "label")
    return segments.border_votes(s, d.normals(spark, sf))




# ---- walls and ceilings after partitioning


_G0 = f"(SELECT i, r, c, CASE WHEN room_id % 16 IN (3, 6, 11) THEN room_id ELSE 0 END AS room_id, cls FROM {_G1})"


def _partly(spark, sf):
    return d.grid(spark, sf).withColumn("room_id", F.when((F.col("room_id") % 16).isin(3, 6, 11), F.col("room_id")).otherwise(0)).distinct()


@query(f"""WITH RECURSIVE g AS (SELECT DISTINCT * FROM {_G0}), a AS MATERIALIZED (SELECT i, r, c, count(DISTINCT room_id) AS n, min(room_id) AS id, max(CASE WHEN cls = 4 THEN 1 ELSE 0 END) AS w, max(CASE WHEN cls IN (0, 3) THEN 1 ELSE 0 END) AS s FROM g GROUP BY 1, 2, 3),
  f AS MATERIALIZED (SELECT i, r, c FROM a WHERE n = 1 AND id = 0 AND (w = 1 OR s = 0)),
  t(i, r, c, ids, taken) USING KEY (i, r, c) AS (SELECT i, r, c, [id], FALSE FROM a WHERE n = 1 AND id <> 0 UNION
    SELECT f.i, f.r, f.c, list(DISTINCT t.ids[1]), TRUE FROM t, {_O4}, f LEFT JOIN recurring.t AS k ON k.i = f.i AND k.r = f.r AND k.c = f.c WHERE k.i IS NULL AND len(t.ids) = 1 AND t.i = f.i AND t.r = f.r + dr AND t.c = f.c + dc GROUP BY 1, 2, 3),
  l AS MATERIALIZED (SELECT i, r, c, unnest(ids) AS id FROM t WHERE taken)
  SELECT i, r, c, room_id, cls FROM g WHERE (i, r, c) NOT IN (SELECT (i, r, c) FROM l) UNION ALL SELECT DISTINCT g.i, g.r, g.c, l.id, CASE cls WHEN 1 THEN 5 WHEN 2 THEN 4 ELSE cls END FROM g JOIN l ON g.i = l.i AND g.r = l.r AND g.c = l.c""")
def inherited_ids(spark, sf):
    from cellgrove.operators import walls

    return walls.inherited_ids(_partly(spark, sf))


_UP = f"""WITH RECURSIVE g AS (SELECT DISTINCT * FROM {_G0}), s AS (SELECT i, r, c, max(CASE WHEN room_id = 0 THEN 1 ELSE 0 END) AS zero, min(CASE WHEN room_id <> 0 THEN room_id END) AS first FROM g GROUP BY 1, 2, 3),
  scan(i, r, c, room, made) AS (SELECT CAST({d.LAYERS} AS INTEGER), r, c, CAST(NULL AS INTEGER), FALSE FROM (SELECT DISTINCT r, c FROM s)
    UNION ALL SELECT CAST(scan.i - 1 AS INTEGER), scan.r, scan.c, CASE WHEN s.zero = 1 AND scan.room IS NOT NULL THEN scan.room ELSE s.first END, coalesce(s.zero = 1 AND scan.room IS NOT NULL, FALSE) FROM scan LEFT JOIN s ON s.i = scan.i - 1 AND s.r = scan.r AND s.c = scan.c WHERE scan.i > 0)
  SELECT i, r, c, room AS room_id, 0 AS cls FROM scan WHERE made UNION ALL SELECT g.* FROM g JOIN scan USING (i, r, c) WHERE NOT made AND room_id <> 0"""


@query(_UP)
def ceilings_of_stack(spark, sf):
    from cellgrove.operators import walls

    return walls.ceilings_of_stack(_partly(spark, sf))


_FW = f"(SELECT DISTINCT i, r, c, (r // 10) + 1 AS room_id, cls FROM {_G1} UNION SELECT i, r, c, (r // 10) + 1, 4 FROM {_G1} WHERE cls IN (0, 3))"


@query(f"""WITH g AS (SELECT * FROM {_FW}), n AS (SELECT DISTINCT i, r, c, room_id FROM g WHERE cls IN (1, 2)), w AS (SELECT DISTINCT i, r, c, room_id FROM g WHERE cls = 4)
  SELECT CAST(i AS INTEGER) AS i, r, c, CAST(room_id AS INTEGER) AS room_id FROM w WHERE ((i, r, c, room_id) IN (SELECT (i, r, c, room_id) FROM g WHERE cls = 0) AND (i + 1, r, c, room_id) IN (SELECT (i, r, c, room_id) FROM n)) OR ((i, r, c, room_id) IN (SELECT (i, r, c, room_id) FROM g WHERE cls = 3) AND (i - 1, r, c, room_id) IN (SELECT (i, r, c, room_id) FROM n))""")
def false_walls(spark, sf):
    from cellgrove.operators import walls

    g = d.grid(spark, sf).select(*CELL, (F.floor(F.col("r") / 10) + 1).cast("int").alias("room_id"), "cls")
    return walls.false_walls(g.union(g.where("cls IN (0, 3)").withColumn("cls", F.lit(4))).distinct())
