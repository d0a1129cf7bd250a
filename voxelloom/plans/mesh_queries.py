"""Triangle meshes and point clouds on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelloom.operators import meshes
from voxelloom.plans.registry import BOXES, plain, query
from voxelloom.sources import testdata


def triangles(spark, sf):
    return testdata.box_triangles(spark, sf)


@query(f"WITH {BOXES} SELECT mesh_id, round(sum(a * b * c), 4) AS volume, round(sum(2 * (a * b + b * c + a * c)), 4) AS area, count(*)::BIGINT * 12 AS n_faces FROM boxes GROUP BY 1")
def mesh_volume_area(spark, sf):
    return plain(meshes.mesh_volume_area(triangles(spark, sf)), 4)


@query(f"""WITH {BOXES}, v AS (SELECT DISTINCT mesh_id, x0 + a * i AS x, b * j AS y, c * k AS z FROM boxes, range(2) p(i), range(2) q(j), range(2) r(k))
SELECT mesh_id, count(*)::BIGINT AS n_vertices FROM v GROUP BY 1""")
def mesh_vertex_count(spark, sf):
    # Corners of meshes that lie in one task each are never shuffled.
    whole, spread = (meshes.mesh_vertex_count(testdata.boxes_of(lines)) for lines in testdata.dealt_box_lines(spark, sf))
    return plain(whole.unionByName(spread))


@query(f"""WITH {BOXES}, m AS (SELECT mesh_id, sum(a * b * c) AS v, (max(x0 + a) - min(x0) + 0.37) * max(b) * max(c) AS box FROM boxes GROUP BY 1)
SELECT mesh_id, round(1 - v / box, 9) AS porosity, round(1 + v / box, 9) AS turned, true AS orientation_ok, false AS turned_ok FROM m""")
def mesh_bbox_porosity(spark, sf):
    tri = triangles(spark, sf)
    box = (F.col("x_max") - F.col("x_min") + 0.37) * (F.col("y_max") - F.col("y_min")) * (F.col("z_max") - F.col("z_min"))
    measured = meshes.mesh_volume_area(tri).join(meshes.mesh_bounds(tri), "mesh_id").withColumn("box", box)
    right = meshes.mesh_bbox_porosity(measured, "box").select("mesh_id", "porosity", "orientation_ok")
    inverted = meshes.mesh_bbox_porosity(measured.withColumn("volume", -F.col("volume")), "box")
    return plain(right.join(inverted.select("mesh_id", F.col("porosity").alias("turned"), F.col("orientation_ok").alias("turned_ok")), "mesh_id"), 9)


@query(f"""WITH {BOXES}, e AS (SELECT mesh_id, min(0.0::DOUBLE) + 0.013::DOUBLE AS lo, max(c) - 0.013::DOUBLE AS hi FROM boxes GROUP BY 1),
p AS (SELECT mesh_id, i, CASE WHEN i = 6 THEN hi ELSE lo + i * ((hi - lo) / 6) END AS pos FROM e, range(7) r(i))
SELECT mesh_id, i::BIGINT AS plane, round(pos, 6) AS position, round(sum(a * b), 4) AS area FROM p JOIN boxes USING (mesh_id) WHERE c >= pos GROUP BY 1, 2, 3""")
def mesh_section_area(spark, sf):
    areas = meshes.mesh_section_area(triangles(spark, sf), 7, "z", 0.013)
    return plain(areas.withColumn("area", F.round("area", 4)))


@query("""WITH c AS (SELECT DISTINCT l_suppkey, l_quantity::INT AS x, l_linenumber AS y, (l_discount * 100)::INT AS z FROM lineitem)
SELECT 's' || l_suppkey AS mesh_id, round(1 - count(*) / ((max(x) - min(x) + 1) * (max(y) - min(y) + 1) * (max(z) - min(z) + 1))::DOUBLE, 6) AS porosity, count(*)::BIGINT AS n_cells FROM c GROUP BY 1""")
def occupied_box_porosity(spark, sf):
    line = testdata.table(spark, sf, "lineitem")
    cells = line.select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("mesh_id"), F.round("l_quantity").cast("int").alias("x"),
        F.col("l_linenumber").alias("y"), F.round(F.col("l_discount") * 100).cast("int").alias("z"),
    ).distinct()
    return plain(meshes.occupied_box_porosity(cells))


def points_sql(name: str, first: int, place: str) -> str:
    axes = ", ".join(f"{place.format(f'embedding[((k + {i}) % len(embedding) + 1)::INT]::DOUBLE')} AS {axis}" for i, axis in enumerate("xyz"))
    return f"{name} AS (SELECT 'c' || label AS cloud, {axes} FROM embeddings, range({first}, 64, 6) r(k))"


POINTS = points_sql("pa", 0, "floor({} * 20) * 5") + ", " + points_sql("pb", 3, "{} * 100")


def nearest_sql(name: str, p: str, q: str) -> str:
    distinct = f"(SELECT cloud, x, y, z, count(*) AS n FROM {p} GROUP BY ALL)"
    return f"""{name} AS (SELECT a.cloud, a.x, a.y, a.z, any_value(a.n) AS n, sqrt(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))) AS d
FROM {distinct} a JOIN {q} b USING (cloud) GROUP BY 1, 2, 3, 4)"""


def clouds(spark, sf):
    return testdata.points(spark, sf, 0, snap=True), testdata.points(spark, sf, 3)


@query(f"WITH {POINTS}, {nearest_sql('ab', 'pa', 'pb')} SELECT cloud, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, n::BIGINT AS n, round(d, 6) AS distance FROM ab")
def nearest_neighbour_distance(spark, sf):
    return plain(meshes.nearest_neighbour_distance(*clouds(spark, sf)))


@query(f"""WITH {POINTS}, {nearest_sql('ab', 'pa', 'pb')}, {nearest_sql('ba', 'pb', 'pa')}
SELECT cloud, round((a + b) / 2, 6) AS chamfer_distance, round(greatest(c, d), 6) AS hausdorff_distance, 'ok' AS status FROM
(SELECT cloud, sum(d * n) / sum(n) AS a, max(d) AS c FROM ab GROUP BY 1) JOIN (SELECT cloud, sum(d * n) / sum(n) AS b, max(d) AS d FROM ba GROUP BY 1) USING (cloud)""")
def chamfer_hausdorff(spark, sf):
    return plain(meshes.chamfer_hausdorff(*clouds(spark, sf)))
