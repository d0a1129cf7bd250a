"""Vertex counts: the corners of small meshes stay in the task of their mesh, large meshes are spread."""

import pytest
from pyspark.sql import functions as F

from voxelloom.operators import meshes
from voxelloom.plans import mesh_queries
from voxelloom.sources import testdata


@pytest.fixture()
def folder(spark, tmp_path):
    rows = [(order, line % 7 + 1, float(line % 50 + 1), line % 11 / 100, line % 9 / 100) for order, n in ((1, 3), (2, 300), (3, 1), (None, 4)) for line in range(n)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_dealt_lines_are_all_lines(spark, folder):
    whole, spread = testdata.dealt_box_lines(spark, folder, most=100)
    assert sorted(r.mesh_id for r in whole.select("mesh_id").distinct().collect()) == ["m1", "m3"]
    assert sorted(str(r.mesh_id) for r in spread.select("mesh_id").distinct().collect()) == ["None", "m2"]
    assert whole.count() + spread.count() == 308
    tasks = whole.select("mesh_id", F.spark_partition_id().alias("task")).distinct()
    assert tasks.groupBy("mesh_id").count().where("count > 1").count() == 0


@pytest.mark.parametrize("most", [0, 100, 10_000])
def test_vertices_count_alike_however_meshes_are_dealt(spark, folder, monkeypatch, most):
    monkeypatch.setattr(testdata.dealt_box_lines, "__defaults__", (most, testdata.TASK_LINES))
    got = {r.mesh_id: r.n_vertices for r in mesh_queries.mesh_vertex_count(spark, folder).collect()}
    plain = meshes.mesh_vertex_count(testdata.box_triangles(spark, folder))
    assert got == {r.mesh_id: r.n_vertices for r in plain.collect()}
    assert set(got) == {"m1", "m2", "m3", None}


def test_corners_of_small_meshes_are_not_shuffled(spark, folder):
    whole, _ = testdata.dealt_box_lines(spark, folder)
    plan = meshes.mesh_vertex_count(testdata.boxes_of(whole))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
