"""Hand-worked values, edge cases and properties of the DataFrame operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom import layouts, ordering
from voxelloom.functions import pixels
from voxelloom.operators import histograms, images, meshes, porosity, psd, renaming, roi, scoring, synthetic, training

RNG = np.random.default_rng(3)


def values(spark, **columns):
    """One row of evaluated column expressions."""
    return spark.range(1).select(*[c.alias(name) for name, c in columns.items()]).first()


def test_crop_boxes(spark):
    row = values(
        spark,
        y=pixels.crop_start(F.lit(197.2), F.lit(300), 150), x=pixels.crop_start(F.lit(664.7), F.lit(1000), 150),
        y2=pixels.crop_start(F.lit(200.0), F.lit(300), 150), x2=pixels.crop_start(F.lit(736.9), F.lit(1000), 150),
        low=pixels.crop_start(F.lit(3.0), F.lit(100), 50), high=pixels.crop_start(F.lit(99.0), F.lit(100), 50),
        half=pixels.crop_start(F.lit(10.5), F.lit(100), 2),
    )
    assert tuple(row) == (122, 590, 125, 662, 0, 50, 9)


def test_sizes_in_voxels(spark):
    sizes = [89, 119.25, 159.75, 213.75, 285.75, 382.25, 511.75, 685.5, 918, 1229.5, 1646.75]
    frame = spark.createDataFrame([(float(s),) for s in sizes], ["nm"]).select(pixels.nm_to_vox("nm", F.lit(10)).alias("v"))
    assert [r.v for r in frame.collect()] == [9, 12, 16, 21, 29, 38, 51, 69, 92, 123, 165]


def test_lognormal_and_discrete_moments(spark):
    mu, sigma = pixels.lognormal_params(F.lit(104.0), F.lit(55.8))
    row = values(spark, mu=mu, sigma=sigma)
    assert row.mu == pytest.approx(4.517894686814409, abs=1e-12) and row.sigma == pytest.approx(0.5029835232429851, abs=1e-12)
    bins = [35.6, 47.7, 63.9, 85.5, 114.3, 152.9, 204.7, 274.2, 367.2, 491.8, 658.7]
    weights = [0.027, 0.061, 0.122, 0.174, 0.212, 0.181, 0.121, 0.065, 0.027, 0.009, 0.001]
    frame = spark.createDataFrame(list(zip(bins, weights)), ["x", "w"]).withColumn("k", F.lit(1))
    moments = synthetic.discrete_mean_std(frame, ["k"], "x", "w").first()
    assert moments["mean"] == pytest.approx(136.0412, abs=1e-9) and moments["std"] == pytest.approx(81.52043021574407, abs=1e-9)


def test_cosine_rates_and_names(spark):
    row = values(
        spark, a=pixels.cosine_lr(F.lit(1e-3), F.lit(1), F.lit(20)), b=pixels.cosine_lr(F.lit(1e-3), F.lit(10), F.lit(20)),
        c=pixels.cosine_lr(F.lit(1e-3), F.lit(20), F.lit(20)), name=pixels.experiment_name(F.lit("ce"), F.lit(3e-4), F.lit(2025)),
        g1=pixels.format_g(F.lit(1e-5)), g2=pixels.format_g(F.lit(1234567.0)), g3=pixels.format_g(F.lit(0.1)), g4=pixels.format_g(F.lit(100.0)),
        label=pixels.stem_label(F.lit("a/b/REAL_stack.v2.tif")), file=pixels.slice_file_name(F.lit("real"), F.lit(7)),
    )
    assert row.a == pytest.approx(9.938441702975688e-4) and row.b == pytest.approx(5e-4) and row.c == pytest.approx(0.0)
    assert row[3:] == ("loss-ce_lr-0.0003_seed-2025", "1e-05", "1.23457e+06", "0.1", "100", "Real_stack", "real_0007.png")


def test_bin_porosities(spark):
    weights = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.25))
    solved = values(spark, p=synthetic.solve_bin_porosities(weights, F.lit(0.5))).p
    assert solved == pytest.approx([0.15218961522006896, 0.3043792304401379, 0.15218961522006896], abs=1e-15)


def test_spec_bins_fall_back_to_three(spark):
    specs = spark.createDataFrame(
        [("a", {"generator": "lognormal", "psd_lognorm_mu": "5.9"}), ("b", {"psd_bins_nm": "10, 20", "psd_weights": "1"}),
         ("c", {"psd_mean_nm": "30", "psd_std_nm": "25", "voxel_size_nm": "2"})],
        "spec string, settings map<string,string>",
    )
    rows = {}
    for r in synthetic.psd_bins(specs).orderBy("spec", "bin").collect():
        rows.setdefault(r.spec, []).append((r.diameter_vox, r.weight))
    assert rows["a"] == [(11, 0.25), (15, 0.5), (19, 0.25)] == rows["b"]
    assert rows["c"] == [(5, 0.25), (15, 0.5), (28, 0.25)]


def test_tracking_clamps_and_shifts_down_for_negative_rates(spark):
    box = spark.createDataFrame([("a", 1200, 630, 20, 180, 1840, 480)], "volume_id string, n_slices int, h int, x_min int, y_min int, x_max int, y_max int")
    tracked = {r.z: (r.y_min, r.y_max) for r in roi.track_shifting_box(box, -0.15).collect()}
    assert tracked[0] == (180, 480) and tracked[100] == (195, 495) and tracked[1199] == (330, 630) and len(tracked) == 1200
    up = {r.z: (r.y_min, r.y_max) for r in roi.track_shifting_box(box, 0.5).collect()}
    assert up[100] == (130, 430) and up[1199] == (0, 300)


def test_key_boxes_truncate_and_leave_the_outside(spark):
    keys = spark.createDataFrame([("a", 1, 10, 0, 50, 9), ("a", 5, 21, 4, 40, 9)], "volume_id string, z int, x_min int, y_min int, x_max int, y_max int")
    boxes = {r.z: tuple(r)[2:] for r in roi.keyframe_interpolate(keys).collect()}
    assert sorted(boxes) == [1, 2, 3, 4, 5] and boxes[2] == (12, 1, 47, 9) and boxes[5] == (21, 4, 40, 9)


def test_region_without_pixels_gives_zeros(spark):
    rows = [("a", z, y, x, 10 * z + y, False) for z in range(2) for y in range(2) for x in range(2)]
    rows += [("b", 0, y, 0, 100 * y, y < 3) for y in range(4)]
    joint = spark.createDataFrame(rows, "volume_id string, z int, y int, x int, v int, region boolean").groupBy("volume_id", "z", "v", "region").count().withColumnRenamed("count", "n")
    result = {r.volume_id: r for r in porosity.region_porosity(porosity.region_pore_mask(joint)).collect()}
    assert tuple(result["a"])[1:] == (0.0, 0.0, 0.0, 0.0, 0.0, 0, 0)
    # mean 150 * 0.8 = 120: of the region values 0, 100, 200 only 200 is above.
    assert result["b"].porosity == pytest.approx(100 / 3) and result["b"].pore_voxels == 1


def test_encodings_and_polarity(stack):
    unit = layouts.slices_to_hist(stack({"a": np.array([[[0, 1, 1, 1]]], np.uint8), "b": np.array([[[0, 127, 128, 255]]], np.uint8)}))

    def of(**rule):
        return {r.volume_id: r.porosity for r in porosity.volume_porosity(porosity.pore_mask(unit, **rule)).collect()}

    assert of() == {"a": 25.0, "b": 50.0}
    assert of(pores_are_black=False) == {"a": 75.0, "b": 50.0}
    assert of(encoding="u8", threshold=0) == {"a": 25.0, "b": 25.0}


def test_histogram_totals_and_volume_mean(stack):
    volume = RNG.integers(0, 256, (6, 5, 7)).astype(np.uint8)
    hist = layouts.slices_to_hist(stack({"a": volume}))
    assert hist.agg(F.sum("n")).first()[0] == volume.size
    marked = porosity.pore_mask(hist)
    mean = porosity.slice_porosity_stats(marked).first().mean_porosity
    assert porosity.volume_porosity(marked).first().porosity == pytest.approx(mean)


def test_matching_to_itself_changes_nothing(stack, volume_of):
    image = RNG.integers(0, 256, (5, 7)).astype(np.uint8)
    slices = stack({"a": np.stack([image, np.roll(image, 3), 255 - image])})
    lookup = histograms.match_histogram(layouts.slices_to_hist(slices), training.ref_slice(layouts.manifest(slices)))
    matched = volume_of(histograms.apply_lookup(slices, lookup), "a")
    assert np.array_equal(matched[0], image) and np.array_equal(matched[1], np.roll(image, 3))
    # Equal counts per value on both sides: the matched values are the reference values in order.
    assert sorted(matched[2].ravel().tolist()) == sorted(np.interp(
        np.searchsorted(np.sort(255 - image.ravel()), 255 - image.ravel(), "right") / 35, np.unique(image, return_counts=True)[1].cumsum() / 35, np.unique(image)
    ).astype(int).tolist())


def test_otsu_splits_two_levels(spark):
    hist = spark.createDataFrame([("a", 10, 50), ("a", 12, 50), ("a", 200, 30), ("b", 5, 9)], "volume_id string, v int, n long")
    plain = {r.volume_id: r.threshold for r in histograms.otsu_threshold(hist, ["volume_id"], integer=True).collect()}
    assert plain == {"a": 12.0, "b": 5.0}
    binned = {r.volume_id: r.threshold for r in histograms.otsu_threshold(hist, ["volume_id"]).collect()}
    assert binned["b"] == pytest.approx(5) and binned["a"] == pytest.approx(10 + 2.5 * 190 / 256)
    marked = histograms.binarize_volume(hist.withColumn("z", F.lit(0)))
    assert {(r.volume_id, r.solid) for r in marked.select("volume_id", "solid").collect()} >= {("b", True), ("a", True), ("a", False)}


def test_crop_then_pad_is_identity(stack, volume_of):
    volume = RNG.integers(0, 256, (2, 16, 32)).astype(np.uint8)
    padded = images.pad_to_multiple(images.crop(stack({"a": volume}), 0, 13, 0, 30), 16)
    back = volume.copy()
    back[:, 13:], back[:, :, 30:] = 0, 0
    assert np.array_equal(volume_of(padded, "a"), back)
    twice = images.flip(images.flip(stack({"a": volume}), True, True), True, True)
    assert np.array_equal(volume_of(twice, "a"), volume)
    with pytest.raises(Exception, match="smaller than the crop"):
        images.crop_around(stack({"a": volume}), 5, 5, 20).collect()


def test_odd_target_sizes(spark, stack):
    volume = RNG.integers(1, 256, (2, 8, 8)).astype(np.uint8)
    boxes = spark.createDataFrame([("a", 0, 2, 4, 1, 3), ("a", 1, None, None, None, None)], "volume_id string, z int, min_row int, max_row int, min_col int, max_col int")
    for compat, size in ((False, 5), (True, 4)):
        rows = images.fit_to_size(stack({"a": volume}), boxes, 5, 5, compat).orderBy("z").collect()
        assert (rows[0].h, rows[0].w) == (size, size) and (rows[1].h, rows[1].w) == (5, 5)
        fitted = np.frombuffer(rows[0].data, np.uint8).reshape(size, size)
        assert np.array_equal(fitted[1:4, 1:4], volume[0, 2:5, 1:4][: size - 1, : size - 1])
        assert not np.frombuffer(rows[1].data, np.uint8).any()


def test_reference_slice_out_of_range(spark):
    volumes = spark.createDataFrame([("a", 5)], "volume_id string, n_slices int")
    assert training.ref_slice(volumes).first().z == 2 and training.ref_slice(volumes, 4).first().z == 4
    with pytest.raises(Exception, match="out of range"):
        training.ref_slice(volumes, 5).collect()


def test_scores_without_positives(spark):
    pixels_ = spark.createDataFrame([("b", "s", 0, x, 0.1, 0) for x in range(4)], "batch string, slice string, y int, x int, p1 double, t int")
    sums = scoring.slice_sums(pixels_)
    assert scoring.iou_class1(sums).first().value == 0.0 and scoring.pixel_accuracy(sums).first().value == 1.0
    assert scoring.cross_entropy(sums).first().value == pytest.approx(-math.log(0.9))
    with pytest.raises(ValueError, match="unknown loss"):
        scoring.combined_loss(sums, "mse")


def test_checkpoints_need_a_strict_gain(spark):
    rows = [("r", 1, 0.0, 0.3), ("r", 2, 0.5, 0.1), ("r", 3, 0.5, 0.9), ("r", 4, 0.4, 0.95), ("q", 1, 0.0, 0.2)]
    history = spark.createDataFrame(rows, "run string, epoch int, val_pixAcc double, val_IoU_pos double")
    best = {r.run: tuple(r)[1:] for r in training.best_checkpoint(history).collect()}
    assert best == {"r": (2, 0.5, 0.1)}
    by_iou = {r.run: tuple(r)[1:] for r in training.best_checkpoint(history, "val_IoU_pos").collect()}
    assert by_iou == {"r": (4, 0.5, 0.95), "q": (1, 0.0, 0.2)}
    stopped = training.early_stop(history.withColumn("val_pixAcc", F.col("val_pixAcc") * 2), 0.99)
    assert stopped.count() == 3


def test_running_maximum_crosses_blocks(spark):
    scores = RNG.random(500).tolist()
    frame = spark.createDataFrame([("r", i, s) for i, s in enumerate(scores)], "run string, epoch int, s double")
    result = {r.epoch: r.b for r in ordering.running_max_before(frame, ["run"], "epoch", "s", "b", block=7).collect()}
    assert result[0] is None and all(result[i] == max(scores[:i]) for i in range(1, 500))


def test_ranks_of_a_hot_key_use_many_buckets(spark):
    names = [f"n{random.Random(i).random()}" for i in range(6000)]
    keys = ["hot" if i % 3 else f"k{i % 50}" for i in range(6000)]
    frame = spark.createDataFrame(list(zip(keys, names)), ["key", "name"])
    ranked = {r.name: r["rank"] for r in ordering.rank_rows(frame, ["key"], ["name"], "rank").collect()}
    expected = {}
    for key in set(keys):
        expected.update({n: i for i, n in enumerate(sorted(n for k, n in zip(keys, names) if k == key))})
    assert ranked == expected


def test_ranges_stay_bounded(spark):
    """One key, and one row, fill a third of the table; each range still holds its share only."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for partitions in (8, 24):
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            frame = spark.range(24000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 7).alias("k"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("v"))
            sizes = ordering.dealt_in_ranges(frame, ["k"], ["v"]).groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count"), F.count("*")).first()
            assert sizes[1] == partitions and sizes[0] < 2.5 * 24000 / partitions
            ranks = ordering.rank_rows(frame, ["k"], ["v"], "r", total="n").groupBy("k").agg(F.max("r") + 1, F.count_distinct("r"), F.max("n"), F.count("*")).collect()
            assert all(len(set(row[1:])) == 1 for row in ranks) and len(ranks) == 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_boxplots_read_their_input_once(spark, tmp_path):
    spark.range(1000).select((F.col("id") % 4).alias("k"), (F.col("id") % 100).cast("double").alias("v")).write.parquet(str(tmp_path / "t"))
    plan = psd.boxplot_stats(spark.read.parquet(str(tmp_path / "t")), ["k"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "parquet" not in plan.lower()  # all from the stored counts


def test_percentiles_of_repeated_values(spark):
    data = [5.0] * 4000 + RNG.normal(size=2001).tolist()
    frame = spark.createDataFrame([(1, v) for v in data], "k int, v double")
    got = ordering.exact_percentiles(frame, ["k"], "v", [0.0, 0.1, 0.25, 0.5, 1.0]).first()
    assert list(got)[1:] == pytest.approx(np.quantile(data, [0.0, 0.1, 0.25, 0.5, 1.0]).tolist())
    box = psd.boxplot_stats(frame, ["k"], "v").first()
    q1, q3 = np.quantile(data, [0.25, 0.75])
    inside = [v for v in data if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
    assert (box.whisker_low, box.whisker_high, box.n_outliers) == (min(inside), max(inside), len(data) - len(inside))


def test_split_sizes(spark):
    for n, share, expected in ((30, 0.1, 3), (5, 0.1, 1), (29, 0.1, 2)):
        files = spark.createDataFrame([(f"f{i}",) for i in range(n)], ["name"])
        parts = {r.part: r["count"] for r in training.train_val_split(files, share=share).groupBy("part").count().collect()}
        assert parts == {"val": expected, "train": n - expected}


def test_rename_skips_taken_targets(spark):
    names = ["synthetic_2_7.png", "synthetic_3_7.PNG", "synthetic_10_150.png", "synthetic_11_3.png", "synthetic_1_8.png", "slice_0008.png", "synthetic_0_00009.png"]
    files = spark.createDataFrame([("d", n) for n in names], ["dir", "name"])
    plan = {r.name: (r.target, r.action) for r in renaming.rename_plan(files).collect()}
    assert plan == {
        "synthetic_2_7.png": ("slice_0007.png", "rename"), "synthetic_3_7.PNG": ("slice_0007.png", "skip_exists"),
        "synthetic_10_150.png": (None, "skip_range"), "synthetic_1_8.png": ("slice_0008.png", "skip_exists"),
        "synthetic_0_00009.png": ("slice_0009.png", "rename"),
    }
    counts = renaming.rename_counts(renaming.rename_plan(files)).first()
    assert (counts.changed, counts.skipped) == (2, 3)


def nearest(a, b):
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2).min(axis=1))


@pytest.mark.parametrize("case", ["spread", "hot cell", "far cluster", "single", "coarse grid"])
def test_nearest_points_in_dense_and_sparse_clouds(spark, case, monkeypatch):
    if case == "coarse grid":
        monkeypatch.setattr(meshes, "CELL_POINTS", 100)  # every cell is crowded: pyramids inside cells
    a = RNG.normal(size=(150, 3)) * 10
    b = RNG.normal(size=(200, 3)) * 10
    if case == "hot cell":
        b[:120] = 3 + RNG.normal(size=(120, 3)) * 1e-5
        a[:50] = 3 + RNG.normal(size=(50, 3)) * 1e-5
    if case == "far cluster":
        b = 1e4 + RNG.normal(size=(200, 3))
    if case == "single":
        b = b[:1]

    def frame(points, cloud="c"):
        return spark.createDataFrame([(cloud, *map(float, p)) for p in points], "cloud string, x double, y double, z double")

    leaf = 3 if case == "coarse grid" else meshes.LEAF
    result = meshes.nearest_neighbour_distance(frame(np.concatenate([a, a[:5]])).unionByName(frame(a[:2], "lonely")), frame(b), leaf=leaf)
    rows = result.collect()
    found = {(r.x, r.y, r.z): (r.n, r.distance) for r in rows if r.cloud == "c"}
    expected = nearest(a, b)
    assert len(found) == 150 and sum(n for n, _ in found.values()) == 155
    assert all(found[tuple(p)][1] == pytest.approx(d, rel=1e-12, abs=1e-12) for p, d in zip(a, expected))
    assert [r.distance for r in rows if r.cloud == "lonely"] == [None, None]


def test_sections_of_a_tilted_tetrahedron(spark):
    corners = np.array([[0, 0, 0], [4, 1, 0.5], [1, 5, 1], [1, 1, 6]], float)
    faces = [(0, 2, 1), (0, 1, 3), (1, 2, 3), (2, 0, 3)]
    rows = [("t", *corners[list(f)].ravel().tolist()) for f in faces]
    names = ["mesh_id"] + [f"{p}{d}" for p in "abc" for d in "xyz"]
    triangles = spark.createDataFrame(rows, names)
    measured = meshes.mesh_volume_area(triangles).first()
    assert measured.volume == pytest.approx(abs(np.linalg.det(corners[1:] - corners[0])) / 6)
    for axis in "xyz":
        areas = [r.area for r in meshes.mesh_section_area(triangles, 400, axis).orderBy("plane").collect()]
        along = corners[:, "xyz".index(axis)]
        assert len(areas) == 400 and min(areas) >= 0
        assert np.trapezoid(areas, np.linspace(along.min(), along.max(), 400)) == pytest.approx(measured.volume, rel=1e-3)


def test_bounding_box_porosity_of_known_volume(spark):
    frame = spark.createDataFrame([("voxel_direct", 2188244.625), ("mc_filled", -2421851.0)], ["mesh_id", "volume"])
    rows = {r.mesh_id: r for r in meshes.mesh_bbox_porosity(frame, F.lit(150.0**3)).collect()}
    assert rows["voxel_direct"].porosity == pytest.approx(0.3516312222, abs=1e-9) and rows["voxel_direct"].orientation_ok
    assert rows["mc_filled"].porosity > 1 and not rows["mc_filled"].orientation_ok


def test_manifests_disagree(stack):
    left = stack({"a": np.zeros((2, 3, 4), np.uint8), "b": np.zeros((2, 3, 4), np.uint8), "c": np.zeros((1, 3, 4), np.uint8)})
    right = stack({"a": np.zeros((2, 3, 4), np.uint8), "b": np.zeros((2, 3, 5), np.uint8), "d": np.zeros((1, 3, 4), np.uint8)})
    status = {r.volume_id: r.status for r in layouts.compare_manifests(left, right).collect()}
    assert status == {"a": "ok", "b": "xy_mismatch", "c": "missing", "d": "missing"}


def test_packing_voxels_fills_gaps(spark, volume_of):
    voxels = spark.createDataFrame([("a", 0, 0, 1, 9), ("a", 0, 1, 0, 200)], layouts.VOXEL_SCHEMA)
    assert volume_of(layouts.voxels_to_slices(voxels, 2, 3), "a").tolist() == [[[0, 9, 0], [200, 0, 0]]]


def test_no_global_sort_or_cartesian_in_the_hot_plans(spark, sf_dir):
    from voxelloom.plans.all_queries import QUERIES

    for name in ("volume_and_slice_report", "slice_porosity", "match_histogram", "binary_open", "mesh_section_area", "focal_loss"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "SinglePartition" not in plan
