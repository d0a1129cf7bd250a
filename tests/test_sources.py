"""Readers and writers on small files made by the tests."""

import io
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom import layouts, sinks
from voxelloom.operators import images, meshes, porosity
from voxelloom.sources import images as image_sources
from voxelloom.sources import specs, tables
from voxelloom.streaming import slices as stream

RNG = np.random.default_rng(11)


def png(pixels):
    """8-bit gray or RGB array as PNG bytes."""
    h, w = pixels.shape[:2]
    kind = 0 if pixels.ndim == 2 else 2
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)

    def chunk(tag, body):
        return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))

    head = struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def tiff(pixels):
    """8-bit gray array as an uncompressed one-page TIFF."""
    h, w = pixels.shape
    tags = [(256, 4, w), (257, 4, h), (258, 3, 8), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, h), (279, 4, h * w)]
    body = pixels.tobytes() + b"\0" * (h * w % 2)
    entries = b"".join(
        struct.pack("<HHI", tag, kind, 1) + (struct.pack("<HH", value, 0) if kind == 3 else struct.pack("<I", value))
        for tag, kind, value in tags
    )
    return b"II*\0" + struct.pack("<I", 8 + len(body)) + body + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0"


def test_slice_folder_sorts_names_and_skips_bad_files(spark, tmp_path, volume_of):
    folder = tmp_path / "vol_a"
    folder.mkdir()
    pictures = {name: RNG.integers(0, 256, (5, 7)).astype(np.uint8) for name in ("s_10.png", "s_2.png", "s_1.PNG")}
    for name, picture in pictures.items():
        (folder / name).write_bytes(png(picture))
    (folder / "s_3.tif").write_bytes(tiff(RNG.integers(0, 256, (5, 7)).astype(np.uint8)))
    (folder / "s_9.png").write_bytes(b"no picture")
    (folder / "notes.txt").write_text("x")
    slices = image_sources.read_slice_folder(spark, str(folder))
    names = [r.name for r in slices.orderBy("z").collect()]
    assert names == ["s_1.PNG", "s_10.png", "s_2.png", "s_3.tif"]
    assert np.array_equal(volume_of(slices, "vol_a")[1], pictures["s_10.png"])
    everything = image_sources.read_images(spark, str(folder), keep_corrupt=True)
    assert {r.status: r.n for r in image_sources.count_by_status(everything).collect()} == {"ok": 4, "corrupt": 1}
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "a.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        image_sources.read_slice_folder(spark, str(empty))


def test_gray_modes_and_tree(spark, tmp_path):
    folder = tmp_path / "root" / "inner"
    folder.mkdir(parents=True)
    colour = RNG.integers(0, 256, (3, 4, 3)).astype(np.uint8)
    (folder / "c.png").write_bytes(png(colour))
    wide = colour.astype(int)
    expected = {
        "first": wide[..., 0],
        "mean": wide.mean(axis=2).astype(int),
        "luma": (wide[..., 0] * 19595 + wide[..., 1] * 38470 + wide[..., 2] * 7471 + 32768) >> 16,
    }
    for mode, pixels in expected.items():
        row = image_sources.read_slice_tree(spark, str(tmp_path / "root"), mode).first()
        assert row.name == "inner/c.png" and row.volume_id == "inner"
        assert np.array_equal(np.frombuffer(row.data, np.uint8).reshape(3, 4), pixels)


def test_npy_volumes(spark, tmp_path, volume_of):
    volume = RNG.normal(size=(3, 4, 5)).astype(np.float32)
    np.save(tmp_path / "v.npy", volume)
    np.save(tmp_path / "flat.npy", np.arange(6, dtype=np.uint16).reshape(2, 3))
    slices = image_sources.read_npy_volumes(spark, str(tmp_path))
    assert np.array_equal(volume_of(slices, "v"), volume)
    assert volume_of(slices, "flat").tolist() == [[[0, 1, 2], [3, 4, 5]]]
    np.save(tmp_path / "bad.npy", np.zeros(3))
    with pytest.raises(Exception, match="expected a 2D or 3D array"):
        image_sources.read_npy_volumes(spark, str(tmp_path)).collect()


def test_spec_text_rules(spark, tmp_path):
    text = "\ufeffnx: 5\r\n# note\n\n ny\u00a0=\t7 # tail\nout=c:/x\nnx : 6\nplain\n: 3\nname = a=b\nlist: 1, ,2.5 ,\n"
    (tmp_path / "a.txt").write_bytes(text.encode("utf-8"))
    (tmp_path / "b.txt").write_bytes("nx: 5\nauthor: J\xf6rg\n".encode("latin-1"))
    parsed = {r.spec[-5]: r for r in specs.parse_specs(specs.read_spec_texts(spark, str(tmp_path))).collect()}
    assert parsed["a"].settings == {"nx": "6", "ny": "7", "out=c": "/x", "name": "a=b", "list": "1, ,2.5 ,"}
    assert parsed["b"].settings == {"nx": "5", "author": "Jörg"}
    frame = specs.parse_specs(specs.read_spec_texts(spark, str(tmp_path / "a.txt")))
    row = frame.select(specs.float_list(specs.setting("list")).alias("l"), specs.missing_keys().alias("m")).first()
    assert row.l == [1.0, 2.5] and row.m == ["nz", "overall_porosity"]


def test_recon_results_keep_failed_methods(spark, tmp_path):
    for i in range(3):
        folder = tmp_path / f"synthetic_{i}"
        folder.mkdir()
        good = {"chamfer_distance": 70.0 + i, "pred_volume": 10.0, "gt_volume": 2.0, "success": True}
        bad = {"success": False, "error": "empty"} if i else good
        (folder / "results.json").write_text(json.dumps({"mc_basic": good, "dual_contour": bad}, indent=2))
    records = tables.read_recon_results(spark, str(tmp_path / "*" / "results.json"))
    rows = {(r.id, r.method): r for r in records.collect()}
    assert len(rows) == 6 and rows[("synthetic_2", "dual_contour")].error == "empty"
    summary = {r.method: (r.n_ok, r.n_failed, r.mean_chamfer_distance) for r in meshes.method_summary(records).collect()}
    assert summary == {"mc_basic": (3, 0, 71.0), "dual_contour": (1, 2, 70.0)}
    assert meshes.recon_ratios(records).count() == 4


def test_json_tables_and_lighting(spark, tmp_path):
    lights = {"radius": 2.0, "height": 2.8, "theta": 88.0, "light_intensity": 300.0, "obj_path": "C:/a b/synthetic_4/x.obj"}
    (tmp_path / "one.json").write_text(json.dumps(lights))
    (tmp_path / "many.json").write_text(json.dumps([{"id": "synthetic_4", "golden_porosity": 0.5}, {"id": "synthetic_5"}]))
    one = tables.read_json_table(spark, str(tmp_path / "one.json"), tables.LIGHTING_SCHEMA)
    many = tables.read_json_table(spark, str(tmp_path / "many.json"), tables.ESTIMATE_SCHEMA).select("id", "golden_porosity")
    joined = tables.lighting_join(one, many).collect()
    assert [(r.id, r.height_per_radius, r.golden_porosity) for r in joined] == [("synthetic_4", 1.4, 0.5)]


def test_history_round_trip(spark, tmp_path):
    rows = [("r1", e, 1.0 / e, 0.5, 0.25, 0.1) for e in (1, 2, 3)] + [("r2", 1, 2.0, 0.5, 0.25, 0.1)]
    columns = ["run", "epoch", "train_loss", "val_pixAcc", "val_IoU_pos", "lr"]
    history = spark.createDataFrame(rows, columns)
    sinks.write_history_csv(history, str(tmp_path / "csv"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "csv"))
    assert back.columns[:2] == ["epoch", "train_loss"] and back.count() == 4
    folder = tmp_path / "json" / "r9"
    folder.mkdir(parents=True)
    (folder / "history.json").write_text(json.dumps([{"epoch": 1, "train_loss": 0.5, "val_pixAcc": 0.9, "val_IoU_pos": 0.8, "lr": 0.1}]))
    read = tables.read_history(spark, str(tmp_path / "json" / "*")).first()
    assert (read.run, read.epoch, read.val_pixAcc) == ("r9", 1, 0.9)
    read = tables.read_history(spark, str(tmp_path / "csv" / "*" / "*.csv"), "csv").where("run = 'run=r1'")
    assert read.count() == 3


def test_slice_sink_reads_back_only_the_range(spark, tmp_path, stack, volume_of):
    volume = RNG.integers(0, 256, (10, 3, 4)).astype(np.uint8)
    sinks.write_slices(stack({"a": volume}), str(tmp_path / "s"), z_block=4)
    part = sinks.read_slices(spark, str(tmp_path / "s"), 3, 6, z_block=4)
    assert np.array_equal(volume_of(part, "a"), volume[3:7])
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(z_block" in plan and "PushedFilters: [IsNotNull(z)" in plan
    sinks.write_volume(stack({"m": (volume > 99).astype(np.uint8)}), str(tmp_path / "m"), display=True)
    shown = volume_of(sinks.read_slices(spark, str(tmp_path / "m")), "m")
    assert np.array_equal(shown, (volume > 99) * 255)


def test_statistics_sinks(spark, tmp_path, stack):
    volume = RNG.integers(0, 256, (4, 3, 4)).astype(np.uint8)
    marked = porosity.pore_mask(layouts.slices_to_hist(stack({"a": volume})))
    stats = porosity.volume_porosity(marked).join(porosity.slice_porosity_stats(marked), "volume_id")
    sinks.write_stats_csv(stats, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).columns == stats.columns
    sinks.write_stats_json(stats, str(tmp_path / "json"))
    value = spark.read.json(str(tmp_path / "json")).first().porosity
    assert value == round(float((volume <= 127).mean() * 100), 6)
    sinks.write_report(porosity.format_report(stats, "A"), str(tmp_path / "txt"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "txt")).collect()]
    assert lines[0] == "=== A Porosity Analysis ===" and lines[2] == f"Overall porosity: {(volume <= 127).mean() * 100:.4f}%"


def test_arriving_slices_give_the_batch_porosity(spark, tmp_path, stack):
    volume = RNG.integers(0, 256, (6, 3, 4)).astype(np.uint8)
    slices = stack({"a": volume})
    for i in range(3):
        slices.where(f"z div 2 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = stream.write_slice_porosity(
        stream.read_arriving_slices(spark, str(tmp_path / "in"), files_per_trigger=1),
        str(tmp_path / "out"), str(tmp_path / "chk"), encoding="u8",
    )
    query.awaitTermination(120)
    got = {r.z: r.porosity for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    expected = {z: float((image <= 127).mean() * 100) for z, image in enumerate(volume)}
    assert got == pytest.approx(expected)


def test_failed_slices_are_kept_apart(spark, stack):
    volume = RNG.integers(0, 256, (3, 5, 7)).astype(np.uint8)

    def load():
        def predict(image):
            assert image.shape == (16, 16)
            if image.max() > 0.999:
                raise ValueError("too bright")
            return image

        return predict

    volume[1, 0, 0] = 255
    volume[[0, 2]] = np.minimum(volume[[0, 2]], 250)
    scored = images.score_slices(stack({"a": volume}), load, threshold=0.5)
    assert [r.error for r in scored.orderBy("z").collect()] == [None, "too bright", None]
    kept = images.drop_failed(scored).orderBy("z").collect()
    assert [r.z for r in kept] == [0, 2]
    assert np.array_equal(np.frombuffer(kept[1].data, np.uint8).reshape(5, 7), volume[2] / 255 > 0.5)
