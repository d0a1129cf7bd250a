"""Per-pixel maps, crops, resampling, rotation, file names and slice choices on the test tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from voxelloom import layouts
from voxelloom.functions import pixels
from voxelloom.operators import images, renaming, roi, rotation, synthetic, training
from voxelloom.ordering import rank_rows
from voxelloom.plans.registry import DENSE, VOX, plain, query
from voxelloom.sources import images as image_sources
from voxelloom.sources import testdata

KEY = ["volume_id", "z", "y", "x"]


def per_slice(voxels, value="f"):
    """Voxels with the extremes of their slice; a slice of the test stacks is 1024 pixels."""
    ends = voxels.groupBy("volume_id", "z").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return voxels.join(ends, ["volume_id", "z"])


@query(f"""WITH {VOX}, e AS (SELECT volume_id, z, min(f) AS lo, max(f) AS hi FROM vox GROUP BY 1, 2)
SELECT volume_id, z, y, x, CASE WHEN hi > lo THEN trunc((f - lo) / (hi - lo) * 255)::BIGINT ELSE 0 END AS u8 FROM vox JOIN e USING (volume_id, z)""")
def normalize_u8(spark, sf):
    voxels = per_slice(testdata.voxels(spark, sf))
    return plain(voxels.select(*KEY, pixels.normalize_u8("f", "lo", "hi").alias("u8")))


@query(f"""WITH {VOX}, e AS (SELECT volume_id, z, max(v) AS hi FROM vox GROUP BY 1, 2)
SELECT volume_id, z, y, x, round(v / nullif(hi, 0)::DOUBLE, 6) AS share FROM vox JOIN e USING (volume_id, z)""")
def normalize_max(spark, sf):
    voxels = per_slice(testdata.voxels(spark, sf), "v")
    return plain(voxels.select(*KEY, pixels.normalize_max("v", "hi").alias("share")))


def wide_slices(spark, sf):
    """The stacks as 16-bit pixels."""
    return layouts.map_slices(testdata.slices(spark, sf), lambda image: image.astype(np.uint16) * 200 + 7, "uint16")


WIDE = f"""{DENSE}, wide AS (SELECT volume_id, z, y, x, v * 200.0::DOUBLE + 7 AS v FROM dense),
ends AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM wide WINDOW w AS (PARTITION BY {{keys}}))
SELECT volume_id, z, y, x, CASE WHEN hi > lo THEN trunc((v - lo) / (hi - lo) * 255)::BIGINT ELSE 0 END AS v FROM ends"""


@query("WITH " + WIDE.format(keys="volume_id, z"))
def normalize_slices(spark, sf):
    return plain(layouts.slices_to_voxels(images.normalize_slices(wide_slices(spark, sf))))


@query("WITH " + WIDE.format(keys="volume_id"))
def normalize_volumes(spark, sf):
    return plain(layouts.slices_to_voxels(images.normalize_slices(wide_slices(spark, sf), "volume")))


@query(f"WITH {VOX} SELECT volume_id, z, y, x, round(v / 255.0::DOUBLE, 6) AS unit FROM vox")
def to_unit(spark, sf):
    return plain(testdata.voxels(spark, sf).select(*KEY, pixels.to_unit("v").alias("unit")))


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, r, g, b, (r * 19595 + g * 38470 + b * 7471 + 32768)::BIGINT // 65536 AS luma, round((r + g + b) / 3.0::DOUBLE, 6) AS mean, r AS first
FROM (SELECT l_orderkey, l_linenumber, l_orderkey % 256 AS r, l_partkey % 256 AS g, l_suppkey % 256 AS b FROM lineitem)""")
def rgb_to_gray(spark, sf):
    colours = testdata.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_orderkey") % 256).alias("r"), (F.col("l_partkey") % 256).alias("g"), (F.col("l_suppkey") % 256).alias("b")
    )
    gray = [pixels.rgb_to_gray("r", "g", "b", mode).alias(mode) for mode in ("luma", "mean", "first")]
    return plain(colours.select("*", *gray))


@query(f"WITH {VOX} SELECT volume_id, z, y, x, (CASE WHEN v > 0 THEN 1 ELSE 0 END)::BIGINT AS m FROM vox")
def mask_binarize(spark, sf):
    return plain(testdata.voxels(spark, sf).select(*KEY, pixels.mask_binarize("v").alias("m")))


@query(f"WITH {VOX} SELECT volume_id, z, y, x, (CASE WHEN v > 127 THEN 255 ELSE 0 END)::BIGINT AS shown, (CASE WHEN v > 127 THEN 0 ELSE 255 END)::BIGINT AS inverted FROM vox")
def binary_to_display(spark, sf):
    mask = testdata.voxels(spark, sf).withColumn("m", (F.col("v") > 127).cast("int"))
    return plain(mask.select(*KEY, pixels.binary_to_display("m").alias("shown"), pixels.binary_to_display("m", True).alias("inverted")))


@query(f"WITH {VOX} SELECT volume_id, z, y, x, CASE WHEN (x + y) % 5 = 0 THEN 255 ELSE trunc(v * (200.0::DOUBLE / 255.0::DOUBLE))::BIGINT END AS shown FROM vox")
def highlight_overlay(spark, sf):
    marked = testdata.voxels(spark, sf).withColumn("m", (F.col("x") + F.col("y")) % 5 == 0)
    return plain(marked.select(*KEY, pixels.highlight_overlay("v", "m").alias("shown")))


@query(f"WITH {DENSE} SELECT volume_id, z, y, 63 - x AS x, v FROM dense")
def hflip(spark, sf):
    return plain(layouts.slices_to_voxels(images.flip(testdata.slices(spark, sf), horizontal=True)))


@query(f"WITH {DENSE} SELECT volume_id, z, 15 - y AS y, x, v FROM dense")
def vflip(spark, sf):
    return plain(layouts.slices_to_voxels(images.flip(testdata.slices(spark, sf), vertical=True)))


@query(f"WITH {VOX} SELECT volume_id, z, y, x, round(pow(v / 255.0::DOUBLE, 0.97::DOUBLE), 6) AS g FROM vox")
def gamma(spark, sf):
    return plain(testdata.voxels(spark, sf).select(*KEY, pixels.gamma("v", 0.97).alias("g")))


@query(f"""WITH {VOX}, c AS (SELECT *, ('0x' || substr(md5('slice_' || z || '|7|flip'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS coin FROM vox)
SELECT volume_id, z, y, CASE WHEN coin < 0.5 THEN 63 - x ELSE x END AS x, round(pow(v / 255.0::DOUBLE, 1.05::DOUBLE), 6) AS img, (CASE WHEN v > 120 THEN 1 ELSE 0 END)::BIGINT AS mask FROM c""")
def compose_pair(spark, sf):
    pairs = testdata.voxels(spark, sf).withColumn("mask", (F.col("v") > 120).cast("int"))
    flipped = pixels.coin(F.concat(F.lit("slice_"), F.col("z").cast("string")), 7, "flip") < 0.5
    transform = training.compose_pair(
        lambda df: images.flip_voxels(df, "x", 64, flipped), lambda df: df.withColumn("img", pixels.gamma("v", 1.05))
    )
    return plain(transform(pairs).select(*KEY, "img", "mask"))


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber,
greatest(0, least(round_even(cy, 0)::BIGINT - 75, 300 - 150)) AS y0, greatest(0, least(round_even(cx, 0)::BIGINT - 75, 1000 - 150)) AS x0
FROM (SELECT l_orderkey, l_linenumber, l_quantity * 5.5 AS cy, l_extendedprice / 100 AS cx FROM lineitem)""")
def crop_box_from_center(spark, sf):
    centres = testdata.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") * 5.5).alias("cy"), (F.col("l_extendedprice") / 100).alias("cx")
    )
    return plain(centres.select(
        "l_orderkey", "l_linenumber", pixels.crop_start("cy", F.lit(300), 150).alias("y0"), pixels.crop_start("cx", F.lit(1000), 150).alias("x0")
    ))


@query(f"WITH {DENSE} SELECT volume_id, z, y - 3 AS y, x - 20 AS x, v FROM dense WHERE y >= 3 AND y < 13 AND x >= 20 AND x < 50")
def crop(spark, sf):
    return plain(layouts.slices_to_voxels(images.crop(testdata.slices(spark, sf), 3, 13, 20, 50)))


@query(f"WITH {DENSE} SELECT volume_id, z, y - 4 AS y, x - 52 AS x, v FROM dense WHERE y >= 4 AND x >= 52")
def crop_around(spark, sf):
    return plain(layouts.slices_to_voxels(images.crop_around(testdata.slices(spark, sf), 30.0, 61.5, 12)))


@query(f"""WITH {DENSE}, g AS (SELECT volume_id, z, a AS y, b AS x FROM (SELECT DISTINCT volume_id, z FROM dense), range(20) p(a), range(70) q(b))
SELECT g.volume_id, g.z, g.y, g.x, coalesce(d.v, 0) AS v FROM g LEFT JOIN dense d ON d.volume_id = g.volume_id AND d.z = g.z AND d.y = g.y AND d.x = g.x""")
def pad_to_multiple(spark, sf):
    return plain(layouts.slices_to_voxels(images.pad_to_multiple(testdata.slices(spark, sf), 10)))


@query(f"WITH {VOX} SELECT volume_id, x AS z, y, z AS x, v FROM vox")
def move_axis(spark, sf):
    axis = ["z", "y", "x"][pixels.axis_index("z")]
    return plain(testdata.voxels(spark, sf).select("volume_id", F.col(axis).alias("z"), "y", F.col("z").alias("x"), "v"))


@query("""SELECT p_partkey, greatest(1, round_even(p_retailprice / 10.0::DOUBLE, 0)::BIGINT) AS vox, greatest(1, round_even(p_size / 2.0::DOUBLE, 0)::BIGINT) AS small FROM part""")
def nm_to_vox(spark, sf):
    part = testdata.table(spark, sf, "part")
    return plain(part.select("p_partkey", pixels.nm_to_vox("p_retailprice", F.lit(10)).alias("vox"), pixels.nm_to_vox("p_size", F.lit(2)).alias("small")))


@query("""SELECT event_id, round(exp(value / 100) / (exp(value / 100) + exp(1 - value / 200)), 6) AS p1 FROM events""")
def softmax_p1(spark, sf):
    value = F.col("value")
    return plain(testdata.table(spark, sf, "events").select("event_id", pixels.softmax_p1(1 - value / 200, value / 100).alias("p1")))


@query(f"WITH {VOX} SELECT volume_id, z, y, x, (CASE WHEN 1 / (1 + exp(-8 * f)) > 0.45 THEN 1 ELSE 0 END)::BIGINT AS pred FROM vox")
def predict_threshold(spark, sf):
    p1 = pixels.softmax_p1(F.lit(0.0), F.col("f") * 8)
    return plain(testdata.voxels(spark, sf).select(*KEY, pixels.predict_threshold(p1, 0.45).alias("pred")))


@query("""WITH s AS (SELECT p_partkey, sqrt(ln(1 + (p_size / p_retailprice) * (p_size / p_retailprice))) AS sigma, p_retailprice AS m FROM part)
SELECT p_partkey, round(ln(m) - sigma * sigma / 2, 6) AS mu, round(sigma, 6) AS sigma FROM s""")
def lognormal_params(spark, sf):
    mu, sigma = pixels.lognormal_params("p_retailprice", "p_size")
    return plain(testdata.table(spark, sf, "part").select("p_partkey", mu.alias("mu"), sigma.alias("sigma")))


@query("""WITH s AS (SELECT s_suppkey, sqrt(ln(1 + 55.8 * 55.8 / ((100.0 + s_suppkey % 50) * (100.0 + s_suppkey % 50)))) AS sigma, 100.0::DOUBLE + s_suppkey % 50 AS m FROM supplier),
q AS (SELECT s_suppkey, i, 20 + i * 480.0::DOUBLE / 499 AS x, ln(m) - sigma * sigma / 2 AS mu, sigma FROM s, range(500) r(i)),
d AS (SELECT s_suppkey, i, x, exp(-(ln(x) - mu) * (ln(x) - mu) / (2 * sigma * sigma)) / (x * sigma * sqrt(2 * pi())) AS pdf FROM q),
a AS (SELECT *, sum((pdf + before) / 2 * (x - xb)) OVER (PARTITION BY s_suppkey) AS area FROM (SELECT *, lag(pdf) OVER w AS before, lag(x) OVER w AS xb FROM d WINDOW w AS (PARTITION BY s_suppkey ORDER BY i)))
SELECT s_suppkey, i::BIGINT AS i, round(x, 6) AS x, round(pdf / area, 6) AS pdf FROM a""")
def lognormal_pdf_grid(spark, sf):
    supplier = testdata.table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 50 + 100.0).alias("mean"), F.lit(55.8).alias("std"))
    return plain(synthetic.lognormal_curve(supplier, ["s_suppkey"], "mean", "std"))


@query("""SELECT event_id, round(value / 1000 * 0.5 * (1 + cos(pi() * (event_id % 20 + 1) / 20)), 6) AS lr FROM events""")
def cosine_lr(spark, sf):
    event = F.col("event_id")
    return plain(testdata.table(spark, sf, "events").select("event_id", pixels.cosine_lr(F.col("value") / 1000, event % 20 + 1, F.lit(20)).alias("lr")))


@query("""SELECT p_partkey, 'loss-' || lower(p_type) || '_lr-' || printf('%g', lr) || '_seed-' || p_size AS run,
upper(substr(split_part(p_name, ' ', 1), 1, 1)) || lower(substr(split_part(p_name, ' ', 1), 2)) AS label
FROM (SELECT *, CASE WHEN p_size % 3 = 0 THEN 0.001 WHEN p_size % 3 = 1 THEN p_size / 1000000.0::DOUBLE ELSE p_retailprice END::DOUBLE AS lr FROM part)""")
def derived_ids(spark, sf):
    size = F.col("p_size")
    lr = F.when(size % 3 == 0, F.lit(0.001)).when(size % 3 == 1, size / F.lit(1000000.0)).otherwise(F.col("p_retailprice"))
    path = F.concat(F.lit("data/Folder/"), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit(".tif"))
    return plain(testdata.table(spark, sf, "part").select(
        "p_partkey", pixels.experiment_name(F.lower("p_type"), lr, size).alias("run"), pixels.stem_label(path).alias("label")
    ))


@query("""SELECT p_partkey, i::BIGINT AS i, round(CASE WHEN i = 6 THEN p_retailprice - 0.01 ELSE p_size + 0.01 + i * (p_retailprice - 0.01 - p_size - 0.01) / 6 END, 6) AS pos,
trunc(CASE WHEN i = 6 THEN p_size::DOUBLE ELSE i * (p_size / 6.0::DOUBLE) END)::BIGINT AS whole FROM part, range(7) r(i)""")
def linspace(spark, sf):
    both = F.arrays_zip(pixels.mesh_positions("p_size", "p_retailprice", 7, 0.01).alias("a"), pixels.linspace(F.lit(0), "p_size", 7, True).alias("b"))
    return plain(testdata.table(spark, sf, "part").select("p_partkey", F.posexplode(both).alias("i", "p")).select("p_partkey", "i", F.col("p.a").alias("pos"), F.col("p.b").alias("whole")))


@query("""SELECT doc_id, printf('%s_%04d.png', source, (doc_id % 12000)::BIGINT) AS slice_name, printf('real_z%04d_y%04d_x%04d.png', (doc_id % 700)::BIGINT, (n_chars % 300)::BIGINT, (n_chars % 1000)::BIGINT) AS crop_name FROM documents""")
def name_slices(spark, sf):
    doc, n = F.col("doc_id"), F.col("n_chars")
    return plain(testdata.table(spark, sf, "documents").select(
        "doc_id", pixels.slice_file_name("source", doc % 12000).alias("slice_name"), pixels.crop_file_name(doc % 700, n % 300, n % 1000).alias("crop_name")
    ))


# Slices -------------------------------------------------------------------------------------------


@query(f"WITH {DENSE} SELECT volume_id, z, count(*)::BIGINT AS n FROM dense WHERE z >= 1 AND z < 1 + 5 GROUP BY 1, 2")
def slice_range(spark, sf):
    kept = training.slice_range(testdata.slices(spark, sf), 0, 5)
    return plain(kept.select("volume_id", "z", F.length("data").alias("n")))


@query(f"WITH {DENSE} SELECT d.volume_id, d.z, d.y, d.x, d.v FROM dense d JOIN shape s ON s.volume_id = d.volume_id AND d.z = s.n_slices // 2")
def ref_slice(spark, sf):
    stack = testdata.slices(spark, sf)
    return plain(layouts.slices_to_voxels(stack.join(training.ref_slice(layouts.manifest(stack)), ["volume_id", "z"])))


@query("""SELECT 'd' || doc_id AS volume_id, ((octet_length(encode(text)) + 2047) // 2048 // 2)::BIGINT AS z FROM documents""")
def middle_slice(spark, sf):
    return plain(training.ref_slice(layouts.manifest(testdata.text_slices(spark, sf)), "middle"))


@query("""WITH d AS (SELECT doc_id, greatest(1, (octet_length(encode(text)) + 2047) // 2048) AS n FROM documents), k AS (SELECT *, least(5, n) AS k FROM d)
SELECT 'd' || doc_id AS volume_id, i::BIGINT AS i, CASE WHEN i = k - 1 THEN n - 1 ELSE trunc(i * ((n - 1) / greatest(1, k - 1)::DOUBLE)) END::BIGINT AS z FROM k, range(5) r(i) WHERE i < k""")
def sample_slices(spark, sf):
    return plain(training.sample_slices(layouts.manifest(testdata.text_slices(spark, sf)), 5))


@query("""SELECT source, lang || '_' || doc_id || '.png' AS name, (row_number() OVER (PARTITION BY source ORDER BY lang || '_' || doc_id || '.png') - 1)::BIGINT AS z FROM documents""")
def slice_index(spark, sf):
    files = testdata.table(spark, sf, "documents").select(
        "source", F.concat("lang", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".png")).alias("name")
    )
    return plain(image_sources.slice_index(files, "name", ("source",)).select("source", "name", "z"))


@query("""SELECT o_orderkey::VARCHAR || '.png' AS name, (row_number() OVER (ORDER BY o_orderkey::VARCHAR || '.png') - 1)::BIGINT AS place FROM orders""")
def sort_by_name(spark, sf):
    files = testdata.table(spark, sf, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".png")).alias("name"))
    return plain(rank_rows(files, [], ["name"], "place"))


@query(f"""WITH {VOX} SELECT volume_id, z, y, area FROM (
SELECT volume_id, z, y, sum(v)::BIGINT AS area, row_number() OVER (PARTITION BY volume_id, z ORDER BY sum(v) DESC, y) AS r FROM vox GROUP BY 1, 2, 3) WHERE r <= 5""")
def first_n(spark, sf):
    areas = testdata.voxels(spark, sf).groupBy("volume_id", "z", "y").agg(F.sum("v").alias("area"))
    # A slice has 16 lines here, so its window partition is bounded.
    order = Window.partitionBy("volume_id", "z").orderBy(F.desc("area"), "y")
    return plain(areas.withColumn("r", F.row_number().over(order)).where("r <= 5").drop("r"))


# Files --------------------------------------------------------------------------------------------

FILES = """files AS (SELECT DISTINCT source || '_' || lang AS dir, CASE WHEN doc_id % 5 = 0 THEN printf('slice_%04d.png', (doc_id % 160)::BIGINT)
  WHEN doc_id % 11 = 0 THEN 'notes_' || doc_id || '.txt'
  ELSE (CASE WHEN doc_id % 3 = 0 THEN 'Synthetic_' ELSE 'synthetic_' END) || (doc_id % 12) || '_' || (doc_id % 170) || (CASE WHEN doc_id % 2 = 0 THEN '.png' ELSE '.PNG' END) END AS name,
  n_chars AS n_bytes FROM documents),
m AS (SELECT dir, name, regexp_extract(name, '(?i)^synthetic_([0-9]|10)_([0-9]+)\\.png$', 2) AS g FROM files),
w AS (SELECT DISTINCT dir, name, g::BIGINT AS idx FROM m WHERE g <> ''),
plan AS (SELECT dir, name, CASE WHEN idx <= 149 THEN printf('slice_%04d.png', idx) END AS target, idx FROM w),
act AS (SELECT p.*, CASE WHEN idx > 149 THEN 'skip_range' WHEN EXISTS (SELECT 1 FROM files f WHERE f.dir = p.dir AND f.name = p.target) THEN 'skip_exists'
  WHEN EXISTS (SELECT 1 FROM plan o WHERE o.dir = p.dir AND o.target = p.target AND o.name < p.name) THEN 'skip_exists' ELSE 'rename' END AS action FROM plan p)"""


def files(spark, sf):
    return testdata.image_files(spark, sf).select("dir", "name").distinct()


@query(f"WITH {FILES} SELECT dir, name, idx, idx <= 149 AS in_range FROM w")
def rename_filter(spark, sf):
    found = renaming.rename_filter(files(spark, sf))
    return plain(found.select("dir", "name", F.col("idx").cast("bigint").alias("idx"), "in_range"))


@query(f"WITH {FILES} SELECT dir, name, target, action FROM act")
def rename_conflicts(spark, sf):
    return plain(renaming.rename_plan(files(spark, sf)))


@query(f"WITH {FILES} SELECT dir, sum(CASE WHEN action = 'rename' THEN 1 ELSE 0 END)::BIGINT AS changed, sum(CASE WHEN action <> 'rename' THEN 1 ELSE 0 END)::BIGINT AS skipped FROM act GROUP BY 1")
def rename_counts(spark, sf):
    return plain(renaming.rename_counts(renaming.rename_plan(files(spark, sf))))


@query("""WITH i AS (SELECT source || '/' || doc_id AS rel_path, 300 + doc_id % 3 AS h, 1000 AS w FROM documents),
m AS (SELECT source || '/' || doc_id AS rel_path, 300 + doc_id % 2 AS mask_h, 1000 AS mask_w FROM documents JOIN labels USING (doc_id))
SELECT rel_path, h, w::BIGINT AS w, mask_h, mask_w::BIGINT AS mask_w, CASE WHEN mask_h IS NULL THEN 'missing' WHEN h = mask_h THEN 'ok' ELSE 'size_mismatch' END AS status FROM i LEFT JOIN m USING (rel_path)""")
def pair_image_mask(spark, sf):
    documents, labels = (testdata.table(spark, sf, name) for name in ("documents", "labels"))
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("rel_path")
    stack = documents.select(path, (F.col("doc_id") % 3 + 300).alias("h"), F.lit(1000).alias("w"))
    masks = documents.join(labels, "doc_id").select(path, (F.col("doc_id") % 2 + 300).alias("h"), F.lit(1000).alias("w"))
    return plain(training.pair_image_mask(stack, masks))


@query("""SELECT doc_id::VARCHAR AS name, octet_length(encode(text))::BIGINT AS w FROM documents WHERE octet_length(encode(text)) % 7 <> 0""")
def skip_corrupt(spark, sf):
    """Rows as the image reader gives them, the unreadable ones without pixels."""
    size = F.octet_length("text")
    status = F.when(size % 7 == 0, "corrupt").otherwise("ok")
    rows = testdata.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("name"), status.alias("status"), size.alias("w"), F.when(status == "ok", F.encode("text", "UTF-8")).alias("data")
    )
    return plain(image_sources.skip_corrupt(rows).select("name", "w"))


def broken_slices(spark, sf):
    """The stacks with a cut slice, one without data and one of an unknown type in every three."""
    data = F.when(F.col("z") % 3 == 1, F.col("data").substr(1, 1000)).when(F.col("z") % 4 == 2, F.lit(None)).otherwise(F.col("data"))
    return testdata.slices(spark, sf).withColumn("data", data).withColumn("dtype", F.when(F.col("z") == 6, "gray").otherwise(F.col("dtype")))


@query(f"""WITH {DENSE} SELECT volume_id, z, y, x, 255 - v AS v FROM dense WHERE z % 3 <> 1 AND z % 4 <> 2 AND z <> 6""")
def drop_failed(spark, sf):
    inverted = layouts.map_slices(broken_slices(spark, sf), lambda image: 255 - image, status=True)
    return plain(layouts.slices_to_voxels(images.drop_failed(inverted)))


@query(f"""WITH {DENSE}, s AS (SELECT DISTINCT volume_id, z FROM dense)
SELECT volume_id, CASE WHEN z % 4 = 2 AND z % 3 <> 1 THEN 'no data' WHEN z = 6 THEN 'unknown pixel type gray' ELSE 'data does not fill the slice' END AS error,
count(*)::BIGINT AS n, min(z)::BIGINT AS first_z FROM s WHERE z % 3 = 1 OR z % 4 = 2 OR z = 6 GROUP BY 1, 2""")
def failures(spark, sf):
    return plain(layouts.failures(layouts.check_slices(broken_slices(spark, sf))))


# Resampling ---------------------------------------------------------------------------------------

# Integer weights of the widening triangle filter from n_in to n_out pixels, as a table (o, i, k).
WEIGHTS = """{name} AS (
  SELECT o, i, floor(t / sum(t) OVER (PARTITION BY o) * 4194304 + 0.5)::BIGINT AS k FROM (
    SELECT o, i, greatest(0, 1 - abs((i - c + 0.5) / s)) AS t FROM (
      SELECT o, i, (o + 0.5) * {n_in} / {n_out}::DOUBLE AS c, greatest({n_in} / {n_out}::DOUBLE, 1) AS s
      FROM range({n_out}) a(o), range({n_in}) b(i))
    WHERE i >= greatest(trunc(c - s + 0.5), 0) AND i < least(trunc(c + s + 0.5), {n_in})))"""


@query(f"""WITH {DENSE}, {WEIGHTS.format(name='wx', n_in=64, n_out=23)}, {WEIGHTS.format(name='wy', n_in=16, n_out=25)},
hor AS (SELECT volume_id, z, y, o AS x, least(255, greatest(0, (sum(v * k) + 2097152)::BIGINT >> 22)) AS v FROM dense JOIN wx ON wx.i = dense.x GROUP BY 1, 2, 3, 4)
SELECT volume_id, z, o AS y, x, least(255, greatest(0, (sum(v * k) + 2097152)::BIGINT >> 22))::BIGINT AS v FROM hor JOIN wy ON wy.i = hor.y GROUP BY 1, 2, 3, 4""")
def resample_bilinear(spark, sf):
    return plain(layouts.slices_to_voxels(images.resample_bilinear(testdata.slices(spark, sf), 23, 25)))


@query(f"""WITH {DENSE} SELECT d.volume_id, d.z, p.o AS y, q.o AS x, d.v FROM dense d
JOIN (SELECT o, floor((o + 0.5) * 16 / 21.0::DOUBLE)::BIGINT AS i FROM range(21) r(o)) p ON p.i = d.y
JOIN (SELECT o, floor((o + 0.5) * 64 / 30.0::DOUBLE)::BIGINT AS i FROM range(30) r(o)) q ON q.i = d.x""")
def resample_nearest(spark, sf):
    return plain(layouts.slices_to_voxels(images.resample_nearest(testdata.slices(spark, sf), 21, 30)))


FIT = """bb AS (SELECT volume_id, z, min(CASE WHEN v > {thr} THEN y END) AS r0, max(CASE WHEN v > {thr} THEN y END) AS r1,
       min(CASE WHEN v > {thr} THEN x END) AS c0, max(CASE WHEN v > {thr} THEN x END) AS c1 FROM dense GROUP BY 1, 2),
geo AS (SELECT *, (r1 - r0 + 1 < {h} OR c1 - c0 + 1 < {w}) AS small FROM bb),
grid AS (SELECT g.*, oy.i AS oy, ox.i AS ox FROM geo g, range({h}) oy(i), range({w}) ox(i)),
src AS (SELECT *, CASE WHEN small THEN r0 + oy + greatest({h}, r1 - r0 + 1) // 2 - {h} // 2 - (greatest({h}, r1 - r0 + 1) - (r1 - r0 + 1)) // 2
   ELSE (CASE WHEN least(r1 + 1, greatest(r0, (r0 + r1) // 2 - {h} // 2) + {h}) - greatest(r0, (r0 + r1) // 2 - {h} // 2) < {h}
     THEN greatest(0, least(r1 + 1, greatest(r0, (r0 + r1) // 2 - {h} // 2) + {h}) - {h}) ELSE greatest(r0, (r0 + r1) // 2 - {h} // 2) END) + oy END AS sy,
  CASE WHEN small THEN c0 + ox + greatest({w}, c1 - c0 + 1) // 2 - {w} // 2 - (greatest({w}, c1 - c0 + 1) - (c1 - c0 + 1)) // 2
   ELSE (CASE WHEN least(c1 + 1, greatest(c0, (c0 + c1) // 2 - {w} // 2) + {w}) - greatest(c0, (c0 + c1) // 2 - {w} // 2) < {w}
     THEN greatest(0, least(c1 + 1, greatest(c0, (c0 + c1) // 2 - {w} // 2) + {w}) - {w}) ELSE greatest(c0, (c0 + c1) // 2 - {w} // 2) END) + ox END AS sx FROM grid),
fit AS (SELECT s.volume_id, s.z, s.oy AS y, s.ox AS x, coalesce(d.v, 0) AS v FROM src s LEFT JOIN dense d
  ON d.volume_id = s.volume_id AND d.z = s.z AND d.y = s.sy AND d.x = s.sx AND s.sy BETWEEN s.r0 AND s.r1 AND s.sx BETWEEN s.c0 AND s.c1)"""


@query(f"WITH {DENSE}, {FIT.format(thr=185, h=9, w=41)} SELECT volume_id, z, y, x, v FROM fit")
def fit_to_size(spark, sf):
    stack = testdata.slices(spark, sf)
    boxes = roi.bounding_box(stack, 185)
    return plain(layouts.slices_to_voxels(images.fit_to_size(stack, boxes, 9, 41)))


@query(f"WITH {DENSE}, {FIT.format(thr=185, h=9, w=41)} SELECT volume_id, z, y, x, CASE WHEN v > 185 THEN v ELSE 0 END AS v FROM fit")
def fit_masked_region(spark, sf):
    stack = testdata.slices(spark, sf)
    mask = layouts.map_slices(stack, lambda image: image > 185)
    return plain(layouts.slices_to_voxels(images.fit_to_size(stack, roi.bounding_box(mask), 9, 41, mask=mask)))


@query(f"WITH {DENSE}, {FIT.format(thr=205, h=13, w=75)} SELECT volume_id, z, y, x, v FROM fit")
def fit_small_regions(spark, sf):
    stack = testdata.slices(spark, sf)
    boxes = roi.bounding_box(stack, 205)
    return plain(layouts.slices_to_voxels(images.fit_to_size(stack, boxes, 13, 75)))


ROTATE = """geo AS (SELECT volume_id, n_slices AS nz, 64 AS nx, cos(radians(52)) AS c, sin(radians(52)) AS s FROM shape),
big AS (SELECT *, trunc(c * nz + s * nx + 0.5)::INT AS oz, trunc(s * nz + c * nx + 0.5)::INT AS ox FROM geo),
outp AS (SELECT b.*, z.i AS z, x.i AS x, c * (z.i - (oz - 1) / 2.0::DOUBLE) + s * (x.i - (ox - 1) / 2.0::DOUBLE) + (nz - 1) / 2.0::DOUBLE AS sz,
   -s * (z.i - (oz - 1) / 2.0::DOUBLE) + c * (x.i - (ox - 1) / 2.0::DOUBLE) + (nx - 1) / 2.0::DOUBLE AS sx FROM big b, range(120) z(i), range(120) x(i) WHERE z.i < oz AND x.i < ox),
lines AS (SELECT o.*, y.i AS y, floor(sz)::INT AS z0, floor(sx)::INT AS x0, sz - floor(sz) AS fz, sx - floor(sx) AS fx,
   (sz >= 0 AND sz <= nz - 1 AND sx >= 0 AND sx <= nx - 1) AS inside FROM outp o, range(16) y(i)),
val AS (SELECT l.volume_id, l.z, l.y, l.x, CASE WHEN inside THEN coalesce(a.v, 0) * (1 - fz) * (1 - fx) + coalesce(b.v, 0) * (1 - fz) * fx + coalesce(p.v, 0) * fz * (1 - fx) + coalesce(q.v, 0) * fz * fx ELSE 0 END AS t
 FROM lines l LEFT JOIN dense a ON a.volume_id = l.volume_id AND a.z = z0 AND a.y = l.y AND a.x = x0
 LEFT JOIN dense b ON b.volume_id = l.volume_id AND b.z = z0 AND b.y = l.y AND b.x = x0 + 1
 LEFT JOIN dense p ON p.volume_id = l.volume_id AND p.z = z0 + 1 AND p.y = l.y AND p.x = x0
 LEFT JOIN dense q ON q.volume_id = l.volume_id AND q.z = z0 + 1 AND q.y = l.y AND q.x = x0 + 1)"""


@query(f"WITH {DENSE}, {ROTATE} SELECT volume_id, z, y, x, floor(t + 0.5)::BIGINT AS v FROM val")
def rotate_plane(spark, sf):
    return plain(layouts.slices_to_voxels(rotation.rotate_plane(testdata.slices(spark, sf), 52)))


@query(f"WITH {DENSE}, {ROTATE} SELECT volume_id, x AS z, y, z AS x, floor(t + 0.5)::BIGINT AS v FROM val")
def rotate_and_reslice(spark, sf):
    return plain(layouts.slices_to_voxels(rotation.rotate_plane(testdata.slices(spark, sf), 52, swap_after=True)))


@query(f"WITH {DENSE} SELECT volume_id, z, y, x, 255 - v AS v FROM dense")
def map_slices(spark, sf):
    return plain(layouts.slices_to_voxels(layouts.map_slices(testdata.slices(spark, sf), lambda image: 255 - image)))


@query(f"WITH {DENSE} SELECT volume_id, z, y, x, (CASE WHEN v / 255.0::DOUBLE > 0.45 THEN 1 ELSE 0 END)::BIGINT AS v FROM dense")
def score_slices(spark, sf):
    scored = images.score_slices(testdata.slices(spark, sf), threshold=0.45)
    return plain(layouts.slices_to_voxels(images.drop_failed(scored)))
