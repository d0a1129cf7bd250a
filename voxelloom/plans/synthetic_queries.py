"""Specifications, candidate matching and reconstruction tables on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelloom.operators import meshes, synthetic
from voxelloom.plans.registry import plain, query
from voxelloom.sources import specs as spec_source
from voxelloom.sources import tables, testdata

# The same settings as testdata.spec_texts, worked out from the part table instead of from text.
SPEC = """spec AS (SELECT 's' || p_partkey AS spec, p_partkey, p_size,
  p_size + 100 AS nx, CASE WHEN p_partkey % 7 <> 0 THEN p_size * 2 + 50 END AS ny, p_size % 30 + 10 AS nz, 10.0::DOUBLE AS voxel,
  ('0.' || (p_size + 20))::DOUBLE AS phi, p_partkey % 2 = 0 AS new_seed, CASE WHEN p_retailprice % 2 < 1 THEN 'True' ELSE 'no' END AS png FROM part)"""


def parsed(spark, sf):
    return spec_source.parse_specs(testdata.spec_texts(spark, sf))


@query(f"""WITH {SPEC}, kv AS (
 SELECT spec, 'nx' AS key, nx::VARCHAR AS value FROM spec UNION ALL SELECT spec, 'ny', ny::VARCHAR FROM spec WHERE ny IS NOT NULL
 UNION ALL SELECT spec, 'nz', nz::VARCHAR FROM spec UNION ALL SELECT spec, 'voxel_size_nm', '10' FROM spec
 UNION ALL SELECT spec, 'overall_porosity', '0.' || (p_size + 20) FROM spec
 UNION ALL SELECT spec, CASE WHEN new_seed THEN 'seed' ELSE 'random_seed' END, p_partkey::VARCHAR FROM spec
 UNION ALL SELECT spec, 'psd_bins_nm', '89.0, ' || (p_size * 10 + 90) || ', , 1646.75' FROM spec
 UNION ALL SELECT spec, 'psd_weights', '0.25, ' || (p_size % 9 + 1) || CASE WHEN p_size % 5 = 0 THEN '' ELSE ', 0.125' END FROM spec
 UNION ALL SELECT spec, 'out=c', '/x' FROM spec UNION ALL SELECT spec, 'export_png', png FROM spec)
SELECT spec, key, value FROM kv""")
def read_specs(spark, sf):
    return plain(parsed(spark, sf).select("spec", F.explode("settings").alias("key", "value")))


@query(f"""WITH {SPEC}, v AS (SELECT spec, 'sizes' AS list, unnest([89.0::DOUBLE, p_size * 10 + 90, 1646.75]) AS value, unnest([0, 1, 2]) AS i FROM spec
UNION ALL SELECT spec, 'weights', unnest([0.25::DOUBLE, p_size % 9 + 1, 0.125])::DOUBLE, unnest([0, 1, 2]) FROM spec)
SELECT v.spec, list, i::BIGINT AS i, round(value, 6) AS value FROM v JOIN spec s ON s.spec = v.spec WHERE NOT (list = 'weights' AND i = 2 AND p_size % 5 = 0)""")
def spec_get_floats(spark, sf):
    lists = [("sizes", "psd_bins_nm"), ("weights", "psd_weights"), ("none", "not_there")]
    parts = [
        parsed(spark, sf).select("spec", F.lit(name).alias("list"), F.posexplode(spec_source.float_list(spec_source.setting(key))).alias("i", "value"))
        for name, key in lists
    ]
    return plain(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query(f"WITH {SPEC} SELECT spec, 'ny' AS missing FROM spec WHERE ny IS NULL")
def spec_required(spark, sf):
    return plain(parsed(spark, sf).select("spec", F.explode(spec_source.missing_keys()).alias("missing")))


@query(f"""WITH {SPEC} SELECT spec, nx::BIGINT AS nx, coalesce(ny, 512)::BIGINT AS ny, nz::BIGINT AS nz, voxel AS voxel_size_nm, round(phi, 6) AS overall_porosity,
'spheres' AS generator, 30::BIGINT AS max_iters, p_partkey AS seed, 'z' AS slice_axis, png = 'True' AS export_png, true AS sem_like FROM spec""")
def spec_typed(spark, sf):
    return plain(spec_source.typed_specs(parsed(spark, sf)).drop("problems"))


@query(f"""WITH {SPEC} SELECT spec, CASE WHEN p_partkey % 10 = 3 THEN NULL ELSE nx END::BIGINT AS nx, CASE WHEN p_partkey % 10 <> 3 THEN 30 END::BIGINT AS max_iters,
CASE WHEN p_partkey % 10 = 3 THEN 'max_iters: many;nx: ten;psd_weights: 0.5, half' ELSE '' END AS problems FROM spec""")
def spec_problems(spark, sf):
    """Every tenth text ends in settings that are no numbers."""
    texts = testdata.spec_texts(spark, sf)
    odd = F.when(F.col("spec").endswith("3"), F.concat("text", F.lit("\nnx: ten\nmax_iters = many\npsd_weights: 0.5, half"))).otherwise(F.col("text"))
    typed = spec_source.typed_specs(spec_source.parse_specs(texts.withColumn("text", odd)))
    return plain(typed.select("spec", "nx", "max_iters", F.array_join("problems", ";").alias("problems")))


BINS = f"""{SPEC}, bins AS (
  SELECT spec, phi, unnest([0, 1, 2]) AS bin, unnest(CASE WHEN p_size % 5 = 0 THEN [110.0::DOUBLE, 150, 190] ELSE [89.0::DOUBLE, p_size * 10 + 90, 1646.75] END) AS nm,
         unnest(CASE WHEN p_size % 5 = 0 THEN [0.25::DOUBLE, 0.5, 0.25] ELSE [0.25::DOUBLE, p_size % 9 + 1, 0.125] END) AS w FROM spec),
norm AS (SELECT spec, phi, bin, nm, w / sum(w) OVER (PARTITION BY spec) AS w FROM bins)"""


@query(f"""WITH {BINS} SELECT spec, bin::BIGINT AS bin, round(nm, 6) AS diameter_nm, greatest(1, round_even(nm / 10, 0)::BIGINT) AS diameter_vox, round(w, 6) AS weight FROM norm""")
def psd_weights_norm(spark, sf):
    return plain(synthetic.psd_bins(parsed(spark, sf)))


@query(f"""WITH RECURSIVE {BINS}, ws AS (SELECT spec, phi, max(w) FILTER (bin = 0) AS a, max(w) FILTER (bin = 1) AS b, max(w) FILTER (bin = 2) AS c FROM norm GROUP BY 1, 2),
it AS (SELECT spec, phi, a, b, c, 0.0::DOUBLE AS lo, 0.999::DOUBLE AS hi, 0 AS k FROM ws
 UNION ALL SELECT spec, phi, a, b, c,
   CASE WHEN 1 - (1 - (lo + hi) / 2 * a) * (1 - (lo + hi) / 2 * b) * (1 - (lo + hi) / 2 * c) < phi THEN (lo + hi) / 2 ELSE lo END,
   CASE WHEN 1 - (1 - (lo + hi) / 2 * a) * (1 - (lo + hi) / 2 * b) * (1 - (lo + hi) / 2 * c) < phi THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM it WHERE k < 60)
SELECT it.spec, n.bin::BIGINT AS bin, round(hi * w, 6) AS porosity FROM it JOIN norm n ON n.spec = it.spec WHERE k = 60""")
def solve_bin_porosities(spark, sf):
    return plain(synthetic.bin_porosities(parsed(spark, sf)))


@query("""WITH s AS (SELECT p_brand, sum(p_retailprice) AS w, sum(p_retailprice * p_size) AS a, sum(p_retailprice * p_size * p_size) AS b FROM part GROUP BY 1)
SELECT p_brand, round(a / w, 6) AS mean, round(sqrt(b / w - a / w * a / w), 6) AS std FROM s""")
def discrete_mean_std(spark, sf):
    return plain(synthetic.discrete_mean_std(testdata.table(spark, sf, "part"), ["p_brand"], "p_size", "p_retailprice"))


# A candidate per event: forty iterations per spec, statistics spread around the targets.
CANDIDATES = """cand AS (SELECT 'k' || (event_id // 40) AS spec, event_id % 40 AS it, 0.49 + value / 10000 - 0.006 AS overall, 0.492 AS overall_target,
  0.48 + value / 5000 AS mean, CASE WHEN event_id // 40 % 3 = 0 THEN NULL ELSE 0.4865 END AS mean_target, 0.03 + value / 8000 AS std, 0.039238 AS std_target,
  0.31 + value / 4000 AS min, 0.303673 AS min_target, 0.61 - value / 4000 AS max, 0.601061 AS max_target FROM events),
scored AS (SELECT *, abs(mean - coalesce(mean_target, mean)) <= 0.02 AND abs(std - std_target) <= 0.02 AND min <= min_target + 0.02 AND max >= max_target - 0.02 AS slices_ok,
  abs(overall - overall_target) + abs(mean - coalesce(mean_target, mean)) + 0.7 * abs(std - std_target) AS loss FROM cand)"""


def candidates(spark, sf):
    event, value = F.col("event_id"), F.col("value")
    group = F.floor(event / 40)
    return testdata.table(spark, sf, "events").select(
        F.concat(F.lit("k"), group.cast("string")).alias("spec"), (event % 40).alias("it"),
        (value / 10000 + 0.49 - 0.006).alias("overall"), F.lit(0.492).alias("overall_target"),
        (value / 5000 + 0.48).alias("mean"), F.when(group % 3 != 0, 0.4865).alias("mean_target"),
        (value / 8000 + 0.03).alias("std"), F.lit(0.039238).alias("std_target"),
        (value / 4000 + 0.31).alias("min"), F.lit(0.303673).alias("min_target"),
        (F.lit(0.61) - value / 4000).alias("max"), F.lit(0.601061).alias("max_target"),
    )


@query(f"WITH {CANDIDATES} SELECT spec, it, slices_ok, slices_ok AND abs(overall - overall_target) <= 0.005 AS ok FROM scored")
def meets_slice_targets(spark, sf):
    rows = candidates(spark, sf)
    return plain(rows.select("spec", "it", synthetic.meets_slice_targets().alias("slices_ok"), synthetic.accepted().alias("ok")))


@query(f"WITH {CANDIDATES} SELECT spec, it, round(loss, 6) AS loss FROM scored")
def match_loss(spark, sf):
    return plain(candidates(spark, sf).select("spec", "it", synthetic.match_loss().alias("loss")))


@query(f"""WITH {CANDIDATES}, f AS (SELECT *, slices_ok AND abs(overall - overall_target) <= 0.005 AS ok FROM scored)
SELECT spec, it, round(loss, 6) AS loss, ok FROM (SELECT *, row_number() OVER (PARTITION BY spec ORDER BY NOT ok, CASE WHEN ok THEN 0 ELSE loss END, it) AS r FROM f) WHERE r = 1""")
def best_candidate(spark, sf):
    return plain(synthetic.best_candidate(candidates(spark, sf)))


@query("""SELECT 'synthetic_' || s_suppkey AS id, round(0.3 + s_suppkey % 100 / 500.0, 6) AS target, round(0.45 + s_acctbal / 100000, 6) AS overall_porosity,
round(0.45 + s_acctbal / 100000 - 0.3 - s_suppkey % 100 / 500.0, 6) AS difference FROM supplier""")
def spec_vs_realized(spark, sf):
    supplier = testdata.table(spark, sf, "supplier").withColumn("id", F.concat(F.lit("synthetic_"), F.col("s_suppkey").cast("string")))
    targets = supplier.select("id", (F.col("s_suppkey") % 100 / 500 + 0.3).alias("target"))
    realized = supplier.select("id", (F.col("s_acctbal") / 100000 + 0.45).alias("overall_porosity"))
    return plain(synthetic.spec_vs_realized(targets, realized))


# Reconstruction results ---------------------------------------------------------------------------

METHODS = ["mc_basic", "mc_smooth", "voxel_direct", "dual_contour"]
RECON = """rec AS (SELECT p_partkey AS k, m, unnest(['mc_basic', 'mc_smooth', 'voxel_direct', 'dual_contour']) AS method, unnest([0, 1, 2, 3]) AS j FROM part, (SELECT 1 AS m)),
r AS (SELECT 'synthetic_' || k AS id, method, NOT (j = 3 AND k % 11 <> 9) AS success, 70.0::DOUBLE + k % 13 + j AS chamfer_distance, 240.0::DOUBLE + k % 17 - j AS hausdorff_distance,
  (600000 + k * 10 + j)::BIGINT AS n_faces, 0.83::DOUBLE + k % 5 / 10.0::DOUBLE AS gt_volume, (500000.0::DOUBLE + k * 7) * (j + 1) AS pred_volume, 83.7::DOUBLE + k % 3 AS gt_area, 400000.0::DOUBLE + k AS pred_area,
  0.7::DOUBLE AS gt_porosity, 0.7::DOUBLE + j / 100.0::DOUBLE AS pred_porosity FROM rec)"""


def result_texts(spark, sf):
    """One nested JSON text per part, as a reconstruction run writes it."""
    k = F.col("p_partkey")

    def record(j: int):
        done = F.to_json(F.struct(
            (k % 13 + 70.0 + j).alias("chamfer_distance"), (k % 17 + 240.0 - j).alias("hausdorff_distance"), (k * 10 + 600000 + j).alias("n_faces"),
            (k % 5 / 10.0 + 0.83).alias("gt_volume"), ((k * 7 + 500000.0) * (j + 1)).alias("pred_volume"), (k % 3 + 83.7).alias("gt_area"),
            (k + 400000.0).alias("pred_area"), F.lit(0.7).alias("gt_porosity"), F.lit(0.7 + j / 100.0).alias("pred_porosity"), F.lit(True).alias("success"),
        ))
        return F.when((k % 11 != 9), '{"success": false, "error": "no mesh"}').otherwise(done) if j == 3 else done

    body = F.concat_ws(", ", *[F.concat(F.lit(f'"{name}": '), record(j)) for j, name in enumerate(METHODS)])
    return testdata.table(spark, sf, "part").select(
        F.concat(F.lit("synthetic_"), k.cast("string")).alias("id"), F.concat(F.lit("{"), body, F.lit("}")).alias("value")
    )


def records(spark, sf):
    return tables.explode_recon(result_texts(spark, sf))


@query(f"""WITH {RECON} SELECT id, method, success, CASE WHEN NOT success THEN 'no mesh' END AS error, CASE WHEN success THEN chamfer_distance END AS chamfer_distance,
CASE WHEN success THEN n_faces END AS n_faces, round(CASE WHEN success THEN pred_volume END, 6) AS pred_volume FROM r""")
def read_recon_results(spark, sf):
    return plain(records(spark, sf).select("id", "method", "success", "error", "chamfer_distance", "n_faces", "pred_volume"))


@query(f"""WITH {RECON} SELECT id, method, round(pred_volume / (gt_volume * 1000000), 6) AS volume_ratio, round(pred_area / (gt_area * 10000), 6) AS area_ratio,
round(abs(pred_porosity - gt_porosity), 6) AS porosity_error, round(pred_porosity / gt_porosity, 6) AS porosity_ratio FROM r WHERE success""")
def recon_ratios(spark, sf):
    return plain(meshes.recon_ratios(records(spark, sf), gt_unit=100.0))


@query(f"""WITH {RECON} SELECT method, count(*) FILTER (success) AS n_ok, count(*) FILTER (NOT success) AS n_failed, round(avg(chamfer_distance) FILTER (success), 6) AS mean_chamfer_distance,
round(avg(hausdorff_distance) FILTER (success), 6) AS mean_hausdorff_distance, round(avg(pred_volume) FILTER (success), 4) AS mean_pred_volume,
CASE WHEN bool_or(NOT success) THEN 'no mesh' END AS first_error FROM r GROUP BY 1""")
def method_summary(spark, sf):
    summary = meshes.method_summary(records(spark, sf))
    kept = summary.select("method", "n_ok", "n_failed", "mean_chamfer_distance", "mean_hausdorff_distance", F.round("mean_pred_volume", 4).alias("mean_pred_volume"), "first_error")
    return plain(kept)


@query("""WITH e AS (SELECT 'synthetic_' || p_partkey AS id, 0.4::DOUBLE + p_size / 200.0::DOUBLE AS golden, unnest(['voxel_direct', 'convex_hull', 'mc_basic']) AS method,
  unnest([0.35::DOUBLE + p_size / 200.0::DOUBLE, p_size / 100.0::DOUBLE, p_retailprice / 2000]) AS estimate FROM part)
SELECT id, round(golden, 6) AS golden_porosity, method, round(estimate, 6) AS estimate, round(estimate - golden, 6) AS error, round(abs(estimate - golden), 6) AS abs_error,
rank() OVER (PARTITION BY id ORDER BY abs(estimate - golden)) AS rank FROM e""")
def method_vs_golden(spark, sf):
    size = F.col("p_size")
    estimates = testdata.table(spark, sf, "part").select(
        F.concat(F.lit("synthetic_"), F.col("p_partkey").cast("string")).alias("id"), (size / 200.0 + 0.4).alias("golden_porosity"),
        (size / 200.0 + 0.35).alias("voxel_direct_result"), (size / 100.0).alias("convex_hull_result"), (F.col("p_retailprice") / 2000).alias("mc_basic_result"),
    )
    return plain(meshes.method_vs_golden(estimates, ["voxel_direct", "convex_hull", "mc_basic"]))


@query("""SELECT 'synthetic_' || p_partkey AS id, round(2.0::DOUBLE + p_size / 100.0::DOUBLE, 6) AS radius, round((2.0::DOUBLE + p_size / 100.0::DOUBLE) * 1.4, 6) AS height, p_size + 40.0::DOUBLE AS theta,
300.0::DOUBLE AS light_intensity, round(1.4::DOUBLE, 6) AS height_per_radius, p_brand FROM part""")
def lighting_join(spark, sf):
    part = testdata.table(spark, sf, "part")
    radius = F.col("p_size") / 100.0 + 2.0
    lighting = part.select(
        radius.alias("radius"), (radius * 1.4).alias("height"), (F.col("p_size") + 40.0).alias("theta"), F.lit(300.0).alias("light_intensity"),
        F.concat(F.lit("C:/data/stacks/synthetic_"), F.col("p_partkey").cast("string"), F.lit("/volume.obj")).alias("obj_path"),
    )
    results = part.select(F.concat(F.lit("synthetic_"), F.col("p_partkey").cast("string")).alias("id"), "p_brand")
    return plain(tables.lighting_join(lighting, results))
