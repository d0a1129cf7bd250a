"""Porosity, histograms and regions on the test tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from voxelloom import layouts
from voxelloom.operators import histograms, images, porosity, roi, synthetic, training
from voxelloom.plans import analyses
from voxelloom.plans.registry import DENSE, TEXT_HIST, VOX, plain, query
from voxelloom.session import cut_lineage
from voxelloom.sources import testdata


def text_hist(spark, sf):
    return layouts.slices_to_hist(testdata.text_slices(spark, sf))


def text_pores(spark, sf):
    """Letters and other bytes above 96 count as solid."""
    return porosity.pore_mask(text_hist(spark, sf), encoding="u8", threshold=96)


@query(f"""WITH {TEXT_HIST}
SELECT volume_id, z::BIGINT AS z, v::BIGINT AS v, n FROM thist""")
def slice_histogram(spark, sf):
    return plain(text_hist(spark, sf))


@query(f"""WITH {VOX}, top AS (SELECT volume_id, max(v) AS m FROM vox GROUP BY 1)
SELECT volume_id, z, y, x, NOT (CASE WHEN m <= 1 THEN v > 0.5 ELSE v > 127 END) AS pore FROM vox JOIN top USING (volume_id)""")
def pore_mask(spark, sf):
    return plain(porosity.pore_mask(testdata.voxels(spark, sf)).select("volume_id", "z", "y", "x", "pore"))


@query(f"""WITH {TEXT_HIST}
SELECT volume_id, round(100.0 * sum(CASE WHEN v <= 96 THEN n ELSE 0 END) / sum(n), 6) AS porosity FROM thist GROUP BY 1""")
def volume_porosity(spark, sf):
    return plain(porosity.volume_porosity(text_pores(spark, sf)))


@query(f"""WITH {TEXT_HIST}
SELECT volume_id, z::BIGINT AS z, round(100.0 * sum(CASE WHEN v <= 96 THEN n ELSE 0 END) / sum(n), 6) AS porosity FROM thist GROUP BY 1, 2""")
def slice_porosity(spark, sf):
    return plain(porosity.slice_porosity(text_pores(spark, sf)))


@query(f"""WITH {TEXT_HIST}, per AS (
  SELECT volume_id, z, 100.0 * sum(CASE WHEN v <= 96 THEN n ELSE 0 END) / sum(n) AS p FROM thist GROUP BY 1, 2)
SELECT volume_id, round(min(p), 6) AS min_porosity, round(max(p), 6) AS max_porosity, round(avg(p), 6) AS mean_porosity,
       round(stddev_pop(p), 6) AS std_porosity, count(*)::BIGINT AS n_slices FROM per GROUP BY 1""")
def slice_porosity_stats(spark, sf):
    return plain(porosity.slice_porosity_stats(text_pores(spark, sf)))


@query(f"""WITH {VOX}, per AS (SELECT volume_id, x, avg(CASE WHEN v <= 127 THEN 1.0::DOUBLE ELSE 0 END) AS p FROM vox GROUP BY 1, 2)
SELECT volume_id, round(min(p), 6) AS min_porosity, round(max(p), 6) AS max_porosity, round(avg(p), 6) AS mean_porosity,
       round(stddev_pop(p), 6) AS std_porosity, count(*)::BIGINT AS n_slices FROM per GROUP BY 1""")
def slice_porosity_stats_along_x(spark, sf):
    marked = porosity.pore_mask(testdata.voxels(spark, sf).withColumn("n", F.lit(1)), encoding="u8")
    return plain(porosity.slice_porosity_stats(marked, "x", percent=False))


@query(f"""WITH {TEXT_HIST}
SELECT volume_id, z::BIGINT AS z, CASE WHEN grouping(z) = 1 THEN 'volume' ELSE 'slice' END AS level,
       sum(CASE WHEN v <= 96 THEN n ELSE 0 END)::BIGINT AS pores, sum(n)::BIGINT AS total,
       round(100.0 * sum(CASE WHEN v <= 96 THEN n ELSE 0 END) / sum(n), 6) AS porosity
FROM thist GROUP BY GROUPING SETS ((volume_id, z), (volume_id))""")
def volume_and_slice_report(spark, sf):
    return plain(porosity.volume_and_slice_report(text_pores(spark, sf)))


@query(f"""WITH {VOX} SELECT volume_id, round(100.0::DOUBLE * sum(CASE WHEN v > 0 THEN v ELSE 0 END) / count(*), 6) AS porosity FROM vox GROUP BY 1""")
def sum_porosity(spark, sf):
    return plain(porosity.sum_porosity(layouts.voxels_to_hist(testdata.voxels(spark, sf))))


@query(f"""WITH {TEXT_HIST}
SELECT volume_id, round(1.0 - 1.0 * sum(CASE WHEN v <= 96 THEN n ELSE 0 END) / sum(n), 6) AS solid FROM thist GROUP BY 1""")
def solid_fraction(spark, sf):
    return plain(porosity.solid_fraction(text_pores(spark, sf)))


@query(f"""WITH {DENSE}
SELECT volume_id, z, min(v)::BIGINT AS v_min, max(v)::BIGINT AS v_max, count(*)::BIGINT AS n_pixels, round(avg(v), 6) AS v_mean,
       round(stddev_pop(v), 6) AS v_std FROM dense GROUP BY 1, 2""")
def slice_summary(spark, sf):
    return plain(porosity.slice_summary(layouts.slices_to_hist(testdata.slices(spark, sf))))


# A gray mask on fewer slices, lines and columns, whose brightest value marks the region.
REGION_SQL = f"""{DENSE}, gray AS (SELECT volume_id, z, y, x, CASE WHEN v > 100 THEN 9 ELSE v // 64 END AS m FROM dense WHERE z < 7),
mask AS (SELECT volume_id, z, y, x, m = max(m) OVER (PARTITION BY volume_id) AND m > 0 AS region FROM gray WHERE y < 14 AND x < 60),
both_ AS (SELECT a.*, m.region FROM dense a JOIN mask m USING (volume_id, z, y, x)),
lim AS (SELECT volume_id, avg(v) * 0.8 AS l FROM both_ GROUP BY 1),
marked AS (SELECT b.*, (v > l AND region) AS pore FROM both_ b JOIN lim USING (volume_id)),
profile AS (SELECT volume_id, z, 100.0::DOUBLE * sum(CASE WHEN pore THEN 1 ELSE 0 END) / count(*) AS p,
                   sum(CASE WHEN pore THEN 1 ELSE 0 END) AS pores, count(*) AS total FROM marked WHERE region GROUP BY 1, 2)"""


def gray_mask(spark, sf):
    gray = layouts.map_slices(testdata.slices(spark, sf).where("z < 7"), lambda image: np.where(image > 100, 9, image // 64))
    return images.crop(gray, 0, 14, 0, 60)


def joint(spark, sf):
    return porosity.joint_hist_of_slices(testdata.slices(spark, sf), gray_mask(spark, sf), None)


@query(f"WITH {REGION_SQL} SELECT volume_id, z, y, x, region::BIGINT AS v FROM mask")
def region_slices(spark, sf):
    return plain(layouts.slices_to_voxels(porosity.region_slices(gray_mask(spark, sf))))


@query(f"""WITH {REGION_SQL}
SELECT volume_id, z, v, region, pore, count(*)::BIGINT AS n FROM marked GROUP BY ALL""")
def region_pore_mask(spark, sf):
    return plain(porosity.region_pore_mask(joint(spark, sf)).select("volume_id", "z", "v", "region", "pore", "n"))


@query(f"""WITH {REGION_SQL}
SELECT volume_id, z, round(p, 6) AS porosity, pores::BIGINT AS pore_voxels, total::BIGINT AS region_voxels FROM profile""")
def porosity_profile(spark, sf):
    return plain(porosity.porosity_profile(porosity.region_pore_mask(joint(spark, sf))))


@query(f"""WITH {REGION_SQL}
SELECT volume_id, round(100.0 * sum(pores) / sum(total), 6) AS porosity, round(min(p), 6) AS min_porosity, round(max(p), 6) AS max_porosity,
       round(avg(p), 6) AS mean_porosity, round(stddev_pop(p), 6) AS std_porosity, sum(total)::BIGINT AS highlighted_voxels,
       sum(pores)::BIGINT AS pore_voxels FROM profile GROUP BY 1""")
def region_porosity(spark, sf):
    return plain(porosity.region_porosity(porosity.region_pore_mask(joint(spark, sf))))


@query(f"""WITH {DENSE}, lim AS (SELECT volume_id, avg(v) * 0.8 AS l FROM dense GROUP BY 1),
profile AS (SELECT volume_id, z, sum(CASE WHEN v < l THEN 1 ELSE 0 END) AS pores, count(*) AS total,
            100.0::DOUBLE * sum(CASE WHEN v < l THEN 1 ELSE 0 END) / count(*) AS p
            FROM dense JOIN lim USING (volume_id) WHERE x >= 8 AND x < 56 AND y >= 2 AND y < 14 GROUP BY 1, 2)
SELECT volume_id, round(100.0 * sum(pores) / sum(total), 6) AS porosity, round(min(p), 6) AS min_porosity, round(max(p), 6) AS max_porosity,
       round(avg(p), 6) AS mean_porosity, round(stddev_pop(p), 6) AS std_porosity, sum(total)::BIGINT AS highlighted_voxels,
       sum(pores)::BIGINT AS pore_voxels FROM profile GROUP BY 1""")
def region_porosity_of_slices(spark, sf):
    stack = testdata.slices(spark, sf)

    def window(image):
        mask = image * 0
        mask[2:14, 8:56] = 1
        return mask

    return plain(analyses.analyze_region_porosity(stack, layouts.map_slices(stack, window), pore_is_white=False))


@query(f"""WITH {VOX}, top AS (SELECT volume_id, max(v) AS m FROM vox GROUP BY 1)
SELECT volume_id, z, y, x, (v = m AND m > 0) AS region FROM vox JOIN top USING (volume_id)""")
def highlight_mask(spark, sf):
    return plain(porosity.highlight_mask(testdata.voxels(spark, sf)).select("volume_id", "z", "y", "x", "region"))


@query(f"WITH {VOX} SELECT volume_id, z, y, x, v > 150 AS region FROM vox")
def highlight_threshold(spark, sf):
    marked = porosity.highlight_threshold(testdata.voxels(spark, sf), threshold=150)
    return plain(marked.select("volume_id", "z", "y", "x", "region"))


@query("""WITH level AS (
  SELECT vec_id, p, trunc(least(255, greatest(0, (CAST(embedding[p + 1] AS DOUBLE) + 0.6) / 1.2 * 255))) AS v,
         trunc(least(255, greatest(0, (CAST(embedding[64 - p] AS DOUBLE) + 0.6) / 1.2 * 255))) AS mirrored
  FROM embeddings, range(60) r(p) WHERE vec_id % 128 // 16 < 6 AND vec_id % 16 < 12)
SELECT 'v' || (vec_id // 128) AS volume_id, vec_id % 128 // 16 AS z, vec_id % 16 AS y, p AS x, v > 127 AND mirrored > 100 AS both_set,
       v > 127 AND NOT mirrored > 100 AS only_first FROM level""")
def stack_mask_join(spark, sf):
    a = testdata.voxels(spark, sf)
    b = images.flip_voxels(a.where("z < 6 AND y < 12 AND x > 3"), "x", 64).select("volume_id", "z", "y", "x", F.col("v").alias("b"))
    first, second = F.col("v") > 127, F.col("b") > 100
    joined = a.join(b, ["volume_id", "z", "y", "x"])
    return plain(joined.select("volume_id", "z", "y", "x", (first & second).alias("both_set"), (first & ~second).alias("only_first")))


@query(f"""WITH {DENSE}, along AS (SELECT *, lead(v, 4) OVER (PARTITION BY volume_id, z, y ORDER BY x) AS right_v FROM dense WHERE z < 6),
other AS (SELECT *, lead(right_v, 2) OVER (PARTITION BY volume_id, z, x ORDER BY y) AS b FROM along)
SELECT volume_id, z, y, x, (CASE WHEN v > 127 AND b > 100 THEN 1 ELSE 0 END)::BIGINT AS v FROM other WHERE b IS NOT NULL""")
def combine_packed_stacks(spark, sf):
    stack = testdata.slices(spark, sf)
    smaller = images.crop(stack.where("z < 6"), 2, 16, 4, 64)
    return plain(layouts.slices_to_voxels(layouts.zip_slices(stack, smaller, lambda a, b: (a > 127) & (b > 100))))


@query(f"""WITH {VOX}, a AS (SELECT volume_id, z, y, x FROM vox WHERE v > 127), b AS (SELECT volume_id, z, y, x FROM vox WHERE v < 150)
SELECT volume_id, z, y, x, 'both' AS part FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT volume_id, z, y, x, 'outside' FROM (SELECT volume_id, z, y, x FROM vox EXCEPT SELECT * FROM a)""")
def mask_intersect_complement(spark, sf):
    voxels = testdata.voxels(spark, sf)
    first, second = F.col("v") > 127, F.col("v") < 150
    part = F.when(first & second, "both").when(~first, "outside")
    return plain(voxels.select("volume_id", "z", "y", "x", part.alias("part")).where("part IS NOT NULL"))


@query(f"""WITH {DENSE}, s AS (SELECT volume_id, z, min(v) AS a, max(v) AS b, avg(v) AS c, stddev_pop(v) AS d FROM dense GROUP BY 1, 2),
q AS (SELECT volume_id, z, min(v) AS a, max(v) AS b, avg(v) AS c, stddev_pop(v) AS d
      FROM (SELECT volume_id, z, 255 - v AS v FROM dense WHERE z < 5) GROUP BY 1, 2)
SELECT volume_id, z, s.a::BIGINT AS left_v_min, s.b::BIGINT AS left_v_max, round(s.c, 6) AS left_v_mean, round(s.d, 6) AS left_v_std,
       q.a::BIGINT AS right_v_min, q.b::BIGINT AS right_v_max, round(q.c, 6) AS right_v_mean, round(q.d, 6) AS right_v_std
FROM s JOIN q USING (volume_id, z)""")
def side_by_side(spark, sf):
    left = testdata.slices(spark, sf)
    right = layouts.map_slices(left.where("z < 5"), lambda image: 255 - image)
    return plain(porosity.side_by_side(layouts.slices_to_hist(left), layouts.slices_to_hist(right)))


@query(f"""WITH {TEXT_HIST}, per AS (
  SELECT volume_id, z, 100.0::DOUBLE * sum(CASE WHEN v <= 96 THEN n ELSE 0 END) / sum(n) AS p FROM thist GROUP BY 1, 2),
vol AS (SELECT volume_id, 100.0::DOUBLE * sum(CASE WHEN v <= 96 THEN n ELSE 0 END) / sum(n) AS porosity FROM thist GROUP BY 1),
st AS (SELECT volume_id, round(porosity, 3) AS o, round(min(p), 3) AS a, round(max(p), 3) AS b, round(avg(p), 3) AS c, round(stddev_pop(p), 3) AS d
       FROM per JOIN vol USING (volume_id) GROUP BY volume_id, porosity)
SELECT volume_id, i::BIGINT AS line_no, CASE i WHEN 0 THEN '=== Text Porosity Analysis ===' WHEN 1 THEN ''
  WHEN 2 THEN printf('Overall porosity: %.4f%%', o) WHEN 3 THEN 'Slice porosity:' WHEN 4 THEN printf('  Min: %.4f%%', a)
  WHEN 5 THEN printf('  Max: %.4f%%', b) WHEN 6 THEN printf('  Mean: %.4f%%', c) ELSE printf('  StdDev: %.4f%%', d) END AS line
FROM st, range(8) r(i)""")
def format_report(spark, sf):
    stats = analyses.analyze_porosity(testdata.text_slices(spark, sf), encoding="u8", threshold=96)
    return plain(porosity.format_report(plain(stats, 3), "Text"))


@query(f"""WITH {TEXT_HIST}, per AS (
  SELECT volume_id, z, 1.0::DOUBLE * sum(CASE WHEN v <= 96 THEN n ELSE 0 END) / sum(n) AS p FROM thist GROUP BY 1, 2),
vol AS (SELECT volume_id, 1.0::DOUBLE * sum(CASE WHEN v <= 96 THEN n ELSE 0 END) / sum(n) AS porosity FROM thist GROUP BY 1)
SELECT volume_id, round(porosity, 6) AS overall_porosity, round(avg(p), 6) AS mean_slice_porosity, round(stddev_pop(p), 6) AS std_slice_porosity,
       round(min(p), 6) AS min_slice_porosity, round(max(p), 6) AS max_slice_porosity, count(*)::BIGINT AS nslices
FROM per JOIN vol USING (volume_id) GROUP BY volume_id, porosity""")
def realized_stats(spark, sf):
    stats = analyses.analyze_porosity(testdata.text_slices(spark, sf), encoding="u8", threshold=96, percent=False)
    return plain(synthetic.realized_stats(stats))


@query(f"""WITH {VOX}, rng AS (SELECT volume_id, min(f) AS lo, max(f) AS hi FROM vox GROUP BY 1),
b AS (SELECT volume_id, least(19, floor((f - lo) / ((hi - lo) / 20))::INT) AS bin FROM vox JOIN rng USING (volume_id)),
c AS (SELECT volume_id, bin, count(*) AS n FROM b GROUP BY 1, 2)
SELECT r.volume_id, g.i::BIGINT AS bin, round(lo + (g.i + 0.5) * ((hi - lo) / 20), 6) AS center, coalesce(n, 0)::BIGINT AS n,
       round(coalesce(n, 0) / ((SELECT sum(n) FROM c k WHERE k.volume_id = r.volume_id) * ((hi - lo) / 20)), 6) AS p
FROM rng r CROSS JOIN range(20) g(i) LEFT JOIN c ON c.volume_id = r.volume_id AND c.bin = g.i""")
def value_histogram(spark, sf):
    return plain(histograms.value_histogram(testdata.voxels(spark, sf), ["volume_id"], "f", 20, density=True))


@query("""WITH e AS (SELECT i, 0.05::DOUBLE * pow(100.0::DOUBLE, i / 11.0::DOUBLE) AS a, 0.05::DOUBLE * pow(100.0::DOUBLE, (i + 1) / 11.0::DOUBLE) AS b FROM range(11) r(i)),
s AS (SELECT l_suppkey, l_extendedprice / 20000 AS v FROM lineitem)
SELECT k.l_suppkey, e.i::BIGINT AS bin, count(v)::BIGINT AS n FROM (SELECT DISTINCT l_suppkey FROM s) k CROSS JOIN e
LEFT JOIN s ON s.l_suppkey = k.l_suppkey AND v >= a AND v < b GROUP BY 1, 2""")
def edge_histogram(spark, sf):
    sizes = testdata.table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_extendedprice") / 20000).alias("v"))
    return plain(histograms.edge_histogram(sizes, ["l_suppkey"], "v", histograms.log_edges(0.05, 5.0, 12)))


OTSU_SQL = """h AS (SELECT {key}, least(255, floor((u - lo) / ((hi - lo) / 256))::INT) AS bin, lo, hi, sum(n) AS n
  FROM unit JOIN (SELECT {key}, CASE WHEN min(u) = max(u) THEN min(u) - 0.5 ELSE min(u) END AS lo, CASE WHEN min(u) = max(u) THEN max(u) + 0.5 ELSE max(u) END AS hi
                  FROM unit GROUP BY {key}) USING ({key}) GROUP BY ALL),
hc AS (SELECT *, lo + (bin + 0.5) * ((hi - lo) / 256) AS c FROM h),
g AS (SELECT DISTINCT {key}, lo, hi, i, lo + (i + 0.5) * ((hi - lo) / 256) AS c FROM h, range(255) r(i)),
w AS (SELECT {gkey}, g.i, g.c, sum(CASE WHEN bin <= g.i THEN n ELSE 0 END) AS w1, sum(CASE WHEN bin > g.i THEN n ELSE 0 END) AS w2,
        sum(CASE WHEN bin <= g.i THEN n * hc.c ELSE 0 END) AS s1, sum(CASE WHEN bin > g.i THEN n * hc.c ELSE 0 END) AS s2
      FROM g JOIN hc USING ({key}) GROUP BY ALL),
var AS (SELECT *, round(w1 / (w1 + w2) * w2 / (w1 + w2) * (s1 / w1 - s2 / w2) * (s1 / w1 - s2 / w2), 9) AS s FROM w WHERE w1 > 0 AND w2 > 0),
otsu AS (SELECT {key}, arg_max(c, (s, -i)) AS threshold FROM var GROUP BY {key})"""
OTSU_VOLUME = OTSU_SQL.format(key="volume_id", gkey="g.volume_id")


@query(f"""WITH {VOX}, unit AS (SELECT volume_id, v / (max(v) OVER (PARTITION BY volume_id))::DOUBLE AS u, 1.0::DOUBLE AS n FROM vox), {OTSU_VOLUME}
SELECT volume_id, round(threshold, 6) AS threshold FROM otsu""")
def otsu_threshold(spark, sf):
    hist = cut_lineage(layouts.voxels_to_hist(testdata.voxels(spark, sf)))
    return plain(histograms.otsu_threshold(histograms.unit_volume(hist), ["volume_id"]))


@query(f"""WITH {VOX}, unit AS (SELECT volume_id, z, y, x, v / (max(v) OVER (PARTITION BY volume_id))::DOUBLE AS u, 1.0::DOUBLE AS n FROM vox), {OTSU_VOLUME}
SELECT volume_id, z, sum(CASE WHEN u >= threshold THEN 1 ELSE 0 END)::BIGINT AS solid, count(*)::BIGINT AS total
FROM unit JOIN otsu USING (volume_id) GROUP BY 1, 2""")
def binarize_volume(spark, sf):
    marked = histograms.binarize_volume(cut_lineage(layouts.voxels_to_hist(testdata.voxels(spark, sf))))
    solid = F.sum(F.when(F.col("solid"), F.col("n")).otherwise(0)).alias("solid")
    return plain(marked.groupBy("volume_id", "z").agg(solid, F.sum("n").alias("total")))


@query(f"""WITH {TEXT_HIST}
SELECT volume_id, z::BIGINT AS z, v::BIGINT AS v, round(sum(n) OVER (PARTITION BY volume_id, z ORDER BY v) / 2048.0::DOUBLE, 6) AS q FROM thist""")
def cdf(spark, sf):
    return plain(histograms.cdf(text_hist(spark, sf)).select("volume_id", "z", "v", "q"))


MATCH_SQL = """hs AS (SELECT volume_id, z, v, count(*) AS n FROM dense GROUP BY 1, 2, 3),
c AS (SELECT volume_id, z, v, sum(n) OVER (PARTITION BY volume_id, z ORDER BY v) / 1024.0::DOUBLE AS q FROM hs),
ref AS (SELECT c.volume_id, q, v, lead(q) OVER o AS q1, lead(v) OVER o AS v1, lag(q) OVER o AS q_before
        FROM c JOIN shape s ON s.volume_id = c.volume_id AND c.z = s.n_slices // 2 WINDOW o AS (PARTITION BY c.volume_id ORDER BY q)),
lut AS (SELECT c.volume_id, c.z, c.v, trunc(CASE WHEN c.q <= r.q OR r.q1 IS NULL THEN r.v::DOUBLE ELSE (r.v1 - r.v)::DOUBLE / (r.q1 - r.q) * (c.q - r.q) + r.v END)::BIGINT AS matched
        FROM c JOIN ref r ON r.volume_id = c.volume_id AND (c.q >= r.q OR r.q_before IS NULL) AND (c.q < r.q1 OR r.q1 IS NULL))"""


@query(f"WITH {DENSE}, {MATCH_SQL} SELECT volume_id, z, v, matched FROM lut")
def match_histogram(spark, sf):
    stack = testdata.slices(spark, sf)
    return plain(histograms.match_histogram(cut_lineage(layouts.slices_to_hist(stack)), training.ref_slice(layouts.manifest(stack))))


@query(f"WITH {DENSE}, {MATCH_SQL} SELECT volume_id, z, y, x, matched AS v FROM dense JOIN lut USING (volume_id, z, v)")
def apply_matched_histogram(spark, sf):
    stack = testdata.slices(spark, sf)
    lookup = histograms.match_histogram(cut_lineage(layouts.slices_to_hist(stack)), training.ref_slice(layouts.manifest(stack)))
    return plain(layouts.slices_to_voxels(histograms.apply_lookup(stack, lookup)))


# Regions ------------------------------------------------------------------------------------------


@query(f"""WITH {DENSE} SELECT volume_id, n_slices::BIGINT AS n_slices, h::BIGINT AS h, 3::BIGINT AS x_min, 2::BIGINT AS y_min,
(w - 5)::BIGINT AS x_max, (h - 4)::BIGINT AS y_max FROM shape""")
def preset_box(spark, sf):
    return plain(roi.preset_box(layouts.manifest(testdata.slices(spark, sf)), 2, 4, 3, 5))


@query(f"""WITH {DENSE}, t AS (SELECT volume_id, z, h, w, greatest(0, 2 - trunc(z * -0.7)::INT) AS y0, h - 6 AS height FROM shape JOIN (SELECT DISTINCT volume_id, z FROM dense) USING (volume_id))
SELECT volume_id, z::BIGINT AS z, 3::BIGINT AS x_min, (CASE WHEN least(h, y0 + height) = h THEN h - height ELSE y0 END)::BIGINT AS y_min,
(w - 5)::BIGINT AS x_max, least(h, y0 + height)::BIGINT AS y_max FROM t""")
def track_shifting_box(spark, sf):
    boxes = roi.preset_box(layouts.manifest(testdata.slices(spark, sf)), 2, 4, 3, 5)
    return plain(roi.track_shifting_box(boxes, -0.7))


KEYS_SQL = """k AS (SELECT DISTINCT volume_id, n_slices, unnest([least(1, n_slices - 1), n_slices // 4, n_slices // 2, 3 * n_slices // 4, n_slices - 1]) AS z FROM shape),
key_ AS (SELECT volume_id, z, z * 3 % 11 AS x_min, z * 5 % 7 AS y_min, 40 + z * 7 % 13 AS x_max, 9 + z % 5 AS y_max FROM k),
every AS (SELECT DISTINCT volume_id, z FROM dense),
near AS (SELECT e.volume_id, e.z, (SELECT max(z) FROM key_ k WHERE k.volume_id = e.volume_id AND k.z <= e.z) AS a,
                (SELECT min(z) FROM key_ k WHERE k.volume_id = e.volume_id AND k.z >= e.z) AS b FROM every e),
kbox AS (SELECT n.volume_id, n.z, CASE WHEN a = b THEN 0.0::DOUBLE ELSE (n.z - a) / (b - a)::DOUBLE END AS wt, p AS p, q AS q
         FROM near n JOIN key_ p ON p.volume_id = n.volume_id AND p.z = n.a JOIN key_ q ON q.volume_id = n.volume_id AND q.z = n.b),
ibox AS (SELECT volume_id, z, trunc(p.x_min * (1 - wt) + q.x_min * wt)::BIGINT AS x_min, trunc(p.y_min * (1 - wt) + q.y_min * wt)::BIGINT AS y_min,
                trunc(p.x_max * (1 - wt) + q.x_max * wt)::BIGINT AS x_max, trunc(p.y_max * (1 - wt) + q.y_max * wt)::BIGINT AS y_max FROM kbox)"""


def key_boxes(spark, sf):
    z = F.col("z")
    volumes = layouts.manifest(testdata.slices(spark, sf))
    return volumes.select("volume_id", F.explode(roi.key_slices()).alias("z")).select(
        "volume_id", "z", (z * 3 % 11).alias("x_min"), (z * 5 % 7).alias("y_min"), (z * 7 % 13 + 40).alias("x_max"), (z % 5 + 9).alias("y_max")
    )


@query(f"WITH {DENSE}, {KEYS_SQL} SELECT volume_id, z, x_min, y_min, x_max, y_max FROM ibox")
def keyframe_interpolate(spark, sf):
    return plain(roi.keyframe_interpolate(key_boxes(spark, sf)))


@query(f"""WITH {DENSE}, {KEYS_SQL}
SELECT d.volume_id, d.z, d.y, d.x, coalesce(y >= y_min AND y < y_max AND x >= x_min AND x < x_max, false) AS region
FROM dense d LEFT JOIN ibox USING (volume_id, z)""")
def roi_box_mask(spark, sf):
    voxels = layouts.slices_to_voxels(testdata.slices(spark, sf))
    marked = roi.roi_box_mask(voxels, roi.keyframe_interpolate(key_boxes(spark, sf)))
    return plain(marked.select("volume_id", "z", "y", "x", "region"))


@query(f"""WITH {DENSE}, {KEYS_SQL}
SELECT d.volume_id, d.z, d.y, d.x, (CASE WHEN y >= y_min AND y < y_max AND x >= x_min AND x < x_max THEN 1 ELSE 0 END)::BIGINT AS v
FROM dense d LEFT JOIN ibox USING (volume_id, z)""")
def box_masks(spark, sf):
    return plain(layouts.slices_to_voxels(roi.box_masks(testdata.slices(spark, sf), roi.keyframe_interpolate(key_boxes(spark, sf)))))


def tracked_masks(spark, sf):
    stack = testdata.slices(spark, sf)
    boxes = roi.track_shifting_box(roi.preset_box(layouts.manifest(stack), 2, 4, 3, 5), -0.7)
    return stack, roi.box_masks(stack, boxes)


TRACKED = """tb AS (SELECT volume_id, z, h, w, greatest(0, 2 - trunc(z * -0.7)::INT) AS y0, h - 6 AS height FROM shape JOIN (SELECT DISTINCT volume_id, z FROM dense) USING (volume_id)),
tin AS (SELECT d.*, (x >= 3 AND x < w - 5 AND y >= (CASE WHEN least(h, y0 + height) = h THEN h - height ELSE y0 END) AND y < least(h, y0 + height)) AS inside FROM dense d JOIN tb USING (volume_id, z))"""


@query(f"WITH {DENSE}, {TRACKED} SELECT volume_id, z, y, x, CASE WHEN inside THEN 255 ELSE trunc(v * (200.0::DOUBLE / 255.0::DOUBLE))::BIGINT END AS v FROM tin")
def highlight_tracked_region(spark, sf):
    return plain(layouts.slices_to_voxels(images.highlight(*tracked_masks(spark, sf))))


@query(f"WITH {DENSE}, {TRACKED} SELECT volume_id, z, y, x, CASE WHEN inside THEN v ELSE 0 END AS v FROM tin")
def apply_mask(spark, sf):
    return plain(layouts.slices_to_voxels(images.apply_mask(*tracked_masks(spark, sf))))


@query(f"""WITH {DENSE}, {TRACKED}, lim AS (SELECT volume_id, avg(v) * 0.8 AS l FROM dense GROUP BY 1),
per AS (SELECT volume_id, z, sum(CASE WHEN v > l THEN 1 ELSE 0 END) AS pores, count(*) AS total, 100.0::DOUBLE * sum(CASE WHEN v > l THEN 1 ELSE 0 END) / count(*) AS p
  FROM tin JOIN lim USING (volume_id) WHERE inside GROUP BY 1, 2),
st AS (SELECT volume_id, sum(total)::BIGINT AS n, sum(pores)::BIGINT AS k, round(100.0::DOUBLE * sum(pores) / sum(total), 3) AS o, round(min(p), 3) AS a, round(max(p), 3) AS b,
  round(avg(p), 3) AS c, round(stddev_pop(p), 3) AS d FROM per GROUP BY 1)
SELECT volume_id, i::BIGINT AS line_no, CASE i WHEN 0 THEN '=== Stack Region Porosity Analysis ===' WHEN 1 THEN '' WHEN 2 THEN 'Total highlighted voxels: ' || n
  WHEN 3 THEN 'Pore voxels within highlighted regions: ' || k WHEN 4 THEN printf('Overall region porosity: %.4f%%', o) WHEN 5 THEN 'Slice porosity within highlighted regions:'
  WHEN 6 THEN printf('  Min: %.4f%%', a) WHEN 7 THEN printf('  Max: %.4f%%', b) WHEN 8 THEN printf('  Mean: %.4f%%', c) ELSE printf('  StdDev: %.4f%%', d) END AS line FROM st, range(10) r(i)""")
def format_region_report(spark, sf):
    stats = analyses.analyze_region_porosity(*tracked_masks(spark, sf))
    return plain(porosity.format_region_report(plain(stats, 3), "Stack"))


CONTENT = """lim AS (SELECT volume_id, z, avg(v) * 1.1 AS l FROM {src} GROUP BY 1, 2),
ry AS (SELECT volume_id, z, y, sum(CASE WHEN v > l THEN 1 ELSE 0 END) AS bright, count(*) AS len FROM {src} JOIN lim USING (volume_id, z) GROUP BY 1, 2, 3),
rx AS (SELECT volume_id, z, x, sum(CASE WHEN v > l THEN 1 ELSE 0 END) AS bright, count(*) AS len FROM {src} JOIN lim USING (volume_id, z) GROUP BY 1, 2, 3)"""


@query(f"""WITH {DENSE}, {CONTENT.format(src='dense')}
SELECT volume_id, z, 'y' AS axis, y AS line, bright::BIGINT AS bright FROM ry WHERE bright > len * 0.35
UNION ALL SELECT volume_id, z, 'x', x, bright::BIGINT FROM rx WHERE bright > len * 0.35""")
def content_rows_cols(spark, sf):
    return plain(roi.content_lines(testdata.slices(spark, sf), 1.1, 0.35))


@query(f"""WITH {DENSE}, smp AS (SELECT DISTINCT volume_id, h, w, unnest([0, n_slices // 2, n_slices - 1]) AS z FROM shape),
src AS (SELECT d.* FROM dense d JOIN smp USING (volume_id, z)), {CONTENT.format(src='src').replace('1.1', '0.8')},
e AS (SELECT a.volume_id, a.z, y0, y1, x0, x1 FROM (SELECT volume_id, z, min(y) AS y0, max(y) AS y1 FROM ry WHERE bright > len * 0.05 GROUP BY 1, 2) a
      JOIN (SELECT volume_id, z, min(x) AS x0, max(x) AS x1 FROM rx WHERE bright > len * 0.05 GROUP BY 1, 2) b ON a.volume_id = b.volume_id AND a.z = b.z),
u AS (SELECT e.volume_id, min(greatest(1, x0 - 2)) AS a, min(greatest(2, y0 - 2)) AS b, max(least(w - 4, x1 + 2)) AS c, max(least(h - 3, y1 + 2)) AS d
      FROM e JOIN shape s ON s.volume_id = e.volume_id GROUP BY 1)
SELECT s.volume_id, n_slices::BIGINT AS n_slices, h::BIGINT AS h, coalesce(a, 1)::BIGINT AS x_min, coalesce(b, 2)::BIGINT AS y_min,
       coalesce(c, w - 4)::BIGINT AS x_max, coalesce(d, h - 3)::BIGINT AS y_max FROM shape s LEFT JOIN u ON u.volume_id = s.volume_id""")
def overall_box(spark, sf):
    stack = testdata.slices(spark, sf)
    boxes = roi.overall_box(stack, layouts.manifest(stack), padding=2, top=2, bottom=3, left=1, right=4)
    return plain(boxes)


BBOX = """bb AS (SELECT volume_id, z, min(CASE WHEN v > 185 THEN y END) AS min_row, max(CASE WHEN v > 185 THEN y END) AS max_row,
       min(CASE WHEN v > 185 THEN x END) AS min_col, max(CASE WHEN v > 185 THEN x END) AS max_col, NOT bool_or(v > 185) AS empty FROM dense GROUP BY 1, 2)"""


@query(f"WITH {DENSE}, {BBOX} SELECT volume_id, z, min_row, max_row, min_col, max_col, empty FROM bb")
def bounding_box(spark, sf):
    return plain(roi.bounding_box(testdata.slices(spark, sf), 185))


@query(f"""WITH {DENSE}, m AS (SELECT * FROM dense WHERE v > 110)
SELECT a.volume_id, a.z, a.y, a.x FROM m a WHERE (SELECT count(*) FROM m b WHERE b.volume_id = a.volume_id AND b.z = a.z
  AND abs(a.y - b.y) + abs(a.x - b.x) = 1) < 4""")
def mask_boundary(spark, sf):
    outline = roi.mask_boundary(layouts.map_slices(testdata.slices(spark, sf), lambda image: image > 110))
    return plain(layouts.slices_to_voxels(outline).where("v = 1").select("volume_id", "z", "y", "x"))


@query(f"""WITH {DENSE} SELECT s.volume_id, n_slices::BIGINT AS left_slices, r.n::BIGINT AS right_slices,
CASE WHEN r.n IS NULL THEN 'missing' WHEN r.n <> n_slices THEN 'z_mismatch' WHEN s.volume_id = 'v1' THEN 'xy_mismatch' ELSE 'ok' END AS status
FROM shape s LEFT JOIN (SELECT volume_id, count(DISTINCT z) AS n FROM dense WHERE z <> 2 OR volume_id <> 'v0' GROUP BY 1) r USING (volume_id)""")
def stack_manifest(spark, sf):
    stack = testdata.slices(spark, sf)
    other = stack.where("z <> 2 OR volume_id <> 'v0'").withColumn("w", F.when(F.col("volume_id") == "v1", 60).otherwise(F.col("w")))
    return plain(layouts.compare_manifests(stack, other))
