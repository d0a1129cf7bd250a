"""Smoothing, morphology, components, distances and pore sizes on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelloom import layouts
from voxelloom.operators import bodies, images, psd, slabs, synthetic
from voxelloom.plans import analyses
from voxelloom.plans.porosity_queries import MATCH_SQL, OTSU_SQL
from voxelloom.plans.registry import DENSE, plain, query
from voxelloom.sources import testdata

# Solid where bright; `solid` is the packed 0/1 stack, DENSE with `s` its SQL twin.
LIMIT = 120
SOLID = DENSE + f", solid AS (SELECT volume_id, z, y, x, (CASE WHEN v > {LIMIT} THEN 1 ELSE 0 END) AS v FROM dense)"
DENSER = SOLID.replace(f"v > {LIMIT}", "v > 90")
CROSS = "(SELECT unnest([0, 1, -1, 0, 0, 0, 0]) AS dz, unnest([0, 0, 0, 1, -1, 0, 0]) AS dy, unnest([0, 0, 0, 0, 0, 1, -1]) AS dx)"


def solid(spark, sf, limit=LIMIT):
    return layouts.map_slices(testdata.slices(spark, sf), lambda image: image > limit)


def spread_sql(name: str, source: str) -> str:
    """Dilation by the cross as SQL: a voxel is set when one of its seven cells is."""
    return f"""{name} AS (SELECT d.volume_id, d.z, d.y, d.x, max(coalesce(s.v, 0)) AS v FROM {source} d, {CROSS} o
  LEFT JOIN {source} s ON s.volume_id = d.volume_id AND s.z = d.z + dz AND s.y = d.y + dy AND s.x = d.x + dx GROUP BY 1, 2, 3, 4)"""


def shrink_sql(name: str, source: str) -> str:
    """Erosion: all seven cells set, those outside the volume counting as 0."""
    return spread_sql(name, source).replace("max(coalesce", "min(coalesce")


def taps_sql(sigma: float, name: str = "taps") -> str:
    radius = int(4 * sigma + 0.5)
    return f"""{name} AS (SELECT d, exp(-0.5 * d * d / ({sigma}::DOUBLE * {sigma}::DOUBLE)) / sum(exp(-0.5 * d * d / ({sigma}::DOUBLE * {sigma}::DOUBLE))) OVER () AS k FROM range({-radius}, {radius + 1}) r(d))"""


def blur_sql(name: str, source: str, axis: str, size: str, integer: bool = False) -> str:
    """One blur pass along an axis; positions outside are mirrored with the edge repeated."""
    value = "sum(s.v * k)"
    value = f"trunc(round({value}, 9))" if integer else value
    others = [a for a in "zyx" if a != axis]
    same = " AND ".join(f"s.{a} = d.{a}" for a in others)
    place = f"d.{axis} + t.d"
    period = f"((({place}) % (2 * {size}) + 2 * {size}) % (2 * {size}))"
    mirrored = f"(CASE WHEN {period} >= {size} THEN 2 * {size} - 1 - {period} ELSE {period} END)"
    return f"""{name} AS (SELECT d.volume_id, d.z, d.y, d.x, {value} AS v FROM {source} d JOIN shape USING (volume_id), taps t
  JOIN {source} s ON s.volume_id = d.volume_id AND {same} AND s.{axis} = {mirrored} GROUP BY 1, 2, 3, 4)"""


@query(f"""WITH {DENSE} SELECT volume_id, z, y, x, coalesce(v - lag(v) OVER w, 0) AS slope, (coalesce(v - lag(v) OVER w, 0) + 256) % 256 AS wrapped
FROM dense WINDOW w AS (PARTITION BY volume_id, z, y ORDER BY x)""")
def forward_gradient(spark, sf):
    stack = testdata.slices(spark, sf)
    slope = images.float_slices_to_voxels(slabs.forward_gradient(stack)).select("volume_id", "z", "y", "x", F.col("v").cast("int").alias("slope"))
    wrapped = images.float_slices_to_voxels(slabs.forward_gradient(stack, wrap=True)).select("volume_id", "z", "y", "x", F.col("v").cast("int").alias("wrapped"))
    return plain(slope.join(wrapped, ["volume_id", "z", "y", "x"]))


@query(f"WITH {DENSE}, {taps_sql(0.8)}, {blur_sql('blur_y', 'dense', 'y', 'h')}, {blur_sql('blur_x', 'blur_y', 'x', 'w')} SELECT volume_id, z, y, x, round(v, 6) AS v FROM blur_x")
def gaussian_blur(spark, sf):
    return plain(images.float_slices_to_voxels(slabs.gaussian_blur_2d(testdata.slices(spark, sf))))


@query(f"WITH {DENSE}, {taps_sql(0.7)}, {blur_sql('blur_z', 'dense', 'z', 'n_slices')}, {blur_sql('blur_y', 'blur_z', 'y', 'h')}, {blur_sql('blur_x', 'blur_y', 'x', 'w')} SELECT volume_id, z, y, x, round(v, 6) AS v FROM blur_x")
def gaussian_blur_3d(spark, sf):
    return plain(images.float_slices_to_voxels(slabs.gaussian_blur_3d(testdata.slices(spark, sf), block=4)))


@query(f"""WITH {DENSE}, {taps_sql(0.8)}, {blur_sql('blur_y', 'dense', 'y', 'h')}, {blur_sql('blur_x', 'blur_y', 'x', 'w')},
g AS (SELECT *, coalesce(v - lag(v) OVER (PARTITION BY volume_id, z, y ORDER BY x), 0) AS slope FROM blur_x)
SELECT volume_id, z, y, x, (CASE WHEN v > 170 THEN 1 WHEN v < 40 THEN 0 WHEN slope > 15 THEN 1 ELSE 0 END)::BIGINT AS v FROM g""")
def tri_threshold(spark, sf):
    ruled = layouts.map_slices(testdata.slices(spark, sf), lambda image: analyses.segment_slice(image, False))
    return plain(layouts.slices_to_voxels(ruled))


@query(f"WITH {SOLID}, {spread_sql('r', 'solid')} SELECT volume_id, z, y, x, v::BIGINT AS v FROM r")
def binary_dilate(spark, sf):
    return plain(layouts.slices_to_voxels(slabs.binary_dilate(solid(spark, sf), block=3)))


@query(f"WITH {DENSER}, {shrink_sql('a', 'solid')}, {shrink_sql('r', 'a')} SELECT volume_id, z, y, x, v::BIGINT AS v FROM r")
def binary_erode(spark, sf):
    return plain(layouts.slices_to_voxels(slabs.binary_erode(solid(spark, sf, 90), iterations=2, block=3)))


@query(f"WITH {SOLID}, {shrink_sql('a', 'solid')}, {spread_sql('r', 'a')} SELECT volume_id, z, y, x, v::BIGINT AS v FROM r")
def binary_open(spark, sf):
    return plain(layouts.slices_to_voxels(slabs.binary_open(solid(spark, sf), block=3)))


@query(f"WITH {SOLID}, {spread_sql('a', 'solid')}, {shrink_sql('r', 'a')} SELECT volume_id, z, y, x, v::BIGINT AS v FROM r")
def binary_close(spark, sf):
    return plain(layouts.slices_to_voxels(slabs.binary_close(solid(spark, sf), block=3)))


@query(f"""WITH {SOLID} SELECT d.volume_id, d.z, d.y, d.x, min(s.v)::BIGINT AS v FROM solid d JOIN solid s ON s.volume_id = d.volume_id AND s.z = d.z
AND s.y BETWEEN d.y - 2 AND d.y + 2 AND s.x BETWEEN d.x - 2 AND d.x + 2 GROUP BY 1, 2, 3, 4""")
def dilate_pore(spark, sf):
    return plain(layouts.slices_to_voxels(slabs.dilate_pore(solid(spark, sf), 2)))


@query(f"""WITH {SOLID}, {taps_sql(0.7)}, {blur_sql('blur_z', 'solid', 'z', 'n_slices')}, {blur_sql('blur_y', 'blur_z', 'y', 'h')}, {blur_sql('blur_x', 'blur_y', 'x', 'w')}
SELECT volume_id, z, y, x, (CASE WHEN v > 0.5 THEN 1 ELSE 0 END)::BIGINT AS v FROM blur_x""")
def smooth_rethreshold(spark, sf):
    return plain(layouts.slices_to_voxels(slabs.smooth_rethreshold(solid(spark, sf), block=3)))


@query(f"""WITH {SOLID}, void AS (SELECT volume_id, z, y, x, 1 - v AS v FROM solid), {spread_sql('up', 'void')}, {shrink_sql('down', 'void')},
phi AS (SELECT volume_id, avg(v) AS p, CASE WHEN volume_id = 'v0' THEN avg(v) WHEN volume_id = 'v1' THEN 0.6 ELSE 0.3 END AS t FROM void GROUP BY 1)
SELECT n.volume_id, n.z, n.y, n.x, (CASE WHEN abs(p - t) < 0.002 THEN n.v WHEN p < t THEN u.v ELSE d.v END)::BIGINT AS v
FROM void n JOIN phi USING (volume_id) JOIN up u USING (volume_id, z, y, x) JOIN down d USING (volume_id, z, y, x)""")
def adjust_porosity(spark, sf):
    voids = layouts.map_slices(solid(spark, sf), lambda image: 1 - image)
    phi = slabs.pore_share(voids)
    target = F.when(F.col("volume_id") == "v0", F.col("phi")).when(F.col("volume_id") == "v1", 0.6).otherwise(0.3)
    return plain(layouts.slices_to_voxels(slabs.adjust_porosity(voids, phi.select("volume_id", target.alias("target")), block=3)))


@query(f"""WITH {DENSE}, l AS (SELECT * FROM dense UNION ALL SELECT volume_id, z, y, 63 - x, 255 - v FROM dense WHERE z < 4)
SELECT volume_id, z, y, x, min(v)::BIGINT AS v FROM l GROUP BY 1, 2, 3, 4""")
def union_voids(spark, sf):
    first = testdata.slices(spark, sf)
    second = layouts.map_slices(images.flip(first.where("z < 4"), horizontal=True), lambda image: 255 - image)
    return plain(layouts.slices_to_voxels(synthetic.union_voids([first, second])))


# Components, distances, sizes ---------------------------------------------------------------------

# Smallest pixel number reachable through 4-neighbours of equal colour, per pixel.
COMPONENTS = """px AS (SELECT volume_id, z, y, x, y * 64 + x + 1 AS id, {colour} AS c FROM {source}),
nb AS (SELECT a.volume_id, a.z, a.id, b.id AS other FROM px a JOIN px b ON a.volume_id = b.volume_id AND a.z = b.z AND a.c = b.c
  AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
reach AS (SELECT volume_id, z, id AS root, id FROM px UNION SELECT r.volume_id, r.z, r.root, n.other FROM reach r JOIN nb n ON n.volume_id = r.volume_id AND n.z = r.z AND n.id = r.id WHERE n.other > r.root),
lab AS (SELECT volume_id, z, id, min(root) AS label FROM reach GROUP BY 1, 2, 3),
comp AS (SELECT px.*, label, count(*) OVER (PARTITION BY px.volume_id, px.z, label) AS size FROM px JOIN lab USING (volume_id, z, id))"""


@query(f"""WITH RECURSIVE {DENSE}, b AS (SELECT * FROM dense WHERE v > 130), {COMPONENTS.format(colour='1', source='b')}
SELECT volume_id, z, label::BIGINT AS label, max(size)::BIGINT AS size FROM comp GROUP BY 1, 2, 3""")
def connected_components(spark, sf):
    return plain(images.component_sizes(solid(spark, sf, 130)))


# The same for bodies of a whole volume, joined through voxel sides.
BODIES = """bpx AS (SELECT volume_id, (z * 16 + y) * 64 + x + 1 AS id, z, y, x FROM dense WHERE v > 165),
bnb AS (SELECT a.volume_id, a.id, b.id AS other FROM bpx a JOIN bpx b ON a.volume_id = b.volume_id
  AND (b.id = a.id + 1 AND b.y = a.y AND b.z = a.z OR b.id = a.id + 64 AND b.z = a.z OR b.id = a.id + 1024)),
both_ways AS (SELECT * FROM bnb UNION ALL SELECT volume_id, other, id FROM bnb),
breach AS (SELECT volume_id, id AS root, id FROM bpx UNION SELECT r.volume_id, r.root, n.other FROM breach r JOIN both_ways n ON n.volume_id = r.volume_id AND n.id = r.id WHERE n.other > r.root)"""


@query(f"WITH RECURSIVE {DENSE}, {BODIES} SELECT volume_id, label::BIGINT AS label, count(*)::BIGINT AS size FROM (SELECT volume_id, id, min(root) AS label FROM breach GROUP BY 1, 2) GROUP BY 1, 2")
def connected_bodies(spark, sf):
    return plain(bodies.body_sizes(bodies.label_volume(solid(spark, sf, 165), block=3)))


@query(f"""WITH RECURSIVE {DENSE}, b AS (SELECT * FROM dense WHERE v > 130), {COMPONENTS.format(colour='1', source='b')}
SELECT d.volume_id, d.z, d.y, d.x, (CASE WHEN size >= 10 THEN 1 ELSE 0 END)::BIGINT AS v FROM dense d LEFT JOIN comp c USING (volume_id, z, y, x)""")
def remove_small_objects(spark, sf):
    return plain(layouts.slices_to_voxels(images.remove_small_objects(solid(spark, sf, 130), 10)))


@query(f"""WITH RECURSIVE {DENSE}, b AS (SELECT * FROM dense WHERE v <= 120), {COMPONENTS.format(colour='1', source='b')}
SELECT d.volume_id, d.z, d.y, d.x, (CASE WHEN size >= 10 THEN 0 ELSE 1 END)::BIGINT AS v FROM dense d LEFT JOIN comp c USING (volume_id, z, y, x)""")
def remove_small_holes(spark, sf):
    return plain(layouts.slices_to_voxels(images.remove_small_holes(solid(spark, sf, 120), 10)))


OTSU_SLICE = OTSU_SQL.format(key="sid", gkey="g.sid")


@query(f"""WITH RECURSIVE {DENSE}, unit AS (SELECT volume_id || '/' || z AS sid, volume_id, z, y, x, v / (max(v) OVER (PARTITION BY volume_id, z))::DOUBLE AS u, 1.0::DOUBLE AS n FROM dense), {OTSU_SLICE},
b AS (SELECT volume_id, z, y, x FROM unit JOIN otsu USING (sid) WHERE u < threshold), {COMPONENTS.format(colour='1', source='b')},
kept AS (SELECT volume_id, z, y, x FROM comp WHERE size >= 10),
open_ AS (SELECT volume_id, z, y, x FROM dense EXCEPT SELECT * FROM kept), {COMPONENTS.format(colour='1', source='open_').replace('px', 'px2').replace('nb ', 'nb2 ').replace('nb AS', 'nb2 AS').replace('reach', 'reach2').replace('lab ', 'lab2 ').replace('JOIN lab2 USING', 'JOIN lab2 USING').replace('comp AS', 'comp2 AS')}
SELECT d.volume_id, d.z, d.y, d.x, (CASE WHEN c.size >= 10 THEN 0 ELSE 1 END)::BIGINT AS v FROM dense d LEFT JOIN comp2 c USING (volume_id, z, y, x)""")
def preprocess_image(spark, sf):
    return plain(layouts.slices_to_voxels(analyses.preprocess_image(testdata.slices(spark, sf))))


EDT = """edt AS (SELECT a.volume_id, a.z, a.y, a.x, CASE WHEN a.v = 0 THEN 0.0::DOUBLE ELSE
 sqrt((SELECT min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) FROM solid b WHERE b.volume_id = a.volume_id AND b.z = a.z AND b.v = 0)) END AS d FROM solid a)"""


@query(f"WITH {SOLID}, {EDT} SELECT volume_id, z, y, x, round(d, 6) AS v FROM edt")
def edt(spark, sf):
    return plain(images.float_slices_to_voxels(images.edt(solid(spark, sf))))


@query(f"""WITH {SOLID}, holes AS (SELECT volume_id, z, y, x FROM solid WHERE v = 0)
SELECT a.volume_id, a.z, a.y, a.x, CASE WHEN a.v = 0 THEN 0.0 ELSE round(sqrt((SELECT min((a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))
  FROM holes b WHERE b.volume_id = a.volume_id)), 6) END::DOUBLE AS v FROM solid a""")
def edt_3d(spark, sf):
    return plain(images.float_slices_to_voxels(images.edt_3d(solid(spark, sf), group_bytes=4096)))


THICK = f"""{EDT}, thick AS (SELECT a.volume_id, a.z, a.y, a.x, 2 * max(coalesce(c.d, 0)) AS t FROM solid a LEFT JOIN edt c ON c.volume_id = a.volume_id AND c.z = a.z AND a.v = 1 AND c.d > 0
  AND (a.y - c.y) * (a.y - c.y) + (a.x - c.x) * (a.x - c.x) < round(c.d * c.d) GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {SOLID}, {THICK} SELECT volume_id, z, y, x, round(t, 6) AS v FROM thick")
def local_thickness(spark, sf):
    return plain(images.float_slices_to_voxels(images.local_thickness(solid(spark, sf))))


PSD = f"""{THICK}, sz AS (SELECT volume_id, z, t * 10 AS v FROM thick WHERE t > 0),
rg AS (SELECT volume_id, z, CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo, CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi, count(*) AS total FROM sz GROUP BY 1, 2),
cn AS (SELECT volume_id, z, least(7, floor((v - lo) / ((hi - lo) / 8)))::INT AS bin, count(*) AS n FROM sz JOIN rg USING (volume_id, z) GROUP BY 1, 2, 3),
psd AS (SELECT rg.volume_id, rg.z, i AS bin, lo + (i + 0.5) * ((hi - lo) / 8) AS center, coalesce(n, 0) AS n, coalesce(n, 0) / (total * ((hi - lo) / 8)) AS p
  FROM rg CROSS JOIN range(8) g(i) LEFT JOIN cn ON cn.volume_id = rg.volume_id AND cn.z = rg.z AND cn.bin = i)"""


def sizes(spark, sf):
    return analyses.pore_sizes(solid(spark, sf))


@query(f"WITH {SOLID}, {PSD} SELECT volume_id, z, bin::BIGINT AS bin, round(center, 6) AS center, n::BIGINT AS n, round(p, 6) AS p FROM psd")
def pore_size_distribution(spark, sf):
    return plain(sizes(spark, sf))


@query(f"WITH {SOLID}, {PSD} SELECT volume_id, z, round(sum(center * p) / sum(p), 6) AS mean_pore_size FROM psd GROUP BY 1, 2")
def weighted_mean_size(spark, sf):
    return plain(psd.weighted_mean_size(sizes(spark, sf)))


@query(f"WITH {SOLID}, {PSD} SELECT volume_id, z, round(arg_max(center, (n, -bin)), 6) AS max_pore_size FROM psd GROUP BY 1, 2")
def modal_size(spark, sf):
    return plain(psd.modal_size(sizes(spark, sf)))


STATS = f"""{PSD}, stats AS (SELECT volume_id, z, porosity, total_pores, mean_pore_size, max_pore_size FROM
  (SELECT volume_id, z, sum(v) / count(*)::DOUBLE AS porosity, sum(v) AS total_pores FROM solid GROUP BY 1, 2)
  JOIN (SELECT volume_id, z, sum(center * p) / sum(p) AS mean_pore_size, arg_max(center, (n, -bin)) AS max_pore_size FROM psd GROUP BY 1, 2) USING (volume_id, z))"""


def pore_stats(spark, sf):
    return psd.image_pore_stats(layouts.slices_to_hist(solid(spark, sf)), sizes(spark, sf))


@query(f"WITH {SOLID}, {STATS} SELECT volume_id, z, round(porosity, 6) AS porosity, total_pores::BIGINT AS total_pores, round(mean_pore_size, 6) AS mean_pore_size, round(max_pore_size, 6) AS max_pore_size FROM stats")
def image_pore_stats(spark, sf):
    return plain(pore_stats(spark, sf))


INTERP = f"""{PSD}, gr AS (SELECT volume_id, min(center) AS lo, max(center) AS hi FROM psd GROUP BY 1),
gp AS (SELECT volume_id, i, CASE WHEN i = 99 THEN hi ELSE lo + i * ((hi - lo) / 99) END AS g FROM gr, range(100) r(i)),
sg AS (SELECT volume_id, z, bin, center AS c, p, lead(center) OVER w AS c1, lead(p) OVER w AS p1, lag(center) OVER w AS c_before FROM psd WINDOW w AS (PARTITION BY volume_id, z ORDER BY bin)),
ip AS (SELECT volume_id, z, i, g, CASE WHEN g <= c OR c1 IS NULL THEN p ELSE (p1 - p) / (c1 - c) * (g - c) + p END AS p FROM gp JOIN sg USING (volume_id)
  WHERE (g >= c OR c_before IS NULL) AND (g < c1 OR c1 IS NULL))"""


@query(f"WITH {SOLID}, {INTERP} SELECT volume_id, z, i::BIGINT AS grid, round(g, 6) AS size, round(p, 6) AS p FROM ip")
def interp_psd(spark, sf):
    return plain(psd.interp_psd(sizes(spark, sf), ["volume_id"]))


@query(f"""WITH {SOLID}, {INTERP} SELECT volume_id, i::BIGINT AS grid, round(max(g), 6) AS bin_centers, round(avg(p), 6) AS mean_probability, round(stddev_pop(p), 6) AS std_probability FROM ip GROUP BY 1, 2""")
def aggregate_psd(spark, sf):
    return plain(psd.aggregate_psd(sizes(spark, sf), ["volume_id"]))


@query(f"""WITH {SOLID}, {STATS} SELECT volume_id, round(avg(porosity), 6) AS mean_porosity, round(stddev_samp(porosity), 6) AS std_porosity, round(avg(mean_pore_size), 6) AS mean_size,
round(stddev_samp(mean_pore_size), 6) AS std_size, count(*)::BIGINT AS n_images, round(a, 6) AS min_size, round(b, 6) AS max_size
FROM stats JOIN (SELECT volume_id, min(center) AS a, max(center) AS b FROM psd GROUP BY 1) USING (volume_id) GROUP BY volume_id, a, b""")
def run_summary(spark, sf):
    return plain(psd.run_summary(pore_stats(spark, sf), ["volume_id"], sizes(spark, sf)))


@query("""WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.5) AS b, quantile_cont(l_extendedprice, 0.75) AS c FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(a, 6) AS q1, round(b, 6) AS median, round(c, 6) AS q3,
round(min(CASE WHEN l_extendedprice BETWEEN a - (c - a) * 1.5 AND c + (c - a) * 1.5 THEN l_extendedprice END), 6) AS whisker_low,
round(max(CASE WHEN l_extendedprice BETWEEN a - (c - a) * 1.5 AND c + (c - a) * 1.5 THEN l_extendedprice END), 6) AS whisker_high,
sum(CASE WHEN l_extendedprice BETWEEN a - (c - a) * 1.5 AND c + (c - a) * 1.5 THEN 0 ELSE 1 END)::BIGINT AS n_outliers
FROM lineitem JOIN q USING (l_returnflag) GROUP BY l_returnflag, a, b, c""")
def boxplot_stats(spark, sf):
    return plain(psd.boxplot_stats(testdata.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice"))


def turn_sql(name: str, source: str, sizes: str, angle: int, z: str = "z", x: str = "x") -> str:
    """Bilinear turn in the plane of two axes; ``sizes`` has (volume_id, nz, nx). Result (volume_id, z, y, x, t)."""
    corner = "LEFT JOIN {0} {1} ON {1}.volume_id = l.volume_id AND {1}.{2} = z0 + {4} AND {1}.y = l.y AND {1}.{3} = x0 + {5}"
    joins = "\n ".join(corner.format(source, f"c{i}{j}", z, x, i, j) for i in (0, 1) for j in (0, 1))
    total = " + ".join(f"coalesce(c{i}{j}.v, 0) * {'fz' if i else '(1 - fz)'} * {'fx' if j else '(1 - fx)'}" for i in (0, 1) for j in (0, 1))
    return f"""{name}_big AS (SELECT *, trunc(abs(c) * nz + abs(s) * nx + 0.5)::INT AS oz, trunc(abs(s) * nz + abs(c) * nx + 0.5)::INT AS ox
  FROM (SELECT *, cos(radians({angle})) AS c, sin(radians({angle})) AS s FROM {sizes})),
{name}_at AS (SELECT b.*, zi AS z, xi AS x, c * (zi - (oz - 1) / 2.0::DOUBLE) + s * (xi - (ox - 1) / 2.0::DOUBLE) + (nz - 1) / 2.0::DOUBLE AS sz,
  -s * (zi - (oz - 1) / 2.0::DOUBLE) + c * (xi - (ox - 1) / 2.0::DOUBLE) + (nx - 1) / 2.0::DOUBLE AS sx
  FROM (SELECT *, unnest(range(oz)) AS zi FROM {name}_big) b, range((SELECT max(ox) FROM {name}_big)) r(xi) WHERE xi < ox),
{name}_line AS (SELECT o.*, y, floor(sz)::INT AS z0, floor(sx)::INT AS x0, sz - floor(sz) AS fz, sx - floor(sx) AS fx,
  sz >= 0 AND sz <= nz - 1 AND sx >= 0 AND sx <= nx - 1 AS inside FROM {name}_at o, range(16) r(y)),
{name} AS (SELECT l.volume_id, l.z, l.y, l.x, CASE WHEN inside THEN {total} ELSE 0 END AS t FROM {name}_line l
 {joins})"""


def turned_blur(name: str, source: str, axis: str, size: str, taps: str) -> str:
    """The same blur without a self-join: every line adds itself, weighted, to the lines it reaches."""
    period = f"((i + d) % (2 * {size}) + 2 * {size}) % (2 * {size})"
    place = {a: "i" if a == axis else a for a in "zyx"}
    return f"""{name}_at AS (SELECT volume_id, i, k, CASE WHEN {period} >= {size} THEN 2 * {size} - 1 - {period} ELSE {period} END AS j
  FROM (SELECT *, unnest(range({size})) AS i FROM turned_shape), {taps}),
{name} AS (SELECT s.volume_id, {place['z']} AS z, {place['y']} AS y, {place['x']} AS x, sum(s.v * k) AS v
  FROM {source} s JOIN {name}_at p ON p.volume_id = s.volume_id AND p.j = s.{axis} GROUP BY 1, 2, 3, 4)"""


SEGMENT = f"""{DENSE}, {MATCH_SQL},
matched AS (SELECT volume_id, z, y, x, matched AS v FROM dense JOIN lut USING (volume_id, z, v)),
first_sizes AS (SELECT volume_id, n_slices AS nz, 64 AS nx FROM shape), {turn_sql('ahead', 'matched', 'first_sizes', 52)},
aligned AS (SELECT volume_id, x AS z, y, z AS x, floor(t + 0.5) AS v FROM ahead),
turned_shape AS (SELECT volume_id, ox AS n_slices, 16 AS h, oz AS w FROM ahead_big),
{taps_sql(0.8)}, {turned_blur('flat_y', 'aligned', 'y', 'h', 'taps')}, {turned_blur('flat_x', 'flat_y', 'x', 'w', 'taps')},
slope AS (SELECT volume_id, z, y, x, round(v, 9) AS v, coalesce(round(round(v, 9) - lag(round(v, 9)) OVER (PARTITION BY volume_id, z, y ORDER BY x), 9), 0) AS g FROM flat_x),
ruled AS (SELECT volume_id, z, y, x, CASE WHEN v > 170 THEN 1 WHEN v < 40 THEN 0 WHEN g > 15 THEN 1 ELSE 0 END AS v FROM slope),
{shrink_sql('o1', 'ruled')}, {spread_sql('opened', 'o1')}, {spread_sql('c1', 'opened')}, {shrink_sql('closed', 'c1')},
{taps_sql(0.7, 'fine')}, {turned_blur('fine_z', 'closed', 'z', 'n_slices', 'fine')}, {turned_blur('fine_y', 'fine_z', 'y', 'h', 'fine')},
{turned_blur('fine_x', 'fine_y', 'x', 'w', 'fine')},
smooth AS (SELECT volume_id, z, y, x, CASE WHEN round(v, 9) > 0.5 THEN 1 ELSE 0 END AS v FROM fine_x),
last_sizes AS (SELECT volume_id, w AS nz, n_slices AS nx FROM turned_shape), {turn_sql('back', 'smooth', 'last_sizes', -52, 'x', 'z')}""".replace(" AS (SELECT", " AS MATERIALIZED (SELECT")


@query(f"WITH {SEGMENT} SELECT volume_id, z::BIGINT AS z, (CASE WHEN t > 0.5 THEN 1 ELSE 0 END)::BIGINT AS v, count(*)::BIGINT AS n FROM back GROUP BY 1, 2, 3")
def segment_volume(spark, sf):
    restored = analyses.segment_volume(testdata.slices(spark, sf), block=4)
    return plain(layouts.slices_to_hist(restored))
