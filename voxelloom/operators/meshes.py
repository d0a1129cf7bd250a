"""Triangle tables ``(mesh_id, ax..cz)``, point clouds and reconstruction results."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.session import broadcast_if_small, cut_lineage

CORNERS = ["a", "b", "c"]
AXES = ["x", "y", "z"]
CELL_POINTS = 16  # points of an average cell, were they spread evenly
LEAF = 256  # points of a cell that are compared one by one
TASK_POINTS = 12_000  # points whose cells, about 14 a point at first, one task sorts


def _cross(u: list[Column], v: list[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def mesh_volume_area(triangles: DataFrame) -> DataFrame:
    """Signed volume, area and face count per mesh: one map-side combined sum."""
    a, b, c = ([F.col(f"{p}{d}") for d in AXES] for p in CORNERS)
    volume = sum((x * y for x, y in zip(a, _cross(b, c))), F.lit(0.0)) / 6
    edge1, edge2 = [q - p for p, q in zip(a, b)], [q - p for p, q in zip(a, c)]
    area = F.sqrt(sum((n * n for n in _cross(edge1, edge2)), F.lit(0.0))) / 2
    return triangles.groupBy("mesh_id").agg(
        F.sum(volume).alias("volume"), F.sum(area).alias("area"), F.count(F.lit(1)).alias("n_faces")
    )


def mesh_vertex_count(triangles: DataFrame) -> DataFrame:
    """Distinct corner positions per mesh."""
    corners = F.array(*[F.struct(*[F.col(f"{p}{d}").alias(d) for d in AXES]) for p in CORNERS])
    distinct = triangles.select("mesh_id", F.explode(corners).alias("v")).distinct()
    return distinct.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_vertices"))


def mesh_bounds(triangles: DataFrame) -> DataFrame:
    """Axis-parallel bounds per mesh."""
    low = [F.min(F.least(*[F.col(f"{p}{d}") for p in CORNERS])).alias(f"{d}_min") for d in AXES]
    high = [F.max(F.greatest(*[F.col(f"{p}{d}") for p in CORNERS])).alias(f"{d}_max") for d in AXES]
    return triangles.groupBy("mesh_id").agg(*low, *high)


def mesh_bbox_porosity(measures: DataFrame, box_volume: str | Column) -> DataFrame:
    """1 - signed volume / box volume; above 1 means inverted winding, flagged by ``orientation_ok``."""
    box = F.col(box_volume) if isinstance(box_volume, str) else box_volume
    return measures.withColumn("porosity", 1.0 - F.col("volume") / F.nullif(box, F.lit(0.0))).withColumn(
        "orientation_ok", F.col("volume") >= 0
    )


def _section_pieces(triangles: DataFrame, axis: str, u: str, v: str) -> DataFrame:
    """``mesh_id, from, to, c0, c1, c2``: the cross product of a section's ends, as a polynomial, for the triangles of equal heights.

    Between its lowest and middle and between its middle and highest corner both ends of a triangle's section are linear
    in the height, so their cross product is a square one. It is taken over the share ``t`` of the way from ``from`` to ``to``, which
    keeps its coefficients as small as the corners' own products, and those of equal heights add up before any shuffle.
    """
    heights = [F.col(f"{p}{axis}") for p in CORNERS]
    lowest = F.when((heights[0] <= heights[1]) & (heights[0] <= heights[2]), 0).when(heights[1] <= heights[2], 1).otherwise(2)

    def corner(turn: int, name: str) -> Column:
        """A coordinate of the corner ``turn`` places after the lowest one; turning a triangle keeps its orientation."""
        at = [F.col(f"{CORNERS[(k + turn) % 3]}{name}") for k in range(3)]
        return F.when(F.col("_lowest") == 0, at[0]).when(F.col("_lowest") == 1, at[1]).otherwise(at[2])

    # A triangle that lacks a height has no share of any area, but it still meets planes between those it has.
    whole = F.lit(True)
    for h in heights:
        whole = whole & h.isNotNull()
    rows = triangles.where(F.least(*heights) < F.greatest(*heights)).withColumn("_lowest", lowest).select(
        "mesh_id", F.least(*heights).alias("_least"), F.greatest(*heights).alias("_greatest"), whole.alias("_whole"),
        *[corner(turn, name).alias(f"_{turn}{d}") for turn in range(3) for d, name in (("h", axis), ("u", u), ("v", v))],
    ).withColumn("_even", F.col("_1h") <= F.col("_2h"))
    rows = rows.select(
        "mesh_id", "_least", "_greatest", "_whole", "_even", *[F.col(f"_0{d}").alias(f"_l{d}") for d in "huv"],
        *[F.when(F.col("_even"), F.col(f"_{p}{d}")).otherwise(F.col(f"_{q}{d}")).alias(f"_{n}{d}") for n, p, q in (("m", 1, 2), ("t", 2, 1)) for d in "huv"],
    )
    share = (F.col("_mh") - F.col("_lh")) / F.nullif(F.col("_th") - F.col("_lh"), F.lit(0.0))
    # The point of the edge from the lowest to the highest corner at the height of the middle one.
    rows = rows.withColumns({f"_g{d}": F.col(f"_l{d}") + (F.col(f"_t{d}") - F.col(f"_l{d}")) * share for d in "uv"})
    point = {n: (F.col(f"_{n}u"), F.col(f"_{n}v")) for n in "lmgt"}

    def less(p: tuple, q: tuple) -> tuple:
        return p[0] - q[0], p[1] - q[1]

    def cross(p: tuple, q: tuple) -> Column:
        return p[0] * q[1] - p[1] * q[0]

    low, middle, long_end, high = point["l"], point["m"], point["g"], point["t"]
    below = [F.lit(0.0), cross(low, less(middle, long_end)), cross(less(long_end, low), less(middle, low))]
    above = [
        cross(long_end, middle), cross(long_end, less(high, middle)) + cross(less(high, long_end), middle),
        cross(less(high, long_end), less(high, middle)),
    ]
    half = F.when(F.col("_whole"), F.when(F.col("_even"), 0.5).otherwise(-0.5))
    whole = F.col("_whole")
    pieces = [
        (F.when(whole, F.col("_lh")).otherwise(F.col("_least")), F.when(whole, F.col("_mh")).otherwise(F.col("_greatest")), below),
        (F.when(whole, F.col("_mh")), F.col("_th"), above),
    ]
    pieces = F.array(*[F.struct(x.alias("from"), y.alias("to"), *[(half * c).alias(f"c{k}") for k, c in enumerate(of)]) for x, y, of in pieces])
    rows = rows.select("mesh_id", F.explode(pieces).alias("p")).select("mesh_id", "p.*").where(F.col("from") < F.col("to"))
    return rows.groupBy("mesh_id", "from", "to").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(3)])


def mesh_section_area(triangles: DataFrame, n: int = 30, axis: str = "z", margin: float = 1e-6) -> DataFrame:
    """Cross-section area at ``n`` evenly spaced planes per mesh.

    The piece of a plane inside a triangle is a directed segment; half the sum of their cross products is the enclosed
    area. Triangles of equal heights are added up first, as polynomials of the plane's place between those heights;
    each sum computes the numbers of the planes it meets, so there is no range join. The bounds, one row a mesh, are
    stored and counted: up to 100,000 meshes the sums stay where they are, beyond they are dealt by mesh.
    """
    u, v = [d for d in AXES if d != axis] if axis != "y" else ["z", "x"]
    bounds = mesh_bounds(triangles).select(
        "mesh_id", (F.col(f"{axis}_min") + margin).alias("_lo"), (F.col(f"{axis}_max") - margin).alias("_hi")
    )
    low, high = F.col("from"), F.col("to")
    step = (F.col("_hi") - F.col("_lo")) / max(1, n - 1)
    first = F.greatest(F.lit(0), F.floor((low - F.col("_lo")) / step) - 1).cast("int")
    last = F.least(F.lit(n - 1), F.ceil((high - F.col("_lo")) / step) + 1).cast("int")
    position = F.when(F.col("plane") == n - 1, F.col("_hi")).otherwise(F.col("_lo") + F.col("plane") * step)
    met = (
        _section_pieces(triangles, axis, u, v).join(broadcast_if_small(cut_lineage(bounds)), "mesh_id")
        .where((last >= first) & (F.col("_hi") > F.col("_lo")))
        .withColumn("plane", F.explode(F.sequence(first, last)))
        .withColumn("pos", position)
        .where((low < F.col("pos")) & (high >= F.col("pos")))
        .withColumn("t", (F.col("pos") - low) / (high - low))
    )
    part = F.col("c0") + F.col("t") * (F.col("c1") + F.col("t") * F.col("c2"))
    return met.select("mesh_id", "plane", "pos", part.alias("part")).groupBy("mesh_id", "plane").agg(
        F.max("pos").alias("position"), F.sum("part").alias("area")
    )


def occupied_box_porosity(cells: DataFrame) -> DataFrame:
    """Free share of the box spanned by the occupied cells (mesh_id, x, y, z) of each mesh."""
    box = F.lit(1.0)
    for axis in AXES:
        box = box * (F.max(axis) - F.min(axis) + 1)
    return cells.groupBy("mesh_id").agg((1.0 - F.count(F.lit(1)) / box).alias("porosity"), F.count(F.lit(1)).alias("n_cells"))


def nearest_neighbour_distance(a: DataFrame, b: DataFrame, keys: list[str] = ["cloud"], leaf: int = LEAF) -> DataFrame:
    """Distance of every distinct point of ``a`` to its nearest point of ``b`` of the same key; exact.

    ``b`` becomes a pyramid of grid cells, built once: one row per non-empty cell and level with the box around its points
    and one of them. A point of ``a`` takes a first bound from its own cells, looks at the level whose cells are as
    wide as that bound (27 of them at most hold all that is nearer), and only cells that may hold a nearer point are
    opened, level by level in one plan. Points are compared one by one only in cells of ``leaf`` points or fewer;
    a denser one is searched by a pyramid of its own. ``n`` counts the copies of a point of ``a``. Null ``distance``: no
    point of ``b`` has the key, or the point lacks a coordinate; points of ``b`` that lack one are left out.
    """
    me = [*keys, *AXES]
    left = a.groupBy(*me).agg(F.count(F.lit(1)).alias("n"))
    whole = " and ".join(f"{d} is not null" for d in AXES)
    found = _search(left.where(whole).select(*me, F.lit(float("inf")).alias("best")), b.select(*me).where(whole).distinct(), keys, leaf)
    same = F.lit(True)
    for c in me:
        same = same & F.col(f"p.{c}").eqNullSafe(F.col(f"f.{c}"))
    joined = left.alias("p").join(found.alias("f"), same, "left")
    return joined.select(*[F.col(f"p.{c}") for c in me], F.col("p.n"), F.sqrt(F.nullif(F.col("f.best"), F.lit(float("inf")))).alias("distance"))


def _steps(x: Column, d: str) -> Column:
    """Number of the finest cell along an axis. Halving it gives the coarser cells: a power of two scales exactly."""
    last = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("depth")) - 1
    at = F.floor((x - F.col(f"from_{d}")) / F.col("extent") * (last + 1).cast("double"))
    return F.greatest(F.lit(0).cast("long"), F.least(last, at))


def _cells(at: dict[str, Column], level: Column) -> list[Column]:
    return [F.call_function("shiftright", at[d], F.col("depth") - level).alias(f"c_{d}") for d in AXES]


def _pyramid(b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Frame of every key (origin, extent, depth) and the cells of all levels as ``keys, level, c_x, c_y, c_z, node``."""
    frame = b.groupBy(*keys).agg(
        *[F.min(d).alias(f"from_{d}") for d in AXES], F.greatest(*[F.max(d) - F.min(d) for d in AXES]).alias("extent"),
        # Two points or more are always parted, so a pyramid inside a cell comes to an end.
        F.when(F.count(F.lit(1)) > 1, F.greatest(F.lit(1.0), F.ceil(F.log2(F.count(F.lit(1)) / CELL_POINTS) / 3))).otherwise(0).cast("int").alias("depth"),
    ).withColumn("extent", F.when(F.col("extent") > 0, F.col("extent")).otherwise(1.0))
    frame = cut_lineage(frame)
    corner = [F.col(f"from_{d}") for d in AXES] + [F.col("extent")]
    cell = [f"c_{d}" for d in AXES]

    def boxes(rows: DataFrame, low: str, high: str, one: Column, n: Column, *by: str) -> DataFrame:
        return rows.groupBy(*keys, *by, *cell).agg(
            *[F.min(low.format(d)).alias(f"lo_{d}") for d in AXES], *[F.max(high.format(d)).alias(f"hi_{d}") for d in AXES],
            F.min(one).alias("one"), n.alias("n"),
        )

    placed = b.join(frame, keys).select(*keys, "depth", *AXES, *[_steps(F.col(d), d).alias(f"c_{d}") for d in AXES])
    finest = boxes(placed, "{}", "{}", F.struct(*AXES), F.count(F.lit(1)), "depth")
    levels = finest.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("depth"))))
    levels = levels.withColumns({c: F.call_function("shiftright", F.col(c), F.col("depth") - F.col("level")) for c in cell})
    every = boxes(levels, "lo_{}", "hi_{}", F.col("one"), F.sum("n"), "level")
    node = F.struct("level", *cell, *[f"{end}_{d}" for end in ("lo", "hi") for d in AXES], "one", "n")
    return frame, cut_lineage(every.select(*keys, "level", *cell, node.alias("node")))


def _lower(node: str = "node") -> Column:
    gap = [F.greatest(F.lit(0.0), F.col(f"{node}.lo_{d}") - F.col(d), F.col(d) - F.col(f"{node}.hi_{d}")) for d in AXES]
    return sum((g * g for g in gap), F.lit(0.0))


def _upper(point: str = "node.one") -> Column:
    return sum(((F.col(d) - F.col(f"{point}.{d}")) * (F.col(d) - F.col(f"{point}.{d}")) for d in AXES), F.lit(0.0))


def _search(a: DataFrame, b: DataFrame, keys: list[str], leaf: int) -> DataFrame:
    """``keys, x, y, z, best``: the smaller of ``a``'s ``best`` and the squared distance to the nearest point of ``b``."""
    me, cell = [*keys, *AXES], [f"c_{d}" for d in AXES]
    b = cut_lineage(b)
    frame, pyramid = _pyramid(b, keys)
    deepest = frame.agg(F.max("depth")).first()[0]
    if deepest is None:
        return a
    placed = a.join(frame, keys)
    own = placed.select(*me, "best", "depth", F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("level"), *[_steps(F.col(d), d).alias(f"s_{d}") for d in AXES])
    own = own.select(*me, "best", "level", *_cells({d: F.col(f"s_{d}") for d in AXES}, F.col("level")))
    # The cell of level 0 holds all points of the key, so every point finds a bound.
    seeds = own.join(pyramid, [*keys, "level", *cell]).groupBy(*me).agg(F.least(F.min("best"), F.min(_upper())).alias("best"))
    seeds = cut_lineage(seeds.withColumn("number", F.monotonically_increasing_id()))
    # Tasks grow in number with the points, not in size. A point's number deals its rows: a window normalises doubles, so that
    # rows dealt by the coordinates would be dealt once more.
    tasks = max(a.sparkSession.sparkContext.defaultParallelism, -(-seeds.count() // TASK_POINTS))
    mine = [*me, "number"]

    # A little more than the bound, so that rounding loses no cell.
    reach = F.sqrt("best") * (1 + 1e-9)
    level = F.when(reach > 0, F.floor(F.log2(F.col("extent") / reach))).otherwise(F.col("depth"))
    around = seeds.join(frame, keys).withColumn("level", F.greatest(F.lit(0), F.least(F.col("depth").cast("long"), level)).cast("int"))
    ends = [_cells({d: _steps(F.col(d) + side * reach, d) for d in AXES}, F.col("level")) for side in (-1, 1)]
    around = around.select(*mine, "best", "depth", "level", *[F.sequence(low, high).alias(c) for c, low, high in zip(cell, *ends)])
    for c in cell:
        around = around.withColumn(c, F.explode(c))
    point = Window.partitionBy("number")

    def kept(rows: DataFrame) -> DataFrame:
        """Cells that may hold a nearer point, and those whose point gives the bound."""
        bound = rows.repartition(tasks, "number").withColumn("best", F.least("best", F.min(_upper()).over(point)))
        return bound.where((_lower() < F.col("best")) | (_upper() <= F.col("best")))

    rows = kept(around.join(pyramid, [*keys, "level", *cell]).select(*mine, "best", "depth", "node"))
    for level in range(deepest):
        parts = pyramid.where(F.col("level") == level + 1)
        parts = parts.groupBy(*keys, *[F.call_function("shiftright", F.col(c), F.lit(1)).alias(c) for c in cell]).agg(F.collect_list("node").alias("parts"))
        # Rows that stay as they are get a level that no part has: their cells still spread them over the tasks.
        opens = (F.col("node.level") == level) & (F.col("depth") > level) & (_lower() < F.col("best"))
        rows = rows.select("*", F.when(opens, level).otherwise(-1).alias("level"), *[F.col(f"node.{c}").alias(c) for c in cell])
        rows = rows.join(parts.withColumn("level", F.lit(level)), [*keys, "level", *cell], "left")
        rows = kept(rows.select(*mine, "best", "depth", F.explode(F.coalesce("parts", F.array("node"))).alias("node")))
    last = cut_lineage(rows.select(*me, "best", (_lower() < F.col("best")).alias("opens"), F.col("node.n").alias("n"), *[F.col(f"node.{c}").alias(c) for c in cell]))
    answers = seeds.drop("number").unionByName(last.select(*me, "best"))

    in_cell = b.join(frame, keys).select(*keys, *[_steps(F.col(d), d).alias(f"c_{d}") for d in AXES], F.struct(*AXES).alias("other"))
    few = last.where(F.col("opens") & F.col("n").between(2, leaf)).select(*me, "best", *cell)
    answers = answers.unionByName(few.join(in_cell, [*keys, *cell]).groupBy(*me).agg(F.min(_upper("other")).alias("best")))
    crowd = last.where(F.col("opens") & (F.col("n") > leaf)).select(*me, "best", *cell)
    if not crowd.isEmpty():
        # A crowded cell becomes a key of its own, with a frame as narrow as its points.
        inner = [f"{c}_{len(keys)}" for c in cell]
        crowd = crowd.withColumnsRenamed(dict(zip(cell, inner)))
        dense = in_cell.withColumnsRenamed(dict(zip(cell, inner))).join(crowd.select(*keys, *inner).distinct(), [*keys, *inner], "left_semi")
        answers = answers.unionByName(_search(crowd, dense.select(*keys, *inner, "other.*"), [*keys, *inner], leaf).select(*me, "best"))
    return answers.groupBy(*me).agg(F.min("best").alias("best"))


def chamfer_hausdorff(a: DataFrame, b: DataFrame, keys: list[str] = ["cloud"]) -> DataFrame:
    """Mean of the two directed mean nearest distances, and the larger of the two directed maxima.

    One row per cloud of either side; ``status`` is ``one_sided``, without distances, where the other side has none.
    """

    def directed(p: DataFrame, q: DataFrame, name: str) -> DataFrame:
        mean = F.sum(F.col("distance") * F.col("n")) / F.sum("n")
        return nearest_neighbour_distance(p, q, keys).groupBy(*keys).agg(
            mean.alias(f"mean_{name}"), F.max("distance").alias(f"max_{name}")
        )

    both = directed(a, b, "ab").join(directed(b, a, "ba"), keys, "full")
    return both.select(
        *keys, ((F.col("mean_ab") + F.col("mean_ba")) / 2).alias("chamfer_distance"),
        F.when(F.col("max_ab").isNotNull(), F.greatest("max_ab", "max_ba")).alias("hausdorff_distance"),
        F.when(F.col("max_ab").isNull() | F.col("max_ba").isNull(), "one_sided").otherwise("ok").alias("status"),
    )


def recon_ratios(records: DataFrame, gt_unit: float = 1.0) -> DataFrame:
    """Volume, area and porosity ratios of the successful records; ``gt_unit`` is the length of one ground-truth unit in voxels."""
    ok = records.where("success")
    scale3, scale2 = math.pow(gt_unit, 3), math.pow(gt_unit, 2)
    return ok.select(
        "id", "method",
        (F.col("pred_volume") / F.nullif(F.col("gt_volume") * scale3, F.lit(0.0))).alias("volume_ratio"),
        (F.col("pred_area") / F.nullif(F.col("gt_area") * scale2, F.lit(0.0))).alias("area_ratio"),
        F.abs(F.col("pred_porosity") - F.col("gt_porosity")).alias("porosity_error"),
        (F.col("pred_porosity") / F.nullif(F.col("gt_porosity"), F.lit(0.0))).alias("porosity_ratio"),
    )


def method_summary(records: DataFrame) -> DataFrame:
    """Successes, failures and mean metrics per method."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    means = ["chamfer_distance", "hausdorff_distance", "pred_volume", "pred_area", "n_faces"]
    return records.groupBy("method").agg(
        F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"),
        *[F.avg(F.when(ok, F.col(c))).alias(f"mean_{c}") for c in means], F.min("error").alias("first_error"),
    )


def method_errors(records: DataFrame) -> DataFrame:
    """Every error text of a method's failed runs with its count; a failure without text has a null one."""
    failed = records.where(~F.coalesce(F.col("success"), F.lit(False)))
    return failed.groupBy("method", "error").agg(F.count(F.lit(1)).alias("n"))


def method_vs_golden(estimates: DataFrame, methods: list[str]) -> DataFrame:
    """(id, method, estimate) against the golden porosity: error, absolute error and rank within the id.

    The methods of one id stand in one row, so they are ranked there: one plus the number of methods
    with a strictly smaller absolute error.
    """
    entries = F.array(*[
        F.struct(F.lit(m).alias("method"), F.col(f"{m}_result").alias("estimate"),
                 (F.col(f"{m}_result") - F.col("golden_porosity")).alias("error")) for m in methods
    ])
    ranked = F.transform(
        entries,
        lambda e: F.struct(
            e["method"].alias("method"), e["estimate"].alias("estimate"), e["error"].alias("error"),
            F.abs(e["error"]).alias("abs_error"),
            (F.size(F.filter(entries, lambda o: F.abs(o["error"]) < F.abs(e["error"]))) + 1).alias("rank"),
        ),
    )
    return estimates.select("id", "golden_porosity", F.explode(ranked).alias("m")).select("id", "golden_porosity", "m.*")
