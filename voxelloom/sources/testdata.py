"""Stacks, pixels, specs and meshes derived from the benchmark parquet tables.

Those tables hold no images. Each view below is a projection of a whole table, so its size grows with
the table; volume sizes are fixed by arithmetic on a dense id, so no volume is unbounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.session import broadcast_if_small, cut_lineage

Z, H, W = 8, 16, 64  # slices per volume, lines per slice, pixels per line of the embedding stacks
TEXT_H, TEXT_W = 32, 64  # text rasters: one document is a stack of 32 x 64 byte images
MESH_LINES = 10_000  # order lines of a mesh that lies in one task
TASK_LINES = 100_000  # order lines, of whole meshes, that one task takes, about


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gray_level(v: Column) -> Column:
    """-0.6..0.6 to 0..255, truncated."""
    scaled = (v.cast("double") + 0.6) / 1.2 * 255
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), scaled)).cast("int")


def scanlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per image line: volume, z, y and the 64 raw values."""
    vec = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("v"), F.floor(vec / (Z * H)).cast("string")).alias("volume_id"),
        F.floor((vec % (Z * H)) / H).cast("int").alias("z"),
        (vec % H).cast("int").alias("y"),
        "embedding",
    )


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form with the raw value ``f`` and the 8-bit value ``v``. Lazy: explode, no shuffle."""
    return (
        scanlines(spark, sf_dir)
        .select("volume_id", "z", "y", F.posexplode("embedding").alias("x", "e"))
        .select(
            "volume_id", "z", "y", "x", F.col("e").cast("double").alias("f"), gray_level(F.col("e")).alias("v")
        )
    )


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 8-bit stacks packed as bytes; lines missing from the last slice are 0."""
    hex_line = F.array_join(F.transform("embedding", lambda e: F.lpad(F.hex(gray_level(e).cast("long")), 2, "0")), "")
    lines = scanlines(spark, sf_dir).select("volume_id", "z", "y", hex_line.alias("line"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "line"))), lambda s: s["line"]), "")
    return (
        lines.groupBy("volume_id", "z")
        .agg(F.unhex(F.rpad(body, H * W * 2, "0")).alias("data"))
        .select(
            "volume_id", "z", F.format_string("slice_%04d.png", "z").alias("name"), F.lit(H).alias("h"),
            F.lit(W).alias("w"), F.lit("uint8").alias("dtype"), "data",
        )
    )


def text_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's whole UTF-8 bytes as a stack of 32 x 64 images; the end is filled with 0."""
    size = TEXT_H * TEXT_W
    raw = F.encode("text", "UTF-8")
    pages = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.length("raw") / size).cast("int")) - 1),
        lambda z: F.struct(z.alias("z"), F.rpad(F.col("raw").substr(z * size + 1, F.lit(size)), size, F.unhex(F.lit("00"))).alias("data")),
    )
    return (
        table(spark, sf_dir, "documents")
        .select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("volume_id"), raw.alias("raw"))
        .select("volume_id", F.explode(pages).alias("page"))
        .select(
            "volume_id", "page.z", F.format_string("slice_%04d.png", "page.z").alias("name"), F.lit(TEXT_H).alias("h"),
            F.lit(TEXT_W).alias("w"), F.lit("uint8").alias("dtype"), "page.data",
        )
    )


def scored_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with a foreground probability and a 0/1 truth; four slices make a batch of each volume."""
    line = F.col("embedding")
    mirrored = F.reverse(line)
    pairs = F.arrays_zip(line.alias("a"), mirrored.alias("b"))
    return (
        scanlines(spark, sf_dir)
        .select("volume_id", "z", "y", F.posexplode(pairs).alias("x", "p"))
        .select(
            F.concat("volume_id", F.lit("_"), F.floor(F.col("z") / 4).cast("string")).alias("batch"),
            F.concat("volume_id", F.lit("_"), F.col("z").cast("string")).alias("slice"),
            "y",
            "x",
            (F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("p.a").cast("double") * F.lit(-8.0)))).alias("p1"),
            (F.col("p.a").cast("double") + F.col("p.b").cast("double") * 0.5 > 0).cast("int").alias("t"),
        )
    )


def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty epochs per run from consecutive events."""
    event, value = F.col("event_id"), F.col("value")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("run_"), F.floor(event / 50).cast("string")).alias("run"),
        (event % 50 + 1).cast("int").alias("epoch"),
        (F.lit(1.0) / (value + 1)).alias("train_loss"),
        (value / (value + 5)).alias("val_pixAcc"),
        (value / (value + 20)).alias("val_IoU_pos"),
        (F.lit(0.001) / (event % 50 + 1)).alias("lr"),
    )


def spec_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A specification text per part, with comments, both delimiters, repeated and missing keys."""
    part = table(spark, sf_dir, "part")
    size, price = F.col("p_size"), F.col("p_retailprice")
    lines = [
        F.lit("# generated"),
        F.concat(F.lit("nx: "), (size + 100).cast("string"), F.lit("  # voxels")),
        F.when(F.col("p_partkey") % 7 != 0, F.concat(F.lit("ny = "), (size * 2 + 50).cast("string"))).otherwise("plain"),
        F.concat(F.lit("nz:"), (size % 30 + 10).cast("string")),
        F.lit("voxel_size_nm: 5"),
        F.concat(F.lit("overall_porosity : 0."), (size + 20).cast("string")),
        F.concat(F.when(F.col("p_partkey") % 2 == 0, "seed: ").otherwise("random_seed: "), F.col("p_partkey").cast("string")),
        F.lit("voxel_size_nm: 10"),
        F.concat(F.lit("psd_bins_nm: 89.0, "), (size * 10 + 90).cast("string"), F.lit(", , 1646.75")),
        F.concat(F.lit("psd_weights: 0.25, "), (size % 9 + 1).cast("string"), F.when(size % 5 == 0, "").otherwise(", 0.125")),
        F.lit("out=c:/x"),
        F.concat(F.lit("export_png: "), F.when(price % 2 < 1, "True").otherwise("no")),
        F.lit(" = nothing"),
    ]
    return part.select(F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("spec"), F.concat_ws("\n", *lines).alias("text"))


# The twelve outward triangles of a unit box, corners numbered 4*x + 2*y + z, counter-clockwise from outside.
BOX_FACES = [
    (0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1),
    (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3),
]


def box_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order lines that ``boxes_of`` makes meshes of."""
    mesh_id = F.concat(F.lit("m"), F.col("l_orderkey").cast("string")).alias("mesh_id")  # once a line, not for each triangle
    return table(spark, sf_dir, "lineitem").select(mesh_id, "l_linenumber", "l_quantity", "l_discount", "l_tax")


def dealt_box_lines(spark: SparkSession, sf_dir: str, most: int = MESH_LINES, at_once: int = TASK_LINES) -> tuple[DataFrame, DataFrame]:
    """The lines of meshes of at most ``most`` lines, a mesh in one task and about ``at_once`` lines in each, and the lines of larger meshes where they are.

    Lines are counted first; of large meshes there are at most as many as lines, divided by ``most``.
    """
    lines = box_lines(spark, sf_dir)
    large = cut_lineage(lines.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("mesh_id"))
    large = broadcast_if_small(large)
    tasks = max(spark.sparkContext.defaultParallelism, -(-lines.count() // at_once))
    # A null mesh, of lines without an order, equals no other and stays where it is.
    null = F.col("mesh_id").isNull()
    whole = lines.where(~null).join(large, "mesh_id", "left_anti").repartition(tasks, "mesh_id")
    return whole, lines.join(large, "mesh_id", "left_semi").unionByName(lines.where(null))


def box_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed meshes: every order is a mesh, every order line one axis-parallel box of 12 triangles."""
    return boxes_of(box_lines(spark, sf_dir))


def boxes_of(lines: DataFrame) -> DataFrame:
    """Twelve triangles of each line; how the lines are dealt by mesh is kept."""
    faces = F.array(*[F.struct(*[F.lit(corner).alias(p) for p, corner in zip("abc", face)]) for face in BOX_FACES])
    low = {"x": F.col("l_linenumber") * 100.0, "y": F.lit(0.0), "z": F.lit(0.0)}
    size = {"x": F.col("l_quantity"), "y": F.col("l_discount") * 100 + 1, "z": F.col("l_tax") * 100 + 1}
    bit = {"x": 4, "y": 2, "z": 1}
    flat = [
        (low[d] + F.when(F.col(f"t.{p}").bitwiseAND(bit[d]) > 0, size[d]).otherwise(0.0)).alias(f"{p}{d}")
        for p in "abc" for d in "xyz"
    ]
    return lines.select("*", F.explode(faces).alias("t")).select("mesh_id", *flat)


def points(spark: SparkSession, sf_dir: str, first: int, snap: bool = False) -> DataFrame:
    """3D points from the components of an embedding, every second triple from ``first`` on; beyond the last one it starts anew.

    The cloud is the label. ``snap`` moves the points to a grid of 5, where many of them coincide.
    """
    size = F.size("embedding")
    starts = F.sequence(F.lit(first), size - 1, F.lit(6))
    triples = table(spark, sf_dir, "embeddings").where(size > first).select("label", "embedding", F.explode(starts).alias("at"))

    def place(i: int) -> Column:
        part = F.get("embedding", (F.col("at") + i) % size).cast("double")
        return F.floor(part * 20).cast("double") * 5 if snap else part * 100

    return triples.select(F.concat(F.lit("c"), F.col("label").cast("string")).alias("cloud"), *[place(i).alias(axis) for i, axis in enumerate("xyz")])


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names in folders, some in the long naming scheme and some already renamed."""
    doc = F.col("doc_id")
    name = (
        F.when(doc % 5 == 0, F.format_string("slice_%04d.png", (doc % 160).cast("int")))
        .when(doc % 11 == 0, F.concat(F.lit("notes_"), doc.cast("string"), F.lit(".txt")))
        .otherwise(
            F.concat(
                F.when(doc % 3 == 0, "Synthetic_").otherwise("synthetic_"), (doc % 12).cast("string"), F.lit("_"),
                (doc % 170).cast("string"), F.when(doc % 2 == 0, ".png").otherwise(".PNG"),
            )
        )
    )
    return table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("_"), F.col("lang")).alias("dir"), name.alias("name"), F.col("n_chars").alias("n_bytes")
    ).distinct()
