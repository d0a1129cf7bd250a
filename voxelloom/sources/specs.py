"""``key: value`` specification texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Keys every specification needs, and the defaults of the typed view.
REQUIRED_KEYS = ["nx", "ny", "nz", "overall_porosity"]
DEFAULT_SPEC = {"nx": 512, "ny": 512, "nz": 256, "voxel_size_nm": 10.0, "overall_porosity": 0.5}

# The characters counted as space at the ends of keys and values.
EDGE_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(EDGE_SPACE))


def read_spec_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(spec, text) per file. UTF-8 where the bytes are valid, Latin-1 otherwise."""
    files = spark.read.format("binaryFile").load(path)
    utf8 = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return files.select(
        F.col("path").alias("spec"), F.coalesce(utf8, F.decode("content", "ISO-8859-1")).alias("text")
    )


def parse_specs(texts: DataFrame) -> DataFrame:
    """(spec, settings MAP): a later line wins over an earlier one with the same key.

    Each text is parsed where it lies: the lines of one file never leave their row, so no shuffle.
    """
    lines = F.split(F.regexp_replace("text", "^\ufeff", ""), "\r\n|\n|\r")
    bodies = F.transform(lines, lambda line: strip(F.element_at(F.split(line, "#", 2), 1)))

    def pair(body: Column) -> Column:
        mark = F.when(F.contains(body, F.lit(":")), ":").otherwise("=")
        halves = F.split(body, mark, 2)
        key = strip(F.replace(F.replace(halves[0], F.lit("\ufeff"), F.lit("")), F.lit("\u00a0"), F.lit(" ")))
        return F.struct(key.alias("key"), strip(F.element_at(halves, 2)).alias("value"))

    settings = F.filter(bodies, lambda body: F.contains(body, F.lit(":")) | F.contains(body, F.lit("=")))
    pairs = F.filter(F.transform(settings, pair), lambda p: p["key"] != "")
    # In order of key and line, an entry holds where the next one has another key: time grows with n log n.
    placed = F.array_sort(F.transform(pairs, lambda p, line: F.struct(p["key"].alias("key"), line.alias("line"), p["value"].alias("value"))))

    def last_of_each(placed: Column) -> Column:
        after = F.slice(placed, 2, F.greatest(F.lit(1), F.size(placed)))
        beside = F.zip_with(placed, after, lambda here, then: F.struct(here["key"].alias("key"), here["value"].alias("value"), then["key"].alias("next")))
        last = F.filter(beside, lambda e: e["next"].isNull() | (e["next"] != e["key"]))
        return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))

    # Bound to a variable, the sorted lines are worked out once, however often they are named.
    return texts.select("spec", F.transform(F.array(placed), last_of_each)[0].alias("settings"))


def setting(key: str, settings: str | Column = "settings") -> Column:
    return F.element_at(settings, key)


def float_list(text: Column) -> Column:
    """Comma list to doubles; blank items dropped, items that are no number null; a missing text gives an empty array."""
    items = F.filter(F.transform(F.split(text, ","), strip), lambda item: item != "")
    return F.coalesce(F.transform(items, lambda item: item.try_cast("double")), F.array().cast("array<double>"))


def missing_keys(settings: str | Column = "settings") -> Column:
    """Required keys the spec does not have."""
    return F.array_except(F.array(*[F.lit(k) for k in REQUIRED_KEYS]), F.map_keys(settings))


def true_text(text: Column, default: str = "true") -> Column:
    return F.lower(F.coalesce(text, F.lit(default))) == "true"


NUMBERS = {"nx": "int", "ny": "int", "nz": "int", "voxel_size_nm": "double", "overall_porosity": "double", "max_iters": "int", "seed": "int", "random_seed": "int"}
LISTS = ["psd_bins_nm", "psd_weights"]


def problems(settings: str | Column = "settings") -> Column:
    """``key: text`` of every numeric setting, and of every list with an item, that is no number; sorted by key."""
    single = [F.when(setting(key, settings).isNotNull() & setting(key, settings).try_cast(kind).isNull(), key) for key, kind in NUMBERS.items()]
    lists = [F.when(F.exists(float_list(setting(key, settings)), lambda item: item.isNull()), key) for key in LISTS]
    found = F.array_sort(F.filter(F.array(*single, *lists), lambda key: key.isNotNull()))
    return F.transform(found, lambda key: F.concat(key, F.lit(": "), F.element_at(settings, key)))


def typed_specs(specs: DataFrame) -> DataFrame:
    """The settings other steps use, with defaults; ``seed`` wins over the older ``random_seed``.

    A number that cannot be read is null, not its default, and its text stands in ``problems``; the other specs go on.
    """

    def number(key: str, default: Column, *older: str) -> Column:
        given = F.coalesce(*[setting(k) for k in (key, *older)])
        return F.when(given.isNull(), default).otherwise(given.try_cast(NUMBERS[key])).alias(key)

    return specs.select(
        "spec",
        *[number(key, F.lit(DEFAULT_SPEC[key])) for key in ("nx", "ny", "nz", "voxel_size_nm", "overall_porosity")],
        F.lower(F.coalesce(setting("generator"), F.lit("spheres"))).alias("generator"),
        number("max_iters", F.lit(30)),
        number("seed", F.lit(-1), "random_seed"),
        F.coalesce(setting("slice_axis"), F.lit("z")).alias("slice_axis"),
        true_text(setting("export_png")).alias("export_png"),
        true_text(setting("sem_like")).alias("sem_like"),
        problems().alias("problems"),
    )
