"""Ranks and running values that no single task has to sort alone.

A plain ``row_number().over(partitionBy(k).orderBy(o))`` pulls a whole key into one task. These helpers
cut the order into buckets first, number rows inside a bucket, and add the counts of the buckets before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from voxelloom.session import cut_lineage


def rank_in_buckets(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    alias: str,
    weight: str | None = None,
    total: str | None = None,
) -> DataFrame:
    """Rows (or ``weight``) that come before each row of its key. ``bucket`` must not decrease along ``order``.

    Rows shuffle on (keys, bucket); the offsets are a prefix sum over one row per (keys, bucket).
    ``total`` names an extra column with the key's full amount.
    """
    amount = F.col(weight) if weight else F.lit(1)
    marked = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        marked.groupBy(*keys, "_bucket")
        .agg(F.sum(amount).alias("_total"))
        .select(
            *keys,
            "_bucket",
            F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"),
            F.sum("_total").over(Window.partitionBy(*keys)).alias(total or "_all"),
        )
    )
    numbered = marked.withColumn("_local", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return (
        numbered.join(offsets, [*keys, "_bucket"])
        .withColumn(alias, F.col("_local") + F.col("_offset"))
        .drop("_bucket", "_offset", "_local", *([] if total else ["_all"]))
    )


def _running(rows: DataFrame, weight: str) -> DataFrame:
    """Add ``_before``: the sum of ``weight`` over the rows before, in the order of each partition."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = 0
        for batch in batches:
            amounts = batch.column(batch.schema.get_field_index(weight)).to_numpy(zero_copy_only=False)
            sums = np.cumsum(amounts) + carried
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums - amounts)], names=[*batch.schema.names, "_before"])
            carried = sums[-1] if len(sums) else carried

    return rows.mapInArrow(add, StructType([*rows.schema.fields, StructField("_before", rows.schema[weight].dataType)]))


def dealt_in_ranges(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Partitions that follow each other in the order of (keys, order), each sorted. Equal rows are dealt by their input position."""
    placed = df.withColumn("_place", F.monotonically_increasing_id())
    return placed.repartitionByRange(*keys, *order, "_place").sortWithinPartitions(*keys, *order).drop("_place")


def rank_rows(df: DataFrame, keys: list[str], order: list[str], alias: str, weight: str | None = None, total: str | None = None) -> DataFrame:
    """Zero-based rank of any sortable columns without nulls; ``weight`` adds up a whole-number column instead of rows.

    Rows are dealt by ranges of (keys, order, input position), sampled by Spark, so there are as many ranges as shuffle
    partitions and a hot key, or a value that fills a third of the table, spans several. They are numbered along the sorted
    ranges and stored; the rows before each range come from one row per range, the rows before each key from one row per key.
    """
    ranges = dealt_in_ranges(df, keys, order)
    if weight:
        numbered = _running(ranges, weight).withColumn("_range", F.spark_partition_id())
    else:
        position = F.monotonically_increasing_id()  # the range's number above bit 33, the row's place below
        numbered = ranges.withColumn("_id", position).withColumns({"_range": F.shiftright("_id", 33).cast("int"), "_before": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id")
    stored = cut_lineage(numbered)
    amount = F.col(weight) if weight else F.lit(1)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes = stored.groupBy("_range").agg(F.max(F.col("_before") + amount).alias("_n"))
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    along = stored.join(F.broadcast(offsets), "_range").withColumn("_before", F.col("_before") + F.col("_offset")).drop("_range", "_offset")
    starts = along.groupBy(*keys).agg(F.min("_before").alias("_start"), F.sum(amount).alias(total or "_all"))
    whole = along.join(starts, keys) if keys else along.join(F.broadcast(starts))  # without keys: one row
    return whole.withColumn(alias, F.col("_before") - F.col("_start")).drop("_before", "_start", *([] if total else ["_all"]))


def rank_by_hash(
    df: DataFrame, keys: list[str], name: str, seed: int, alias: str, total: str | None = None
) -> DataFrame:
    """Zero-based rank in a repeatable pseudo-random order, md5 of name and seed.

    The hash spreads rows evenly, so its first three hex digits serve as 4096 balanced buckets.
    """
    digest = F.md5(F.concat_ws("|", F.col(name), F.lit(str(seed))))
    hashed = df.withColumn("_md5", digest)
    ranked = rank_in_buckets(hashed, keys, ["_md5", name], F.substring("_md5", 1, 3), alias, total=total)
    return ranked.drop("_md5")


def running_max_before(
    df: DataFrame, keys: list[str], step: str, value: str, alias: str, block: int = 65536
) -> DataFrame:
    """Largest ``value`` on strictly earlier steps (integer column ``step``); null on the first one.

    Two levels: inside blocks of ``block`` steps, then over the block maxima.
    """
    marked = df.withColumn("_block", F.floor(F.col(step) / block))
    earlier = Window.partitionBy(*keys, "_block").orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    blocks_before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    tops = (
        marked.groupBy(*keys, "_block")
        .agg(F.max(value).alias("_top"))
        .select(*keys, "_block", F.max("_top").over(blocks_before).alias("_carry"))
    )
    return (
        marked.withColumn("_inside", F.max(value).over(earlier))
        .join(tops, [*keys, "_block"])
        .withColumn(alias, F.greatest("_inside", "_carry"))
        .drop("_block", "_inside", "_carry")
    )


def ranked_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, _n, _first, _size): how often each value occurs, how many smaller ones its key has, and its key's rows.

    Equal values are counted before the shuffle, so a value that fills a third of the table is one row. The input is read once;
    the result is stored.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return rank_rows(counted, keys, [value], "_first", weight="_n", total="_size")


def percentiles_of(ranked: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """Linear-interpolated percentiles per key from ``ranked_counts``, columns ``p0, p1, ...``."""
    def at_rank(rank: Column) -> Column:
        return F.max(F.when((F.col("_first") <= rank) & (rank < F.col("_first") + F.col("_n")), F.col(value)))

    columns = []
    for i, share in enumerate(shares):
        place = (F.col("_size") - 1) * F.lit(float(share))
        low, high = at_rank(F.floor(place)), at_rank(F.ceil(place))
        columns.append((low + (high - low) * F.max(place - F.floor(place))).alias(f"p{i}"))
    return ranked.groupBy(*keys).agg(*columns)


def exact_percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """Linear-interpolated percentiles per key, columns ``p0, p1, ...``."""
    return percentiles_of(ranked_counts(df, keys, value), keys, value, shares)
