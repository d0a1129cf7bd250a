"""Connected bodies of whole volumes: labels inside z-blocks, block faces as edges, star contraction, labels rewritten.

Three exchanges of packed slices at most and no pixel row: slices meet in their block, the touching faces of two blocks meet
as one pair of packed slices, and the finished labels meet the few names that changed. Only labels at block faces
become edges, so the graph is a small share of the volume.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.layouts import SLICE_COLUMNS, SLICE_SCHEMA, extent, image_of
from voxelloom.operators.images import label_components
from voxelloom.session import broadcast_if_small, cut_lineage

BLOCK = 8
LABEL_SCHEMA = SLICE_SCHEMA + ", block int, face int"


def smallest_reachable(edges: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """(keys, node, root): the smallest node each node of undirected edges (keys, a, b) is connected to.

    Alternating star contraction: every node first hands its larger neighbours, then its smaller ones, to the smallest
    node it knows. Each round is an aggregation and a join, stored before the next; rounds grow with the logarithm of the
    longest path. A node with very many neighbours is a hot key of the join only, which adaptive execution splits.
    """
    def contract(links: DataFrame, larger: bool) -> DataFrame:
        """Links point from a larger node ``u`` to a smaller one ``v``."""
        turned = links.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))
        around = links.union(turned) if larger else links
        least = around.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = around.join(least, [*keys, "u"])
        if larger:
            moved = moved.where(F.col("v") > F.col("u")).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = moved.select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(*keys, "u", F.col("m").alias("v")))
        return moved.where(F.col("u") != F.col("v")).distinct()

    def state(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first())

    links = edges.select(*keys, F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    links = cut_lineage(links)
    before = state(links)
    while True:
        links = cut_lineage(contract(contract(links, True), False))
        after = state(links)
        if after == before:
            break
        before = after
    return links.select(*keys, F.col("u").alias("node"), F.col("v").alias("root")).union(
        links.select(*keys, F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def label_blocks(slices: DataFrame, block: int = BLOCK) -> DataFrame:
    """int64 slices of labels that hold inside z-blocks: 0 outside, else 1 + the smallest voxel number of the body's part.

    ``face`` is 1 on a block's first slice, 2 on its last one, 3 if they are the same, else 0. A voxel's number counts from the
    volume's first slice.
    """
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("z")
        h, w = int(pdf["h"].iat[0]), int(pdf["w"].iat[0])
        mask = np.stack([image_of(row) != 0 for row in pdf.itertuples(index=False)])
        labels = label_components(mask)
        labels[labels > 0] += (int(pdf["z"].iat[0]) - int(pdf["first_z"].iat[0])) * h * w
        face = np.zeros(len(pdf), np.int32)
        face[0] += 1
        face[-1] += 2
        return pdf[SLICE_COLUMNS].assign(dtype="int64", data=[np.ascontiguousarray(image).tobytes() for image in labels], block=np.int32(key[1]), face=face)

    starts = broadcast_if_small(cut_lineage(extent(slices).select("volume_id", "first_z", F.col("n_slices").alias("_n"))), 500_000)
    placed = slices.select(*SLICE_COLUMNS).join(starts, "volume_id").withColumn("_block", F.floor((F.col("z") - F.col("first_z")) / block).cast("int"))
    return placed.groupBy("volume_id", "_block").applyInPandas(run, LABEL_SCHEMA)


def face_edges(labelled: DataFrame) -> DataFrame:
    """(volume_id, a, b): labels that touch across a block face. One pair of packed slices per face."""
    def touch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                a, b = np.frombuffer(row.data, np.int64), np.frombuffer(row.below, np.int64)
                both = (a > 0) & (b > 0)
                pairs = np.unique(np.stack([a[both], b[both]], 1), axis=0)
                yield pd.DataFrame({"volume_id": row.volume_id, "a": pairs[:, 0], "b": pairs[:, 1]})

    ends = labelled.where("face >= 2").select("volume_id", (F.col("block") + 1).alias("block"), "data")
    starts = labelled.where("face % 2 = 1").select("volume_id", "block", F.col("data").alias("below"))
    return ends.join(starts, ["volume_id", "block"]).mapInPandas(touch, "volume_id string, a bigint, b bigint")


def label_volume(slices: DataFrame, block: int = BLOCK) -> DataFrame:
    """int64 slices: 0 outside, else the label of the voxel's 6-connected body, 1 + its smallest voxel number.

    A volume may start at any z; gaps, repeated slices and mixed sizes raise. Block labels are stored once, because faces and
    the final labels both read them.
    """
    labelled = cut_lineage(label_blocks(slices, block))
    roots = smallest_reachable(face_edges(labelled), ["volume_id"]).where(F.col("node") != F.col("root"))
    # A label names the block it began in: the renamed labels of a block travel as one row.
    shape = labelled.groupBy("volume_id").agg((F.max("h").cast("long") * F.max("w") * block).alias("_voxels"))
    homes = roots.join(broadcast_if_small(cut_lineage(shape), 500_000), "volume_id").withColumn("block", F.floor((F.col("node") - 1) / F.col("_voxels")).cast("int"))
    renamed = homes.groupBy("volume_id", "block").agg(F.array_sort(F.collect_list(F.struct("node", "root"))).alias("names"))
    nodes = renamed.select("volume_id", "block", F.col("names.node").alias("nodes"), F.col("names.root").alias("roots"))

    def rename(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = []
            for row in batch.itertuples(index=False):
                labels = np.frombuffer(row.data, np.int64)
                if row.nodes is not None and len(row.nodes):
                    known, root = np.asarray(row.nodes, np.int64), np.asarray(row.roots, np.int64)
                    at = np.minimum(np.searchsorted(known, labels), len(known) - 1)
                    labels = np.where(known[at] == labels, root[at], labels)
                packed.append(labels.tobytes())
            yield batch[SLICE_COLUMNS].assign(data=packed)

    return labelled.join(nodes, ["volume_id", "block"], "left").select(*SLICE_COLUMNS, "nodes", "roots").mapInPandas(rename, SLICE_SCHEMA)


def body_sizes(labels: DataFrame) -> DataFrame:
    """(volume_id, label, size) of labelled slices: counted per slice in the scan's tasks, then added up."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                found, sizes = np.unique(image_of(row), return_counts=True)
                yield pd.DataFrame({"volume_id": row.volume_id, "label": found[found > 0], "n": sizes[found > 0]})

    parts = labels.select("volume_id", "h", "w", "dtype", "data").mapInPandas(count, "volume_id string, label bigint, n bigint")
    return parts.groupBy("volume_id", "label").agg(F.sum("n").alias("size"))
