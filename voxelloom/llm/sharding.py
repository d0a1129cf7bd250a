"""Sharding by a weighted hash tree: region, rack and shard are drawn one below the other."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.ordering import rank_in_buckets

DIGITS = 13  # hex digits of a draw: 52 bits, exact as a double


@dataclass(frozen=True)
class Tree:
    """``shards`` leaves of equal weight, filled rack by rack and region by region.

    A full region never changes: another shard joins the last open region, or opens a new one when all are
    full. A node weighs as much as the shards below it.
    """

    shards: int
    racks_per_region: int = 2
    shards_per_rack: int = 2

    def children(self) -> dict[int, dict[int, list[int]]]:
        """Region -> rack -> shards."""
        out: dict[int, dict[int, list[int]]] = {}
        for shard in range(self.shards):
            rack = shard // self.shards_per_rack
            out.setdefault(rack // self.racks_per_region, {}).setdefault(rack, []).append(shard)
        return out


def draw(key: Column, level: str, node: int, weight: int) -> Column:
    """``ln(u) / weight`` with a uniform ``u`` from key, level and node: the largest draw wins in proportion to weight.

    Growing one node's weight raises only its own draws, so keys move only into that node.
    """
    digest = F.md5(F.concat_ws("|", key, F.lit(level), F.lit(str(node))))
    u = (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**DIGITS))
    return F.log(u) / F.lit(float(weight))


def winner(key: Column, level: str, weights: dict[int, int]) -> Column:
    """The drawn node; equal draws go to the smaller number."""
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    best = F.greatest(*[F.struct(draw(key, level, n, w).alias("d"), F.lit(-n).alias("n")) for n, w in weights.items()])
    return -best["n"]


def shard_of(key: Column, tree: Tree) -> Column:
    """Descend the tree. ``key`` is a string column; null takes the draws of the word ``null``."""
    key = F.coalesce(key, F.lit("null"))
    regions = tree.children()

    def leaf(rack: int, shards: list[int]) -> Column:
        return winner(key, "shard", {s: 1 for s in shards})

    def inside(racks: dict[int, list[int]]) -> Column:
        rack = winner(key, "rack", {r: len(s) for r, s in racks.items()})
        out = None
        for r, shards in racks.items():
            out = F.when(rack == r, leaf(r, shards)) if out is None else out.when(rack == r, leaf(r, shards))
        return out

    region = winner(key, "region", {r: sum(map(len, racks.values())) for r, racks in regions.items()})
    out = None
    for r, racks in regions.items():
        out = F.when(region == r, inside(racks)) if out is None else out.when(region == r, inside(racks))
    return out.cast("int")


def shard_documents(docs: DataFrame, shards: int = 16, rows_per_bucket: int = 50_000, **tree) -> DataFrame:
    """Shard, slot and checksum of every row; the texts themselves are not shuffled.

    Equal ids share a shard. Slots count from 0 in each shard, in the order of a hash bucket, doc_id, checksum
    and size; rows equal in all of these are alike, so their order does not matter. A null text has size 1 and
    checksum 0, a null id is a key like any other. Extra columns are dropped. An empty table gives no rows.
    """
    key = F.col("doc_id").cast("string")
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select(
        F.col("doc_id"),
        (F.length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, Tree(shards, **tree)).alias("shard"),
        shard_of(key, Tree(shards + 1, **tree)).alias("grown_shard"),
    )
    # Copies of one id cannot spread over buckets by the id alone, so the checksum is part of the bucket's hash.
    buckets = max(1, docs.count() // (rows_per_bucket * shards))
    bucket = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets))
    order = ["doc_id", "text_crc32", "size"]
    return rank_in_buckets(rows, ["shard"], order, bucket, "slot")
