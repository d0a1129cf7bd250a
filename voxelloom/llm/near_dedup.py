"""SimHash near-duplicates: fingerprints, links found with pivot distance tables, connected groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from voxelloom.llm.shared import SpanHasher, mix64, pieces, runs, store, texts_of
from voxelloom.session import broadcast_if_small

BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEED = 42
BITS = 64
MAX_DISTANCE = 3
PIVOTS = 24  # reference fingerprints of the distance table
GROUP = 4096  # fingerprints compared with each other in one array
# Near copies of the pipeline's stage.
SHINGLE = 5
LEAST_JACCARD = 0.8
WIDE_BLOCKS = 8  # 16-bit blocks of its 128-bit fingerprints
WIDE_DISTANCE = 32  # Jaccard 0.8 differs in about 19 of 128 bits, standard deviation 4
SETS_IN_GROUP = 512  # sets compared with each other in one array
SETS_AT_ONCE = 1 << 20  # shingles of a group that one row holds, about
PREFIX_BYTES = 1 << 19  # text whose shingles the pipeline's stage takes at once
ORDER_SAMPLE, ORDER_SHINGLES = 2_000, 1 << 18  # texts whose shingles are counted, at least, and frequent shingles that are put last
ORDER_SHARE = 0.04  # of the texts: a shingle that grows frequent with the table is seen at any size
COARSE_SET = 512  # shingles of a set beyond which 256 parities say nothing


def shingle_spans(data: np.ndarray, ends: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cleaned bytes, start and stop and text number of every shingle in them, and shingles of each text.

    Words are runs of non-blank bytes, A-Z in lower case; a text of fewer words than a shingle has one shingle.
    """
    words = ~BLANK[data]
    start, stop, doc = runs(words, ends)
    n_docs = len(ends) - 1
    # Words again, with one space after each.
    keep = words.copy()
    keep[stop[stop < len(data)]] = True
    # A text may end in a word; its follower belongs to the next text, so spaces are set by position below.
    length = stop - start
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length + 1, out=at[1:])
    clean = np.full(at[-1], 32, np.uint8)
    letters = np.ones(at[-1], bool)
    letters[at[1:] - 1] = False
    clean[letters] = LOWER[data[words]]
    count = np.bincount(doc, minlength=n_docs)
    grams = np.where(count == 0, 0, np.maximum(1, count - shingle + 1))
    first_word = np.concatenate([[0], np.cumsum(count)[:-1]])
    gram_end = np.cumsum(grams)
    gram_doc = np.repeat(np.arange(n_docs), grams)
    word = np.arange(len(gram_doc)) - (gram_end - grams)[gram_doc] + first_word[gram_doc]
    last = np.minimum(word + shingle, (first_word + count)[gram_doc])
    return clean, at[word], at[last] - 1, gram_doc, grams


def fingerprints_of(data: np.ndarray, ends: np.ndarray, shingle: int = 3, hashes_at_once: int = 1 << 16) -> np.ndarray:
    """SimHash of each text as ``uint64``, from its shingles."""
    clean, a, b, gram_doc, grams = shingle_spans(data, ends, shingle)
    raw, n_docs = clean.tobytes(), len(grams)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros((n_docs, BITS), np.int64)
    for lo in range(0, len(a), hashes_at_once):
        hi = min(len(a), lo + hashes_at_once)
        hashes = np.fromiter((digest(raw[x:y], SEED) for x, y in zip(a[lo:hi].tolist(), b[lo:hi].tolist())), np.uint64, hi - lo)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        docs, heads = np.unique(gram_doc[lo:hi], return_index=True)
        ones[docs] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > grams[:, None], axis=1, bitorder="little").reshape(-1).view(np.uint64)


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and its 64-bit fingerprint ``fp`` as a signed long. Null and wordless texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, ends = texts_of(batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array(fingerprints_of(data, ends).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def pivot_table(fps: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Hamming distances of fingerprints to fixed random references, one row per pivot.

    By the triangle inequality the distance of two fingerprints is at least every difference of a row.
    """
    references = np.random.default_rng(9).integers(0, 2**64, pivots, dtype=np.uint64)
    return np.bitwise_count(fps[None, :] ^ references[:, None]).astype(np.int8)


def roots_of(parent: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    found = parent[nodes]
    while True:
        above = parent[found]
        if np.array_equal(above, found):
            return found
        found = above


def join_nodes(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union the ends of links; every node keeps pointing at a smaller one or itself."""
    while len(a):
        a, b = roots_of(parent, a), roots_of(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def linked(fps: np.ndarray, group: np.ndarray, side: np.ndarray | None = None, pivots: int = PIVOTS, most: int = MAX_DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect each group as all links at ``most`` or fewer differing bits would.

    Rows are sorted by group and by their distance to the first pivot; a row is compared with the rows after it
    while that distance differs by ``most`` or less. Pairs that another pivot separates are discarded, pairs
    that are connected already are skipped, the rest is verified. With ``side`` only pairs of both sides count.
    """
    table = pivot_table(fps, pivots)
    order = np.lexsort((table[0], group))
    fps, group, table = fps[order], group[order], table[:, order]
    side = None if side is None else side[order]
    parent = np.arange(len(fps))
    left = np.arange(len(fps) - 1)
    lag = 1
    while len(left):
        right = left + lag
        near = (group[left] == group[right]) & (table[0][right] - table[0][left] <= most)
        left = left[near]
        a, b = left, left + lag
        if side is not None:
            across = side[a] != side[b]
            a, b = a[across], b[across]
        open_ = parent[a] != parent[b]
        a, b = a[open_], b[open_]
        for row in table[1:]:
            if not len(a):
                break
            close = np.abs(row[a] - row[b]) <= most
            a, b = a[close], b[close]
        true = np.bitwise_count(fps[a] ^ fps[b]) <= most
        if true.any():
            join_nodes(parent, a[true], b[true])
            parent = roots_of(parent, parent)
        lag += 1
        left = left[left + lag < len(fps)]
    child = np.flatnonzero(parent != np.arange(len(fps)))
    return fps[child], fps[parent[child]]


def fingerprint_links(fps: DataFrame, most: int = MAX_DISTANCE, group: int = GROUP) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints that connect exactly what all links would connect.

    Fingerprints with ``most`` or fewer differing bits agree in at least one of ``most + 1`` blocks of bits, so
    rows meet on equal blocks. A block value with more than ``group`` fingerprints is dealt over parts; parts
    are compared within themselves and pairwise, so no task holds a whole hot value.
    """
    width = BITS // (most + 1)
    blocks = F.explode(F.array(*[
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", i * width).bitwiseAND((1 << width) - 1).alias("value"))
        for i in range(most + 1)
    ])).alias("k")
    keyed = fps.select("fp", blocks).select("fp", "k.block", "k.value")
    counts = keyed.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / group).cast("int")
    packed = (
        keyed.join(counts, ["block", "value"])
        .withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .repartition("block", "value", "part", "parts")  # see grouped_links
        .groupBy("block", "value", "part", "parts")
        .agg(F.collect_list("fp").alias("fps"))
    )
    packed = store(packed, "simhash-blocks")

    def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.diff(column.offsets.to_numpy())
        return column.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(column)), sizes)

    def links(batch: pa.RecordBatch, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, owner = flat(batch.column(0))
            yield links(batch, *linked(values, owner, most=most))

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                x, y = (np.array(one.column(k)[0].as_py(), np.int64).view(np.uint64) for k in (0, 1))
                side = np.repeat([0, 1], [len(x), len(y)])
                yield links(batch, *linked(np.concatenate([x, y]), np.zeros(len(side), np.int64), side, most=most))

    local = packed.select("fps").mapInArrow(inside, "a long, b long")
    hot = packed.where("parts > 1")
    pairs = hot.withColumn("other", F.explode(F.sequence(F.col("part") + 1, F.col("parts")))).where("other < parts").alias("x").join(
        hot.select("block", "value", F.col("part").alias("other"), F.col("fps").alias("others")), ["block", "value", "other"]
    )
    across = pairs.select("fps", "others").repartition(F.col("fps")[0], F.col("others")[0]).mapInArrow(between, "a long, b long")
    return local.unionByName(across).distinct()


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)``, the root being the smallest node of its component.

    Large-star and small-star steps by turns: each node's larger, then its smaller neighbours are linked to its
    smallest one. Rounds are written to the shared folder; the number of rounds grows with the logarithm of
    the longest chain.
    """
    edges = store(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = store(large.distinct(), name)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        ).select("e.a", "e.b").where("a <> b")
        edges = store(small.distinct(), name)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def near_duplicates(docs: DataFrame, most: int = MAX_DISTANCE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Documents link if their fingerprints differ in ``most`` or fewer bits; ``component_id`` is the smallest
    doc_id that links reach, the own one included. Equal fingerprints are one node, so copies add no pairs.
    Null, empty and wordless texts have fingerprint 0 and link with each other. A null doc_id never is a
    component_id unless the whole component has none. Repeated rows stay. Extra columns are ignored.
    """
    marked = store(with_fingerprints(docs), "simhash-fingerprints")
    nodes = store(marked.groupBy("fp").agg(F.min("doc_id").alias("smallest")), "simhash-nodes")
    roots = components(fingerprint_links(nodes.select("fp"), most), "simhash-links")
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.groupBy("root").agg(F.min("smallest").alias("component_id"))
    component = placed.select("fp", "root").join(named, "root").select("fp", "component_id")
    return marked.join(component, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, most: int = MAX_DISTANCE) -> DataFrame:
    """The rows of ``docs`` whose doc_id is their component's smallest; rows repeating that id count as one.

    Rows without doc_id have no identity to be kept by: they stay.
    """
    found = near_duplicates(docs, most)
    kept = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    known = docs.where(F.col("doc_id").isNotNull())
    return known.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def shingle_sets(data: np.ndarray, ends: np.ndarray, hasher: SpanHasher, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and their ``n + 1`` offsets."""
    clean, a, b, doc, grams = shingle_spans(data, ends, shingle)
    hashes = hasher.spans(hasher.sums(clean), a, b) if len(a) else np.zeros(0, np.uint64)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[first], np.concatenate([[0], np.cumsum(np.bincount(doc[first], minlength=len(grams)))])


def wide_fingerprints(hashes: np.ndarray, offsets: np.ndarray, at_once: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """128-bit SimHash ``uint64[n, 2]`` of each set of hashes, and a 64-bit name of the set (0: empty)."""
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    ones = np.zeros((len(sizes), 2 * BITS), np.int64)
    for lo in range(0, len(hashes), at_once):
        some = hashes[lo : lo + at_once]
        both = np.stack([some, mix64(some * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))], axis=1)
        bits = np.unpackbits(both.view(np.uint8).reshape(-1, 16), axis=1, bitorder="little")
        docs, heads = np.unique(owner[lo : lo + at_once], return_index=True)
        ones[docs] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    wide = np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(np.uint64)
    names = np.zeros(len(sizes), np.uint64)
    full = sizes > 0
    if full.any():
        names[full] = np.add.reduceat(mix64(hashes ^ np.uint64(0xA0761D6478BD642F)), offsets[:-1][full])
    return wide, names


def shared_count(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted arrays without repeats share."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def wide_links(
    wide: np.ndarray, group: np.ndarray, side: np.ndarray | None, linked_too=None, most: int = WIDE_DISTANCE, known: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) that connect each group as all true pairs would; a pair is true at ``most`` or fewer
    differing bits and if ``linked_too`` says so of the arrays ``i, j``. Pairs that are connected already are skipped, and
    rows of a group with equal ``known`` count as connected from the start.

    Rows are sorted by group and distance to a pivot, as in ``linked``.
    """
    pivot = np.random.default_rng(9).integers(0, 2**64, 2, dtype=np.uint64)
    table = np.bitwise_count(wide ^ pivot).sum(axis=1, dtype=np.int64)
    order = np.lexsort((table, group))
    wide, group, table = wide[order], group[order], table[order]
    side = None if side is None else side[order]
    parent = np.arange(len(wide))
    if known is not None and len(wide):
        known = known[order]
        by_root = np.lexsort((parent, known, group))
        new = np.append(True, (group[by_root][1:] != group[by_root][:-1]) | (known[by_root][1:] != known[by_root][:-1]))
        parent[by_root] = by_root[np.flatnonzero(new)[np.cumsum(new) - 1]]
    left = np.arange(len(wide) - 1)
    lag = 1
    while len(left):
        left = left[(group[left] == group[left + lag]) & (table[left + lag] - table[left] <= most)]
        a, b = left, left + lag
        if side is not None:
            across = side[a] != side[b]
            a, b = a[across], b[across]
        open_ = parent[a] != parent[b]
        a, b = a[open_], b[open_]
        near = np.bitwise_count(wide[a] ^ wide[b]).sum(axis=1) <= most
        a, b = a[near], b[near]
        if linked_too is None:
            join_nodes(parent, a, b)
        else:
            for lo in range(0, len(a), 64):
                i, j = a[lo : lo + 64], b[lo : lo + 64]
                apart = roots_of(parent, i) != roots_of(parent, j)
                i, j = i[apart], j[apart]
                if len(i):
                    alike = linked_too(order[i], order[j])
                    join_nodes(parent, i[alike], j[alike])
        if len(a):
            parent = roots_of(parent, parent)
        lag += 1
        left = left[left + lag < len(wide)]
    child = np.flatnonzero(parent != np.arange(len(wide)))
    return order[child], order[parent[child]]


def grouped_links(rows: DataFrame, keys: list[str], item: list[str], find) -> DataFrame:
    """``(a, b)``: links that ``find(columns, group, side)`` sees between rows of equal ``keys``.

    ``parts`` says over how many parts a row's key is dealt; parts are compared within themselves and pairwise, so no
    task holds a whole hot key. Rows of whole and of dealt keys are two disjoint branches; nothing is stored between.
    """
    packed = (
        rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .repartition(*keys, "part", "parts")
        .groupBy(*keys, "part", "parts")
        .agg(F.collect_list(F.struct(*item)).alias("rows"))
        .select(*keys, "part", "parts", *[F.col(f"rows.{c}").alias(c) for c in item])
    )
    n = len(item)

    def links(columns: list[pa.Array], sided: bool) -> pa.RecordBatch:
        sizes = [np.diff(columns[c].offsets.to_numpy()) for c in range(0, len(columns), n)]
        group = np.concatenate([np.repeat(np.arange(len(size)), size) for size in sizes])
        side = np.repeat([0, 1], [int(size.sum()) for size in sizes]) if sided else None
        flat = [pa.concat_arrays([columns[c].flatten() for c in range(i, len(columns), n)]) for i in range(n)]
        a, b = find(flat, group, side)
        nodes = flat[0].to_numpy()
        # Every member links to its cluster's smallest node, so that a node's links from many keys are mostly one and the same.
        smallest = nodes.copy()
        np.minimum.at(smallest, b, nodes[a])
        roots = np.unique(b)
        roots = roots[smallest[roots] != nodes[roots]]
        from_, to = np.concatenate([nodes[a], nodes[roots]]), np.concatenate([smallest[b], smallest[roots]])
        other = from_ != to
        return pa.record_batch([pa.array(from_[other]), pa.array(to[other])], names=["a", "b"])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield links(batch.columns, False)

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                columns = batch.slice(i, 1).columns
                same = columns.pop()[0].as_py()
                yield links(columns[:n] if same else columns, not same)

    local = packed.where("parts = 1").select(*item).mapInArrow(inside, "a long, b long")
    hot = packed.where("parts > 1")
    pairs = hot.withColumn("other", F.explode(F.sequence(F.col("part"), F.col("parts").cast("int") - 1))).join(
        hot.select(*keys, F.col("part").alias("other"), *[F.col(c).alias(f"{c}_2") for c in item]), [*keys, "other"]
    )
    across = pairs.repartition(F.xxhash64(*keys, "part", "other")).select(*item, *[f"{c}_2" for c in item], F.expr("part = other").alias("same")).mapInArrow(between, "a long, b long")
    return local.unionByName(across).distinct()


def candidate_links(nodes: DataFrame, most: int = WIDE_DISTANCE, group: int = GROUP) -> DataFrame:
    """Links ``(a, b)`` that connect nodes as pairs would that differ in ``most`` bits and, in a block, in two or fewer.

    A row goes to its value of each of the eight 16-bit blocks and to the 16 values one bit away, so rows meet
    that are two bits apart there: all pairs with up to 23 differing bits, and of those at Jaccard 0.8 (0.55
    for one block) 0.998. Rows of equal blocks are linked first; the others then only link what is still apart, so
    a large group of copies gives a few links a row and not one for each of its values.
    """
    flips = np.array([0, *(1 << i for i in range(16))], np.int64)
    names = ["key", "root", "node", "low", "high"]

    def links(rows: DataFrame, moves: np.ndarray) -> DataFrame:
        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 1024):
                    part = batch.slice(lo, 1024)
                    wide = np.stack([part.column(c).to_numpy() for c in (2, 3)], axis=1)
                    blocks = wide.view("<u2").astype(np.int64)
                    keys = (np.arange(WIDE_BLOCKS) << 16)[None, :, None] + (blocks[:, :, None] ^ moves)
                    repeat = pa.array(np.repeat(np.arange(len(wide)), WIDE_BLOCKS * len(moves)))
                    yield pa.record_batch([pa.array(keys.reshape(-1).astype(np.int32)), *(part.column(c).take(repeat) for c in range(4))], names=names)

        def find(columns, of_group, side):
            wide = np.stack([c.to_numpy() for c in columns[1:3]], axis=1).view(np.uint64)
            return wide_links(wide, of_group, side, most=most, known=columns[0].to_numpy())

        keyed = rows.select(*names[1:]).mapInArrow(spread, "key int, root long, node long, low long, high long")
        # Eight blocks of 16 bits: at most 524,288 keys of twelve bytes, whatever the table.
        parts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / group).alias("parts"))
        return grouped_links(keyed.join(F.broadcast(store(parts, "near-keys")), "key"), ["key"], ["root", "low", "high"], find)

    equal = store(links(nodes.withColumn("root", F.col("node")), flips[:1]), "near-equal-links")
    placed = nodes.select("node", "low", "high").join(components(equal, "near-equal-roots"), "node", "left")
    return equal.unionByName(links(placed.withColumn("root", F.coalesce("root", "node")), flips))


def verified_links(candidates: DataFrame, least: float = LEAST_JACCARD, most: int = WIDE_DISTANCE, at_once: int = SETS_AT_ONCE) -> DataFrame:
    """Links ``(a, b)`` that connect the rows ``root, node, low, high, n, text`` of each root as all pairs of Jaccard ``least`` would."""
    parts = candidates.groupBy("root").agg(F.ceil(F.greatest(F.sum("n") / at_once, F.count(F.lit(1)) / SETS_IN_GROUP)).alias("parts"))
    hot = broadcast_if_small(store(parts.where("parts > 1"), "near-hot-groups"))

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for batch in pieces(batches, "text", PREFIX_BYTES):
            hashes, offsets = shingle_sets(*texts_of(batch.column(4)), hasher)
            packed = [hashes[x:y].tobytes() for x, y in zip(offsets[:-1], offsets[1:])]
            yield pa.record_batch([*(batch.column(c) for c in range(4)), pa.array(packed, pa.binary())], names=["root", "node", "low", "high", "hashes"])

    rows = candidates.select("root", "node", "low", "high", "text").mapInArrow(with_sets, "root long, node long, low long, high long, hashes binary")

    def find(columns, of_group, side):
        sets = [np.frombuffer(v.as_py(), np.uint64) for v in columns[3]]
        sizes = np.array([len(x) for x in sets])

        def alike(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            both = sizes[i] + sizes[j]
            out = np.minimum(sizes[i], sizes[j]) >= least * np.maximum(sizes[i], sizes[j])
            for lo in np.flatnonzero(out):
                common = shared_count(sets[i[lo]], sets[j[lo]])
                out[lo] = common >= least * (both[lo] - common)
            return out

        return wide_links(np.stack([c.to_numpy() for c in columns[1:3]], axis=1).view(np.uint64), of_group, side, alike, most)

    dealt = rows.join(hot, "root", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return grouped_links(dealt, ["root"], ["node", "low", "high", "hashes"], find)


def prefixes(hashes: np.ndarray, offsets: np.ndarray, frequent: np.ndarray, counts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of each set that meet those of any set of Jaccard ``least`` or more, their offsets, and the sets' parities.

    All sets are in one order, frequent shingles last. Sets of this Jaccard share ``least`` of the larger one, so of
    the first ``n - least * n + 1`` shingles of both at least one is the same, whatever the order. The 256 parities of a set (shingles by their
    lowest byte) differ in no more places than the sets do.
    """
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    rank = np.zeros(len(hashes), np.int64)
    if len(frequent) and len(hashes):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        known = frequent[at] == hashes
        rank[known] = counts[at[known]]
    order = np.lexsort((hashes, rank, owner))
    length = np.where(sizes > 0, sizes - np.ceil(least * sizes - 1e-9).astype(np.int64) + 1, 0)
    first = np.arange(len(hashes)) - np.repeat(offsets[:-1], sizes) < np.repeat(length, sizes)
    odd = np.bincount(owner * 256 + (hashes & np.uint64(255)).astype(np.int64), minlength=256 * len(sizes)) & 1
    parity = np.packbits(odd.astype(np.uint8).reshape(-1, 256), axis=1, bitorder="little").view(np.uint64)
    return hashes[order][first], np.concatenate([[0], np.cumsum(length)]), parity


def sketches(hashes: np.ndarray, offsets: np.ndarray, per_shingle: float = 2) -> pa.Array:
    """Parities of each set in as many places as a power of two says that is twice its size (``per_shingle``) or more, as bytes.

    A place counts the shingles of equal lowest bits, so sketches of two lengths compare once the longer one is folded.
    """
    sizes = np.diff(offsets)
    places = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(per_shingle * sizes, 1))).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(places)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = ends[:-1][owner] + (hashes & (places[owner] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(at, minlength=ends[-1]) & 1
    packed = np.packbits(odd.astype(np.uint8), bitorder="little")
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends // 8), pa.py_buffer(packed)]).cast(pa.binary())


def sketched_apart(x: bytes, y: bytes) -> int:
    """In how many places two sketches differ: no more than their sets do."""
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def coarse_bits(hashes: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Sketches of a place for two shingles or more as lists of longs, for sets of more than ``COARSE_SET``; an empty list for others."""
    sizes = np.diff(offsets)
    large = sizes > COARSE_SET
    of = np.repeat(large, sizes)
    packed = sketches(hashes[of], np.concatenate([[0], np.cumsum(sizes[large])]), 0.5)
    lengths = np.zeros(len(sizes), np.int64)
    lengths[large] = pc.binary_length(packed).to_numpy() // 8
    data, _ = texts_of(packed)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(data.view("<i8")))


def coarsely_apart(x: Column, y: Column) -> Column:
    """In how many places two ``coarse_bits`` differ, no more than their sets do; 0 if one is empty. One is twice as long as the other at most."""
    def folded(b: Column, other: Column) -> Column:
        half = F.floor(F.size(b) / 2).cast("int")
        return F.when(F.size(b) > F.size(other), F.zip_with(F.slice(b, F.lit(1), half), F.slice(b, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(b)

    places = F.zip_with(folded(x, y), folded(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.aggregate(places, F.lit(0), lambda total, n: total + n)).otherwise(0)


def remaining_links(texts: DataFrame, roots: DataFrame, n_nodes: int, least: float = LEAST_JACCARD) -> DataFrame:
    """All links ``(a, b)`` of Jaccard ``least`` or more between rows ``node, text`` whose ``roots`` (node, root) differ; exact.

    Nodes meet on the shingles of their prefixes, only on those that nodes of two roots have, and on one of those that the very same nodes
    have. What is left of the pairs by size and parities (256, and a place for two shingles or more of a large set) is sifted by sketches, a 32nd of
    the sets' size, and verified on the whole sets. The order of the shingles, rare ones first, comes from
    the counts in a sample of texts; it decides how many pairs are tried, not which are found. Rows of equal node are one.
    """
    spark = texts.sparkSession

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        hasher = SpanHasher()
        for batch in pieces(batches, "text", PREFIX_BYTES):
            yield batch.column(0), *shingle_sets(*texts_of(batch.column(1)), hasher)

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hashes, _ in sets(batches):
            yield pa.record_batch([pa.array(hashes.view(np.int64))], names=["token"])

    texts = texts.select("node", "text")
    sample = texts.where(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < int(1e6 * min(1, max(ORDER_SHARE, ORDER_SAMPLE / max(1, n_nodes)))))
    known = sample.dropDuplicates(["node"]).mapInArrow(every, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    known = known.orderBy(F.col("n").desc(), "token").limit(ORDER_SHINGLES).toPandas()
    tokens = known["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    ranks = spark.sparkContext.broadcast((tokens[order], known["n"].to_numpy(np.int64)[order]))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, hashes, offsets in sets(batches):
            found, ends, parity = prefixes(hashes, offsets, *ranks.value, least)
            tokens = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found.view(np.int64)))
            bits = [pa.array(np.ascontiguousarray(parity[:, c]).view(np.int64)) for c in range(4)]
            yield pa.record_batch([node, pa.array(np.diff(offsets)), tokens, sketches(hashes, offsets), coarse_bits(hashes, offsets), *bits], names=["node", "n", "tokens", "sketch", "coarse", *parities])

    parities = [f"p{c}" for c in range(4)]
    schema = "node long, n long, tokens array<long>, sketch binary, coarse array<long>, " + ", ".join(f"{c} long" for c in parities)
    # Sets of three shingles or fewer have Jaccard 0.75 at most with another one.
    fewest = int(np.ceil(least / (1 - least) - 1e-9)) if least < 1 else 1
    begun = texts.mapInArrow(begin, schema).where(F.col("n") >= fewest).dropDuplicates(["node"])
    begun = store(begun.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-prefixes")
    # One exchange of narrow rows, read twice; what is left of them gets sizes and parities.
    placed = begun.select("node", "root", F.explode("tokens").alias("token")).repartition("token")
    # Tokens of the same nodes would make the same pairs: one of them is enough.
    same = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"same_{k}") for k in range(2)]
    met = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("members"), *same).where("low < high")
    met = met.groupBy("members", "same_0", "same_1").agg(F.min("token").alias("token"))
    met = placed.select("token", "node").join(met.select("token", F.ceil(F.col("members") / GROUP).cast("int").alias("parts")), "token")
    rows = store(met.join(begun.drop("tokens", "sketch"), "node"), "near-tokens")
    one = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts").alias("x")
    other = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts").alias("y")
    apart = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in parities), F.lit(0))
    x, y = F.col("x.n"), F.col("y.n")
    alike = (F.least(x, y) >= F.greatest(x, y) * least - 1e-9) & (apart <= (x + y) * ((1 - least) / (1 + least)) + 1e-9)
    alike = alike & (coarsely_apart(F.col("x.coarse"), F.col("y.coarse")) <= (x + y) * ((1 - least) / (1 + least)) + 1e-9)
    pairs = one.join(other, (F.col("x.token") == F.col("y.token")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & alike)
    pairs = store(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "near-pairs")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = batch.column(2).to_numpy() * ((1 - least) / (1 + least)) + 1e-9
            close = [sketched_apart(i.as_py(), j.as_py()) <= m for i, j, m in zip(batch.column(3), batch.column(4), most)]
            yield batch.select([0, 1]).filter(pa.array(close, pa.bool_()))

    sketch = {c: begun.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"of_{c}")) for c in "ab"}
    compared = pairs.join(sketch["a"], "a").join(sketch["b"], "b").select("a", "b", F.col("n_a") + F.col("n_b"), "of_a", "of_b")
    pairs = store(compared.mapInArrow(sift, "a long, b long"), "near-close-pairs")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, hashes, offsets in sets(batches):
            yield pa.record_batch([node, pa.array([hashes[i:j].tobytes() for i, j in zip(offsets[:-1], offsets[1:])], pa.binary())], names=["node", "hashes"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    packed = store(texts.join(broadcast_if_small(wanted, 500_000), "node", "left_semi").dropDuplicates(["node"]).mapInArrow(pack, "node long, hashes binary"), "near-sets")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, j in zip(batch.column(2), batch.column(3)):
                i, j = np.frombuffer(i.as_py(), np.uint64), np.frombuffer(j.as_py(), np.uint64)
                common = shared_count(i, j)
                keep.append(common >= least * (len(i) + len(j) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(packed.select(F.col("node").alias("a"), F.col("hashes").alias("of_a")), "a").join(packed.select(F.col("node").alias("b"), F.col("hashes").alias("of_b")), "b")
    return both.select("a", "b", "of_a", "of_b").mapInArrow(verify, "a long, b long")


def drop_near_copies(docs: DataFrame, least: float = LEAST_JACCARD) -> DataFrame:
    """One row of each group of near copies: the smallest ``(doc_id, name of its shingle set)``.

    Documents link if their sets of five-word shingles have Jaccard ``least`` or more. Candidates come from
    128-bit SimHash fingerprints first, and every link is verified; pairs that these miss are searched exactly between
    the groups found (``remaining_links``). Texts of equal sets are one node, wordless texts the same one. Rows without doc_id have no identity to be kept by: they stay and link nothing.
    """
    columns = docs.columns
    known = docs.where(F.col("doc_id").isNotNull())
    text = columns.index("text")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for batch in pieces(batches, "text", PREFIX_BYTES):
            hashes, offsets = shingle_sets(*texts_of(batch.column(text)), hasher)
            wide, names = wide_fingerprints(hashes, offsets)
            added = [names.view(np.int64), *(np.ascontiguousarray(wide[:, c]).view(np.int64) for c in (0, 1)), np.diff(offsets)]
            yield pa.record_batch([*batch.columns, *map(pa.array, added)], names=[*columns, "_node", "_low", "_high", "_n"])

    schema = StructType([*known.schema.fields, *(StructField(name, LongType()) for name in ("_node", "_low", "_high", "_n"))])
    marked = store(known.mapInArrow(mark, schema), "near-marked")
    nodes = store(
        marked.groupBy(F.col("_node").alias("node")).agg(
            F.min("doc_id").alias("smallest"), F.first("_low").alias("low"), F.first("_high").alias("high"), F.first("_n").alias("n")
        ), "near-nodes",
    )
    coarse = components(candidate_links(nodes.where("n > 0")), "near-coarse")
    chosen = coarse.join(nodes, "node")
    texts = marked.select(F.col("_node").alias("node"), F.col("doc_id").alias("smallest"), "text")
    # The texts of nodes that have a candidate, before any text is shuffled.
    paired = texts.join(broadcast_if_small(chosen.select("node", "smallest"), 500_000), ["node", "smallest"], "left_semi")
    candidates = store(chosen.join(paired, ["node", "smallest"]).dropDuplicates(["node"]).select("root", "node", "low", "high", "n", "text"), "near-candidates")
    links = store(verified_links(candidates, least), "near-verified")
    more = remaining_links(texts.where(F.col("node") != 0), components(links, "near-found"), nodes.count(), least)
    roots = components(links.unionByName(more), "near-links")
    placed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = placed.groupBy("root").agg(F.min(F.struct("smallest", "node")).alias("k")).select(F.col("k.smallest").alias("doc_id"), F.col("k.node").alias("_node"))
    rows = marked.join(kept, ["doc_id", "_node"], "left_semi").dropDuplicates(["doc_id", "_node"])
    return rows.select(*columns).unionByName(docs.where(F.col("doc_id").isNull()))
