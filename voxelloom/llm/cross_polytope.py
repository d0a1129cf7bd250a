"""Approximate nearest neighbours by inner product: cross-polytope hashing, many probes, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.llm.shared import store

TABLES = 12
BUCKET = 256  # vectors in an average bucket: the bucket count follows the row count
BLOCK = 1024  # vectors of one bucket in one row
HELD = 1 << 19  # scored pairs that a task holds before it keeps only the best of each query
SEED = 5


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row; the length is a power of two."""
    x = x.copy()
    step = 1
    while step < x.shape[1]:
        pairs = x.reshape(len(x), -1, 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), -1)
        step *= 2
    return x / np.sqrt(x.shape[1])


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    """Pseudo-random rotation: three rounds of random signs and a Hadamard transform."""
    rng = np.random.default_rng((SEED, table))
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    return x


def axis_counts(width: int, rows: int) -> list[int]:
    """Axes that each polytope of one hash uses: whole ones, and a last one cut to what ``BUCKET`` rows a bucket ask for."""
    counts, buckets = [width], 2 * width
    while buckets * BUCKET < rows:
        counts.append(min(width, 1 << max(0, int(np.ceil(np.log2(rows / BUCKET / buckets / 2))))))
        buckets *= 2 * counts[-1]
    return counts


def probe_count(counts: list[int], rows: int) -> int:
    """Buckets that a query looks into: a share of them that falls as ``rows ** -0.3``.

    The exponent was measured on random directions, the hardest case, where it keeps the recall about level.
    """
    buckets = int(np.prod([2.0 * c for c in counts]))
    return max(1, min(buckets, int(np.ceil(0.9 * rows**-0.3 * buckets))))


def axes(x: np.ndarray, table: int, counts: list[int], probes: int) -> np.ndarray:
    """The ``probes`` nearest buckets of every row, nearest first.

    A bucket is one signed axis of each rotated polytope: ``i`` for +e_i, ``i + count`` for -e_i. Its distance is the
    sum of the squared differences to the nearest axis of each polytope.
    """
    codes, far = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for number, count in enumerate(counts):
        turned = rotate(x, table + 1000 * number)[:, :count]
        both = np.concatenate([turned, -turned], axis=1)
        if probes == 1:
            codes = codes * 2 * count + both.argmax(axis=1)[:, None]
            continue
        order = np.argsort(-both, axis=1, kind="stable")[:, :probes]
        sorted_values = np.take_along_axis(both, order, axis=1)
        gaps = (sorted_values[:, :1] - sorted_values) ** 2
        # The i-th nearest prefix and the j-th nearest axis can be among the best only if (i + 1)(j + 1) <= probes.
        i, j = (np.concatenate(parts) for parts in zip(*[
            (np.full(n, at), np.arange(n)) for at in range(codes.shape[1]) for n in [min(order.shape[1], probes // (at + 1))]
        ]))
        total = far[:, i] + gaps[:, j]
        best = np.argsort(total, axis=1, kind="stable")[:, :probes]
        far = np.take_along_axis(total, best, axis=1)
        codes = np.take_along_axis(codes, i[best], axis=1) * 2 * count + np.take_along_axis(order, j[best], axis=1)
    return codes


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_py() for v in column), kind).reshape(len(column), -1).astype(np.float64)


def stored_kind(*tables: DataFrame) -> str:
    """Vectors travel in their own width: single precision loses nothing where all columns have it."""
    return "<f4" if all(t.schema["embedding"].dataType.simpleString() == "array<float>" for t in tables) else "<f8"


def usable(vectors: DataFrame, kind: str = "<f8") -> DataFrame:
    """Usable vectors: ``vec_id``, ``vec`` (little-endian numbers of ``kind``) and ``norm2``.

    Null, zero-length or zero vectors and vectors with null or non-finite components are left out, and so are
    rows without vec_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, packed, norms = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or not v or any(c is None for c in v):
                    continue
                x = np.array(v, "<f8")
                norm = float(x @ x)
                if np.isfinite(x).all() and norm > 0:
                    ids.append(i), packed.append((x + 0.0).astype(kind).tobytes()), norms.append(norm)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(packed, pa.binary()), pa.array(norms, pa.float64())], names=["vec_id", "vec", "norm2"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, vec binary, norm2 double")


def _hashed(
    vectors: DataFrame, id_column: str, bands: dict[tuple[int, int], tuple[float, int]], kind: str, tables: int, probes: int | None,
    is_query: bool, with_vec: bool,
) -> DataFrame:
    """``size, key, id`` and, if asked for, ``vec``: one row per vector, table and bucket.

    ``bands`` gives each (bytes, band) its longest squared norm and its rows. Vectors are lifted to that norm by one more
    component (0 for queries), which turns the largest inner product of a band into the smallest angle. Queries look
    into every band.
    """
    names = ["size", "key", "id", "vec"] if with_vec else ["size", "key", "id"]

    def hashed(part: pa.RecordBatch, length: int, own: int) -> Iterator[pa.RecordBatch]:
        x = _matrix(part.column(1), kind)
        lift = np.zeros(len(x))
        if is_query:
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
        else:
            most = bands[length, own][0]
            lift = np.sqrt(np.maximum(0.0, most - (x * x).sum(axis=1)))
            lift[lift < 1e-4 * np.sqrt(most)] = 0.0
        wide = 1 << int(np.ceil(np.log2(x.shape[1])))
        lifted = np.zeros((len(x), wide if wide > x.shape[1] else wide * 2))
        lifted[:, : x.shape[1]] = x
        lifted[:, x.shape[1]] = lift
        for band in [band for size, band in bands if size == length] if is_query else [own]:
            rows = bands[length, band][1]
            counts = axis_counts(lifted.shape[1], rows)
            looked = (probes or probe_count(counts, rows)) if is_query else 1
            step = max(1, (1 << 16) // looked)
            for table in range(tables):
                for lo in range(0, len(x), step):
                    found = axes(lifted[lo : lo + step], table, counts, looked)
                    at = pa.array(np.repeat(np.arange(lo, lo + len(found)), found.shape[1]))
                    keys = ((found * tables + table) * 4096 + band + 2048).reshape(-1)
                    columns = [pa.array(np.full(len(keys), length, np.int32)), pa.array(keys), part.column(0).take(at)]
                    yield pa.record_batch(columns + ([part.column(1).take(at)] if with_vec else []), names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                lengths = np.array([len(v.as_py()) for v in part.column(1)])
                of_band = np.zeros(len(lengths), np.int64) if is_query else part.column(2).to_numpy()
                for length, own in sorted(set(zip(lengths.tolist(), of_band.tolist()))):
                    some = part.take(pa.array(np.flatnonzero((lengths == length) & (of_band == own))))
                    yield from hashed(some, length, own)

    schema = "size int, key long, id long" + (", vec binary" if with_vec else "")
    return vectors.select(F.col(id_column).alias("id"), "vec", *([] if is_query else ["band"])).mapInArrow(run, schema)


def packed(rows: DataFrame, keys: list[str], parts: DataFrame) -> DataFrame:
    """``keys, part, ids, vecs``: the ``(id, vec)`` of each key in blocks of about ``BLOCK``.

    ``parts`` names the keys that need more than one block and how many: few rows, whose stored size Spark knows. The blocks
    of a crowded key are dealt by (key, part): without that exchange a join by key would leave them in one task.
    """
    numbered = rows.join(parts, keys, "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int"))
    return numbered.repartition(*keys, "part").groupBy(*keys, "part").agg(F.collect_list(F.struct("id", "vec")).alias("rows")).select(
        *keys, "part", F.col("rows.id").alias("ids"), F.col("rows.vec").alias("vecs")
    )


def crowded(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``keys, parts`` of the keys with more than ``BLOCK`` rows."""
    counts = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    return store(counts.where("parts > 1"), name)


def best_of(query: np.ndarray, lead: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best distinct leads of every query among scored pairs; equal scores go to the smaller lead."""
    order = np.lexsort((-score, lead, query))
    query, lead, score = query[order], lead[order], score[order]
    first = np.ones(len(query), bool)
    first[1:] = (query[1:] != query[:-1]) | (lead[1:] != lead[:-1])
    query, lead, score = query[first], lead[first], score[first]
    order = np.lexsort((lead, -score, query))
    query, lead, score = query[order], lead[order], score[order]
    heads = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
    place = np.arange(len(query)) - np.repeat(heads, np.diff(np.append(heads, len(query))))
    return query[place < k], lead[place < k], score[place < k]


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, tables: int = TABLES, probes: int | None = None
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products that each query's buckets hold.

    ``vectors`` and ``queries`` have ``vec_id, embedding``; a query never finds its own vec_id. Each table turns
    the vectors and files them under the nearest signed axes of as many polytopes as the row count asks for; a query looks
    into its ``probes`` nearest buckets of every table (``probe_count`` unless given). Bucket and query meet in an
    equi-join of blocks, so a hot bucket is many rows: a vector travels once a table and a query once a bucket, which
    is far less than a row for every pair that is compared. A task keeps the best of each query before it sends them. Scores
    are the inner products of the original vectors in double precision; equal ones go to the smaller
    vec_id. Equal vectors are hashed and compared once. Vectors are hashed in bands of norms (a factor of the square
    root of two). A query whose buckets hold fewer than ``k`` vectors, while there are more, is compared with
    all vectors in blocks. Vectors of different lengths never meet. Empty tables give an empty table.
    """
    kind = stored_kind(vectors, queries)
    rows = store(usable(vectors, kind).withColumn("band", F.floor(F.log2("norm2") + 0.5).cast("long")), "ann-vectors")
    same = rows.groupBy("vec").agg(F.min("vec_id").alias("lead"), F.max("band").alias("band"))
    copies = rows.join(same, "vec").select("lead", "vec_id")
    # The k + 1 smallest ids of equal vectors; ranked by bucket first so that no task sorts all copies of one vector.
    salted = Window.partitionBy("lead", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    final = Window.partitionBy("lead").orderBy("vec_id")
    first_copies = copies.distinct().withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1).withColumn("r", F.row_number().over(final)).where(F.col("r") <= k + 1)
    first_copies = store(first_copies.select("lead", "vec_id"), "ann-copies")
    asked = store(usable(queries, kind), "ann-queries")
    asked_same = asked.groupBy("vec").agg(F.min("vec_id").alias("lead_query"))
    asked_copies = asked.join(asked_same, "vec").select("lead_query", F.col("vec_id").alias("query_id")).distinct()
    # Doubles have at most 2,100 bands of norms.
    of_band = rows.groupBy(F.octet_length("vec").alias("size"), "band").agg(F.max("norm2").alias("longest"), F.count_distinct("vec").alias("n"))
    bands = {(r.size, r.band): (r.longest, r.n) for r in of_band.collect()}
    keys = ["size", "key"]

    def buckets(table: DataFrame, id_column: str, is_query: bool, name: str) -> DataFrame:
        hashed = [_hashed(table, id_column, bands, kind, tables, probes, is_query, with_vec) for with_vec in (False, True)]
        return packed(hashed[1], keys, crowded(hashed[0], keys, f"ann-crowded-{name}"))

    probing = buckets(asked_same, "lead_query", True, "probes")
    probing = probing.select(*keys, F.col("part").alias("query_part"), F.col("ids").alias("query_ids"), F.col("vecs").alias("query_vecs"))
    pairs = buckets(same, "lead", False, "index").join(probing, keys)

    def scores_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, vecs, query_ids, query_vecs = (batch.column(c)[row].values for c in range(4))
                ids, query_ids, x = ids.to_numpy(), query_ids.to_numpy(), _matrix(vecs, kind)
                scores = np.einsum("qd,vd->qv", _matrix(query_vecs, kind), x)
                # One more than k distinct vectors, because the query's own one may be among them.
                keep = min(k + 1, len(ids))
                bar = -np.partition(-scores, keep - 1, axis=1)[:, keep - 1 : keep]
                at_query, at_vector = np.nonzero(scores >= bar)
                yield query_ids[at_query], ids[at_vector], scores[at_query, at_vector]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(arrays: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(a) for a in arrays], names=["lead_query", "lead", "score"])

        held, n = [], 0
        for scored in scores_of(batches):
            held.append(scored)
            n += len(scored[0])
            if n >= HELD:
                few = best_of(*(np.concatenate(column) for column in zip(*held)), k + 1)
                held, n = [few], len(few[0])
                if n >= HELD // 2:  # as many queries as fit: they are the next task's
                    yield batch_of(few)
                    held, n = [], 0
        if held:
            yield batch_of(best_of(*(np.concatenate(column) for column in zip(*held)), k + 1))

    best = Window.partitionBy("lead_query").orderBy(F.desc("score"), "lead")
    by_lead = Window.partitionBy("lead_query").orderBy(F.desc("score"), "vec_id")

    def nearest_leads(pairs: DataFrame) -> DataFrame:
        scored = pairs.select("ids", "vecs", "query_ids", "query_vecs").mapInArrow(compare, "lead_query long, lead long, score double")
        distinct = scored.groupBy("lead_query", "lead").agg(F.max("score").alias("score"))
        few = distinct.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
        found = few.join(first_copies, "lead").select("lead_query", "vec_id", "score")
        # Only the k + 1 nearest ids of a distinct query vector can be needed; its copies share them.
        return found.withColumn("r", F.row_number().over(by_lead)).where(F.col("r") <= k + 1).drop("r")

    short = store(nearest_leads(pairs), "ann-found")
    held = short.groupBy("lead_query").agg(F.count(F.lit(1)).alias("held"))
    totals = rows.select(F.octet_length("vec").alias("size"), "vec_id").distinct().groupBy("size").agg(F.count(F.lit(1)).alias("total"))
    lacking = asked_same.withColumn("size", F.octet_length("vec")).join(held, "lead_query", "left").join(totals, "size")
    lacking = store(lacking.where(F.coalesce("held", F.lit(0)) < F.least("total", F.lit(k + 1))).select("lead_query", "vec", "size"), "ann-lacking")
    if not lacking.isEmpty():
        def blocks(table: DataFrame, column: str, name: str) -> DataFrame:
            sized = table.select("size", F.col(column).alias("id"), "vec")
            return packed(sized, ["size"], crowded(sized, ["size"], name))

        every = store(blocks(same.withColumn("size", F.octet_length("vec")), "lead", "ann-crowded-every"), "ann-every")
        asking = blocks(lacking, "lead_query", "ann-crowded-lacking").select("size", F.col("part").alias("query_part"), F.col("ids").alias("query_ids"), F.col("vecs").alias("query_vecs"))
        exact = nearest_leads(every.join(asking, "size").repartition("size", "part", "query_part"))
        short = short.join(lacking.select("lead_query"), "lead_query", "left_anti").unionByName(exact)
    each = short.join(asked_copies, "lead_query").where("vec_id <> query_id")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
