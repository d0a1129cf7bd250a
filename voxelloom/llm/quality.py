"""Quality classifier: a small convolutional network over bytes, trained and run in numpy."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.llm.shared import crc_class, pieces, texts_of

WIDTH, STRIDE, EMBED, FILTERS = 8, 2, 6, 16
WINDOWS = 128  # filter positions pooled in one chunk: 256 bytes, and 6 more that the next chunk sees too
CHUNK = STRIDE * (WINDOWS - 1) + WIDTH
FIT_ROWS = 1500  # labelled documents of each class that the network is fitted on, about
FIT_CHUNKS = 16  # chunks of each of them, spread over its whole text
EPOCHS, LEAST_STEPS, BATCH, RATE = 12, 500, 64, 0.004
KEEP = 0.7


def chunk_pool(net: dict[str, np.ndarray], data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Max-pooled filter outputs of every chunk, and the number of chunks of every text.

    A text is filled with zero bytes up to a whole number of strides, at least one window; each byte is in a window.
    """
    size = np.diff(ends)
    steps = np.maximum(1, -(-np.maximum(0, size - WIDTH) // STRIDE) + 1)
    padded = (steps - 1) * STRIDE + WIDTH
    room = np.concatenate([[0], np.cumsum(padded)])
    buffer = np.zeros(room[-1], np.uint8)
    where = np.ones(room[-1], bool)
    gaps = padded - size
    filled = np.repeat(room[1:] - gaps, gaps) + np.arange(gaps.sum()) - np.repeat(np.cumsum(gaps) - gaps, gaps)
    where[filled] = False
    buffer[where] = data
    first = np.repeat(room[:-1], steps) + STRIDE * (np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps))
    chunks = -(-steps // WINDOWS)
    chunk_start = np.repeat(np.cumsum(steps) - steps, chunks) + WINDOWS * (np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks))
    embedded = net["embed"][buffer]
    spread = np.lib.stride_tricks.sliding_window_view(embedded.reshape(-1), WIDTH * EMBED)[::EMBED]
    out = np.empty((len(first), FILTERS), np.float32)
    for lo in range(0, len(first), 1 << 16):
        out[lo : lo + (1 << 16)] = spread[first[lo : lo + (1 << 16)]] @ net["filters"]
    pooled = np.maximum.reduceat(out, chunk_start, axis=0) if len(out) else out
    return np.maximum(pooled + net["bias"], 0.0), chunks


def probabilities(net: dict[str, np.ndarray], data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One probability per text: chunk scores are averaged over the whole text."""
    pooled, chunks = chunk_pool(net, data, ends)
    doc = np.repeat(np.arange(len(chunks)), chunks)
    score = np.bincount(doc, pooled.astype(np.float64) @ net["head"], len(chunks)) / np.maximum(1, chunks)
    return 1.0 / (1.0 + np.exp(-(score + net["offset"][0])))


def train(
    chunks: np.ndarray, sizes: np.ndarray, doc: np.ndarray, label: np.ndarray, prior: float, seed: int = 6
) -> dict[str, np.ndarray]:
    """Adam on the log loss of documents.

    ``chunks`` are byte rows of ``CHUNK`` of which the first ``sizes`` are text, ``doc`` ascending document numbers.
    """
    used_windows = np.maximum(1, -(-np.maximum(0, sizes - WIDTH) // STRIDE) + 1)
    rng = np.random.default_rng(seed)
    net = {
        "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        "filters": rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32), "head": rng.normal(0, 0.3, FILTERS).astype(np.float32), "offset": np.zeros(1, np.float32),
    }
    first, second = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2))
    heads = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]])
    step = 0
    batches = max(1, len(label) // BATCH)
    for _ in range(max(EPOCHS, -(-LEAST_STEPS // batches))):
        for picked in np.array_split(rng.permutation(len(label)), batches):
            rows = np.concatenate([np.arange(heads[d], heads[d + 1]) for d in picked])
            size = heads[picked + 1] - heads[picked]
            owner = np.repeat(np.arange(len(picked)), size)
            x = chunks[rows]
            e = net["embed"][x].reshape(len(x), -1)
            view = np.lib.stride_tricks.sliding_window_view(e, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]
            flat = view.reshape(-1, WIDTH * EMBED)
            z = (flat @ net["filters"]).reshape(len(x), WINDOWS, FILTERS)
            z[np.arange(WINDOWS) >= used_windows[rows][:, None]] = -np.inf  # filled places take no part, as in scoring
            top = z.argmax(axis=1)
            pooled = np.maximum(np.take_along_axis(z, top[:, None], 1)[:, 0] + net["bias"], 0.0)
            score = np.bincount(owner, pooled @ net["head"], len(picked)) / size + net["offset"][0]
            error = (1.0 / (1.0 + np.exp(-score)) - label[picked]) / len(picked)
            on_chunk = (error / size)[owner].astype(np.float32)
            on_pool = on_chunk[:, None] * net["head"] * (pooled > 0)
            windows = flat.reshape(len(x), WINDOWS, -1)[np.arange(len(x))[:, None], top]  # chunk, filter, inputs
            on_input = on_pool[:, :, None] * net["filters"].T[None]
            places = (top * STRIDE)[:, :, None] + np.arange(WIDTH)
            used = x[np.arange(len(x))[:, None, None], places].reshape(-1)
            on_embed = on_input.reshape(-1, EMBED)
            slope = {
                "embed": np.stack([np.bincount(used, on_embed[:, k], 256) for k in range(EMBED)], axis=1),
                "filters": np.einsum("cf,cfi->if", on_pool, windows), "bias": on_pool.sum(axis=0),
                "head": pooled.T @ on_chunk, "offset": np.array([error.sum()]),
            }
            step += 1
            for k, g in slope.items():
                g = g.astype(np.float32) + np.float32(1e-4) * net[k]
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                net[k] -= (RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    # The sample is balanced; the offset brings back the share of label 1 among all labelled rows.
    seen = label.mean()
    if 0 < seen < 1 and 0 < prior < 1:
        net["offset"] = net["offset"] + np.log(prior / (1 - prior)) - np.log(seen / (1 - seen))
    return net


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = FIT_ROWS, chunks_per_row: int = FIT_CHUNKS) -> dict[str, np.ndarray]:
    """Train on a bounded sample of ``labels (doc_id, quality)``: about ``rows_per_class`` documents of each class.

    Of each one, ``chunks_per_row`` chunks spread evenly over the whole text go to the one training task. If
    labels of an id disagree, the id is not used. Without both classes the network answers the share of label 1.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    known = known.where("quality = other").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    marked = known.where(crc_class(F.col("doc_id")) != 2)
    sizes = {row.quality: row.n for row in marked.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = sizes.get(1, 0) / max(1, sum(sizes.values()))
    empty = {"embed": np.zeros((256, EMBED), np.float32), "filters": np.zeros((WIDTH * EMBED, FILTERS), np.float32), "bias": np.zeros(FILTERS, np.float32), "head": np.zeros(FILTERS, np.float32)}
    if len(sizes) < 2:
        return empty | {"offset": np.array([20.0 if prior > 0.5 else 0.0 if not sizes else -20.0], np.float32)}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).cast("double") / float(1 << 30)
    share = F.when(F.col("quality") == 1, min(1.0, rows_per_class / sizes[1])).otherwise(min(1.0, rows_per_class / sizes[0]))
    picked = marked.where(draw < share)
    # Two numbers for each sampled label; the draw keeps about the documented number of them.
    picked = F.broadcast(picked) if picked.count() <= 8 * rows_per_class else picked
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(picked, "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, ends = texts_of(batch.column(1))
            rows = []
            for a, b in zip(ends[:-1], ends[1:]):
                n = int(min(chunks_per_row, max(1, -(-(b - a) // (STRIDE * WINDOWS)))))
                starts = np.linspace(a, max(a, b - CHUNK), n).astype(int) if n > 1 else [a]
                cuts = [data[s : min(b, s + CHUNK)].tobytes() for s in starts]
                rows.append((b"".join(c.ljust(CHUNK, b"\0") for c in cuts), [len(c) for c in cuts]))
            columns = [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))]
            yield pa.record_batch([batch.column(0), batch.column(2), *columns], names=["doc_id", "quality", "chunks", "sizes"])

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "chunks"])
        rows = np.frombuffer(b"".join(frame.chunks), np.uint8).reshape(-1, CHUNK)
        count = frame.chunks.map(len).to_numpy() // CHUNK
        sizes = np.concatenate(frame.sizes.tolist())
        net = train(rows, sizes, np.repeat(np.arange(len(frame)), count), frame.quality.to_numpy().astype(float), prior)
        return pd.DataFrame({"net": [pickle.dumps(net)]})

    cuts = sample.select("doc_id", "text", "quality").mapInArrow(cut, "doc_id long, quality int, chunks binary, sizes array<int>")
    trained = cuts.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(learn, "net binary").first()
    return pickle.loads(trained.net) if trained else empty | {"offset": np.zeros(1, np.float32)}


def score(docs: DataFrame, net: dict[str, np.ndarray], *keep: str) -> DataFrame:
    """``doc_id, score`` and the columns ``keep`` of every row, from its whole text. Null texts score as empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[c for c in keep if c not in ("doc_id", "text")])
    kept = [c for c in source.columns if c in keep and c != "doc_id"]
    schema = source.select("doc_id", *kept).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, ends = texts_of(batch.column(1))
            columns = [batch.column(0), *[batch.column(batch.schema.get_field_index(c)) for c in kept]]
            yield pa.record_batch([*columns, pa.array(probabilities(shared.value, data, ends))], names=["doc_id", *kept, "score"])

    return source.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """``doc_id, held_out, score, predicted``: learns from labels whose ``crc32(doc_id) mod 4`` is not 2.

    Every row is scored, whatever its text; equal texts score alike. A null doc_id is not held out. Extra columns
    are ignored, an empty table gives an empty table.
    """
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id", F.coalesce(crc_class(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= keep).cast("int").alias("predicted"),
    )


def good_documents(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that score ``keep`` or more, with all their columns."""
    scored = score(docs.withColumn("_row", F.struct(*docs.columns)), fit(docs, labels), "_row")
    return scored.where(F.col("score") >= keep).select("_row.*")
