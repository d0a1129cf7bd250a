"""Language identification by unigram models over the pieces of a fixed vocabulary, summed over all segmentations."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.llm.decontamination import WORD_BYTE
from voxelloom.llm.shared import SpanHasher, crc_class, pieces, runs, store, texts_of

MAX_PIECE = 12  # bytes
MAX_WORD = 24  # bytes; a longer word is scored in parts of this length
FIT_ROWS = 2500  # documents per language that a model is fitted on, about
ROUNDS = 3  # of expectation maximisation
PSEUDO = 0.02  # added to every piece's expected count
CACHE_WORDS = 400_000
SPACE = 32


def read_vocabulary(path: str, max_piece: int = MAX_PIECE) -> list[bytes]:
    """Pieces of a ranks file (base64 and rank per line) that can occur in lower-case words with a leading space."""
    out = []
    with open(path, "rb") as lines:
        for line in lines:
            piece = base64.b64decode(line.split()[0])
            body = piece[1:] if piece[:1] == b" " else piece
            if len(piece) <= max_piece and all(WORD_BYTE[b] for b in body):
                out.append(piece)
    single = {bytes([b]) for b in range(256) if WORD_BYTE[b] or b == SPACE}
    return sorted(single.union(out))


class Pieces:
    """Looks up all pieces inside words at once: an open-addressing table keyed by a polynomial hash."""

    RADIX = np.uint64(0x9E3779B97F4A7C15)
    SLOT_BITS = 19

    def __init__(self, vocabulary: list[bytes]) -> None:
        self.size = len(vocabulary)
        self.longest = max(map(len, vocabulary))
        self.value = SpanHasher().values
        keys = np.array([self._hash(np.frombuffer(p, np.uint8)) for p in vocabulary], np.uint64)
        slots = 1 << self.SLOT_BITS
        self.key, self.id = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
        for number, key in enumerate(keys.tolist()):
            at = key >> (64 - self.SLOT_BITS)
            while self.id[at] >= 0:
                at = (at + 1) % slots
            self.key[at], self.id[at] = key, number

    def _finish(self, h: np.ndarray, length: int) -> np.ndarray:
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(length)
        return h ^ (h >> np.uint64(31))

    def _hash(self, piece: np.ndarray) -> int:
        h = np.zeros(1, np.uint64)
        for b in piece:
            h = h * self.RADIX + self.value[b]
        return int(self._finish(h, len(piece))[0])

    def find(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For ``words`` of equal length (one per row): end, length, rows and piece ids, ends ascending."""
        n, width = words.shape
        sums = np.zeros((width + 1, n), np.uint64)
        for i in range(width):
            sums[i + 1] = sums[i] * self.RADIX + self.value[words[:, i]]
        power = np.ones(1, np.uint64)
        powers = [power]
        for _ in range(self.longest):
            power = power * self.RADIX
            powers.append(power)
        for end in range(1, width + 1):
            for length in range(1, min(end, self.longest) + 1):
                key = self._finish(sums[end] - sums[end - length] * powers[length], length)
                at = (key >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)
                ids = np.where(self.key[at] == key, self.id[at], -1)
                rows = np.flatnonzero((ids < 0) & (self.id[at] >= 0))
                while len(rows):  # the slot belongs to another piece: look at the next ones
                    at[rows] = (at[rows] + 1) % len(self.id)
                    same = (self.key[at[rows]] == key[rows]) & (self.id[at[rows]] >= 0)
                    ids[rows[same]] = self.id[at[rows[same]]]
                    rows = rows[~same & (self.id[at[rows]] >= 0)]
                rows = np.flatnonzero(ids >= 0)
                if len(rows):
                    yield end, length, rows, ids[rows]

    def log_likelihood(self, words: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """Forward algorithm: log of the summed chance of all segmentations, one column per model."""
        forward = np.zeros((words.shape[1] + 1, len(words), chance.shape[1]))
        forward[0] = 1.0
        for end, length, rows, ids in self.find(words):
            forward[end][rows] += forward[end - length][rows] * chance[ids]
        return np.log(forward[-1])

    def expected(self, words: np.ndarray, counts: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """Forward and backward algorithm: expected number of uses of each piece in ``counts`` times each word."""
        n, width = words.shape
        found = list(self.find(words))
        forward, backward = np.zeros((width + 1, n)), np.zeros((width + 1, n))
        forward[0] = backward[width] = 1.0
        for end, length, rows, ids in found:
            forward[end][rows] += forward[end - length][rows] * chance[ids]
        for end, length, rows, ids in sorted(found, key=lambda f: -f[0]):
            backward[end - length][rows] += backward[end][rows] * chance[ids]
        weight = counts / forward[width]
        out = np.zeros(self.size)
        for end, length, rows, ids in found:
            use = forward[end - length][rows] * chance[ids] * backward[end][rows] * weight[rows]
            out += np.bincount(ids, use, self.size)
        return out


def words_of(column: pa.Array, hasher: SpanHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, hashes, starts, stops and text numbers of all lower-case words, long ones in parts."""
    data, ends = texts_of(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    start, stop, doc = runs(WORD_BYTE[data], ends)
    parts = -(-(stop - start) // MAX_WORD)
    if len(parts) and parts.max() > 1:
        which = np.repeat(np.arange(len(start)), parts)
        step = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        start, stop, doc = start[which] + step * MAX_WORD, np.minimum(stop[which], start[which] + (step + 1) * MAX_WORD), doc[which]
    return data, hasher.spans(hasher.sums(data), start, stop), start, stop, doc


def by_length(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and bytes of words of equal length, each with a leading space."""
    length = stop - start
    for n in np.unique(length):
        rows = np.flatnonzero(length == n)
        for lo in range(0, len(rows), 1 << 15):
            part = rows[lo : lo + (1 << 15)]
            words = np.full((len(part), n + 1), SPACE, np.uint8)
            words[:, 1:] = data[start[part][:, None] + np.arange(n)]
            yield part, words


def fit(docs: DataFrame, vocabulary: list[bytes], rows_per_language: int = FIT_ROWS, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """``{language: log chance of every piece}`` from ``docs (doc_id, text, lang)``.

    A bounded sample, about ``rows_per_language`` documents of each language picked by a hash of doc_id, is
    counted by word; a task per language then fits the piece chances by expectation maximisation.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    sizes = F.broadcast(sizes) if sizes.count() <= 10_000 else sizes  # a code and a number per language
    share = known.join(sizes, "lang").where(
        F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(float(rows_per_language) * (1 << 30)) / F.col("n")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for batch in pieces(batches, "text"):
            langs = batch.column(0).dictionary_encode()
            data, hashes, start, stop, doc = words_of(batch.column(1), hasher)
            code = langs.indices.to_numpy()[doc].astype(np.uint64)
            _, first, n = np.unique(hashes + code * np.uint64(0x9E3779B97F4A7C15), return_index=True, return_counts=True)
            raw = data.tobytes()
            words = [raw[a:b] for a, b in zip(start[first].tolist(), stop[first].tolist())]
            yield pa.record_batch([langs.dictionary.take(pa.array(code[first].astype(np.int64))), pa.array(words, pa.binary()), pa.array(n)], names=["lang", "word", "n"])

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        finder = Pieces(vocabulary)
        raw = b"".join(frame.word)
        stop = np.cumsum(frame.word.map(len).to_numpy())
        start = stop - frame.word.map(len).to_numpy()
        groups = list(by_length(np.frombuffer(raw, np.uint8), start, stop))
        n = frame.n.to_numpy().astype(float)
        counts = np.zeros(finder.size)
        for rows, words in groups:  # at first every piece counts wherever it occurs
            for _, length, at, ids in finder.find(words):
                counts += np.bincount(ids, n[rows[at]] * length, finder.size)
        for round_ in range(rounds + 1):
            chance = (counts + PSEUDO) / (counts.sum() + PSEUDO * finder.size)
            if round_ < rounds:
                counts = sum(finder.expected(words, n[rows], chance) for rows, words in groups)
        return pd.DataFrame({"lang": [frame.lang.iloc[0]], "chance": [chance.astype("<f8").tobytes()]})

    counted = share.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(count, "lang string, word binary, n long")
    words = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    models = words.groupBy("lang").applyInPandas(learn, "lang string, chance binary")
    return {row.lang: np.frombuffer(row.chance, "<f8") for row in sorted(models.collect())}


class Scorer:
    """Scores of words under every model, kept while there are not too many of them."""

    def __init__(self, vocabulary: list[bytes], models: dict[str, np.ndarray], cache: int = CACHE_WORDS) -> None:
        self.finder, self.hasher, self.cache = Pieces(vocabulary), SpanHasher(), cache
        self.chance = np.stack(list(models.values()), axis=1)
        self.hashes, self.scores = np.zeros(0, np.uint64), np.zeros((0, len(models)))

    def log_likelihoods(self, column: pa.Array) -> np.ndarray:
        """One row per text, one column per model."""
        data, hashes, start, stop, doc = words_of(column, self.hasher)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        scores = np.empty((len(distinct), self.chance.shape[1]))
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(0, len(self.hashes) - 1))
        known = self.hashes[at] == distinct if len(self.hashes) else np.zeros(len(distinct), bool)
        scores[known] = self.scores[at[known]]
        new = np.flatnonzero(~known)
        for rows, words in by_length(data, start[first[new]], stop[first[new]]):
            scores[new[rows]] = self.finder.log_likelihood(words, self.chance)
        if len(self.hashes) + len(new) > self.cache:
            self.hashes, self.scores = distinct, scores
        else:
            hashes = np.concatenate([self.hashes, distinct[new]])
            order = np.argsort(hashes)
            self.hashes, self.scores = hashes[order], np.concatenate([self.scores, scores[new]])[order]
        return np.stack([np.bincount(doc, column_[which], len(column)) for column_ in scores.T], axis=1)


def predict(docs: DataFrame, vocabulary: list[bytes], models: dict[str, np.ndarray]) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row; the score is the language's share of the summed likelihoods.

    ``und`` with score 0 if the text is null or has no letter, or no language was learned. Equal likelihoods
    go to the first language by name. Repeated rows stay; extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letters"))
    if not models:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast((vocabulary, models))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        names = np.array(list(shared.value[1]), object)
        for batch in pieces(batches, "text"):
            total = scorer.log_likelihoods(batch.column(1))
            best = total.argmax(axis=1)
            share = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            letters = batch.column(2).to_numpy(zero_copy_only=False)
            yield pa.record_batch([
                batch.column(0), pa.array(np.where(letters, names[best], "und"), pa.string()), pa.array(np.where(letters, share, 0.0))
            ], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, vocabulary_path: str, rows_per_language: int = FIT_ROWS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; learns from rows whose ``crc32(doc_id) mod 4`` is not 2.

    A null doc_id is neither learned from nor held out.
    """
    vocabulary = read_vocabulary(vocabulary_path)
    part = crc_class(F.col("doc_id"))
    models = fit(docs.where(part != 2), vocabulary, rows_per_language)
    return predict(docs, vocabulary, models).withColumn("held_out", F.coalesce(part == 2, F.lit(False)))
