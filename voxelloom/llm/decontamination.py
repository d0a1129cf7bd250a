"""Benchmark decontamination with spaced seeds: hash hits that ignore some positions, verified around the hit."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.llm.shared import SpanHasher, mix64, pieces, runs, texts_of

# Selected positions of a mask. Every stretch of 13 words of which 11 agree has a place where one of the two long
# masks meets agreeing words only; every five words of which four agree meet one of the short masks.
LONG_MASKS = ((0, 3, 5, 6, 7, 8), (0, 1, 2, 4, 5, 8))
SHORT_MASKS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4), (1, 2, 3, 4))
WINDOW = 13  # words of an overlap that must agree to SIMILARITY; a shorter passage counts as a whole
SIMILARITY = 0.8
LEAST_WORDS = 5  # passages of fewer words have no spaced seed: they are matched exactly, as sentences of their own
PIECE = 4096  # words of a test passage that are handled together
BLOCK = 1 << 20  # words of test passages in one broadcast block
PRECHECK_BITS = 23

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True

# Scripts that put no spaces between words: each of their characters counts as a word.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F))
SENTENCE_END = "\n.!?\u3002\uff01\uff1f"
PART, BREAK, ALONE = 0, 1, 2


def _kinds() -> np.ndarray:
    """For characters up to U+FFFF: part of a word, punctuation or space, or a word of its own."""
    kind = np.array([BREAK if unicodedata.category(chr(c))[0] in "PZ" else PART for c in range(1 << 16)], np.uint8)
    for low, high in UNSPACED:
        part = kind[low : high + 1]
        part[part == PART] = ALONE
    return kind


KINDS = _kinds()


def word_bounds(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and text number of every word of lower-case UTF-8 texts, and whether a sentence begins with it."""
    inside = WORD_BYTE[data]
    stops = np.isin(data, np.frombuffer(b"\n.!?", np.uint8))
    cut = None
    if (data >= 0xC2).any():
        cut = np.zeros(len(data) + 4, bool)
        for low, high, length in ((0xC2, 0xDF, 2), (0xE0, 0xEF, 3), (0xF0, 0xF4, 4)):
            at = np.flatnonzero((data >= low) & (data <= high))
            code = data[at].astype(np.int64) & (0x7F >> length)
            for k in range(1, length):
                code = code << 6 | data[at + k] & 0x3F
            # Beyond U+FFFF: the supplementary planes of ideographs are 2 and 3.
            kind = KINDS[code] if length < 4 else np.where((code >> 16 == 2) | (code >> 16 == 3), ALONE, PART)
            for k in range(length):
                inside[at[kind == BREAK] + k] = False
            alone = at[kind == ALONE]
            cut[alone] = cut[alone + length] = True
            stops[at[np.isin(code, [ord(c) for c in SENTENCE_END if ord(c) > 127])]] = True
        cut = cut[: len(data)]
    start, stop, doc = runs(inside, ends, cut)
    total = np.concatenate([[0], np.cumsum(stops)])
    begins = np.ones(len(start), bool)
    begins[1:] = (total[start[1:]] > total[stop[:-1]]) | (doc[1:] != doc[:-1])
    return start, stop, doc, begins


def word_hashes(column: pa.Array, hasher: SpanHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-case words (letters, digits and non-ASCII; single characters of unspaced scripts) of each
    text, ``n + 1`` offsets, and whether a word begins a sentence."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data, ends = texts_of(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    start, stop, doc, begins = word_bounds(data, ends)
    offsets = np.zeros(len(ends), np.int64)
    np.cumsum(np.bincount(doc, minlength=len(ends) - 1), out=offsets[1:])
    return hasher.spans(hasher.sums(data), start, stop), offsets, begins


def whole_hashes(words: np.ndarray, offsets: np.ndarray, begins: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the stretches of ``n`` words from a sentence's begin to a sentence's end; single words
    only where they are the whole text."""
    edge = np.append(begins, True)
    at = np.flatnonzero(edge[: max(0, len(words) - n + 1)] & edge[n:])
    text = np.searchsorted(offsets, at, "right") - 1
    fits = at + n <= offsets[text + 1]
    if n == 1:
        fits &= offsets[text + 1] - offsets[text] == 1
    at = at[fits]
    return at, seeds(words, tuple(range(n)), 100 + n)[at]


def seeds(words: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """The mask's hash at every position where it fits into ``words``."""
    n = max(0, len(words) - mask[-1])
    out = np.full(n, number + 1, np.uint64)
    for place, at in enumerate(mask):
        out += words[at : at + n] * np.uint64(2 * (0x9E3779B97F4A7C15 * (place + 3) % 2**62) + 1)
    return mix64(out)


class Block:
    """Test passages, their seeds in sorted order and a bitmap of them; short passages by the hash of all their words."""

    def __init__(self, items: list[tuple[int, int, np.ndarray]]) -> None:
        """``items``: item_id, words of the whole passage, and the hashes of one piece of it."""
        short = [(len(w), i, seeds(w, tuple(range(len(w))), 100 + len(w))[0]) for i, n, w in items if n < LEAST_WORDS]
        self.short = {}
        for n in {n for n, _, _ in short}:
            hashes = np.array([h for m, _, h in short if m == n], np.uint64)
            order = np.argsort(hashes, kind="stable")
            self.short[n] = hashes[order], np.array([i for m, i, _ in short if m == n], np.int64)[order]
        items = [item for item in items if item[1] >= LEAST_WORDS]
        self.item = np.array([i for i, _, _ in items], np.int64)
        lengths = np.array([len(w) for _, _, w in items], np.int64)
        self.window = np.minimum(WINDOW, np.array([n for _, n, _ in items], np.int64))
        self.words = np.concatenate([np.zeros(0, np.uint64), *[w for _, _, w in items]])
        self.ends = np.concatenate([[0], np.cumsum(lengths)])
        owner = np.repeat(np.arange(len(items)), lengths)
        found, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        self.masks = []
        for number, mask in enumerate(LONG_MASKS + SHORT_MASKS):
            wanted = (self.window >= WINDOW) == (number < len(LONG_MASKS))
            if wanted.any():
                at = np.arange(max(0, len(self.words) - mask[-1]))
                at = at[wanted[owner[at]] & (owner[at] == owner[at + mask[-1]])]
                self.masks.append((number, mask))
                found.append(seeds(self.words, mask, number)[at])
                places.append(at)
        hashes, places = np.concatenate(found), np.concatenate(places)
        order = np.argsort(hashes, kind="stable")
        self.places, hashes = places[order], hashes[order]
        self.hashes, first = np.unique(hashes, return_index=True)
        self.first = np.append(first, len(hashes))
        bits = np.zeros(1 << PRECHECK_BITS, bool)
        bits[hashes >> np.uint64(64 - PRECHECK_BITS)] = True
        self.bitmap = np.packbits(bits)

    def hits(self, words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``words`` and in the block's words where a seed agrees, within one text and one passage."""
        text, test = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for number, mask in self.masks:
            hashes = seeds(words, mask, number)
            bit = hashes >> np.uint64(64 - PRECHECK_BITS)
            at = np.flatnonzero(self.bitmap[bit >> np.uint64(3)] & (np.uint8(128) >> (bit & np.uint64(7)).astype(np.uint8)))
            place = np.searchsorted(self.hashes, hashes[at])
            place[place == len(self.hashes)] = 0  # the bitmap has the hash's bits, so there are hashes
            same = self.hashes[place] == hashes[at]
            at, place = at[same], place[same]
            inside = np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + mask[-1], "right")
            at, place = at[inside], place[inside]
            n = self.first[place + 1] - self.first[place]
            text.append(np.repeat(at, n))
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            test.append(self.places[np.repeat(self.first[place], n) + step])
        return np.concatenate(text), np.concatenate(test)

    def wholes(self, words: np.ndarray, offsets: np.ndarray, begins: np.ndarray) -> Iterator[np.ndarray]:
        """Rows as ``overlaps`` gives them, for passages too short for seeds: exact, sentence by sentence."""
        for n, (known, items) in self.short.items():
            at, hashes = whole_hashes(words, offsets, begins, n)
            low, high = np.searchsorted(known, hashes), np.searchsorted(known, hashes, "right")
            count = high - low
            item = items[np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())]
            at = np.repeat(at, count)
            if len(at):
                doc = np.searchsorted(offsets, at, "right") - 1
                yield np.stack([doc, item, at - offsets[doc], np.full(len(at), n), np.full(len(at), n)])

    def overlaps(self, words: np.ndarray, offsets: np.ndarray, at_once: int = 1 << 21) -> Iterator[np.ndarray]:
        """Rows ``(text, item, first word, agreeing words, words)`` of verified overlaps.

        Each hit names a diagonal: text and passage laid over each other. Along it, stretches of ``window``
        positions with enough agreeing words are joined.
        """
        text, test = self.hits(words, offsets)
        if not len(text):
            return
        doc = np.searchsorted(offsets, text, "right") - 1
        piece = np.searchsorted(self.ends, test, "right") - 1
        shift = text - test
        key = np.unique(np.stack([doc, piece, shift]), axis=1)
        doc, piece, shift = key
        low = np.maximum(offsets[doc] - shift, self.ends[piece])
        high = np.minimum(offsets[doc + 1] - shift, self.ends[piece + 1])
        length = high - low
        start = 0
        ends = np.concatenate([[0], np.cumsum(length)])
        while start < len(doc):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + at_once, "right")) - 1)
            part = slice(start, stop)
            n, d, i, s, lo = length[part], doc[part], piece[part], shift[part], low[part]
            owner = np.repeat(np.arange(len(n)), n)
            head = np.cumsum(n) - n
            test_at = np.arange(n.sum()) - head[owner] + lo[owner]
            same = self.words[test_at] == words[test_at + s[owner]]
            total = np.concatenate([[0], np.cumsum(same)])
            width = self.window[i]
            here = np.arange(len(owner))
            fits = here + width[owner] <= (head + n)[owner]
            begin = here[fits]
            w = width[owner[begin]]
            agree = total[begin + w] - total[begin]
            good = agree >= np.ceil(SIMILARITY * w - 1e-9)
            begin, w = begin[good], w[good]
            cover = np.zeros(len(owner) + 1, np.int64)
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + w, -1)
            covered = np.cumsum(cover)[:-1] > 0
            if covered.any():
                rows, first = np.unique(owner[covered], return_index=True)
                at = here[covered][first]
                yield np.stack([
                    d[rows], self.item[i[rows]], test_at[at] + s[rows] - offsets[d[rows]],
                    np.bincount(owner[covered & same], minlength=len(n))[rows], np.bincount(owner[covered], minlength=len(n))[rows],
                ])
            start = stop


def _test_pieces(benchmark: DataFrame) -> DataFrame:
    """``item_id, n_words, words``: hashed passages in pieces of ``PIECE`` words that overlap by a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for batch in pieces(batches, "text"):
            words, offsets, _ = word_hashes(batch.column(1), hasher)
            rows = []
            for i, item in enumerate(batch.column(0).to_pylist()):
                own = words[offsets[i] : offsets[i + 1]]
                if len(own):
                    for at in range(0, max(1, len(own) - WINDOW), PIECE - WINDOW):
                        rows.append((item, len(own), own[at : at + PIECE].tobytes()))
            columns = zip(*rows) if rows else ([], [], [])
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], names=["item_id", "n_words", "words"])

    known = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return known.mapInArrow(run, "item_id long, n_words long, words binary").distinct()


def _blocks(tests: DataFrame, block: int) -> Iterator[Block]:
    """Blocks of at most ``block`` words; the driver holds one partition of hashed passages and one block."""
    items: list[tuple[int, int, np.ndarray]] = []
    size = 0
    for row in tests.toLocalIterator():
        words = np.frombuffer(row.words, np.uint64)
        if items and size + len(words) > block:
            yield Block(items)
            items, size = [], 0
        items.append((row.item_id, row.n_words, words))
        size += len(words)
    if items:
        yield Block(items)


OVERLAP = "doc_id long, item_id long, first_word long, n_same long, n_words long"


def overlaps(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every document's best verified overlap with each passage: ``doc_id, item_id, first_word, n_same, n_words``.

    Words are lower-case runs of letters and digits, so case, punctuation and white space do not matter; in scripts
    without spaces each character is a word. An overlap has at least 13 words (a shorter passage: all its words) of
    which at least 0.8 agree position by position. A passage of two to four words must agree exactly and fill whole
    sentences or lines, one of a single word the whole text: such words are too common to count anywhere. The passages are joined in blocks of bounded size, each one broadcast; documents are scanned
    where they lie, once per block, and only overlaps are returned. Null or empty texts, null ids of passages
    and passages without words give nothing; an empty benchmark gives an empty table. Rows
    with equal doc_ids give rows of their own. Extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = spark.createDataFrame([], OVERLAP)

    def scan(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher, tests = SpanHasher(), shared.value
            for batch in pieces(batches, "text"):
                words, offsets, begins = word_hashes(batch.column(1), hasher)
                for part in chain(tests.overlaps(words, offsets), tests.wholes(words, offsets, begins)):
                    # One row per text and passage: the overlap with most agreeing words, then the first one.
                    order = np.lexsort((part[2], -part[3], part[1], part[0]))
                    part = part[:, order]
                    best = np.append(True, (part[0][1:] != part[0][:-1]) | (part[1][1:] != part[1][:-1]))
                    part = part[:, best]
                    ids = batch.column(0).take(pa.array(part[0]))
                    yield pa.record_batch([ids, *[pa.array(c) for c in part[1:]]], names=["doc_id", "item_id", "first_word", "n_same", "n_words"])

        return rows.mapInArrow(run, OVERLAP)

    for tests in _blocks(_test_pieces(benchmark), block):
        found = found.unionByName(scan(spark.sparkContext.broadcast(tests)))
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated doc_id: its best overlap, and the number of passages found in it."""
    best = F.max_by(F.struct("item_id", "first_word", "n_same", "n_words"), F.struct("n_same", -F.col("item_id"), -F.col("first_word")))
    return overlaps(docs, benchmark).groupBy("doc_id").agg(best.alias("b"), F.count_distinct("item_id").alias("n_items")).select(
        "doc_id", "b.item_id", "b.first_word", "b.n_same", "b.n_words", "n_items"
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a verified overlap; each row is judged by its own text.

    Rows that share a doc_id, or have none, are told apart by a hash of doc_id and text.
    """
    own = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    texts = docs.select(own.alias("doc_id"), F.col("text").cast("string").alias("text"))
    bad = overlaps(texts, benchmark).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, own == F.col("_bad"), "left_anti")
