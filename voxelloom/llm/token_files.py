"""Token-id files: tokenized documents in doc_id order, range-coded in independent, checksummed blocks."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelloom.llm import range_coder
from voxelloom.llm.shared import SpanHasher, pieces, shared_folder, store, texts_of

BLOCK_IDS = 1 << 21
END_ID = 0
CACHE_SEGMENTS = 3 << 18  # segments kept; when there are more, those that came only once are forgotten
PIECE_BYTES = 1 << 19  # text that one numpy step takes at once
JOINED_BYTES = 1 << 12  # segments that are joined to one text for the tokenizer

_PRINTABLE = np.zeros(256, bool)
_PRINTABLE[0x21:0x7F] = True
# First bytes of characters that are surely no white space; those of U+0080..U+00BF, U+1xxx, U+2xxx and U+3xxx are left out.
_PLAIN_LEAD = _PRINTABLE.copy()
_PLAIN_LEAD[[*range(0xC3, 0xE0), *range(0xE4, 0xF5)]] = True


def _pairs() -> np.ndarray:
    """For two neighbouring bytes (the first one times 256 plus the second): a cut between them is 0 not known, 1 sure,
    2 sure if the byte before both of them allows it."""
    kind = np.zeros(256, np.uint8)  # 1 letters, 2 digits, 3 other marks, 4 white space
    kind[_PRINTABLE] = 3
    kind[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
    kind[0x30:0x3A] = 2
    kind[[0x20, 0x0A]] = 4
    before, after = kind[:, None], kind[None, :]
    sure = (before > 0) & (before < 4) & (after > 0) & (before != after)
    sure[0x27, kind < 4] = False  # an apostrophe may begin a contraction
    out = sure.astype(np.uint8)
    out[0x80:0xC0, kind == 4] = 2
    out[0x0A, _PLAIN_LEAD] = 2
    return out.reshape(-1)


_PAIRS = _pairs()


class Encoder:
    """Encodes whole texts with a byte-level BPE tokenizer; equal segments are encoded once.

    The tokenizer's own split takes runs of letters, of digits and of other marks, each with one space before it, and
    contractions as words. So a word always ends where a letter, digit or mark (but no apostrophe) is followed by
    another of these kinds or by white space, and a line end alone is a word of its own. Cutting there and encoding the
    parts one by one gives the ids of the whole text.
    """

    def __init__(self, path: str | None = None, data: str | None = None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task per core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data) if data else Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.length = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of a token: one character each
        for token, number in vocabulary.items():
            self.length[number] = len(token)
        self.hasher = SpanHasher()
        self.pool, self.pooled = np.zeros(1 << 16, np.uint32), 0  # ids of the segments one after another
        self._resize(1 << 16)

    def _resize(self, slots: int) -> None:
        """An empty table of the segments' hashes (0: a free slot) and of the place and number of their ids."""
        self.keys, self.first, self.count = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.again = np.zeros(slots, bool)  # the segment came in a later piece too
        self.shift, self.used = np.uint64(65 - slots.bit_length()), 0

    def _insert(self, hashes: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        """Enter distinct segments that are not in the table; a quarter of it stays free."""
        if 4 * (self.used + len(hashes)) > 3 * len(self.keys):
            kept = np.flatnonzero(self.keys)
            old = (self.keys[kept], self.first[kept], self.count[kept], self.again[kept])
            self._resize(1 << ((len(kept) + len(hashes)) * 4 // 3).bit_length())
            self._insert(*old[:3])
            self.again[self._find(old[0])] = old[3]
        left = np.arange(len(hashes))
        while len(left):  # of those that meet in a free slot, one takes it
            slot = self._find(hashes[left])
            self.keys[slot], self.first[slot], self.count[slot], self.again[slot] = hashes[left], first[left], count[left], False
            left = left[self.keys[slot] != hashes[left]]
        self.used += len(hashes)

    def _forget(self, room: int) -> None:
        """Forget the segments that came in one piece only; all of them if the others leave no room for so many."""
        kept = np.flatnonzero(self.again & (self.keys != 0))
        if len(kept) + room > CACHE_SEGMENTS * 3 // 4:
            kept = kept[:0]
        hashes, count = self.keys[kept], self.count[kept]
        first = np.cumsum(count, dtype=np.int64) - count
        self.pooled = int(count.sum())
        self.pool = self.pool.take(np.repeat(self.first[kept] - first, count) + np.arange(self.pooled))
        self._resize(1 << 16)
        self._insert(hashes, first, count)

    def _cuts(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where segments begin: the texts, and the positions inside them at which a word surely ends."""
        begins = np.zeros(len(data) + 1, bool)
        kinds = _PAIRS.take((data[:-1].astype(np.uint16) << np.uint16(8)) | data[1:])
        begins[1:-1] = kinds == 1
        at = np.flatnonzero(kinds == 2) + 1
        near, far = data[at - 1], data[np.maximum(at - 2, 0)]
        # A single line end after a mark, or the second byte of a character that is no white space.
        begins[at] = np.where(near == 0x0A, _PRINTABLE[far], (far >= 0xC3) & (far < 0xE0))
        begins[ends] = True
        return np.flatnonzero(begins[:-1])

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The slots of these segments, a free slot for one that is not known."""
        slot = (hashes >> self.shift).astype(np.int64)
        held = self.keys.take(slot)
        left = np.flatnonzero((held != hashes) & (held != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            held = self.keys.take(slot[left])
            left = left[(held != hashes[left]) & (held != 0)]
        return slot

    def _encode_joined(self, raw: bytes, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments that begin with a space before a word and end in no white space: many of them make one text."""
        ids, counts = [], []
        sizes = np.cumsum(stop - start)
        group = (sizes - (stop - start)) // JOINED_BYTES
        heads = np.flatnonzero(np.diff(group, prepend=-1))
        texts = [b"".join(raw[a:b] for a, b in zip(start[lo:hi].tolist(), stop[lo:hi].tolist())).decode() for lo, hi in zip(heads, [*heads[1:], len(start)])]
        for encoding, lo, hi in zip(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), heads, [*heads[1:], len(start)]):
            found = np.array(encoding.ids, np.uint32)
            reached = np.cumsum(self.length[found])
            last = np.searchsorted(reached, np.cumsum(stop[lo:hi] - start[lo:hi])) + 1
            ids.append(found)
            counts.append(np.diff(last, prepend=0))
        return np.concatenate(ids), np.concatenate(counts)

    def _learn(self, data: np.ndarray, hashes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
        """Encode distinct segments that are not known yet."""
        raw = data.tobytes()
        final = data[stop - 1]
        joinable = (stop - start > 1) & (data[start] == 0x20) & _PLAIN_LEAD[data[np.minimum(start + 1, len(data) - 1)]]
        joinable &= _PRINTABLE[final] | ((final & 0xC0) == 0x80) & (data[stop - 2] >= 0xC3) & (data[stop - 2] < 0xE0)
        for together in (True, False):
            which = joinable == together
            if not which.any():
                continue
            if together:
                ids, count = self._encode_joined(raw, start[which], stop[which])
            else:
                texts = [raw[a:b].decode() for a, b in zip(start[which].tolist(), stop[which].tolist())]
                encoded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                count = np.array([len(e) for e in encoded], np.int64)
                ids = np.array([i for e in encoded for i in e], np.uint32)
            self._insert(hashes[which], self.pooled + np.cumsum(count) - count, count)
            if self.pooled + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.pooled], np.zeros(max(self.pooled, len(ids)), np.uint32)])
            self.pool[self.pooled : self.pooled + len(ids)] = ids
            self.pooled += len(ids)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of an Arrow column one after another, and the number of ids of each; null is empty."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        data, ends = texts_of(column)
        n = len(ends) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        start = self._cuts(data, ends)
        stop = np.append(start[1:], len(data))
        hashes = np.maximum(self.hasher.spans(self.hasher.sums(data), start, stop), np.uint64(1))
        slot = self._find(hashes)
        self.again[slot] = True
        table = self.keys
        missing = np.flatnonzero(table.take(slot) == 0)
        if len(missing):
            new = missing[np.unique(hashes[missing], return_index=True)[1]]
            if self.used + len(new) > CACHE_SEGMENTS:
                self._forget(len(new))
                new = np.unique(hashes, return_index=True)[1]
                new = new[self.keys[self._find(hashes[new])] == 0]
            self._learn(data, hashes[new], start[new], stop[new])
            if self.keys is not table:  # it grew, or was emptied
                missing = np.arange(len(hashes))
            slot[missing] = self._find(hashes[missing])
        count = self.count.take(slot)
        reached = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        ids = self.pool.take(np.repeat(self.first.take(slot) - reached[:-1], count) + np.arange(reached[-1]))
        return ids, np.diff(reached[np.searchsorted(start, ends)])


_encoders: dict[int, Encoder] = {}


def encoder_of(data: str) -> Encoder:
    """The worker's encoder: its segments are kept from task to task."""
    key = zlib.crc32(data.encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(data=data)
    return _encoders[key]


BLOCK_SCHEMA = (
    "file int, block int, n_ids long, n_docs int, doc_ids array<long>, parts array<int>, lasts array<boolean>, lengths array<long>, payload binary"
)


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, block_ids: int = BLOCK_IDS, partitions: int | None = None) -> None:
    """Write ``docs`` in ascending doc_id order (null ids first; rows of one id by text) under ``path``.

    A file is a range of doc_ids, a row of it one block: up to ``block_ids`` range-coded ids of consecutive
    documents, with the ids and lengths of the documents. A document that does not fit continues in the next
    block as its next part. Every text ends with id 0; a null text has only that one. Executors write through Spark,
    so ``path`` may be any file system Spark reaches, and a lost task is written again.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:  # a fixed public vocabulary of some megabytes
        shared = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        number = TaskContext.get().partitionId()
        waiting: list[np.ndarray] = []
        index: list[tuple] = []  # doc_id, part, is the last part, ids
        held = block = 0

        def flush() -> pa.RecordBatch:
            nonlocal waiting, index, held, block
            ids = np.concatenate(waiting)
            columns = [[number], [block], [len(ids)], [len(index)], *[[list(c)] for c in zip(*index)], [range_coder.encode(ids)]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary())
            waiting, index, held, block = [], [], 0, block + 1
            names = ["file", "block", "n_ids", "n_docs", "doc_ids", "parts", "lasts", "lengths", "payload"]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in pieces(batches, "text", PIECE_BYTES):
            found, counts = encoder.encode(batch.column(1))
            stops = np.cumsum(counts)
            # The ids of all texts with the end id after each.
            ids = np.insert(found, stops, np.uint32(END_ID))
            stops += np.arange(1, len(stops) + 1)
            begin = 0
            for doc, stop in zip(batch.column(0).to_pylist(), stops.tolist()):
                part = 0
                while stop - begin > block_ids - held:
                    if block_ids > held:
                        waiting.append(ids[begin : begin + block_ids - held])
                        index.append((doc, part, False, block_ids - held))
                        begin, part = begin + block_ids - held, part + 1
                    yield flush()
                waiting.append(ids[begin:stop])
                index.append((doc, part, True, stop - begin))
                held += stop - begin
                begin = stop
        if index:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(count, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, BLOCK_SCHEMA).write.parquet(path)


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32, bits reflected."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def crc32_joined(crc: int, after: int, n_bytes: int) -> int:
    """CRC-32 of two texts joined, from theirs and the length of the second one."""
    shift, square, n = 1 << 31, 1 << 23, n_bytes  # x**0 and x**8
    while n:
        if n & 1:
            shift = _times(shift, square)
        square, n = _times(square, square), n >> 1
    return _times(shift, crc) ^ after


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files under ``path``, from their decoded ids, checksums verified.

    ``doc_id, start, n_tokens, ids_crc32, n_parts``: ids of all documents before it, ids with the end id, and the
    unsigned CRC-32 of all of them as little-endian 32-bit integers.
    """
    blocks = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                file, block, doc_ids, parts, lasts, lengths, payload = (batch.column(c)[row] for c in range(7))
                raw = range_coder.decode(payload.as_py()).astype("<u4")
                size = lengths.values.to_numpy()
                stop = np.cumsum(size)
                if stop[-1] != len(raw):
                    raise ValueError("damaged token block")
                crc = [zlib.crc32(raw[a:b]) for a, b in zip((stop - size).tolist(), stop.tolist())]
                n = len(size)
                yield pa.record_batch([
                    pa.array(np.full(n, file.as_py(), np.int32)), pa.array(np.full(n, block.as_py(), np.int32)), pa.array(np.arange(n, dtype=np.int32)),
                    doc_ids.values, parts.values, lasts.values, pa.array(stop - size), lengths.values, pa.array(crc, pa.int64()),
                ], names=["file", "block", "place", "doc_id", "part", "last", "before", "n", "crc"])

    decoded = blocks.select("file", "block", "doc_ids", "parts", "lasts", "lengths", "payload").mapInArrow(
        run, "file int, block int, place int, doc_id long, part int, last boolean, before long, n long, crc long"
    )
    decoded = store(decoded, "token-index")  # some numbers a document; else both branches below decode the files
    # Ids before a block: those of earlier files, then those of earlier blocks of its file.
    sizes = blocks.select("file", "block", "n_ids")
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    files = sizes.groupBy("file").agg(F.sum("n_ids").alias("n")).select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("file_start"))
    starts = sizes.withColumn("block_start", F.coalesce(F.sum("n_ids").over(in_file), F.lit(0))).join(files, "file").select(
        "file", "block", (F.col("file_start") + F.col("block_start")).alias("block_start")
    )
    if sizes.count() <= 200_000:
        starts = F.broadcast(starts)  # three numbers a row
    placed = decoded.join(starts, ["file", "block"]).withColumn("start", F.col("block_start") + F.col("before"))
    whole = placed.where("part = 0 and last").select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"), F.lit(1).alias("n_parts"))

    @F.udf("long")
    def joined(parts: list) -> int:
        crc = parts[0].crc
        for part in parts[1:]:
            crc = crc32_joined(crc, part.crc, 4 * part.n)
        return crc

    # Parts of one document: the block in which it starts is that of a part minus the part's number.
    split = placed.where("part > 0 or not last").groupBy("file", (F.col("block") - F.col("part")).alias("first_block"), "doc_id").agg(
        F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("part", "n", "crc"))).alias("list")
    )
    several = split.select("doc_id", "start", "n_tokens", joined("list").alias("ids_crc32"), F.size("list").alias("n_parts"))
    return whole.unionByName(several)


def token_index(docs: DataFrame, tokenizer_path: str, path: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write the token files of ``docs`` (into the shared folder if no ``path`` is given) and read them back."""
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, tokenizer_path, path, block_ids)
    return read_token_files(spark, path)
