"""Lines that many documents share: sorted hash ranges are streamed once, and each document gets a bitmap back.

Only hashes travel. A line becomes ``(hash, doc_id, text hash, position)``; these rows are dealt by ranges of
(hash, doc_id) and sorted inside a range by document and position. A stream over a range sees the first
occurrence of a line in each document, counts them, and lists the lines to drop. A frequent line spans as many
ranges as it needs; what its ranges counted is added up afterwards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.llm.shared import pieces, store

SPACE = b" \t\n\x0b\x0c\r"
SURE, PENDING = 0, -1  # values of ``docs`` of a row that goes for certain, and of one that waits for its range's neighbours


def _bytes_of(column: pa.Array) -> list[bytes]:
    return [raw or b"" for raw in column.cast(pa.large_binary()).to_pylist()]


def text_hash() -> Column:
    """What tells rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def line_hashes(docs: DataFrame, least_chars: int) -> DataFrame:
    """(hi, lo, doc_id, text_hash, pos) of every line whose key has ``least_chars`` code points or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            digests, places, counts = [], [], []
            for raw in _bytes_of(batch.column("text")):
                found = len(places)
                for place, line in enumerate(raw.split(b"\n")):
                    key = line.strip(SPACE).lower()  # of bytes: A-Z only
                    if len(key) >= least_chars and (least_chars < 2 or len(key.decode()) >= least_chars):
                        digests.append(xxhash.xxh3_128_digest(key))
                        places.append(place)
                counts.append(len(places) - found)
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            owner = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column("doc_id").take(owner),
                 batch.column("text_hash").take(owner), pa.array(places, pa.int32())],
                ["hi", "lo", "doc_id", "text_hash", "pos"],
            )

    texts = docs.select(F.col("doc_id").cast("long"), "text", text_hash().alias("text_hash"))
    return texts.mapInArrow(run, "hi long, lo long, doc_id long, text_hash long, pos int")


def _starts(fields: list[np.ndarray]) -> np.ndarray:
    """True where any field differs from the row before, and on the first row."""
    out = np.ones(len(fields[0]), bool)
    out[1:] = np.logical_or.reduce([f[1:] != f[:-1] for f in fields])
    return out


def stream_ranges(lines: DataFrame, least_docs: int) -> DataFrame:
    """Lines found in ``least_docs`` documents or more, from one pass over sorted ranges.

    Rows of runs that end inside their range are decided there. The first and last run of a range may go on in
    its neighbours: it leaves a row ``pos = -1`` with the documents it counted, and while that is too few, its
    rows (of fewer than ``least_docs`` documents) as ``PENDING``. Memory: a batch and the pending rows.
    """
    names = ["hi", "lo", "doc_id", "text_hash", "pos"]
    schema = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("pos", pa.int32()), ("docs", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the open run, if it has too few documents so far
        known: tuple[int, int] | None = None  # the open run, if it has enough: its later rows go at once
        first = True  # the next run that ends is the range's first

        def marked(rows: pa.Table, docs: int) -> list[pa.RecordBatch]:
            return rows.append_column("docs", pa.array(np.full(len(rows), docs, np.int32))).cast(schema).combine_chunks().to_batches()

        def edge(key: tuple[int, int], docs: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"hi": key[0], "lo": key[1], "doc_id": None, "text_hash": 0, "pos": -1, "docs": docs}], schema)

        for batch in batches:
            rows = pa.Table.from_batches([batch]).select(names)
            rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
            if not len(rows):
                continue
            hi, lo = rows["hi"].to_numpy(), rows["lo"].to_numpy()
            doc, unknown = rows["doc_id"].fill_null(0).to_numpy(), rows["doc_id"].is_null().to_numpy()
            new_run = _starts([hi, lo])
            new_doc = new_run | _starts([doc, unknown])
            begin = np.flatnonzero(new_run)
            size = np.diff(np.append(begin, len(hi)))
            docs = np.add.reduceat(new_doc.astype(np.int64), begin)
            if known == (hi[0], lo[0]):
                docs[0] += least_docs
            enough = docs >= least_docs
            if first:  # the range's first run: its count is told as soon as it ends or is enough
                key = (int(hi[0]), int(lo[0]))
                if enough[0] or len(begin) > 1:
                    first = False
                    yield edge(key, int(min(docs[0], least_docs)))
                    if not enough[0]:
                        yield from marked(rows.slice(0, int(size[0])), PENDING)
            yield from marked(rows.filter(pa.array(np.repeat(enough, size))), SURE)
            held, known = None, None
            if enough[-1]:
                known = (hi[-1], lo[-1])
            else:
                held = rows.slice(int(begin[-1])).combine_chunks()
        if held is not None:
            yield edge((held["hi"][0].as_py(), held["lo"][0].as_py()), len(set(held["doc_id"].to_pylist())))
            yield from marked(held, PENDING)
        elif known is not None:
            yield edge((int(known[0]), int(known[1])), least_docs)

    ranges = lines.repartitionByRange("hi", "lo", "doc_id").sortWithinPartitions("hi", "lo", "doc_id", "text_hash", "pos")
    streamed = store(ranges.mapInArrow(run, "hi long, lo long, doc_id long, text_hash long, pos int, docs int"), "repeated-lines")
    where = ["doc_id", "text_hash", "pos"]
    total = streamed.where("pos = -1").groupBy("hi", "lo").agg(F.sum("docs").alias("total")).where(F.col("total") >= least_docs)
    late = streamed.where(F.col("docs") == PENDING).join(total, ["hi", "lo"]).select(*where)
    return streamed.where(F.col("docs") == SURE).where("pos >= 0").select(*where).union(late)


def pack_keep(places: np.ndarray) -> bytes:
    """Compressed bits of the lines up to the last dropped one: 1 keeps."""
    keep = np.ones(int(places.max()) + 1, np.uint8)
    keep[places] = 0
    return len(keep).to_bytes(4, "little") + zlib.compress(np.packbits(keep).tobytes(), 6)


def unpack_keep(packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(packed[4:]), np.uint8))[: int.from_bytes(packed[:4], "little")].astype(bool)


def keep_bitmaps(docs: DataFrame, least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """(doc_id, text_hash, n_dropped, keep) of every document that loses lines; no text is moved.

    A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lower-cased. Keys of ``least_chars`` code
    points or more that ``least_docs`` documents hold lose all their lines. ``keep`` (``unpack_keep``) holds a bit for
    each line up to the last dropped one; lines beyond are kept.

    A document is a doc_id: repeated rows and rows that share an id count once, a null id is one document; rows of
    one id with different texts have a bitmap each, told apart by ``text_hash``. A null or empty text is one empty
    line and never dropped. Extra columns are ignored; an empty table gives no rows.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [np.asarray(p, np.int64) for p in batch.column("places").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(p) for p in places], pa.int64()),
                 pa.array([pack_keep(p) for p in places], pa.binary())],
                ["doc_id", "text_hash", "n_dropped", "keep"],
            )

    gone = stream_ranges(line_hashes(docs, least_chars), least_docs)
    places = gone.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("places"))
    return places.mapInArrow(pack, "doc_id long, text_hash long, n_dropped long, keep binary")


def drop_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of every row of ``docs``: its lines that the bitmap keeps, joined by \\n.

    Each row of ``docs`` gives one row, repeated ones too. A text whose lines all go is empty.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, counts = [], []
            for raw, packed in zip(_bytes_of(batch.column("text")), batch.column("keep").to_pylist()):
                lines = raw.split(b"\n")
                counts.append(len(lines))
                if packed is not None:
                    keep = unpack_keep(packed)
                    raw = b"\n".join([line for line, stays in zip(lines, keep) if stays] + lines[len(keep) :])
                kept.append(raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), batch.column("n_dropped"), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept"],
            )

    texts = docs.select(F.col("doc_id").cast("long"), "text", text_hash().alias("text_hash")).alias("d")
    found = bitmaps.alias("b")
    same = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("d.text_hash") == F.col("b.text_hash"))
    joined = texts.join(found, same, "left").select("d.doc_id", "d.text", F.coalesce("b.n_dropped", F.lit(0)).alias("n_dropped"), "b.keep")
    return joined.mapInArrow(cut, "doc_id long, n_lines long, n_dropped long, kept string")


def drop_repeated_lines(docs: DataFrame, least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """Documents without the lines that ``least_docs`` documents share; see ``keep_bitmaps`` and ``drop_lines``."""
    return drop_lines(docs, keep_bitmaps(docs, least_docs, least_chars))
