"""Removal of repeated 50-byte strings: suffix arrays of candidate regions, common prefixes, merging by binary search.

Three steps, each a Spark shuffle on its own key:

1. Every 50-byte window names its smallest 24-byte hash. Windows next to each other mostly name the same one, so a
   document becomes runs of windows. Equal windows name equal hashes, therefore a window that occurs in two
   documents lies in runs with the same mark. Marks that only one document has are dropped.
2. Of the strings of the remaining runs, one copy of each is gathered by mark, under its smallest doc_id; it stands for
   the other copies, which go as a whole. The strings are cut into shards in the order of their marks; each
   shard gets a suffix array and its common prefixes, which give the groups of equal windows and the smallest
   doc_id of each. Shards that share a mark are merged by binary search in each other's sorted windows.
   A mark with many strings in one piece of the table (the edge of a passage that many documents share) is crowded:
   its strings are dealt over all shards by their hash. What the shards of crowded marks cannot decide, their
   windows without a smaller doc_id of their own, meets in one more shuffle, dealt by window.
3. Each run learns which of its windows occur under a smaller doc_id, and the documents are cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.llm.shared import PIECE_BYTES, SpanHasher, mix64, pieces, texts_of

WINDOW = 50
GRAM = 24
LONGEST_RUN = 64  # windows of a run, so that they fit the bits of a long
BUCKET_BYTES = 8 << 20  # text bytes whose marks meet in one group
SHARD_BYTES = 2 << 20  # bytes of one suffix array
CROWDED = 16  # strings of a mark in one piece, from which they are dealt over all shards


# --- runs of windows ---------------------------------------------------------------------------------------------


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring values, from minima of doubling widths."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


def window_runs(data: np.ndarray, ends: np.ndarray, hasher: SpanHasher) -> tuple[np.ndarray, ...]:
    """First window, number of windows, text number and mark of every run, and the running sums of the hasher."""
    sums = hasher.sums(data)
    if len(data) < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64), sums
    grams = sums[GRAM:] - sums[:-GRAM]
    grams *= hasher.inverse[: len(grams)]
    grams ^= grams >> np.uint64(32)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    least = sliding_min(grams, WINDOW - GRAM + 1)
    inside = np.ones(len(data), bool)
    size = np.diff(ends)
    tail = np.minimum(size, WINDOW - 1)
    inside[np.repeat(ends[1:] - tail, tail) + np.arange(tail.sum()) - np.repeat(np.cumsum(tail) - tail, tail)] = False
    inside = inside[: len(least)]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    begin, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    marks = mix64(least[begin] + np.uint64(1))
    parts = -(-(stop - begin) // LONGEST_RUN)
    step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin, stop, marks = np.repeat(begin, parts) + step * LONGEST_RUN, np.repeat(stop, parts), np.repeat(marks, parts)
    return begin, np.minimum(LONGEST_RUN, stop - begin), np.searchsorted(ends, begin, "right") - 1, marks, sums


def bucket_of(marks: np.ndarray, buckets: int) -> np.ndarray:
    return ((marks >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def by_key(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by ``key``, the start of each group in it and its end."""
    order = np.argsort(key, kind="stable")
    head = np.flatnonzero(np.append(True, np.diff(key[order]) != 0)) if len(key) else np.zeros(0, np.int64)
    return order, head, np.append(head[1:], len(key)) if len(key) else head


# --- suffix arrays -----------------------------------------------------------------------------------------------


def suffix_array(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sorted suffixes of all strings, each ending with its string; equal ones by position.

    Larsson and Sadakane: suffixes are sorted by 8 bytes, then by twice as many each time, using the ranks so far
    of what follows; only groups that are not yet sorted are looked at again.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    left = np.repeat(ends[1:], np.diff(ends)) - np.arange(n)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.ndarray(n, ">u8", padded, strides=(1,)).astype(np.uint64)
    # Bytes of value 0 and the end of a string are told apart by what is left.
    short = np.minimum(left, 8)
    key &= np.uint64(2**64 - 1) << ((8 - short) * 8 % 64).astype(np.uint64)
    order = np.argsort(key)
    new = np.append(True, np.diff(key[order]) != 0)
    number = np.flatnonzero(new)[np.cumsum(new) - 1] + 1
    slots = _open_slots(new)
    tied = order[slots][np.argsort(number[slots] * 9 + short[order[slots]])]
    order[slots] = tied
    new[slots] |= np.append(True, np.diff(short[tied]) != 0)[: len(tied)]
    rank = np.empty(n + 1, np.int64)
    rank[n] = 0
    number = np.flatnonzero(new)[np.cumsum(new) - 1] + 1
    rank[order] = number
    depth, longest = 8, int(np.diff(ends).max())
    while depth < longest and len(slots := _open_slots(new)):
        here = order[slots]
        follows = np.where(left[here] > depth, rank[np.minimum(here + depth, n)], 0)
        again = np.argsort(number[slots] * (n + 2) + follows)
        order[slots] = here[again]
        follows = follows[again]
        new[slots] |= np.append(True, (np.diff(number[slots]) != 0) | (np.diff(follows) != 0))
        number = np.flatnonzero(new)[np.cumsum(new) - 1] + 1
        rank[order] = number
        depth *= 2
    slots = _open_slots(new)
    order[slots] = order[slots][np.argsort(number[slots] * (n + 1) + order[slots])]
    return order


def _open_slots(new: np.ndarray) -> np.ndarray:
    """Slots of groups with more than one suffix; ``new`` is true where a group begins."""
    size = np.diff(np.append(np.flatnonzero(new), len(new)))
    return np.flatnonzero(np.repeat(size > 1, size))


def common_prefixes(data: np.ndarray, ends: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each suffix of ``order`` shares with the one before it.

    Kasai: going from a suffix to the one that starts a byte later, at most one shared byte is lost. All
    strings are walked side by side.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    left = np.repeat(ends[1:], np.diff(ends)) - np.arange(n)
    out = np.zeros(n, np.int64)
    start, size = ends[:-1], np.diff(ends)
    by_size = np.argsort(-size, kind="stable")
    start, size = start[by_size], size[by_size]
    shared = np.zeros(len(start), np.int64)
    for step in range(int(size[0]) if len(size) else 0):
        m = int(np.searchsorted(-size, -step, "left"))
        here = start[:m] + step
        other = before[here]
        now = np.where(other < 0, 0, np.maximum(shared[:m] - 1, 0))
        most = np.where(other < 0, 0, np.minimum(left[here], left[other]))
        going = np.flatnonzero(now < most)
        while len(going):
            same = data[here[going] + now[going]] == data[other[going] + now[going]]
            going = going[same]
            now[going] += 1
            going = going[now[going] < most[going]]
        shared[:m] = now
        out[here] = now
    return out[order]


def window_words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The windows at ``at`` as rows of big-endian words that sort as their bytes do."""
    rows = data[at[:, None] + np.arange(WINDOW)]
    wide = np.zeros((len(at), -(-WINDOW // 8) * 8), np.uint8)
    wide[:, :WINDOW] = rows
    return wide.view(">u8").astype(np.uint64)


def find_rows(table: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Row of the sorted ``table`` that equals each row of ``wanted``, or -1: binary search."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(table), np.int64)
    while (open_ := low < high).any():
        middle = (low + high) // 2
        rows = table[np.minimum(middle, len(table) - 1)]
        less, equal = np.zeros(len(wanted), bool), np.ones(len(wanted), bool)
        for c in range(table.shape[1]):
            less |= equal & (rows[:, c] < wanted[:, c])
            equal &= rows[:, c] == wanted[:, c]
        low, high = np.where(open_ & less, middle + 1, low), np.where(open_ & ~less, middle, high)
    found = np.minimum(low, len(table) - 1)
    return np.where((table[found] == wanted).all(axis=1), found, -1) if len(table) else np.full(len(wanted), -1)


def smallest_owner(
    data: np.ndarray, ends: np.ndarray, owner: np.ndarray, marks: np.ndarray, shard_bytes: int = SHARD_BYTES
) -> np.ndarray:
    """For every window start, the smallest owner of a string that has an equal window; other bytes get no meaning.

    Strings come in the order of ``marks``; equal windows are in strings of equal marks. A shard ends between two
    marks, unless one mark alone has more than ``shard_bytes``.
    """
    out = np.full(len(data), np.iinfo(np.int64).max)
    shards: list[list] = []
    begin = 0
    while begin < len(owner):
        stop = max(begin + 1, int(np.searchsorted(ends, ends[begin] + shard_bytes, "right")) - 1)
        if stop < len(owner) and marks[stop] == marks[stop - 1]:
            cut = int(np.searchsorted(marks, marks[stop], "left"))
            stop = cut if cut > begin else stop
        part, base = data[ends[begin] : ends[stop]], ends[begin]
        own_ends = ends[begin : stop + 1] - base
        order = suffix_array(part, own_ends)
        shared = common_prefixes(part, own_ends, order)
        text = np.repeat(np.arange(stop - begin), np.diff(own_ends))
        full = own_ends[1:][text[order]] - order >= WINDOW
        # Suffixes between two equal windows share them, so groups are not interrupted.
        group = np.cumsum(shared < WINDOW)[full]
        at = order[full]
        if len(at):
            head = np.flatnonzero(np.append(True, np.diff(group) != 0))
            least = np.minimum.reduceat(owner[begin:stop][text[at]], head)
            new = [at + base, np.repeat(np.arange(len(head)), np.diff(np.append(head, len(at)))), least, at[head] + base, marks[begin]]
            if shards and shards[-1][4] != marks[begin]:
                _merge(data, shards, out)
                shards = []
            shards.append(new)
            if marks[stop - 1] != marks[begin]:
                _merge(data, shards, out)
                shards = []
        begin = stop
    _merge(data, shards, out)
    return out


def _merge(data: np.ndarray, shards: list[list], out: np.ndarray) -> None:
    """Shards of one mark learn the smallest owners of each other's windows; the result goes to ``out``."""
    words = [window_words(data, shard[3]) for shard in shards] if len(shards) > 1 else []
    # Shards before i agree already, so that after i is compared with each of them all agree.
    for i, one in enumerate(shards):
        for j in range(i):
            found = find_rows(words[j], words[i])
            rows = np.flatnonzero(found >= 0)
            least = np.minimum(one[2][rows], shards[j][2][found[rows]])
            one[2][rows] = least
            shards[j][2][found[rows]] = least
    for at, group, least, _, _ in shards:
        out[at] = least[group]


# --- the three steps ---------------------------------------------------------------------------------------------

MARKED = "bucket int, doc_ids array<long>, counts array<int>, marks binary"
FLAGGED = "doc_id long, id long"
ASKED = "bucket int, doc_ids array<long>, hashes array<long>"
ANSWERED = "doc_id long, hash long, first boolean"
STRINGS = "bucket int, doc_ids array<long>, hashes array<long>, marks array<long>, lengths array<int>, strings binary, crowded array<long>"
PARTS = "bucket int, doc_ids array<long>, hashes array<long>, masks array<long>, marks array<long>, windows array<long>"
MASKS = "doc_id long, hash long, mask long"


def _mark_rows(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Marks of each piece by bucket. A mark that two documents of the piece share needs no answer: its documents
        are flagged at once (rows of bucket numbers above), and one of them stands for all."""
        hasher = SpanHasher()
        for batch in pieces(batches, "text"):
            data, ends = texts_of(batch.column(1))
            _, _, text, marks, _ = window_runs(data, ends, hasher)
            if not len(marks):
                continue
            doc_ids = batch.column(0).to_numpy()
            bucket = bucket_of(marks, buckets)
            ids = (bucket << 32) | (marks & np.uint64(0xFFFFFFFF)).astype(np.int64)
            order = np.lexsort((doc_ids[text], ids))
            ids, docs = ids[order], doc_ids[text[order]]
            once = np.append(True, (np.diff(ids) != 0) | (np.diff(docs) != 0))
            ids, docs = ids[once], docs[once]
            lead = np.append(True, np.diff(ids) != 0)
            several = np.diff(np.append(np.flatnonzero(lead), len(ids))) > 1
            shared = np.repeat(several, np.diff(np.append(np.flatnonzero(lead), len(ids))))
            for keep, local in ((lead, False), (shared, True)):
                some, of = ids[keep], docs[keep]
                key = some >> 32 if not local else np.full(len(some), buckets + int(marks[0] % np.uint64(buckets)))
                perm = np.lexsort((of, key))
                some, of, key = some[perm], of[perm], key[perm]
                heads = np.flatnonzero(np.append(True, np.diff(key) != 0)) if len(key) else []
                for a, b in zip(heads, [*heads[1:], len(key)]):
                    new = np.flatnonzero(np.append(True, np.diff(of[a:b]) != 0))
                    raw = some[a:b].astype("<i8") if local else (some[a:b] & 0xFFFFFFFF).astype("<u4")
                    yield pa.record_batch([
                        pa.array([int(key[a])], pa.int32()), pa.array([of[a:b][new]], pa.list_(pa.int64())),
                        pa.array([np.diff(np.append(new, b - a)).astype(np.int32)], pa.list_(pa.int32())), pa.array([raw.tobytes()], pa.binary()),
                    ], names=["bucket", "doc_ids", "counts", "marks"])

    return run


def _flag_rows(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """Marks of one bucket that two documents have, by document."""
        bucket = table.column("bucket")[0].as_py()
        local = bucket >= buckets
        raw = b"".join(v.as_py() for v in table.column("marks"))
        marks = np.frombuffer(raw, "<i8" if local else "<u4").astype(np.int64)
        docs = np.repeat(
            np.concatenate([v.values.to_numpy() for v in table.column("doc_ids")]), np.concatenate([v.values.to_numpy() for v in table.column("counts")])
        )
        if not local:
            order, head, end = by_key(marks)
            marks, docs = marks[order], docs[order]
            apart = np.minimum.reduceat(docs, head) < np.maximum.reduceat(docs, head)
            keep = np.repeat(apart, end - head)
            marks, docs = marks[keep] | (bucket << 32), docs[keep]
        return pa.table({"doc_id": docs, "id": marks})

    return run


def _unpack(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    reader = zstandard.ZstdDecompressor()
    texts = [reader.decompress(b.as_py()) if b.is_valid else b"" for b in blobs]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), ends


def _chosen(column: pa.Array, doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Place in the column's flat lists of each value of its own row's list, or -1."""
    lengths = np.array([len(v) if v.is_valid else 0 for v in column], np.int64)
    flat = np.concatenate([v.values.to_numpy() for v in column if v.is_valid and len(v)] or [np.zeros(0, np.int64)])
    keys = mix64(flat.astype(np.uint64) + np.repeat(np.arange(len(column)), lengths).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    wanted = mix64(value.astype(np.uint64) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys[order], wanted), len(keys) - 1)
    return np.where(keys[order][at] == wanted, order[at], -1)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with packed texts, in batches whose texts have about ``PIECE_BYTES`` (column 2 holds their lengths)."""
    for batch in batches:
        size = np.cumsum(batch.column(2).to_numpy())
        start = 0
        while start < batch.num_rows:
            done = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, done + PIECE_BYTES, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _runs_of(batch: pa.RecordBatch, hasher: SpanHasher, buckets: int) -> tuple[np.ndarray, ...]:
    """Bytes, and first byte, end, text number, bucket, mark and string hash of every run of packed texts."""
    data, ends = _unpack(batch.column(1))
    start, count, text, marks, sums = window_runs(data, ends, hasher)
    stop = start + count + WINDOW - 1
    bucket = bucket_of(marks, buckets)
    return data, start, stop, text, bucket, (bucket << 32) | (marks & np.uint64(0xFFFFFFFF)).astype(np.int64), hasher.spans(sums, start, stop).astype(np.int64)


def _ask_rows(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes of the strings of flagged runs, dealt by hash, under the smallest doc_id of the piece. A string that comes
        again under a larger doc_id of the piece is known to go (rows of bucket numbers above)."""
        hasher = SpanHasher()
        for batch in _small(batches):
            batch = batch.filter(batch.column(3).is_valid())
            _, _, _, text, _, ids, hashes = _runs_of(batch, hasher, buckets)
            keep = np.flatnonzero(_chosen(batch.column(3), text, ids) >= 0)
            if not len(keep):
                continue
            docs, hashes = batch.column(0).to_numpy()[text[keep]], hashes[keep]
            order = np.lexsort((docs, hashes))
            docs, hashes = docs[order], hashes[order]
            bucket = bucket_of(hashes.view(np.uint64), buckets)
            lead = np.append(True, np.diff(hashes) != 0)
            smallest = docs[lead][np.cumsum(lead) - 1]
            key = np.where(lead, bucket, np.where(docs > smallest, buckets + hashes[0] % buckets, -1))
            order, head, end = by_key(key)
            for a, b in zip(head, end):
                if key[order[a]] >= 0:
                    some = order[a:b]
                    yield pa.record_batch([
                        pa.array([int(key[some[0]])], pa.int32()), pa.array([docs[some]], pa.list_(pa.int64())), pa.array([hashes[some]], pa.list_(pa.int64()))
                    ], names=["bucket", "doc_ids", "hashes"])

    return run


def _answer_rows(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """For each document and string, whether no document has it before; otherwise it goes as a whole."""
        docs = np.concatenate([v.values.to_numpy() for v in table.column("doc_ids")])
        hashes = np.concatenate([v.values.to_numpy() for v in table.column("hashes")])
        if table.column("bucket")[0].as_py() >= buckets:
            first = np.zeros(len(docs), bool)
        else:
            order = np.lexsort((docs, hashes))
            docs, hashes = docs[order], hashes[order]
            lead = np.append(True, np.diff(hashes) != 0)
            first = docs == docs[lead][np.cumsum(lead) - 1]
        return pa.table({"doc_id": docs, "hash": hashes, "first": first})

    return run


def _string_rows(buckets: int, crowded: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The strings that documents have first, by bucket. Those of marks that are crowded in this piece are dealt by
        their hash (bucket numbers above), and the mark's own bucket, where other pieces may send strings, is told."""
        hasher = SpanHasher()
        for batch in _small(batches):
            batch = batch.filter(batch.column(3).is_valid())
            data, start, stop, text, bucket, ids, hashes = _runs_of(batch, hasher, buckets)
            docs, raw = batch.column(0).to_numpy(), data.tobytes()
            keep = np.flatnonzero(_chosen(batch.column(3), text, hashes) >= 0)
            keep = keep[np.unique(hashes[keep], return_index=True)[1]]  # a document may hold a string twice
            _, of, count = np.unique(ids[keep], return_inverse=True, return_counts=True)
            many = count[of] >= crowded
            told = np.unique(ids[keep][many])
            key = np.where(many, buckets + bucket_of(hashes[keep].view(np.uint64), buckets), bucket[keep])
            key, keep = np.concatenate([key, told >> 32]), np.concatenate([keep, np.full(len(told), -1)])
            told = np.concatenate([np.full(len(many), -1), told])
            order, head, end = by_key(key)
            for a, b in zip(head, end):
                some = keep[order[a:b]]
                crowd = told[order[a:b]][some < 0]
                some = some[some >= 0]
                yield pa.record_batch([
                    pa.array([int(key[order[a]])], pa.int32()), pa.array([docs[text[some]]], pa.list_(pa.int64())),
                    pa.array([hashes[some]], pa.list_(pa.int64())), pa.array([ids[some]], pa.list_(pa.int64())),
                    pa.array([(stop - start)[some].astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([b"".join(raw[x:y] for x, y in zip(start[some].tolist(), stop[some].tolist()))], pa.binary()),
                    pa.array([crowd], pa.list_(pa.int64())),
                ], names=["bucket", "doc_ids", "hashes", "marks", "lengths", "strings", "crowded"])

    return run


def _flat(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [np.concatenate([v.values.to_numpy() for v in table.column(c)]) for c in names]


def _mask_rows(buckets: int, shard_bytes: int):
    def run(table: pa.Table) -> pa.Table:
        """Bits of the windows that occur under a smaller doc_id, for every string of one bucket, and the other windows
        of crowded marks: rows with a mark and the window's hash, by window, in the order of both."""
        docs, hashes, marks, length, crowd = _flat(table, "doc_ids", "hashes", "marks", "lengths", "crowded")
        length = length.astype(np.int64)
        data = np.frombuffer(b"".join(v.as_py() for v in table.column("strings")), np.uint8)
        begin = np.cumsum(length) - length
        order = np.lexsort((hashes, marks))
        order = order[np.append(True, np.diff(hashes[order]) != 0)[: len(order)]]  # rows of one doc_id may send a string twice
        asks = np.ones(len(order), bool) if table.column("bucket")[0].as_py() >= buckets else np.isin(marks[order], crowd)
        # The only string of its mark has no partner.
        apart = np.append(True, np.diff(marks[order]) != 0)[: len(order)]
        several = asks | ~(apart & np.append(apart[1:], True)[: len(order)])
        order, asks = order[several], asks[several]
        docs, hashes, marks, length, begin = docs[order], hashes[order], marks[order], length[order], begin[order]
        ends = np.concatenate([[0], np.cumsum(length)])
        data = data[np.repeat(begin - ends[:-1], length) + np.arange(ends[-1])]
        least = smallest_owner(data, ends, docs, marks, shard_bytes)
        windows = length - WINDOW + 1
        owner = np.repeat(np.arange(len(docs)), windows)
        bit = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = ends[owner] + bit
        gone = least[at] < docs[owner]
        bits = np.uint64(1) << bit.astype(np.uint64)
        masks = np.bitwise_or.reduceat(np.where(gone, bits, np.uint64(0)), np.cumsum(windows) - windows) if len(docs) else bits
        some = np.flatnonzero(masks)
        open_ = np.flatnonzero(asks[owner] & ~gone)
        hasher = SpanHasher()
        window = hasher.spans(hasher.sums(data), at[open_], at[open_] + WINDOW)
        key = np.concatenate([bucket_of(hashes[some].view(np.uint64), buckets), bucket_of(window, buckets)])
        nothing = np.zeros(len(some), np.int64)
        columns = [
            np.concatenate([docs[some], docs[owner[open_]]]), np.concatenate([hashes[some], hashes[owner[open_]]]),
            np.concatenate([masks[some], bits[open_]]).view(np.int64), np.concatenate([nothing - 1, marks[owner[open_]]]),
            np.concatenate([nothing, window.view(np.int64)]),
        ]
        order = np.lexsort((columns[4], columns[3], key))
        key = key[order]
        heads = np.flatnonzero(np.append(True, np.diff(key) != 0)[: len(key)])
        cuts = np.append(heads, len(key)).astype(np.int32)
        return pa.table(
            [pa.array(key[heads], pa.int32())] + [pa.ListArray.from_arrays(pa.array(cuts), pa.array(c[order], pa.int64())) for c in columns],
            names=["bucket", "doc_ids", "hashes", "masks", "marks", "windows"],
        )

    return run


def _merged_rows(table: pa.Table) -> pa.Table:
    """Masks as they are, and the bits of windows that another shard has under a smaller doc_id. Each shard's sorted
    windows are found by binary search in the sorted windows of all."""
    sent = [[v.values.to_numpy() for v in table.column(c)] for c in ("doc_ids", "hashes", "masks", "marks", "windows")]
    kind = np.dtype([("mark", "<i8"), ("window", "<i8")])
    shards = []
    for marks, windows in zip(sent[3], sent[4]):
        keys = np.empty(len(marks), kind)
        keys["mark"], keys["window"] = marks, windows
        shards.append(keys)
    known = np.concatenate(shards)
    order = np.lexsort((known["window"], known["mark"]))
    known = known[order]
    head = np.flatnonzero(np.append(True, known[1:] != known[:-1])[: len(known)])
    least = np.minimum.reduceat(np.concatenate(sent[0])[order], head) if len(head) else np.zeros(0, np.int64)
    place = [find_rows(_columns(known[head]), _columns(keys)) for keys in shards]
    docs, hashes, masks, marks = (np.concatenate(c) for c in sent[:4])
    some = (marks < 0) | (least[np.concatenate(place)] < docs) if len(docs) else np.zeros(0, bool)
    return pa.table({"doc_id": docs[some], "hash": hashes[some], "mask": masks[some]})


def _columns(keys: np.ndarray) -> np.ndarray:
    return np.stack([keys["mark"], keys["window"]], axis=1)


def _all_bits(hashes: pa.Array, masks: pa.Array) -> np.ndarray:
    """The flat masks, each with the bits of all masks that its row has for the same hash."""
    rows = np.repeat(np.arange(len(hashes)), [len(v) if v.is_valid else 0 for v in hashes])
    flat, bits = (np.concatenate([v.values.to_numpy() for v in c if v.is_valid and len(v)] or [np.zeros(0, np.int64)]) for c in (hashes, masks))
    if not len(flat):
        return bits.view(np.uint64)
    order = np.lexsort((flat, rows))
    new = np.append(True, (np.diff(flat[order]) != 0) | (np.diff(rows[order]) != 0))
    out = np.empty(len(flat), np.uint64)
    out[order] = np.bitwise_or.reduceat(bits.view(np.uint64)[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    return out


def removed_bytes(data: np.ndarray, ends: np.ndarray, hashes: pa.Array, masks: pa.Array, hasher: SpanHasher) -> np.ndarray:
    """True for every byte that a repeated window covers."""
    start, count, text, _, sums = window_runs(data, ends, hasher)
    own = hasher.spans(sums, start, start + count + WINDOW - 1).astype(np.int64)
    at = _chosen(hashes, text, own)
    hit = np.flatnonzero(at >= 0)
    flat = _all_bits(hashes, masks)
    windows = count[hit]
    owner = np.repeat(np.arange(len(hit)), windows)
    bit = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    gone = (flat[at[hit]][owner] >> bit.astype(np.uint64)) & np.uint64(1) > 0
    at = start[hit][owner[gone]] + bit[gone]
    cover = np.zeros(len(data) + 1, np.int32)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return np.cumsum(cover)[:-1] > 0


def _packed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for batch in pieces(batches, "text"):
            data, ends = texts_of(batch.column(1))
            raw = data.tobytes()
            blobs = [writer.compress(raw[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.record_batch([batch.column(0), pa.array(blobs, pa.binary()), pa.array(np.diff(ends))], names=["doc_id", "blob", "size"])

    return docs.mapInArrow(run, "doc_id long, blob binary, size long")


def with_masks(
    docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, shard_bytes: int = SHARD_BYTES, crowded: int = CROWDED
) -> DataFrame:
    """``doc_id, blob, size, hashes, masks``: packed texts, and bits of windows to remove by the hash of their run's string."""
    packed = _packed(docs)
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))

    def with_lists(rows: DataFrame, **columns: str) -> DataFrame:
        """All packed texts with the lists of their doc_id. The same join each time, so that texts are dealt once."""
        per_doc = rows.groupBy("doc_id").agg(*[F.collect_list(c).alias(name) for name, c in columns.items()])
        return packed.join(per_doc, "doc_id", "left").select("doc_id", "blob", "size", *columns)

    flagged = known.mapInArrow(_mark_rows(buckets), MARKED).groupBy("bucket").applyInArrow(_flag_rows(buckets), FLAGGED)
    asked = with_lists(flagged, ids="id").mapInArrow(_ask_rows(buckets), ASKED)
    answers = asked.groupBy("bucket").applyInArrow(_answer_rows(buckets), ANSWERED)
    strings = with_lists(answers.where("first"), first="hash").mapInArrow(_string_rows(buckets, crowded), STRINGS)
    parts = strings.groupBy("bucket").applyInArrow(_mask_rows(buckets, shard_bytes), PARTS)
    masks = parts.groupBy("bucket").applyInArrow(_merged_rows, MASKS)
    gone = answers.where("not first").select("doc_id", "hash", F.lit(-1).cast("long").alias("mask"))
    return with_lists(masks.unionByName(gone), hashes="hash", masks="mask")


def dedup(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, shard_bytes: int = SHARD_BYTES, crowded: int = CROWDED) -> DataFrame:
    """``doc_id, kept, n_bytes, n_removed, n_spans`` of every row; ``kept`` are the remaining bytes.

    A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id; strings are
    judged on the input, bytes are those of UTF-8, matches never cross documents. Null texts are empty. A row
    without doc_id keeps everything and removes nothing elsewhere. Rows with equal doc_ids remove nothing from
    each other. Extra columns are ignored, an empty table gives an empty table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for batch in _small(batches):
            data, ends = _unpack(batch.column(1))
            gone = removed_bytes(data, ends, batch.column(3), batch.column(4), hasher)
            first = gone.copy()
            first[1:] &= ~gone[:-1]
            heads = ends[:-1][ends[1:] > ends[:-1]]
            first[heads] = gone[heads]
            kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(ends[:-1], ends[1:])]
            size = np.diff(ends)
            total, spans = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(first)])
            yield pa.record_batch([
                batch.column(0), pa.array(kept, pa.binary()), pa.array(size), pa.array(np.diff(total[ends])), pa.array(np.diff(spans[ends]))
            ], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return with_masks(rows, bucket_bytes, shard_bytes, crowded).mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
