"""Range coder for token ids whose probabilities mix order-0, order-1 and order-2 predictions of the next id.

A block lists its distinct ids; an id is coded as its rank among them. Order 0 counts every rank. Order 1 (the id
before) and order 2 (the two ids before) keep, per context, how often it was met and the ranks that followed it
most, with their counts; what these leave over goes to order 0, so every id of the block always has a share. The three
predictions are mixed; the weights follow how much each one contributed to the ids seen so far, by how often its
contexts were met. A block starts with empty counts. Its ids are cut into lanes that are coded side by side with shared
counts, each into a stream of its own, so one numpy step codes an id of every lane.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES = 6144
LEAST_PER_LANE = 128
SLOTS = (3, 1)  # following ranks kept per context of orders 1 and 2
HASHED_BITS = 18  # contexts of order 2, as a power of two
GAIN = 16  # what one occurrence adds to the order-0 count, which starts at 1
TOTAL_BITS = 30  # sum of all shares of a mix
LEAST_BITS, MOST_BITS = 18, 24  # sum of the order-0 shares, by the number of distinct ids
LEAST_BASE = (1 << MOST_BITS) + (1 << 12)  # order 0 keeps this much of a mix: no id falls to share 0
BUCKETS = 7  # contexts met 0, 1, 2-3, 4-7, 8-15, 16-31 times or more often share mixing weights
EVERY_STEP = 32  # so many steps at the beginning learn at once, later ones in turn:
LEARN_COUNTS, LEARN_WEIGHTS, LEARN_BASE = 4, 8, 16  # steps between updates of contexts' counts, mixing weights and order-0 shares
MASK48, LOW_LIMIT = np.uint64((1 << 48) - 1), np.uint64(1 << 32)
MAGIC = b"VXT3"
# CRC-32 of the ids, number of ids, lanes, distinct ids, bytes of their list, pairs, bytes of their list, number of symbols.
HEAD = struct.Struct("<IIIIIIII")
PAIRS, PAIRED_BITS = 8192, 17  # most pairs of a block; slots to look them up, as a power of two
SAMPLED_PAIRS, LEAST_PAIR = 1 << 17, 16  # places at which pairs are counted; occurrences (by that count) that pay for a pair
CHUNK_IDS = 1 << 17  # ids in which pairs are looked up at once


def _record(k: int) -> int:
    """Numbers of a context's record: following ranks, their counts, times met; filled up to a power of two."""
    return 1 << (2 * k).bit_length()


class Mixer:
    """Counts, mixing weights and the ranks before, of all lanes of one block.

    Ranks and counts stand as ``float32``, which holds whole numbers up to 2**24 exactly.
    """

    def __init__(self, lanes: int, alphabet: int) -> None:
        self.alphabet = alphabet
        self.bits = max(LEAST_BITS, min(alphabet.bit_length() + 2, MOST_BITS))
        self.count = np.ones(alphabet, np.int64)
        # Rank ``alphabet`` stands before a lane's first id.
        self.table = [np.zeros((n, _record(k)), np.float32) for n, k in zip((alphabet + 1, 1 << HASHED_BITS), SLOTS)]
        for table, k in zip(self.table, SLOTS):
            table[:, :k] = -1  # an empty slot is no rank
        self.credit = [np.full(BUCKETS * BUCKETS, start) for start in (1.0, 0.6, 0.4)]
        self._weigh()
        self.before = np.full(lanes, alphabet, np.int64)
        self.older = np.full(lanes, alphabet, np.uint32)
        self.steps = self.learned = 0

    def _weigh(self) -> None:
        total = self.credit[0] + self.credit[1] + self.credit[2]
        self.weight = [(credit / total).astype(np.float32) for credit in self.credit]

    def _due(self, every: int) -> bool:
        return self.steps <= EVERY_STEP or self.steps % every == 0

    def _refresh(self) -> None:
        running = np.concatenate([[0], np.cumsum(self.count)])
        room = (1 << self.bits) - self.alphabet
        self.base = running * room // int(running[-1]) + np.arange(self.alphabet + 1)
        self.rank_of: np.ndarray | None = None  # of every order-0 share; only decoding needs it

    def predict(self, m: int) -> None:
        """Shares of order 0 and of the kept ranks for the next id of the first ``m`` lanes."""
        self.steps += 1
        if self._due(LEARN_BASE):
            self._refresh()
        one = self.before[:m]
        mixed = one.astype(np.uint32) * np.uint32(0x9E3779B1) + self.older[:m] * np.uint32(0x85EBCA6B)
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE35)
        self.rows = (one, (mixed >> np.uint32(32 - HASHED_BITS)).astype(np.int64))
        n = sum(SLOTS)
        self.ranks, self.counts = np.empty((n, m), np.float32), np.empty((n, m), np.float32)
        self.met = []
        at = 0
        for table, rows, k in zip(self.table, self.rows, SLOTS):
            record = table.take(rows, axis=0)
            self.ranks[at : at + k] = record[:, :k].T
            self.counts[at : at + k] = record[:, k : 2 * k].T
            self.met.append(record[:, 2 * k] + np.float32(0.5))
            at += k
        # The exponent of a half more than the times met numbers the buckets.
        first, second = (np.minimum((met.view(np.int32) >> 23) - 126, BUCKETS - 1) for met in self.met)
        self.group = (first * BUCKETS + second).astype(np.int64)
        scale = np.float32((1 << TOTAL_BITS) - LEAST_BASE)
        self.shares = np.empty((n, m), np.int32)
        at = 0
        for weight, met, k in zip(self.weight[1:], self.met, SLOTS):
            self.shares[at : at + k] = self.counts[at : at + k] * (weight.take(self.group) * scale / met)
            at += k
        self.base_share = ((1 << TOTAL_BITS) - np.add.reduce(self.shares, axis=0, dtype=np.int32)).astype(np.int64)

    def interval(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First share and number of shares of each lane's rank."""
        narrow = rank.astype(np.float32)
        begin = (self.base_share * self.base.take(rank)) >> self.bits
        self.base_size = ((self.base_share * self.base.take(rank + 1)) >> self.bits) - begin
        self.same = self.ranks == narrow
        begin += np.add.reduce(self.shares * (self.ranks < narrow), axis=0, dtype=np.int32)
        size = self.base_size + np.add.reduce(self.shares * self.same, axis=0, dtype=np.int32)
        return begin.view(np.uint64), size.view(np.uint64)

    def rank_at(self, value: np.ndarray) -> np.ndarray:
        """The rank whose interval holds ``value``, the inverse of ``interval``.

        Kept ranks whose interval begins at or before the value are taken out of it; what is left is a place in the
        order-0 shares. It is at least the largest of those ranks, whose own shares may hold the value.
        """
        if self.rank_of is None:
            self.rank_of = np.repeat(np.arange(self.alphabet), np.diff(self.base))
        ranks = self.ranks.astype(np.int32)
        begin = ((self.base_share * self.base.take(ranks)) >> self.bits).astype(np.int32)
        smaller = np.empty_like(ranks)
        for rank, share in zip(ranks, self.shares):
            np.subtract(rank, ranks, out=smaller)
            smaller >>= 31  # all bits, if the rank is smaller
            smaller &= share
            begin += smaller
        passed = (begin <= value.astype(np.int32)) & (self.shares > 0)
        rest = np.maximum(value - np.add.reduce(self.shares * passed, axis=0, dtype=np.int32), 0)
        place = (((rest + 1) << self.bits) - 1) // self.base_share
        return np.maximum(self.rank_of.take(place), np.maximum.reduce(ranks * passed, axis=0))

    def update(self, rank: np.ndarray) -> None:
        """Learn the ranks of this step; lanes that meet in one record all count as met, the last one fills a slot."""
        m = len(rank)
        if self._due(LEARN_WEIGHTS):
            self._learn_weights()
        if self._due(LEARN_COUNTS):
            self._learn_counts(rank)
        self.older[:m] = self.before[:m]
        self.before[:m] = rank

    def _learn_counts(self, rank: np.ndarray) -> None:
        np.add.at(self.count, rank, GAIN)
        self.learned += 1
        at = 0
        for table, rows, k in zip(self.table, self.rows, SLOTS):
            flat, first = table.reshape(-1), rows * _record(k)
            np.add.at(flat, first + 2 * k, np.float32(1))
            for slot in range(k):
                lane = np.flatnonzero(self.same[at + slot])
                np.add.at(flat, first.take(lane) + (k + slot), np.float32(1))
            # A rank without a slot wears down the slots in turn and takes one that is worn out.
            new = np.flatnonzero(~np.logical_or.reduce(self.same[at : at + k]))
            place = first.take(new) + self.learned % k
            smaller = flat.take(place + k) - np.float32(1)
            flat[place + k] = np.maximum(smaller, np.float32(1))
            out = smaller <= 0
            flat[place[out]] = rank.take(new[out])
            at += k

    def _learn_weights(self) -> None:
        base = (self.base_size / self.base_share).astype(np.float32)
        told, at = [base * self.weight[0].take(self.group)], 0
        for weight, met, k in zip(self.weight[1:], self.met, SLOTS):
            counts = self.counts[at : at + k]
            share = (1 - np.add.reduce(counts, axis=0) / met) * base + np.add.reduce(counts * self.same[at : at + k], axis=0) / met
            told.append(share * weight.take(self.group))
            at += k
        total = 1 / (told[0] + told[1] + told[2])
        for credit, share in zip(self.credit, told):
            credit += np.bincount(self.group, share * total, len(credit))
        self._weigh()


def _lanes(n: int, lanes: int) -> tuple[int, int, np.ndarray]:
    """Number of lanes, ids per lane, and at each step the number of lanes that still have an id."""
    lanes = max(1, min(lanes, n // LEAST_PER_LANE))
    length = -(-n // lanes) if n else 0
    lanes = -(-n // length) if n else 0
    last = n - length * (lanes - 1)
    return lanes, length, np.where(np.arange(length) < last, lanes, lanes - 1)


def _encode_ranks(values: np.ndarray, alphabet: int, lanes: int, length: int, active: np.ndarray) -> bytes:
    """Words of each lane's stream, and the streams."""
    grid = np.zeros(lanes * length, np.int32)
    grid[: len(values)] = values
    grid = grid.reshape(lanes, length).T.copy()
    words = np.zeros((2 * length + 4, lanes), np.uint32)
    flat, used = words.reshape(-1), np.zeros(lanes, np.int64)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 1 << 48, np.uint64)
    model = Mixer(lanes, alphabet)
    for step in range(length):
        m = int(active[step])
        now = grid[step, :m].astype(np.int64)
        model.predict(m)
        begin, size = model.interval(now)
        unit = span[:m] >> np.uint64(TOTAL_BITS)
        low[:m] += unit * begin
        span[:m] = unit * size
        over = np.flatnonzero(low[:m] > MASK48)
        if len(over):  # carry into the last word of the stream
            flat[(used[over] - 1) * lanes + over] += np.uint32(1)
            low[over] &= MASK48
        short = np.flatnonzero(span[:m] < LOW_LIMIT)
        while len(short):
            top, row, left = low.take(short), used.take(short), span.take(short) << np.uint64(16)
            flat[row * lanes + short] = top >> np.uint64(32)
            used[short] = row + 1
            low[short] = (top << np.uint64(16)) & MASK48
            span[short] = left
            short = short[left < LOW_LIMIT]
        model.update(now)
    for shift in (32, 16, 0):
        flat[used * lanes + np.arange(lanes)] = ((low >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint32)
        used += 1
    for row in range(len(words) - 1, 0, -1):
        words[row - 1] += words[row] >> np.uint32(16)
        words[row] &= np.uint32(0xFFFF)
    inside = np.arange(len(words))[:, None] < used
    return used.astype("<u4").tobytes() + words.T[inside.T].astype("<u2").tobytes()


def _decode_ranks(body: bytes, at: int, n: int, alphabet: int, lanes: int, length: int, active: np.ndarray) -> np.ndarray:
    """The ranks that ``_encode_ranks`` wrote at ``at``."""
    used = np.frombuffer(body, "<u4", lanes, at).astype(np.int64)
    # Streams may be read past their end by a few words at the last ids.
    words = np.concatenate([np.frombuffer(body, "<u2", int(used.sum()), at + 4 * lanes), np.zeros(4, "<u2")]).astype(np.uint64)
    place_in = np.cumsum(used) - used
    code = np.zeros(lanes, np.uint64)
    for _ in range(3):
        code = (code << np.uint64(16)) | words[place_in]
        place_in += 1
    span = np.full(lanes, 1 << 48, np.uint64)
    grid = np.zeros((length, lanes), np.int32)
    model = Mixer(lanes, alphabet)
    for step in range(length):
        m = int(active[step])
        model.predict(m)
        unit = span[:m] >> np.uint64(TOTAL_BITS)
        now = model.rank_at(np.minimum((code[:m] // unit).astype(np.int64), (1 << TOTAL_BITS) - 1))
        begin, size = model.interval(now)
        code[:m] -= unit * begin
        span[:m] = unit * size
        short = np.flatnonzero(span[:m] < LOW_LIMIT)
        while len(short):
            place, left = place_in.take(short), span.take(short) << np.uint64(16)
            code[short] = (code.take(short) << np.uint64(16)) | words.take(place, mode="clip")
            place_in[short] = place + 1
            span[short] = left
            short = short[left < LOW_LIMIT]
        grid[step, :m] = now
        model.update(now)
    return grid.T.reshape(-1)[:n]


def _frequent_pairs(ranks: np.ndarray, alphabet: int) -> np.ndarray:
    """Neighbouring ranks that occur often, as first rank times ``alphabet`` plus the second one, ascending."""
    places = np.arange(0, max(len(ranks) - 1, 0), max(1, len(ranks) // SAMPLED_PAIRS))
    pairs, count = np.unique(ranks[places].astype(np.int64) * alphabet + ranks[places + 1], return_counts=True)
    often = np.flatnonzero(count >= max(2, LEAST_PAIR * len(places) // max(1, len(ranks))))
    most = min(PAIRS, (1 << (MOST_BITS - 1)) - alphabet)
    return pairs[np.sort(often[np.argsort(-count[often], kind="stable")[:most]])]


def _slot(pairs: np.ndarray) -> np.ndarray:
    return ((pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIRED_BITS)).view(np.int64)


def _join_pairs(ranks: np.ndarray, alphabet: int, pairs: np.ndarray) -> np.ndarray:
    """The ranks with each listed pair as one symbol, ``alphabet`` plus its place in the list; from left to right."""
    if not len(pairs):
        return ranks
    known, number = np.full(1 << PAIRED_BITS, -1, np.int64), np.zeros(1 << PAIRED_BITS, np.int32)
    slot = _slot(pairs)
    known[slot], number[slot] = pairs, np.arange(alphabet, alphabet + len(pairs))  # of pairs with one slot the last is used
    out = []
    for start in range(0, len(ranks), CHUNK_IDS):
        symbols = ranks[start : start + CHUNK_IDS].astype(np.int32)
        pair = symbols[:-1].astype(np.int64) * alphabet + symbols[1:]
        slot = _slot(pair)
        at = np.flatnonzero(known.take(slot) == pair)
        # Every second one of pairs that overlap in a row.
        place = np.arange(len(at))
        at = at[((place - np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, place, 0))) & 1) == 0]
        symbols[at] = number.take(slot.take(at))
        alone = np.ones(len(symbols), bool)
        alone[at + 1] = False
        out.append(symbols[alone])
    return np.concatenate(out)


def encode(ids: np.ndarray, lanes: int = LANES) -> bytes:
    """A self-contained block: head, distinct ids, pairs, streams, and a checksum of all of it. Ids are 32-bit."""
    ids = np.ascontiguousarray(ids, np.uint32)
    if len(ids) and ids.max() < 1 << 20:  # ids of a vocabulary: counted, not sorted
        present = np.bincount(ids) > 0
        distinct, ranks = np.flatnonzero(present).astype(np.uint32), (np.cumsum(present, dtype=np.int32) - 1)[ids]
    else:
        distinct, ranks = np.unique(ids, return_inverse=True)
    alphabet = len(distinct)
    if alphabet > 1 << (MOST_BITS - 1):
        raise ValueError("more distinct ids than a block can hold: use smaller blocks")
    pairs = _frequent_pairs(ranks, alphabet)
    symbols = _join_pairs(ranks, alphabet, pairs)
    lanes, length, active = _lanes(len(symbols), lanes)
    listed = zlib.compress(np.diff(distinct, prepend=np.uint32(0)).astype("<u4").tobytes())
    paired = zlib.compress(np.diff(pairs, prepend=np.int64(0)).astype("<u8").tobytes())
    head = HEAD.pack(zlib.crc32(ids.astype("<u4").tobytes()), len(ids), lanes, alphabet, len(listed), len(pairs), len(paired), len(symbols))
    body = MAGIC + head + listed + paired
    if len(ids):
        body += _encode_ranks(symbols, alphabet + len(pairs), lanes, length, active)
    return body + struct.pack("<I", zlib.crc32(body))


def decode(block: bytes) -> np.ndarray:
    """The ids of a block as ``uint32``; a damaged block raises ``ValueError``."""
    body = block[:-4]
    if len(block) < 8 + HEAD.size or block[:4] != MAGIC or struct.unpack("<I", block[-4:])[0] != zlib.crc32(body):
        raise ValueError("damaged token block")
    check, n, lanes, alphabet, size, n_pairs, pairs_size, n_symbols = HEAD.unpack_from(body, 4)
    at = 4 + HEAD.size + size
    ids = np.zeros(n, np.uint32)
    if n:
        distinct = np.cumsum(np.frombuffer(zlib.decompress(body[at - size : at]), "<u4"), dtype=np.uint32)
        pairs = np.cumsum(np.frombuffer(zlib.decompress(body[at : at + pairs_size]), "<u8"), dtype=np.uint64).astype(np.int64)
        symbols = _decode_ranks(body, at + pairs_size, n_symbols, alphabet + n_pairs, *_lanes(n_symbols, lanes))
        paired = symbols >= alphabet
        place = np.arange(n_symbols) + (np.cumsum(paired) - paired)
        ids[place] = np.concatenate([distinct, distinct[pairs // alphabet]]).take(symbols)
        ids[place[paired] + 1] = distinct[pairs % alphabet].take(symbols[paired] - alphabet)
    if zlib.crc32(ids.astype("<u4").tobytes()) != check:
        raise ValueError("damaged token block")
    return ids
