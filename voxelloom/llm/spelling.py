"""Spelling variants: words one code point apart, found in tries of letter counts.

A word is the vector of its counts of 32 letter groups. One replaced code point moves a count from one group to
another, one inserted code point adds to one group, so a word's neighbours lie within a surplus of one and a
deficit of one. The trie's root level is the length and its next levels are the three most frequent letters: these
nodes are Spark's groups. A word is sent to the nodes its budget reaches; inside a node the trie goes on over the
other letter groups, and the words of a leaf are compared letter by letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.llm.shared import pieces, store
from voxelloom.session import broadcast_if_small

# Letters from frequent to rare; the first three are levels of Spark's groups.
LETTERS = "etaoinshrldcumfpgwybvkxjqz"
ROOT_LEVELS = 3
GROUPS = 32  # one for each letter, the rest of Latin-1 over the other six
NODE = ["len", "c0", "c1", "c2"]
BLOCK_WORDS = 20_000  # words of a node that meet in one task, and as many times TRAVELLERS that visit it
TRAVELLERS = 8
HELD_WORDS = 300_000  # distinct words that a counting task holds before it hands them on
AT_ONCE = 1 << 22  # bytes that one comparison step takes

_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")  # UTF-8 of [a-zÀ-ÿ]


def _group_table() -> np.ndarray:
    """Letter group of every Latin-1 code point."""
    table = np.arange(256, dtype=np.int64) % (GROUPS - len(LETTERS)) + len(LETTERS)
    for group, letter in enumerate(LETTERS):
        table[ord(letter)] = group
    return table


def word_counts(docs: DataFrame, least_letters: int = 5, least_count: int = 3, typo_every: int | None = None) -> DataFrame:
    """(word, n): the runs ``[A-Za-z\\u00C0-\\u00FF]+`` of all texts, A-Z lower-cased, of ``least_letters`` code points and
    ``least_count`` occurrences or more.

    ``typo_every`` plants mistakes first: where it divides h, the crc32 of ``<doc_id>:<run>``, the run loses its code
    point ``h % length``. A null text has no words, a null doc_id reads as nothing in h. Repeated rows count
    again. Extra columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in pieces(batches, "text"):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist()
            for doc_id, raw in zip(ids, texts):
                before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(_RUN.findall((raw or b"").lower())).items():
                    if len(word) < least_letters:
                        continue
                    if typo_every:
                        h = zlib.crc32(word, before)
                        if h % typo_every == 0:
                            letters = word.decode()
                            at = h % len(letters)
                            word = (letters[:at] + letters[at + 1 :]).encode()
                    if len(word) - word.count(b"\xc3") >= least_letters:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield told()
                    held.clear()
        if held:
            yield told()

    found = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def visits(words: DataFrame) -> DataFrame:
    """(len, c0, c1, c2, home, word, n): each word in its own node (``home``) and in the nodes it has to visit.

    A pair is found once: by its shorter word, or, if both are as long, by the word of the smaller node, and inside
    a node by the smaller word.
    """
    length = F.length("word").cast("int")
    counts = [(length - F.length(F.replace("word", F.lit(letter)))).cast("int") for letter in LETTERS[:ROOT_LEVELS]]

    def node(home: bool, longer: int, *change: int) -> Column:
        cells = [(F.col("len") + longer).alias("len")] + [(F.col(f"c{i}") + c).alias(f"c{i}") for i, c in enumerate(change)]
        return F.struct(*cells, F.lit(home).alias("home"))

    plus = [tuple(int(i == j) for j in range(ROOT_LEVELS)) for i in range(ROOT_LEVELS)]
    none = (0,) * ROOT_LEVELS
    # Same length: a surplus alone, or a surplus before the deficit; the other way round the partner does the visit.
    same = plus + [tuple(a - b for a, b in zip(plus[i], plus[j])) for i in range(ROOT_LEVELS) for j in range(i + 1, ROOT_LEVELS)]
    nodes = [node(True, 0, *none)] + [node(False, 0, *change) for change in same] + [node(False, 1, *change) for change in [none, *plus]]
    sized = words.select("word", "n", length.alias("len"), *[c.alias(f"c{i}") for i, c in enumerate(counts)])
    spread = sized.select("word", "n", F.explode(F.array(*nodes)).alias("node")).select("node.*", "word", "n")
    return spread.where(" AND ".join(f"c{i} >= 0" for i in range(ROOT_LEVELS)))


def split_nodes(spread: DataFrame) -> DataFrame:
    """Deal crowded nodes over blocks: ``a`` of its own words, ``b`` of its visitors; every visitor meets every word once."""
    home = F.col("home")
    crowd = spread.groupBy(*NODE).agg(F.sum(home.cast("long")).alias("words"), F.sum((~home).cast("long")).alias("visitors"))
    crowd = crowd.where("words > 0").select(
        *NODE, F.ceil(F.col("words") / BLOCK_WORDS).cast("int").alias("_a"),
        F.greatest(F.lit(1), F.ceil((F.col("words") + F.col("visitors")) / (BLOCK_WORDS * TRAVELLERS))).cast("int").alias("_b"),
    )
    own_a, own_b = F.pmod(F.xxhash64("word"), F.col("_a")).cast("int"), F.pmod(F.xxhash64(F.lit(1), "word"), F.col("_b")).cast("int")
    all_a, all_b = F.sequence(F.lit(0), F.col("_a") - 1), F.sequence(F.lit(0), F.col("_b") - 1)
    joined = spread.join(broadcast_if_small(store(crowd, "letter-nodes")), NODE)
    dealt = (
        # A home word is also a visitor of its own node, in every block of words but with one block of visitors.
        joined.withColumn("_ab", F.when(home, F.array_union(
            F.transform(all_b, lambda b: F.struct(own_a.alias("a"), b.alias("b"))), F.transform(all_a, lambda a: F.struct(a.alias("a"), own_b.alias("b")))
        )).otherwise(F.transform(all_a, lambda a: F.struct(a.alias("a"), own_b.alias("b")))))
        .withColumn("_at", F.explode("_ab"))
        .select(*NODE, F.col("_at.a").alias("a"), F.col("_at.b").alias("b"), "word", "n",
                (home & (F.col("_at.a") == own_a)).alias("resident"), (~home | (F.col("_at.b") == own_b)).alias("visitor"), "home")
    )
    return dealt.repartition(*NODE, "a", "b")  # a shuffled join has dealt by node alone, which would keep blocks together


def letter_vectors(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Counts of the letter groups below Spark's levels, one row a word; counts beyond 255 stay 255."""
    n = len(ends) - 1
    cells = np.repeat(np.arange(n) * GROUPS, np.diff(ends)) + _group_table()[data]
    return np.minimum(np.bincount(cells, minlength=n * GROUPS).reshape(n, GROUPS)[:, ROOT_LEVELS:], 255).astype(np.int16)


def search_trie(words: np.ndarray, seekers: np.ndarray, surplus: np.ndarray, deficit: np.ndarray, few: int = 256) -> Iterator[tuple[np.ndarray, int, int]]:
    """Leaves: seekers, and the run of words whose count vectors are within their budgets, by depth-first search.

    ``words`` must be sorted row by row; a trie node is a run of them. All seekers that reach a node go down together;
    each spends its ``surplus`` on a count one higher and its ``deficit`` on one that is one lower. A run of equal
    vectors is a leaf; a run with at most ``few`` pairs left is cut into leaves of one word.
    """
    levels = words.shape[1]
    stack = [(0, 0, len(words), np.arange(len(seekers)), surplus, deficit)]
    while stack:
        level, low, high, who, up, down = stack.pop()
        if not len(who) or low == high:
            continue
        alike = level == levels or (words[low, level:] == words[high - 1, level:]).all()
        if alike or len(who) * (high - low) <= few:
            rest = words[low : low + 1, level:] if alike else words[low:high, level:]
            gap = rest[None] - seekers[who, None, level:]
            fits = (np.maximum(gap, 0).sum(2) <= up[:, None]) & (np.maximum(-gap, 0).sum(2) <= down[:, None])
            for i in range(fits.shape[1]):
                if fits[:, i].any():
                    yield who[fits[:, i]], low + i, high if alike else low + i + 1
            continue
        column = words[low:high, level]
        begins = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
        mine = seekers[who, level]
        for at, stop in zip(begins, np.append(begins[1:], high - low)):
            gap = column[at] - mine
            more, less = gap == 1, gap == -1
            goes = (gap == 0) | (more & (up > 0)) | (less & (down > 0))
            stack.append((level + 1, low + at, low + stop, who[goes], (up - more)[goes], (down - less)[goes]))


def one_apart(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Do rows of equal letters differ by exactly one replaced letter, or, if ``long`` has one more, one inserted one?"""
    if short.shape[1] == long.shape[1]:
        return (short != long).sum(1) == 1
    lead = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(1)
    trail = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(1)
    return lead + trail >= short.shape[1]


def equal_rows(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of equal rows."""
    if not left.shape[1]:
        return np.repeat(np.arange(len(left)), len(right)), np.tile(np.arange(len(right)), len(left))
    kind = np.dtype((np.void, left.shape[1]))
    _, code = np.unique(np.concatenate([np.ascontiguousarray(left).view(kind), np.ascontiguousarray(right).view(kind)]), return_inverse=True)
    code = code.ravel()
    mine, theirs = code[: len(left)], code[len(left) :]
    order = np.argsort(theirs, kind="stable")
    begin, end = (np.searchsorted(theirs[order], mine, side) for side in ("left", "right"))
    count = end - begin
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(np.arange(len(left)), count), order[np.repeat(begin, count) + step]


def leaf_pairs(short: np.ndarray, long: np.ndarray, few: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a leaf that are one apart. In a leaf of more than ``few`` pairs only rows with an equal half are
    compared: one replaced or inserted letter leaves the half before or behind it as it is."""
    if len(short) * len(long) <= few:
        a, b = np.repeat(np.arange(len(short)), len(long)), np.tile(np.arange(len(long)), len(short))
    else:
        half = long.shape[1] // 2
        tail = half - (long.shape[1] - short.shape[1])
        a, b = equal_rows(short[:, :half], long[:, :half])
        c, d = equal_rows(short[:, tail:], long[:, half:])
        fresh = (short[c, :half] != long[d, :half]).any(1)
        a, b = np.concatenate([a, c[fresh]]), np.concatenate([b, d[fresh]])
    step = max(1, AT_ONCE // long.shape[1])
    good = [one_apart(short[a[at : at + step]], long[b[at : at + step]]) for at in range(0, len(a), step)]
    good = np.concatenate(good) if good else np.zeros(0, bool)
    return a[good], b[good]


def _near_in_node(table: pa.Table) -> pa.Table:
    """Of every word in a pair: its partners in this node, and the best of them (largest n, then smallest word)."""
    texts = [w.encode("latin-1") for w in table["word"].to_pylist()]
    n, resident, visitor = (table[c].to_numpy() for c in ("n", "resident", "visitor"))
    home = table["home"].to_numpy()
    size = np.array(list(map(len, texts)))
    length = int(table["len"][0].as_py())
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum(size))
    vectors = letter_vectors(data, ends)
    words = np.flatnonzero(resident)
    words = words[np.lexsort(vectors[words].T[::-1])]
    rows = lambda who, width: data[ends[who][:, None] + np.arange(width)]
    found = []
    for width, budget in ((length, 1), (length - 1, 0)):  # replaced, inserted
        who = np.flatnonzero(visitor & (size == width))
        if not len(who) or not len(words):
            continue
        # What Spark's levels spent of a visitor's budget, from its own counts of their letters.
        spent = _root_gaps(table, data, ends, who)
        up, down = 1 - np.maximum(spent, 0).sum(1), budget - np.maximum(-spent, 0).sum(1)
        for seekers, low, high in search_trie(vectors[words], vectors[who], up, down):
            p, q = who[seekers], words[low:high]
            a, b = leaf_pairs(rows(p, width), rows(q, length))
            found.append((p[a], q[b]))
    if not found:
        return PARTNERS.empty_table()
    a, b = (np.concatenate(x) for x in zip(*found))
    order = np.empty(len(texts), np.int64)
    order[sorted(range(len(texts)), key=texts.__getitem__)] = np.arange(len(texts))
    once = ~home[a] | (order[a] < order[b])  # two words of this node see each other twice
    a, b = a[once], b[once]
    me, other = np.concatenate([a, b]), np.concatenate([b, a])
    rank = np.lexsort((order[other], -n[other], me))
    me, other = me[rank], other[rank]
    first = np.flatnonzero(np.append(True, me[1:] != me[:-1])) if len(me) else np.zeros(0, np.int64)
    text = table["word"].combine_chunks()
    return pa.Table.from_arrays(
        [text.take(pa.array(me[first])), pa.array(np.diff(np.append(first, len(me)))), pa.array(n[other[first]]), text.take(pa.array(other[first]))],
        schema=PARTNERS,
    )


def _root_gaps(table: pa.Table, data: np.ndarray, ends: np.ndarray, who: np.ndarray) -> np.ndarray:
    """Counts of the root letters in this node less those in each visitor."""
    node = np.array([table[f"c{i}"][0].as_py() for i in range(ROOT_LEVELS)])
    own = []
    for letter in LETTERS[:ROOT_LEVELS]:
        sums = np.append(0, np.cumsum(data == ord(letter)))
        own.append(sums[ends[who + 1]] - sums[ends[who]])
    return node - np.stack(own, 1)


PARTNERS = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near) of every word of (word, n) that has words one code point away.

    ``near`` is the one of largest n (ties: smallest in code-point order). Words must be distinct and of Latin-1.
    """
    spread = split_nodes(visits(words))
    found = spread.groupBy(*NODE, "a", "b").applyInArrow(_near_in_node, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    whole = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return whole.select("word", "n_near", (-F.col("best.less")).alias("near_n"), "best.near")


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of each chain, by doubling jumps; written to the shared folder each round.

    A form occurs twice as often as its word, so chains have at most 60 steps and there are at most 7 rounds.
    """
    jumps = store(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = jumps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        jumped = store(jumps.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "forms")
        moved = jumped.where("moved").limit(1).count()
        jumps = jumped.drop("moved")
        if not moved:
            return jumps


def spelling_variants(words: DataFrame, share: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of (word, n).

    ``form`` is the most frequent word one code point away, if it occurs at least ``share`` (2 or more) times as often,
    else null. ``root`` follows forms to the last. Ties go to the smallest word in code-point order. An empty table
    gives no rows.
    """
    words = store(words.select("word", "n"), "words")
    near = near_words(words)
    likely = F.col("near_n") >= share * F.col("n")
    judged = store(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(likely, F.col("near")).alias("form"), F.when(likely, F.col("near_n")).alias("form_n")
        ),
        "near-words",
    )
    roots = last_forms(judged.where("form IS NOT NULL").select("word", "form"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
