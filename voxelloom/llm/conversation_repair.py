"""Conversation repair: the cheapest edits that give turns a legal order, by tables of symbol blocks.

A turn is one symbol (initial of its role, blank, repeated, truncated). The cost of repairing a conversation from some
turn on depends on what is legal next, which is one of four states; the vector of the four costs, less its smallest,
takes few values. Tables hold, for every such vector and every block of ``BLOCK`` symbols, the vector in front of the block
and the cost it adds, so a conversation is costed from its end by one lookup a block. The vectors at block borders are
kept; tracing goes forward and works out the vectors inside a block when it gets there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.llm.shared import store

SPACES = " \t\n\x0b\x0c\r"
# Costs and states. States: nothing yet, after the system turn, after a user turn, after an assistant turn.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
NEXT = (2, 2, 3, 2)  # the state that a user or assistant turn leads to
ROLE = ("", "", "user", "assistant")  # the role that leads to a state
ENDS = (0, None, None, 0)  # a conversation may end before any turn or after an assistant
FAR = 1 << 20
# Symbols: 0-3 other, system, user, assistant; +4 if truncated; 8 has to go.
SYMBOLS, GONE = 9, 8
BLOCK = 3
# Bits of a turn's byte.
ROLE_BITS, BLANK, REPEATED, TRUNCATED, DROPPED = 3, 4, 8, 16, 32


def moves(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of what may be done with a turn in a state, by edit."""
    out = [("D", DELETE, state)]
    if symbol != GONE:
        role, cut = symbol % 4, CUT * (symbol // 4)
        if (role == 1 and state == 0) or (role in (2, 3) and NEXT[state] == role):
            out.append(("K", KEEP + cut, role))
        out.append(("R", REROLE + cut, NEXT[state]))
    return out


def _with_inserts(costs: list[int]) -> list[int]:
    """Costs when turns may be inserted first; three in a row reach every state."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[NEXT[s]]) for s, c in enumerate(costs)]
    return costs


def step_back(symbol: int, costs: list[int]) -> list[int]:
    """Costs in front of a turn from the costs behind it."""
    return _with_inserts([min(cost + costs[to] for _, cost, to in moves(symbol, s)) for s in range(4)])


def end_costs() -> list[int]:
    return _with_inserts([FAR if e is None else e for e in ENDS])


@lru_cache(maxsize=1)
def block_tables() -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """All vectors, and for (vector, block) the vector in front of the block and the cost it adds."""
    vectors, number, todo = [], {}, []

    def norm(costs: list[int]) -> tuple[int, int]:
        low = min(costs)
        key = tuple(c - low for c in costs)
        if key not in number:
            number[key] = len(vectors)
            vectors.append(key)
            todo.append(key)
        return number[key], low

    norm(end_costs())
    one: dict[tuple[int, int], tuple[int, int]] = {}
    while todo:
        key = todo.pop()
        for symbol in range(SYMBOLS):
            one[number[key], symbol] = norm(step_back(symbol, list(key)))
    to = np.array([[one[v, s][0] for s in range(SYMBOLS)] for v in range(len(vectors))])
    add = np.array([[one[v, s][1] for s in range(SYMBOLS)] for v in range(len(vectors))])
    # A block is a number in base SYMBOLS, its last symbol the lowest digit, so that it is taken from the end.
    block_to, block_add = to, add
    for _ in range(BLOCK - 1):  # put one more symbol in front
        block_add = (block_add[:, None, :] + add[block_to].transpose(0, 2, 1)).reshape(len(vectors), -1)
        block_to = to[block_to].transpose(0, 2, 1).reshape(len(vectors), -1)
    return vectors, block_to, block_add


def repair(symbols: np.ndarray) -> tuple[str, int]:
    """The cheapest edits of a conversation, the smallest in ASCII among equally cheap ones, and their cost.

    Memory: a byte or two a turn.
    """
    vectors, block_to, block_add = block_tables()
    lead = -len(symbols) % BLOCK  # the first block may be short: it is worked out symbol by symbol
    first = (BLOCK - lead) % BLOCK
    body = symbols[first:].reshape(-1, BLOCK).astype(np.int64)
    blocks = body @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))
    borders = np.zeros(len(blocks) + 1, np.uint16)  # vectors behind the blocks, and in front of the first
    vector, cost = 0, min(end_costs())
    for i in range(len(blocks) - 1, -1, -1):
        borders[i + 1] = vector
        cost += int(block_add[vector, blocks[i]])
        vector = int(block_to[vector, blocks[i]])
    borders[0] = vector
    state, audit = 0, []
    pieces = [symbols[:first]] * bool(first) + list(body)
    behind = borders[0:1] if first else borders[:0]
    for piece, border in zip(pieces, np.concatenate([behind, borders[1:]])):
        costs = [list(vectors[border])]
        for symbol in piece[::-1]:
            costs.append(step_back(int(symbol), costs[-1]))
        if not audit and piece is pieces[0]:
            extra = costs[-1][0] - (min(vectors[borders[0]]) if first else 0)
        for i, symbol in enumerate(piece):
            state = _trace(int(symbol), state, costs[-1 - i], costs[-2 - i], audit)
    if not pieces:
        return "", 0
    # Behind the last turn: insert until the conversation may end.
    left = end_costs()[state]
    while left:
        audit.append("I")
        state = NEXT[state]
        left -= INSERT
    total = cost + extra if first else cost + vectors[borders[0]][0]
    return "".join(audit), total


def _trace(symbol: int, state: int, here: list[int], behind: list[int], audit: list[str]) -> int:
    """Append the edits up to and with one turn; of the cheapest ways the one with the smallest letters."""
    base = here[state]
    while True:
        for edit, cost, to in [moves(symbol, state)[0], ("I", INSERT, NEXT[state]), *moves(symbol, state)[1:]]:
            rest = here[to] if edit == "I" else behind[to]
            if cost + rest == base:
                audit.append(edit)
                state, base = to, rest
                break
        if edit != "I":
            return state


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, dropped) after planted damage, in order within each partition.

    The crc32 of ``conv_id:turn`` modulo 20 decides: 0 drops the row (it stays with ``dropped`` set), 1 empties the text, 2 removes
    its ``[.!?]``, 3 repeats the row, 4 sets the role to user. Nulls of role and text, and in the key, read as one space.
    Rows go by conv_id, turn (nulls first), role and text, as they were before the damage.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), blank("role").alias("role"), blank("text").alias("text"))
    dealt = rows.repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    hit = F.crc32(F.encode(F.concat(blank("conv_id"), F.lit(":"), blank("turn")), "UTF-8")) % 20
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return (
        dealt.withColumn("hit", hit)
        .withColumn("again", F.explode(F.sequence(F.lit(1), F.when(F.col("hit") == 3, 2).otherwise(1))))
        .select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("hit") == 0).alias("dropped"))
    )


def turn_bits(repeated: Column) -> Column:
    """The byte of a turn: role and faults. Each turn has at most one fault, the first of blank, repeated, truncated."""
    ending = F.expr(r"trim(TRAILING ' \t\n\u000b\f\r' FROM text)")
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    fault = F.when(ending == "", BLANK).when(repeated, REPEATED).when(~F.substring(ending, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    return F.when(F.col("dropped"), DROPPED).otherwise(role + fault).cast("int")


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def judge(turns: DataFrame) -> DataFrame:
    """Counts, cost and audit of every conversation from rows (conv_id, pos, turn, bits).

    Rows are dealt by conversation and streamed in order. A task holds a byte a turn of the conversation at hand, as long
    as the audit that it returns.
    """
    schema = pa.schema([("conv_id", pa.int64()), *((f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in COUNTS.split(", "))])

    def close(conv_id: int | None, bits: bytearray, turns_seen: tuple) -> dict:
        b = np.frombuffer(bytes(bits), np.uint8)
        role = b & ROLE_BITS
        symbols = np.where(b & (BLANK | REPEATED), GONE, role + 4 * ((b & TRUNCATED) > 0)).astype(np.uint8)
        pair = 4 * role[:-1].astype(int) + role[1:]
        audit, cost = repair(symbols)
        low, high, distinct = turns_seen
        return {
            "conv_id": conv_id, "gaps": high - low + 1 - distinct if distinct else 0,
            "blank": int(((b & BLANK) > 0).sum()), "duplicate": int(((b & REPEATED) > 0).sum()), "truncated": int(((b & TRUNCATED) > 0).sum()),
            "illegal": int((~np.isin(pair, (4 * 1 + 2, 4 * 2 + 3, 4 * 3 + 2))).sum()), "cost": cost, "audit": audit,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bits, span = (), bytearray(), (0, 0, 0)  # span: smallest and largest turn, distinct turns
        for batch in batches:
            done = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "bits"))
            for conv_id, turn, bit in zip(*columns):
                if at != (conv_id,):
                    if at:
                        done.append(close(*at, bits, span))
                    at, bits, span = (conv_id,), bytearray(), (0, 0, 0)
                if bit == DROPPED:
                    continue
                bits.append(bit)
                if turn is not None and not (span[2] and turn == span[1]):
                    span = (span[0] if span[2] else turn, turn, span[2] + 1)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if at:
            yield pa.RecordBatch.from_pylist([close(*at, bits, span)], schema)

    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return dealt.select("conv_id", "turn", "bits").mapInArrow(run, f"conv_id long, {COUNTS}")


def repaired_turns(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, role, text) lines of the repaired conversations hashed: one row a conversation with its counts.

    The audit leads its conversation's rows; texts are hashed as they pass, so a conversation of any length streams.
    """
    names = [f.split()[0] for f in COUNTS.split(", ")]
    schema = pa.schema([("conv_id", pa.int64()), *((f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in COUNTS.split(", ")), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: dict = {}

        class Writer:
            def __init__(self, audit: str) -> None:
                self.audit, self.next, self.state, self.hash, self.empty = audit, 0, 0, hashlib.sha256(), True

            def line(self, role: str, text: str) -> None:
                self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
                self.empty = False

            def inserts(self) -> None:
                while self.next < len(self.audit) and self.audit[self.next] == "I":
                    self.state, self.next = NEXT[self.state], self.next + 1
                    self.line(ROLE[self.state], "")

            def turn(self, role: str, text: str) -> None:
                self.inserts()
                edit, self.next = self.audit[self.next], self.next + 1
                if edit == "K":
                    self.state = {"s": 1, "u": 2, "a": 3}[role[0]]
                    self.line(role, text)
                elif edit == "R":
                    self.state = NEXT[self.state]
                    self.line(ROLE[self.state], text)

        writer = Writer("")

        def close() -> dict:
            writer.inserts()
            return head | {"repaired_sha256": writer.hash.hexdigest()}

        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if row["pos"] < 0:
                    if head:
                        done.append(close())
                    head = {c: row[c] for c in ["conv_id", *names]}
                    writer = Writer(head["audit"])
                else:
                    writer.turn(row["role"], row["text"])
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if head:
            yield pa.RecordBatch.from_pylist([close()], schema)

    fields = [f.rsplit(" ", 1) for f in COUNTS.split(", ")]
    heads = audits.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), *names)
    body = rows.where("NOT dropped").select("conv_id", "pos", "role", "text", *[F.lit(None).cast(kind).alias(name) for name, kind in fields])
    dealt = heads.union(body).repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return dealt.mapInArrow(run, f"conv_id long, {COUNTS}, repaired_sha256 string")


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row a conversation: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    ``rows`` is (conv_id, turn, role, text, dropped) as ``damaged`` gives it, ordered within its partitions and
    across them. Its order is fixed by writing it once with a position. A turn is repeated if an earlier one has
    its role and text: the earliest position of each (conversation, role, text hash of 128 bits) is found by an aggregation.

    A null conv_id is a conversation like any other; a conversation without rows has zeros, an empty audit and the
    hash of nothing. Only the initials s, u and a of roles count. Extra columns are ignored; an empty table gives no rows.
    """
    rows = store(rows.withColumn("pos", F.monotonically_increasing_id()), "turns")
    marked = rows.select("conv_id", "pos", "turn", "role", "text", "dropped", F.md5(F.concat_ws("\x00", F.col("role"), F.col("text"))).alias("_same"))
    shared = marked.where("NOT dropped").groupBy("conv_id", "_same").agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    same = F.col("m.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("m._same") == F.col("f._same"))
    thin = marked.select("conv_id", "pos", "turn", "dropped", "_same", turn_bits(F.lit(False)).alias("bits"))
    joined = thin.alias("m").join(shared.alias("f"), same, "left")
    later = F.coalesce(F.col("m.pos") > F.col("f._first"), F.lit(False)) & ~F.col("m.dropped") & (F.col("m.bits").bitwiseAND(BLANK) == 0)
    bits = F.when(later, F.col("m.bits").bitwiseAND(ROLE_BITS) + REPEATED).otherwise(F.col("m.bits"))
    audits = judge(joined.select("m.conv_id", "m.pos", "m.turn", bits.alias("bits")))
    return repaired_turns(rows, audits)
