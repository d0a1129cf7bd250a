"""Line dedup, spelling variants and conversation repair against brute force and their SQL."""

import glob
import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom.llm import conversation_repair as cr
from voxelloom.llm import line_dedup, spelling
from voxelloom.llm.queries import CHECKS, QUERIES

TYPES = {"bigint": "BIGINT", "string": "VARCHAR"}


def docs_of(spark, rows):
    """Documents whose extra columns have the operators' own names."""
    schema = "doc_id long, text string, pos int, hi string, n long, word string, keep binary, text_hash int"
    return spark.createDataFrame([(d, t, 1, "h", 2, "w", b"", 3) for d, t in rows], schema)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = con.execute(CHECKS[name])
    names = [d[0] for d in found.description]
    result = QUERIES[name](spark, sf_dir)
    assert {d[0]: str(d[1]) for d in found.description} == {c: TYPES[t] for c, t in result.dtypes}
    expected = [tuple(row[names.index(c)] for c in result.columns) for row in found.fetchall()]
    assert sorted(map(tuple, result.collect()), key=repr) == sorted(expected, key=repr)


def line_key(line, least):
    key = re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    return key if len(key) >= least else None


def lines_by_hand(rows, least_docs, least_chars):
    found = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            found.setdefault(line_key(line, least_chars), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if line_key(x, least_chars) is None or len(found[line_key(x, least_chars)]) < least_docs]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(2)
    pool = [f"Line number {i}" for i in range(40)] + [" line NUMBER 3\t", "", "  ", "É", "é", "x"]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"own {i} {k}" for k in range(rng.randint(1, 12)))) for i in range(200)]
    rows = [(d, t + "\nthe hot line" * (1 + d % 3)) for d, t in rows]
    rows += [(None, "the hot line\nLine number 1"), (None, "Line number 1"), (300, None), (301, ""), (302, "\n\n"), rows[5], rows[5], (7, "other text\nthe hot line")]
    return rows + [(400, "long " * 40000 + "\n" + "\n".join(["the hot line", "once"] * 3000))]


def test_lines(spark, pages):
    docs = docs_of(spark, pages)
    for least_docs, least_chars in ((10, 1), (3, 2), (1, 1)):
        found = line_dedup.drop_repeated_lines(docs, least_docs, least_chars)
        assert sorted(map(tuple, found.collect()), key=repr) == lines_by_hand(pages, least_docs, least_chars)
    assert line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0
    assert line_dedup.keep_bitmaps(docs, 10**6).count() == 0


@pytest.mark.parametrize("least", [2, 10])
def test_lines_over_many_ranges_and_small_batches(spark, pages, least):
    """A line of every document spans ranges and Arrow batches."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = line_dedup.drop_repeated_lines(docs_of(spark, pages[:120] + pages[200:208]), least, 1).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        for key, value in old.items():
            spark.conf.set(key, value)
    assert sorted(map(tuple, found), key=repr) == lines_by_hand(pages[:120] + pages[200:208], least, 1)


def test_keep_bits():
    for n in (1, 8, 9, 70000):
        places = np.unique(np.random.default_rng(n).integers(0, n, 5))
        keep = line_dedup.unpack_keep(line_dedup.pack_keep(places))
        assert len(keep) == places[-1] + 1 and np.flatnonzero(~keep).tolist() == places.tolist()


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(words):
    form, out = {}, []
    close = {w: [v for v in words if near(w, v)] for w in words}
    for w, n in words.items():
        best = min(close[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(close[w]), form[w] and words[form[w]]))
    return sorted(out, key=repr)


def test_variants(spark, monkeypatch):
    rng = random.Random(4)
    words = {}
    for _ in range(300):
        w = "".join(rng.choice("etaqéÿß×") for _ in range(rng.randint(5, 7)))
        words[w] = rng.randint(3, 400)
    words |= {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaaaaa": 24, "q" * 300: 5, "q" * 299: 10, "q" * 299 + "e": 10, "Étape": 4, "étape": 9}
    table = spark.createDataFrame([(w, n, 1) for w, n in words.items()], "word string, n long, len int")
    expected = variants_by_hand(words)
    assert sorted(map(tuple, spelling.spelling_variants(table).collect()), key=repr) == expected
    # Crowded nodes over blocks.
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 5)
    monkeypatch.setattr(spelling, "TRAVELLERS", 1)
    assert sorted(map(tuple, spelling.spelling_variants(table).collect()), key=repr) == expected
    spread = spelling.split_nodes(spelling.visits(table))
    assert max(r["count"] for r in spread.groupBy(*spelling.NODE, "a", "b").count().collect()) < 40
    assert spelling.spelling_variants(table.limit(0)).count() == 0


def test_large_leaves():
    """Rows with an equal half give the pairs of the full comparison."""
    rng = np.random.default_rng(0)
    for width in (1, 2, 5, 6):
        short = np.unique(rng.integers(97, 100, (60, width)).astype(np.uint8), axis=0)
        same, more = np.unique(rng.integers(97, 100, (60, width)).astype(np.uint8), axis=0), np.unique(rng.integers(97, 100, (60, width + 1)).astype(np.uint8), axis=0)
        for long in (same, more):
            whole, halves = (sorted(zip(*map(list, spelling.leaf_pairs(short, long, few)))) for few in (10**9, 0))
            assert whole == halves == [(i, j) for i in range(len(short)) for j in range(len(long)) if near(bytes(short[i]), bytes(long[j]))]


def test_trie_keeps_every_pair_within_the_budget():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, (80, 6)).astype(np.int16)
    words = words[np.lexsort(words.T[::-1])]
    seekers = rng.integers(0, 3, (50, 6)).astype(np.int16)
    up, down = rng.integers(0, 2, 50), rng.integers(0, 2, 50)
    gap = words[None] - seekers[:, None]
    expected = (np.maximum(gap, 0).sum(2) <= up[:, None]) & (np.maximum(-gap, 0).sum(2) <= down[:, None])
    for few in (0, 16, 10**6):
        found = np.zeros((50, 80), int)
        for who, low, high in spelling.search_trie(words, seekers, up, down, few):
            found[who, low:high] += 1
        assert (found == expected).all()


def words_by_hand(rows, every):
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return sorted((w, n) for w, n in counts.items() if len(w) >= 5 and n >= 3)


def test_word_counts(spark, monkeypatch):
    rng = random.Random(6)
    pool = ["Thing", "thing", "ÉTAPE", "étape", "naïve×x", "word_word", "漢字words漢", "short", "abc", "ÀÉÎÕÜ", "x" * 5000]
    rows = [(i % 50, rng.choice([" ", "\n", "-"]).join(rng.choice(pool) for _ in range(rng.randint(0, 40)))) for i in range(120)]
    rows += [(None, "thing étape thing"), (3, None), (4, ""), (5, "thing " * 20000)]
    monkeypatch.setattr(spelling, "HELD_WORDS", 4)
    for every in (None, 2, 97):
        found = spelling.word_counts(docs_of(spark, rows), typo_every=every)
        assert sorted(map(tuple, found.collect())) == words_by_hand(rows, every)
    assert spelling.word_counts(docs_of(spark, rows).limit(0)).count() == 0


def audit_by_hand(symbols):
    """All audits of up to two inserts a gap: least cost, then least letters."""
    legal = re.compile("(s?(ua)+)?$")
    best = {("", 0): 0}
    gaps = ["", "u", "a", "ua", "au"]
    states = {("", ""): 0}  # (roles, audit) -> cost
    for symbol in [*symbols, None]:
        after = {}
        for (roles, audit), cost in states.items():
            for gap in gaps:
                here, letters, price = roles + gap, audit + "I" * len(gap), cost + 2 * len(gap)
                ways = [("", "", 0)] if symbol is None else [("", "D", 3)]
                if symbol is not None and symbol != cr.GONE:
                    cut = symbol // 4
                    ways += [(" sua"[symbol % 4], "K", cut), ("u", "R", 2 + cut), ("a", "R", 2 + cut)]
                for role, letter, more in ways:
                    key = (here + role, letters + letter)
                    if re.match("s?(ua)*u?$", key[0]):
                        after[key] = min(after.get(key, 10**9), price + more)
        # Of the same roles only the least can win.
        least = {}
        for (roles, audit), cost in after.items():
            tail = (roles[-1:], roles == "s")
            if (cost, audit) < least.get(tail, ((10**9, ""), ""))[0]:
                least[tail] = ((cost, audit), roles)
        states = {(roles, audit): cost for (cost, audit), roles in least.values()}
    done = [(cost, audit) for (roles, audit), cost in states.items() if legal.match(roles)]
    cost, audit = min(done)
    return audit, cost


def test_repair_of_symbols():
    for n in range(4):
        for symbols in itertools.product(range(cr.SYMBOLS), repeat=n):
            assert cr.repair(np.array(symbols, np.uint8)) == audit_by_hand(symbols)
    rng = np.random.default_rng(3)
    for n in (5, 6, 7, 40, 200):
        for _ in range(30):
            symbols = rng.integers(0, cr.SYMBOLS, n).astype(np.uint8)
            assert cr.repair(symbols) == audit_by_hand(symbols.tolist())


def test_block_tables_equal_single_steps():
    vectors, to, add = cr.block_tables()
    assert to.shape == (len(vectors), cr.SYMBOLS**cr.BLOCK) and max(map(max, vectors)) < 10
    for v in range(len(vectors)):
        for block, digits in enumerate(itertools.product(range(cr.SYMBOLS), repeat=cr.BLOCK)):
            if block % 37 == v % 37:
                costs = list(vectors[v])
                for symbol in digits[::-1]:
                    costs = cr.step_back(symbol, costs)
                assert costs == [c + add[v, block] for c in vectors[to[v, block]]]


def conversation_by_hand(rows):
    """Audit, counts and repaired lines of one damaged conversation [(turn, role, text)], in order."""
    fault, seen = [], set()
    for _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        fault.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated")
        seen.add((role, text))
    initial = [" sua".find(r[:1]) if r[:1] and r[:1] in "sua" else 0 for _, r, _ in rows]
    audit, cost = audit_by_hand([cr.GONE if f in ("blank", "duplicate") else i + 4 * (f == "truncated") for i, f in zip(initial, fault)])
    lines, state, at = [], "", iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(at)[1:]
        if edit == "D":
            continue
        role = role if edit == "K" else "assistant" if state == "u" else "user"
        state = role[0]
        lines.append(f"{role}:{text}")
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum((" sua"[a] + " sua"[b]) not in ("su", "ua", "au") for a, b in zip(initial, initial[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(fault.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def repaired_by_hand(rows):
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv), key=lambda k: (k[:2], k[2].encode(), k[3].encode()))
        damaged = []
        for known, t, role, text in mine:
            hit = zlib.crc32(f"{' ' if conv is None else conv}:{t if known else ' '}".encode()) % 20
            if hit:
                text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
                damaged += [(t if known else None, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
        out.append((conv, *conversation_by_hand(damaged)))
    return sorted(out, key=repr)


def test_conversations(spark):
    rng = random.Random(9)
    roles, texts = ["user", "assistant", "system", "s", "", None, "tool", "User"], ["Hi.", "yes!", "no", " \t", "", None, "Why?\n", "é.", "same."]
    rows = [(c, t, rng.choice(roles[:3] if c % 2 else roles), rng.choice(texts)) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(c, t + 3 * (t > 2), ["user", "assistant"][t % 2], f"turn {t} of {c}.") for c in range(100, 140) for t in range(6)]
    rows += [(200, None, "user", "a."), (200, None, "user", "b."), (200, 5, "assistant", "c."), (None, 1, "user", "null id."), (None, None, None, None)]
    rows += [(300, 0, "user", "same."), (300, 0, "user", "same."), (300, 0, "assistant", "z."), (300, 2, "assistant", "end")]
    rows += [(400, t, "user" if t % 2 else "assistant", f"{t} " * (t % 40) + ".") for t in range(3000)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, pos int, hit int")
    found = sorted(map(tuple, cr.repair_conversations(cr.damaged(table.repartition(5))).collect()), key=repr)
    expected = repaired_by_hand(rows)
    for a, b in zip(found, expected):
        assert a == b
    assert len(found) == len(expected)
    assert cr.repair_conversations(cr.damaged(table.limit(0))).count() == 0
    assert cr.repair_conversations(cr.damaged(table).withColumn("dropped", F.lit(True))).where("audit <> '' OR cost <> 0 OR gaps <> 0").count() == 0
