"""Operators for training data against brute force, on small tables with nulls, empty and long texts, ties and copies."""

import html
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from voxelloom.llm import (
    cross_polytope, decontamination, html_text, language, mixing, near_dedup, quality, range_coder, sharding, suffix_dedup, token_files,
)
from voxelloom.llm.queries import QUERIES
from voxelloom.llm.shared import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies int, size long, p double"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def make(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, "en", s, 1, 7, 8, 0.5) for d, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = ["the", "Of", "and", "éa", "thing", "ning", "x", "wo,rd", "ß", "42"]
    text = lambda n: rng.choice(["", " ", "\n"]).join([" ".join(rng.choice(words) for _ in range(n))])
    passage = " ".join(f"shared{i}" for i in range(30))
    rows = [(None, text(40), "a"), (100, None, None), (101, "", "a"), (102, " \t\n", "b"), (103, "one two", "b"), (104, "😀" * 30, "c")]
    rows += [(i, text(rng.randint(1, 80)) + (" " + passage if i % 5 == 0 else ""), rng.choice("abcd")) for i in range(60)]
    rows += [(200 + i, rows[20][1], "a") for i in range(6)] + [(300, "\x00" * 120, "a"), (301, "\x00" * 70, None), (302, text(9000), "d")]
    rows += [rows[30], rows[30]]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return make(spark, corpus)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def test_sharding(docs, nothing, corpus):
    rows = sharding.shard_documents(docs, 16, rows_per_bucket=1).collect()
    assert len(rows) == len(corpus)
    for shard in range(16):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 16) for r in rows)
    raw = {(d, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for d, t, _ in corpus}
    assert {(r.doc_id, r.text_crc32, r.size) for r in rows} == raw
    assert sharding.shard_documents(nothing).count() == 0


def test_shards_are_even(spark):
    counts = spark.range(20000).select(sharding.shard_of(F.col("id").cast("string"), sharding.Tree(16)).alias("s")).groupBy("s").count().collect()
    assert len(counts) == 16 and all(abs(r["count"] - 1250) < 200 for r in counts)


def targets_by_hand(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    stopped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in stopped]
        rest = total - sum(3 * sizes[s] for s in stopped)
        over = [s for s in free if rest * weight[s] / sum(weight[f] for f in free) > 3 * sizes[s]]
        if not over:
            return {s: 3 * sizes[s] if s in stopped else rest * weight[s] / sum(weight[f] for f in free) for s in names}
        stopped.update(over)


def test_mixing(spark, docs, nothing, corpus):
    rows = mixing.mix_sources(docs, group=4).collect()
    assert len(rows) == len(corpus) and mixing.mix_sources(nothing).count() == 0
    sizes = {}
    for _, text, source in corpus:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    target = targets_by_hand(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * (1 + target[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix_sources(docs.repartition(5), group=4).collect()), key=str)


def test_mixing_keeps_words_near_targets(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(1, 60), "hot" if i % 3 else f"s{i % 5}") for i in range(900)]
    found = mixing.mix_sources(make(spark, rows), group=16).groupBy("source").agg(F.sum("taken").alias("k"), F.first("target").alias("t"))
    assert all(abs(r.k - r.t) <= 60 for r in found.collect())
    docs = make(spark, rows)
    assert mixing.repeat_documents(docs, mixing.mix_sources(docs)).columns == docs.columns


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_hand(prints):
    """Smallest id reachable by links of three bits or fewer."""
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(len(prints)):
                if (prints[i] ^ prints[j]).bit_count() <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_simhash(docs, nothing, corpus):
    prints = [simhash(t) for _, t, _ in corpus]
    label = groups_by_hand(prints)
    smallest = {g: min((corpus[i][0] for i in range(len(corpus)) if label[i] == g and corpus[i][0] is not None), default=None) for g in set(label)}
    expected = sorted(((d, f"{p:016x}", smallest[g]) for (d, _, _), p, g in zip(corpus, prints, label)), key=str)
    assert sorted(map(tuple, near_dedup.near_duplicates(docs).collect()), key=str) == expected
    assert near_dedup.near_duplicates(nothing).count() == 0
    kept = [r.doc_id for r in near_dedup.keep_representatives(docs).collect() if r.doc_id is not None]
    assert sorted(kept) == sorted({c for _, _, c in expected if c is not None} & {d for d, _, _ in corpus})


def test_links_in_hot_blocks(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 12, dtype=np.int64)
    found = {int(b) for b in base}
    for b in base[:4]:
        for _ in range(40):
            b = int(b) ^ sum(1 << int(k) for k in rng.choice(60, rng.integers(1, 5), replace=False))
            found.add(b)
    fps = sorted(found)
    links = near_dedup.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), group=8)
    root = {r.node: r.root for r in near_dedup.components(links).collect()}
    label = groups_by_hand(fps)
    assert [root.get(f, f) for f in fps] == [fps[g] for g in label]


def five_word_jaccard(x, y):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (x, y))
    return len(x & y) / len(x | y)


def test_stage_drops_near_copies(spark):
    rng = random.Random(11)
    new = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, copies, apart = [], [], []
    for i in range(150):
        words = new(rng.randint(60, 600))
        rows.append((i, " ".join(words)))
        edited = list(words)
        if i % 2:  # more words at the end: every kind of shingle changes alike
            edited += new(round(len(words) * rng.uniform(0.05, 0.24)))
        else:
            for at in rng.sample(range(len(words)), max(1, len(words) * rng.randint(10, 24) // 1000)):
                edited[at] = "changed"
        alike = five_word_jaccard(" ".join(words), " ".join(edited))
        rows.append((1000 + i, " ".join(edited)))
        (copies if alike >= 0.8 else apart).append(1000 + i)
        rows.append((2000 + i, " ".join(words[: len(words) * 7 // 10] + new(len(words) * 3 // 10))))  # Jaccard about 0.54
    rows += [(5000, "one of a kind text here"), (5000, rows[0][1]), (5001, rows[3][1].upper()), (5002, None), (5003, " "), (None, rows[0][1])]
    docs = make(spark, [(d, t, "a") for d, t in rows])
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()]
    expected = set(range(150)) | set(range(2000, 2150)) | set(apart) | {5000, 5002, None}
    assert len(copies) > 100 and {d for d, _ in kept} == expected and len(kept) == len(expected)
    assert (5000, "one of a kind text here") in kept


def test_stage_links_in_hot_groups(spark):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base[:i], "x", *base[i + 1 :]]) for i in range(0, 200, 4)]
    hasher = near_dedup.SpanHasher()
    rows = []
    for i, t in enumerate(texts):
        wide, _ = near_dedup.wide_fingerprints(*near_dedup.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), hasher))
        rows.append((i, *wide[0].view(np.int64).tolist(), 196, t, 0))
    nodes = spark.createDataFrame(rows, "node long, low long, high long, n long, text string, root long")
    for links in (near_dedup.candidate_links(nodes, group=8), near_dedup.verified_links(nodes, at_once=2000)):
        assert {r.root for r in near_dedup.components(links).collect()} == {0} and near_dedup.components(links).count() == len(texts)


def test_candidate_links_stay_few_in_large_groups(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 2, dtype=np.int64)
    for n in (250, 1000):
        bits = np.unpackbits(np.tile(base.view(np.uint8), (n, 1)), axis=1)
        for row in bits:
            row[rng.choice(128, 8, replace=False)] ^= 1
        wide = np.packbits(bits, axis=1).view(np.int64)
        rows = [(int(x), int(a), int(b)) for x, (a, b) in zip(rng.integers(-2**62, 2**62, n), wide)]
        links = near_dedup.candidate_links(spark.createDataFrame(rows, "node long, low long, high long"))
        assert links.count() < 8 * n and near_dedup.components(links).select("root").distinct().count() == 1


def test_decontamination(spark, docs, nothing):
    words = [f"word{i}" for i in range(60)]
    tests = spark.createDataFrame(
        [(1, " ".join(words[:20]), 0), (2, "alpha beta gamma delta epsilon zeta", 0), (3, None, 0), (4, "", 0), (None, " ".join(words[30:50]), 0), (5, "Too few words", 0)],
        "item_id long, text string, doc_id int",
    )
    changed = words[:20]
    changed[4] = changed[11] = changed[17] = "other"
    rows = [
        (1, "before " + " ".join(words[:20]).upper() + " after", "a"), (2, "x, " + ";\n".join(changed) + "! y", "a"), (3, " ".join(words[:10]), "a"),
        (4, "see Alpha BETA - gamma delta epsilon zeta.", "a"), (5, "alpha beta gamma delta", "a"), (6, None, "a"), (7, "", "a"), (8, " ".join(words[30:50]), "a"),
        (9, "too few words " * 20, "a"), (1, "clean text here", "a"), (10, "alpha beta wrong delta epsilon zeta " * 9000, "a"),
    ]
    found = {r.doc_id: r for r in decontamination.contaminated(make(spark, rows), tests).collect()}
    assert sorted(found) == [1, 2, 4, 10]
    assert (found[1].n_same, found[1].n_words, found[1].first_word) == (20, 20, 1)
    assert found[2].n_same < found[2].n_words and found[4].item_id == 2 and found[10].n_same == 5
    clean = decontamination.clean_documents(make(spark, rows), tests)
    kept = [(r.doc_id, r.text) for r in clean.collect()]
    assert sorted(d for d, _ in kept) == [1, 3, 5, 6, 7, 8, 9] and clean.columns == docs.columns and (1, "clean text here") in kept
    shared = [(None, "clean one", "a"), (None, " ".join(words[:20]), "a"), (7, "clean two", "a"), (7, " ".join(words[:20]), "a"), (8, " ".join(words[:20]), "a")]
    assert sorted(r.text for r in decontamination.clean_documents(make(spark, shared), tests).collect()) == ["clean one", "clean two"]
    assert decontamination.contaminated(nothing, tests).count() == 0
    assert decontamination.contaminated(make(spark, rows), tests.limit(0)).count() == 0


def test_decontamination_of_short_passages_and_unspaced_scripts(spark):
    chinese = "今天天气很好我们去公园散步吧朋友"
    tests = spark.createDataFrame(
        [(1, "What is entropy?", 0), (2, "Yes", 0), (3, chinese, 0), (4, "Pi is 3.14", 0), (5, "你好吗", 0), (6, "l\u2019eau est \u00abtr\u00e8s\u00bb froide ce matin", 0)],
        "item_id long, text string, doc_id int",
    )
    rows = [
        (1, "A quiz. what is entropy?\nNext.", "a"), (2, "she knows what is entropy and more", "a"), (3, "yes!", "a"), (4, "Yes. We do.", "a"),
        (5, "他说：" + chinese[:5] + "真" + chinese[6:] + "。再见", "a"), (6, "pi is 3.14", "a"), (7, "（你好吗？）好", "a"), (8, "他们问你好吗今天", "a"),
        (9, "on dit: l'eau est tr\u00e8s froide ce matin", "a"), (10, "what is entropy", "a"), (11, chinese[:9], "a"),
    ]
    found = {(r.doc_id, r.item_id) for r in decontamination.overlaps(make(spark, rows), tests).collect()}
    assert found == {(1, 1), (10, 1), (3, 2), (5, 3), (6, 4), (7, 5), (9, 6)}


def test_decontamination_equals_all_diagonals(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randint(0, 30)}"
    passages = [(i, [word() for _ in range(rng.choice([5, 6, 8, 10, 12, 13, 14, 20, 40]))]) for i in range(40)]
    documents = []
    for d in range(120):
        body = [word() for _ in range(rng.randint(0, 30))]
        if d % 3:
            part = list(rng.choice(passages)[1])
            for _ in range(rng.randint(0, max(1, len(part) // 4))):
                part[rng.randrange(len(part))] = word()
            body[rng.randint(0, len(body)) : 0] = part
        documents.append((d, body))
    expected = set()
    for d, body in documents:
        for i, passage in passages:
            width = min(13, len(passage))
            for shift in range(-len(passage), len(body)):
                same = [0 <= shift + k < len(body) and body[shift + k] == w for k, w in enumerate(passage)]
                for at in range(len(passage) - width + 1):
                    if 0 <= shift + at and shift + at + width <= len(body) and sum(same[at : at + width]) * 5 >= 4 * width:
                        expected.add((d, i))
    tests = spark.createDataFrame([(i, " ".join(p), 0) for i, p in passages], "item_id long, text string, doc_id int")
    for block in (64, decontamination.BLOCK):
        found = decontamination.overlaps(make(spark, [(d, ", ".join(b), "a") for d, b in documents]), tests, block)
        assert {(r.doc_id, r.item_id) for r in found.collect()} == expected and expected


def test_masks_meet_every_window_of_eleven_in_thirteen():
    for masks, width, wrong in ((decontamination.LONG_MASKS, 13, 2), (decontamination.SHORT_MASKS, 5, 1)):
        for bad in __import__("itertools").combinations(range(width), wrong):
            assert any(not {at + k for k in mask} & set(bad) for mask in masks for at in range(width - mask[-1]))


def test_repeated_strings(docs, nothing, corpus):
    texts = [(d, (t or "").encode()) for d, t, _ in corpus]
    first = {}
    for d, raw in texts:
        if d is not None:
            for i in range(len(raw) - 49):
                first[raw[i : i + 50]] = min(d, first.get(raw[i : i + 50], d))
    expected = []
    for d, raw in texts:
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if d is not None and first[raw[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i in range(len(raw)) if gone[i] and not (i and gone[i - 1]))
        expected.append((d, bytes(x for x, g in zip(raw, gone) if not g), len(raw), sum(gone), spans))
    for crowded in (1, 3, suffix_dedup.CROWDED):
        found = suffix_dedup.dedup(docs.repartition(7), bucket_bytes=2000, shard_bytes=300, crowded=crowded).collect()
        assert sorted(((r[0], bytes(r[1]), *r[2:]) for r in found), key=str) == sorted(expected, key=str)
    assert suffix_dedup.dedup(nothing).count() == 0


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(20):
        parts = [bytes(rng.integers(0, 2, rng.integers(1, 90)).astype(np.uint8)) for _ in range(rng.integers(1, 8))] * 2
        data, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
        suffixes = sorted((data[i : ends[np.searchsorted(ends, i, "right")]].tobytes(), i) for i in range(len(data)))
        order = suffix_dedup.suffix_array(data, ends)
        assert [i for _, i in suffixes] == order.tolist()
        shared = suffix_dedup.common_prefixes(data, ends, order)
        for (a, _), (b, _), n in zip(suffixes, suffixes[1:], shared[1:]):
            assert a[:n] == b[:n] and a[n : n + 1] != b[n : n + 1] or n == min(len(a), len(b)) and a[:n] == b[:n]


def test_range_coder():
    rng = np.random.default_rng(2)
    for n in (0, 1, 127, 300, 40000):
        ids = np.minimum(rng.geometric(0.001, n), 65535).astype(np.uint32)
        block = range_coder.encode(ids, lanes=64)
        assert (range_coder.decode(block) == ids).all()
        if n:
            with pytest.raises(ValueError):
                range_coder.decode(block[:9] + bytes([block[9] ^ 1]) + block[10:])
    assert len(range_coder.encode(np.tile(np.arange(50, dtype=np.uint32), 2000))) < 20000
    # Every rank must be found again from the first and last share of its interval, empty contexts and equal ids included.
    for ids in (np.zeros(5000, np.uint32), rng.integers(0, 2**32, 20000, dtype=np.uint32), np.sort(rng.integers(0, 40, 30000, dtype=np.uint32))):
        assert (range_coder.decode(range_coder.encode(ids)) == ids).all()
    model = range_coder.Mixer(32, 60)
    for _ in range(200):
        ranks = np.minimum(rng.geometric(0.2, 32) - 1, 59)
        model.predict(32)
        begin, size = (x.astype(np.int64) for x in model.interval(ranks))
        assert (size > 0).all() and (begin + size <= 1 << range_coder.TOTAL_BITS).all()
        assert (model.rank_at(begin) == ranks).all() and (model.rank_at(begin + size - 1) == ranks).all()
        model.update(ranks)


def test_encoder_equals_tokenizer():
    plain = Tokenizer.from_file(BPE)
    plain.encode_special_tokens = True
    encoder, rng = token_files.Encoder(BPE), random.Random(4)
    parts = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "'", "23", " ", "　", "<|endoftext|>", "😀", "漢", "\r\n", "...", " a", "\u0085", "\x00"]
    for _ in range(40):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(30)] + [None]
        ids, counts = encoder.encode(pa.array(texts, pa.string()))
        expected = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == sum(expected, []) and counts.tolist() == list(map(len, expected))


def test_token_files(spark, docs, nothing, corpus, tmp_path):
    plain = Tokenizer.from_file(BPE)
    expected, at = [], 0
    for d, t, _ in sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        expected.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    found = token_files.token_index(docs, BPE, str(tmp_path / "files"), block_ids=500).collect()
    assert sorted((tuple(r)[:4] for r in found), key=lambda r: r[1]) == expected
    assert max(r.n_parts for r in found) > 1
    assert token_files.token_index(nothing, BPE).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16)) * rng.uniform(0.5, 2, (300, 1))
    x[50:60] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    bad = [(400, None), (401, []), (402, [0.0] * 16), (403, [None] + [1.0] * 15), (404, [float("nan")] * 16), (405, [float("inf")] + [0.0] * 15)]
    vectors = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    found = cross_polytope.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20, tables=12, probes=48).collect()
    exact, hits = np.array([v for _, v in rows]), 0
    for q in range(0, 300, 20):
        scores = exact @ exact[q]
        scores[q] = -np.inf
        best = np.lexsort((np.arange(300), -scores))[:20]
        mine = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, 21)) and q not in [v for _, v, _ in mine]
        assert [v for _, v, _ in mine] == [v for _, v in sorted((-s, v) for _, v, s in mine)]
        assert all(abs(s - exact[v] @ exact[q]) < 1e-12 for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & set(best.tolist()))
    assert hits >= 0.9 * 300 and not {r.query_id for r in found} & set(range(400, 406))
    assert cross_polytope.nearest(vectors.limit(0), vectors.limit(0)).count() == 0


def neighbours_recall(spark, x, step):
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in cross_polytope.nearest(vectors, vectors.where(f"vec_id % {step} = 0"), 20).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q in range(0, len(x), step):
        scores = x @ x[q]
        scores[q] = -np.inf
        best = set(np.argsort(-scores)[: min(20, len(x) - 1)].tolist())
        assert len(found[q]) == len(best)
        hits, total = hits + len(best & found[q]), total + len(best)
    return hits / total


def test_neighbours_of_skewed_norms_and_small_tables(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[77] *= 100
    assert neighbours_recall(spark, x, 50) > 0.95
    assert neighbours_recall(spark, rng.normal(size=(15, 64)), 1) == 1
    assert neighbours_recall(spark, rng.normal(size=(30, 64)), 1) > 0.9


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(cross_polytope.rotate(x, 3), axis=1), np.linalg.norm(x, axis=1))


def test_forward_sums_all_segmentations():
    vocabulary = [b" ", b"a", b"ab", b"abc", b"b", b"bc", b"c", b" a"]
    finder = language.Pieces(vocabulary)
    chance = np.random.default_rng(1).dirichlet(np.ones(len(vocabulary)))

    def total(word):
        return 1.0 if not word else sum(chance[i] * total(word[len(p) :]) for i, p in enumerate(vocabulary) if word.startswith(p))

    for word in (b" abc", b" abab", b" cab"):
        got = finder.log_likelihood(np.frombuffer(word, np.uint8)[None], chance[:, None])
        assert np.isclose(got[0, 0], np.log(total(word)))


def test_language(spark, sf_dir, docs, nothing):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    whole = table(spark, sf_dir, "documents")
    joined = language.identify(whole, path, 200).join(whole.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in joined) > 0.95 * len(joined)
    vocabulary = language.read_vocabulary(path)
    models = {"b": np.full(len(vocabulary), 1 / len(vocabulary)), "a": np.full(len(vocabulary), 1 / len(vocabulary))}
    found = language.predict(docs, vocabulary, models).collect()
    none = {r.doc_id for r in found if r.lang_pred == "und"}
    assert {100, 101, 102, 104, 300, 301} <= none and all(r.score == 0.5 for r in found if r.lang_pred != "und")
    assert language.identify(nothing, path).count() == 0
    assert {r.lang_pred for r in language.predict(docs, vocabulary, {}).collect()} == {"und"}


def test_quality(spark, sf_dir, docs, nothing):
    whole, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = quality.classify(whole, labels).join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) > 0.9 * len(rows)
    net = quality.fit(whole, labels)
    scored = quality.score(docs, net).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert quality.score(nothing, net).count() == 0 and quality.classify(docs, labels.limit(0)).count() == docs.count()
    assert quality.good_documents(docs, labels).columns == docs.columns


def test_html(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header>Top words here</header><nav><a href='/x'>menu one</a></nav>"
        "<aside>side words</aside><article><h1>Head &amp; line</h1><p>First  <b>bold</b>\ntext &lt;x&gt;<br>next<p>Second &eacute;"
        "<script>if (a<b) { '</p>' }</script> end.</p><form><input>mail <button>send</button></form><div class='comments'><p>reader says</p></div>"
        "<!-- note > --><ul><li>One</li><li>Two</li></ul></article><div class=\"ad\">Buy many fine things now today</div><footer>&copy; 2020</footer></body></html>"
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "plain words only"), (5, "u", "<p>a<p>b"), (None, "u", "<<<"), (1, "u", page)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    found = [(r.page_id, r.text, r.n_chars) for r in html_text.extract(pages).collect()]
    text = "Head & line\n\nFirst bold text <x> next\n\nSecond é end.\n\nOne\n\nTwo"
    assert found.count((1, text, len(text))) == 2 and (2, "", 0) in found and (3, "", 0) in found
    assert ("plain words only" in [t for _, t, _ in found]) and len(found) == len(rows)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_on_given_pages(spark, sf_dir):
    pages = {r.page_id: r.html for r in table(spark, sf_dir, "pages").collect()}
    for r in QUERIES["op8_max_scoring_html"](spark, sf_dir).collect():
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_html_scan_decides_without_content_elements(spark):
    filler = [f"<body><nav><ul><li>a{i}</li></ul></nav><article><h1>head</h1><p>some more words here</p></article><footer>f</footer></body>" for i in range(5)]
    main = "<div class='story'><p>the main text of this page has many words</p><p>and a second block of it</p></div>"
    cases = {
        "aside": f"<body>{main}<aside><article><p>teaser one</p></article></aside></body>",
        "nav": f"<body><nav><article><a>teaser</a></article></nav>{main}</body>",
        "comments": f"<body>{main}<article class='comment'><p>reader says this</p></article><article id='comment-7'><p>me too</p></article></body>",
        "card": f"<body>{main}<nav><ul><li>x</li><li>y</li></ul></nav><article><p>short card</p></article></body>",
        "outside": "<body><article><h1>head</h1><p>the main text has many words</p></article><p>and goes on after its element ends here</p></body>",
    }
    rows = [(i, page, page) for i, page in enumerate(filler)] + [(10, name, page) for name, page in cases.items()]
    found = {r.url: r.text.split() for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = "the main text of this page has many words and a second block of it".split()
    assert all(found[name] == whole for name in ("aside", "nav", "comments", "card"))
    assert found["outside"] == "head the main text has many words and goes on after its element ends here".split()
    # The linear scan against all regions.
    rng = random.Random(1)
    for _ in range(200):
        weights = {"#word": 1.0, "#tag": -1.5, "p": -0.5, "div": -2.0}
        tokens = [(rng.choice(["p", "div", "x", None]), "a b" * rng.randint(0, 2), rng.random() < 0.2, None, None) for _ in range(rng.randint(0, 15))]
        score = [weights.get(t[0], 0.0 if t[2] else -1.5) if t[0] else 0.0 if t[2] else float(html_text.words_in(t[1])) for t in tokens]
        start, stop = html_text.best_region(tokens, weights)
        assert sum(score[start:stop]) == max([0.0] + [sum(score[i:j]) for i in range(len(score)) for j in range(i + 1, len(score) + 1)])
    assert html_text.signature("article", ' class="post category-social"') == ("article.category-social.post", False)


def test_pipeline_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, held = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = corpus_pipeline.store(stage(spark, docs, sf_dir), "test")
        assert after.columns == columns and 0 < after.count() < held
        assert after.join(docs, "doc_id", "left_anti").count() == 0
        docs, held = after, after.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
