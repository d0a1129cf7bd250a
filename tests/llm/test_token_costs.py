"""What token files cost: segments that reach the tokenizer, and symbols that are coded."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from voxelloom.llm import range_coder, token_files

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    return tokenizer


def learned(encoder, monkeypatch):
    """Numbers of segments that reach the tokenizer, one for each call."""
    sizes, learn = [], encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda data, hashes, *rest: (sizes.append(len(hashes)), learn(data, hashes, *rest)))
    return sizes


def encodes_alike(encoder, plain, texts):
    ids, counts = encoder.encode(pa.array(texts, pa.string()))
    expected = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    return ids.tolist() == sum(expected, []) and counts.tolist() == list(map(len, expected))


def test_words_are_learned_without_their_marks(plain, monkeypatch):
    encoder = token_files.Encoder(BPE)
    sizes = learned(encoder, monkeypatch)
    words = [f"wo{chr(97 + i // 26)}{chr(97 + i % 26)}rd" for i in range(200)]
    texts = [" " + (mark + " ").join(words) + mark + "\n" + words[0] for mark in ("", ".", ",", ";", "!", ":", ")")]
    assert encodes_alike(encoder, plain, texts)
    assert sum(sizes) <= 200 + 20  # the words, the marks, a line end and a word without a space


def test_segments_that_come_again_are_kept(plain, monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_SEGMENTS", 400)
    encoder = token_files.Encoder(BPE)
    sizes = learned(encoder, monkeypatch)
    rng = random.Random(3)
    common = [" " + "".join(rng.choices("abcdefgh", k=5)) for _ in range(100)]
    for _ in range(20):
        assert encodes_alike(encoder, plain, ["x" + "".join(common + [" " + "".join(rng.choices("ijklmnop", k=9)) for _ in range(50)])])
    assert sum(sizes) <= 100 + 20 * 50 + 10
    # More distinct segments in one text than the cache keeps.
    assert encodes_alike(encoder, plain, ["".join(" " + "".join(rng.choices("ijklmnop", k=9)) for _ in range(900))])


def test_cuts_keep_the_ids(plain):
    rng = random.Random(7)
    parts = ["a", "é", "È", "×", "ß", " ", "  ", "\n", "\n\n", " \n", "\t", "'s", "'", "'ll", "'re", "'S", "23", " ", "　", "漢", "\r\n", "...", ",", "-",
             '"', "_", " a", "\u0085", "\x1c", "\x7f", "́", "½", "٣", "\x0b", "word.\nNext", "’", "<|endoftext|>"]
    encoder = token_files.Encoder(BPE)
    for _ in range(60):
        some = rng.sample(parts, rng.randint(2, len(parts)))
        assert encodes_alike(encoder, plain, ["".join(rng.choice(some) for _ in range(rng.randint(0, 30))) for _ in range(30)] + [None])


def test_frequent_pairs_are_one_symbol(monkeypatch):
    rng = np.random.default_rng(4)
    words = rng.integers(0, 5000, (300, 3)).astype(np.uint32)
    ids = words[np.minimum(rng.geometric(0.02, 30000) - 1, 299)].reshape(-1)
    coded, update = [], range_coder.Mixer.update
    monkeypatch.setattr(range_coder.Mixer, "update", lambda self, rank: (coded.append(len(rank)), update(self, rank))[1])
    block = range_coder.encode(ids)
    assert sum(coded) <= 0.7 * len(ids)
    coded.clear()
    assert (range_coder.decode(block) == ids).all()
    assert sum(coded) <= 0.7 * len(ids)


def test_pairs_that_overlap():
    rng = np.random.default_rng(6)
    for n in (2, 3, 50, 1 << 17, (1 << 17) + 1, 200000):  # around the ids that are looked up at once, too
        for ids in (np.zeros(n, np.uint32), np.tile(np.array([7, 7, 9], np.uint32), n)[:n], rng.integers(0, 3, n).astype(np.uint32) * np.uint32(2**31 - 1)):
            assert (range_coder.decode(range_coder.encode(ids)) == ids).all()
