"""Pieces of texts give the ids of whole texts; BM25 scores against a plain version."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from agorascope.llm import packing, tokens

ALPHABET = [
    *" \t\n\r\x0b\x0c", "  ", "\x1c", "\x1f", "\x00", "\x01", "\x85", "\xa0", " ", " ", " ", " ", " ", "　",
    "​", "﻿", *"abXY019.,;:!?#$%&*|'-_<>", "'s", "'ll", "é", "é", "́", "̸", "à", "ß", "İ", "Σ", "中", "🙂", "<|endoftext|>", "word", "The",
]


def texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("spaces, path", [(False, tokens.word_vocabulary()), (True, tokens.byte_vocabulary())])
@pytest.mark.parametrize("weak", [False, True])
def test_any_characters(monkeypatch, spaces, path, weak):
    if weak:  # most pieces share a hash with others
        monkeypatch.setattr(tokens, "_hashes", lambda data, begin, end: (data[begin] & 3).astype(np.uint64))
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    tool, found = tokens.Encoder(path, spaces), texts(1, 3000) + ["x" * 300_000, "", " ", "a. " * 5000]
    for low in range(0, len(found), 500):
        some = found[low : low + 500]
        ids, counts = tool.encode(some)
        want = [plain.encode(t, add_special_tokens=False).ids for t in some]
        assert counts.tolist() == list(map(len, want))
        assert ids.tolist() == [i for w in want for i in w]


def test_cache_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 100_000)
    tool = tokens.Encoder(tokens.byte_vocabulary(), True)
    for i in range(40):
        tool.encode([f"\x1c{i}" + "ab\x1f" * 3000])  # a piece of 9,000 characters, never seen again
        assert tool.raw.used < 120_000


def test_scores():
    r = random.Random(3)
    docs = [[r.choice([1, 2, 3, 5, 8, 13, 70_000]) for _ in range(r.randint(0, 12))] + [2] for _ in range(30)]
    counts = np.array([len(d) for d in docs])
    index = packing.Index(np.array([i for d in docs for i in d], np.uint32), counts)
    df = Counter(i for d in docs for i in set(d))
    for seed in range(len(docs)):
        want = []
        for doc in docs:
            norm = packing.K1 * (1 - packing.B + packing.B * len(doc) / counts.mean())
            idf = {i: max(0, math.log((len(docs) - df[i] + 0.5) / (df[i] + 0.5))) for i in set(docs[seed])}
            want.append(sum(w * doc.count(i) * (packing.K1 + 1) / (doc.count(i) + norm) for i, w in idf.items()))
        assert np.allclose(index.scores(seed), want, rtol=1e-5)
