from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from foldsmith.llm import token_counts
from foldsmith.llm.token_counts import MARK, TrieCounter, count_tokens, vocabulary
from tests.llm.tables import frame, rows

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return vocabulary(PATH)


def brute(word: str, pieces: dict[str, float], unknown: float) -> int:
    best = [(0.0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        tries = [(best[end - 1][0] + unknown, -best[end - 1][1] - len(word[end - 1].encode()))]
        tries += [(best[s][0] + pieces[word[s:end]], -best[s][1] - 1) for s in range(end) if word[s:end] in pieces]
        score, tokens = max(tries)
        best[end] = (score, -tokens)
    return best[-1][1]


def some_words(n: int, letters: str) -> list[str]:
    rng = random.Random(5)
    return sorted(MARK + "".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(n))


def test_against_brute_force_with_a_small_trie(pieces):
    trie = TrieCounter(pieces, limit=500)
    for word in some_words(2000, "etaoinshré,漢🙂"):
        assert trie.count(word) == brute(word, pieces, trie.unknown), word


def test_against_the_library(pieces):
    model = Tokenizer(Unigram([("<unk>", 0.0), *pieces.items()], 0, False))
    trie = TrieCounter(pieces)
    different = [w for w in some_words(2000, "etaoinshrdlu") if trie.count(w) != len(model.encode(w).ids)]
    assert len(different) <= 2  # equal scores may be cut either way


def test_kept_counts_are_bounded(spark, monkeypatch):
    """Counts that a task keeps from batch to batch, and starting anew when they are many, change no result."""
    docs = frame(spark)
    whole = sorted(map(str, count_tokens(docs, PATH).collect()))
    monkeypatch.setattr(token_counts, "KNOWN", 3)
    assert sorted(map(str, count_tokens(docs, PATH).collect())) == whole


def test_sums_over_documents(spark, pieces):
    trie = TrieCounter(pieces)
    want = []
    for doc, text, *_ in rows():
        parts = [p.decode() for p in (text or "").encode().split()]
        want.append((doc, len(parts), sum(trie.count(MARK + p) for p in parts)))
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, count_tokens(frame(spark), PATH).collect()), key=key) == sorted(want, key=key)
    assert count_tokens(frame(spark).limit(0), PATH).count() == 0
