from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foldsmith.llm.token_files import WordEncoder, WordIds, decode_values, encode_values, read_token_files, token_digests, write_token_files
from foldsmith.storage import scratch_path
from tests.llm.tables import frame, plain, rows, sentence

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text: str | None) -> list[int]:
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 1 << 17), st.integers(0, (1 << 32) - 1))))
@settings(max_examples=300, deadline=None)
def test_values_round_trip(values):
    control, data = encode_values(np.array(values, np.uint32))
    assert decode_values(control, data, len(values)).tolist() == values
    assert len(control) == -(-len(values) // 4) and len(data) == sum(max(1, -(-v.bit_length() // 8)) for v in values)


LETTERS = st.text(st.characters(min_codepoint=0x20, max_codepoint=0x24F), max_size=60)


@given(st.lists(st.one_of(st.text(max_size=60), LETTERS), max_size=5))
@settings(max_examples=300, deadline=None)
def test_words_give_the_ids_of_whole_texts(texts):
    words = WordEncoder(PATH, limit=50)
    for _ in range(2):
        assert [np.frombuffer(b, words.dtype).tolist() for b in words.encode(texts)] == [ids_of(t) for t in texts]


def test_known_hard_texts():
    texts = [r[1] for r in rows()] + ["J̌ À, K. İ. DON'T they'll 's ʼs Ⅷ x2y <|STARTOFTEXT|> <|startoftext|> a<|endoftext|>b", "Word, WORD. word", "\x85a b　c"]
    words = WordEncoder(PATH, limit=200)
    assert [np.frombuffer(b, words.dtype).tolist() for b in words.encode(texts)] == [ids_of(t) for t in texts]


def test_other_vocabularies_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    words, library = WordEncoder(path), Tokenizer.from_file(path)
    probed = WordEncoder(PATH)
    assert probed.by_word and probed.known.by_letter and not words.by_word
    texts = ["One two  three", "", None, "Été, x"]
    assert [np.frombuffer(b, words.dtype).tolist() for b in words.encode(texts)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_given_texts_word_by_word(spark, sf_dir):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    words = WordEncoder(PATH, limit=3000)
    assert [np.frombuffer(b, words.dtype).tolist() for b in words.encode(texts)] == [ids_of(t) for t in texts]


def test_files_against_the_library(spark):
    data = rows()
    found = token_digests(frame(spark, data), PATH).collect()
    want = Counter()
    for r in data:
        ids = np.array([*ids_of(r[1]), 2], "<u4")
        want[r[0], len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == want
    found.sort(key=lambda r: r["start"])
    at = 0
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in found]
    assert order == sorted(order, key=lambda d: (d is not None, d))


def test_many_parts_and_blocks(spark):
    rng = random.Random(4)
    texts = {i: sentence(rng, rng.randint(0, 300)) for i in rng.sample(range(1000), 120)}
    folder = scratch_path(spark, "tokens")
    write_token_files(plain(spark, texts), folder, PATH, 7, part_tokens=5000, block_tokens=700)
    found = sorted(read_token_files(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == sorted(texts)
    at = 0
    for r in found:
        assert r["start"] == at and np.frombuffer(r["ids"], "<u4").tolist() == [*ids_of(texts[r["doc_id"]]), 7]
        at += r["n_tokens"]
    assert spark.read.parquet(f"{folder}/blocks").select("part").distinct().count() > 3
    book = spark.read.parquet(f"{folder}/codebook").orderBy("rank").collect()
    assert [r["rank"] for r in book] == list(range(len(book))) and [r["n"] for r in book] == sorted((r["n"] for r in book), reverse=True)


def test_empty(spark):
    assert token_digests(frame(spark, []), PATH).count() == 0


def test_the_merge_model_is_looked_up_once():
    class Counted:
        looks = 0

        def __getattr__(self, name):
            return getattr(LIBRARY, name)

        @property
        def model(self):
            Counted.looks += 1
            return LIBRARY.model

    known = WordIds(Counted(), np.dtype("<u2"), 1000)
    words = ["overlong", "Été", "naïveté", "x", "Zebra,"]
    assert [np.frombuffer(known[w.encode()], "<u2").tolist() for w in words] == [ids_of(w) for w in words]
    assert Counted.looks == 1
