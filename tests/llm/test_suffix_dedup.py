from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from foldsmith.llm import suffix_dedup
from foldsmith.llm.queries import QUERIES, suffix_digests
from foldsmith.llm.suffix_dedup import bundles, merged, multikey_sort, remove_repeats
from tests.llm.tables import frame, plain, rows, sentence


def brute(texts: list[tuple[object, bytes]], length: int = 100) -> list[tuple]:
    """(id, n_bytes, removed spans, kept) in the given order of documents, by a table of all strings."""
    seen, out = set(), []
    for i, raw in texts:
        spans = []
        for at in range(len(raw) - length + 1):
            if (string := raw[at:at + length]) in seen:
                if spans and at <= spans[-1][1]:
                    spans[-1][1] = at + length
                else:
                    spans.append([at, at + length])
            seen.add(string)
        gone = set()
        for a, b in spans:
            gone |= set(range(a, b))
        out.append((i, len(raw), [(a, b - a) for a, b in spans], bytes(c for k, c in enumerate(raw) if k not in gone)))
    return out


def digest(row) -> tuple:
    i, n, spans, kept = row
    return (i, n, sum(m for _, m in spans), len(spans), hashlib.sha256(kept).hexdigest())


def passages(seed: int) -> dict[int, str]:
    """Documents made of own and shared pieces; a piece may be cut, and repeat in one document."""
    rng = random.Random(seed)
    shared = [sentence(rng, 30)[:rng.choice([60, 99, 100, 101, 140, 300])] for _ in range(6)]
    texts = {}
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 6)):
            part = rng.choice(shared) if rng.random() < 0.5 else sentence(rng, rng.randint(1, 25))
            cut = rng.choice([0, 0, 3, 20])
            parts.append(part[cut:])
        texts[i * 3] = rng.choice(["", " ", "\n"]).join(parts)
    texts |= {200: texts[3], 201: texts[3], 1: texts[9], 202: "ab" * 400, 203: "x" * 350, 204: "x" * 99, 205: "x" * 100, 206: None, 207: ""}
    return texts


def check(found, want):
    got = Counter((r.doc_id, r.n_bytes, tuple(tuple(s) for s in r.spans), bytes(r.kept)) for r in found.collect())
    assert got == Counter((i, n, tuple(spans), kept) for i, n, spans, kept in want)


@pytest.mark.parametrize("hot, seen, windows", [(2_000, 1 << 18, 1 << 18), (2, 1, 1 << 18), (3, 40, 64)])
def test_against_brute_force(spark, monkeypatch, hot, seen, windows):
    """Usual leads, hot leads (dealt out suffix by suffix to tiny buckets), and large bundles sorted in parts."""
    for name, value in {"HOT": hot, "SEEN": seen, "WINDOWS": windows, "BUCKET_ROWS": 60 if hot < 9 else 500, "FILTER_BITS": 1 << 14, "HOT_BITS": 1 << 12}.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    texts = passages(hot)
    want = brute([(i, (t or "").encode()) for i, t in sorted(texts.items())])
    check(remove_repeats(plain(spark, texts).repartition(8)), want)
    assert sum(bool(spans) for _, _, spans, _ in want) > 30


def test_full_filters_lose_nothing(spark, monkeypatch):
    """A filter so small that it lets everything through, and takes every lead for hot."""
    monkeypatch.setattr(suffix_dedup, "FILTER_BITS", 1 << 9)
    monkeypatch.setattr(suffix_dedup, "HOT_BITS", 1 << 9)
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", 3_000)
    texts = dict(list(passages(5).items())[:30])
    check(remove_repeats(plain(spark, texts)), brute([(i, (t or "").encode()) for i, t in sorted(texts.items())]))


@pytest.mark.parametrize("length", [36, 64, 157])
def test_other_lengths(spark, length):
    texts = passages(length)
    check(remove_repeats(plain(spark, texts), length), brute([(i, (t or "").encode()) for i, t in sorted(texts.items())], length))


def test_bundles_partition_the_windows(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRETCH", 256)
    rng = random.Random(2)
    for raw in (sentence(rng, 300).encode(), b"a" * 1_000, b"ab" * 300, bytes(rng.randrange(2) for _ in range(700))):
        at, lead_of = 0, {}
        for first, count, lead, gram in bundles(raw, 100):
            for s, n, p, g in zip(first.tolist(), count.tolist(), lead.tolist(), gram.tolist()):
                assert s == at and s + n - 1 <= p and p + 32 <= s + 100
                at += n
                for i in range(s, s + n):  # equal windows have equal leads at equal places
                    assert lead_of.setdefault(raw[i:i + 100], (p - i, g)) == (p - i, g)
        assert at == len(raw) - 99


def test_multikey_sort():
    rng = random.Random(3)
    strings = [(rng.randrange(3), bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(1, 2)))) for _ in range(400)]
    length = {0: 5, 1: 9, 2: 100}
    strings = [(g, (s * 100)[:length[g]]) for g, s in strings]
    data = np.frombuffer(b"".join(s for _, s in strings) + bytes(4), np.uint8)
    sizes = np.array([len(s) for _, s in strings])
    order, starts = multikey_sort(data, np.cumsum(sizes) - sizes, sizes, np.array([g for g, _ in strings]))
    ranked = [strings[i] for i in order]
    assert ranked == sorted(strings)
    assert starts.tolist() == [i for i in range(len(ranked)) if i == 0 or ranked[i] != ranked[i - 1]]
    assert merged([(5, 9), (0, 2), (2, 3), (6, 7), (20, 21)]) == [(0, 3), (5, 9), (20, 21)]


def test_awkward_rows(spark, monkeypatch):
    """Null ids and texts, repeated ids, repeated rows, a very long text, clashing names; order within an id is by a hash."""
    monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", 400)
    data = rows()
    data += [data[2], data[2], (2, sentence(random.Random(7), 80), *data[2][2:]), (9_000, data[50][1][3:], *data[2][2:])]
    df = frame(spark, data)
    marks = {(r.doc_id, r.text): r.mark for r in df.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) mark").collect()}
    order = sorted((r[0] is not None, r[0] or 0, marks[r[0], r[1]], (r[1] or "").encode()) for r in data)
    want = brute([(i if there else None, raw) for there, i, _, raw in order])
    check(remove_repeats(df), want)
    assert remove_repeats(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(df, 30)


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = [digest(r) for r in brute([(i, (t or "").encode()) for i, t in sorted(docs, key=lambda r: r[0])])]
    assert sorted(map(tuple, QUERIES["op11_suffix_dedup"](spark, sf_dir).collect())) == want
    assert suffix_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
