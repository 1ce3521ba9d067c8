from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from foldsmith.llm.periodic_runs import collapse, periodic_runs, repeat_words, runs_of, scan_lags, split_rare
from foldsmith.llm.queries import QUERIES, run_digests
from tests.llm.tables import frame, rows


def brute(parts: list, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    out, n = [], len(parts)
    for q in range(1, n // times + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and parts[end] == parts[end + q]:
                end += 1
            length = end + q - at
            if end > at and length >= max(least, times * q) and not any(
                    all(parts[i] == parts[i + p] for i in range(at, at + length - p)) for p in range(1, q)):
                out.append((at, length, q))
            at = end + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def damaged(doc_id: int | None, text: str | None) -> list[bytes]:
    parts = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(parts)
    if doc_id is None or h % 10 or not n:
        return parts
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [parts[i] if i < a else parts[a + (i - a) % p] for i in range(n)]


def digests(doc_id, parts: list[bytes], found) -> tuple:
    best = None
    for start, length, q in found:
        if best is None or length * best[2] > best[1] * q:
            best = (start, length, q)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(b"".join(b"%d,%d,%d\n" % r for r in found)),
            sha(b" ".join(w for i, w in enumerate(parts) if i not in gone)))


def text_with_runs(rng: random.Random) -> list[bytes]:
    out: list[bytes] = []
    for _ in range(rng.randint(1, 5)):
        out += [b"%d" % rng.randrange(rng.choice([2, 4, 300])) for _ in range(rng.randint(0, 40))]
        unit = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 13, 20]))]
        out += (unit * 12)[:rng.randint(len(unit), len(unit) * rng.randint(2, 9))]
    return out


@pytest.mark.parametrize("seed", range(8))
def test_runs_against_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(60):
        parts = text_with_runs(rng)
        assert runs_of(parts) == brute(parts)
        assert runs_of(parts, 6, 3) == brute(parts, 6, 3) and runs_of(parts, 5, 4) == brute(parts, 5, 4)
        codes = np.array([int(p) for p in parts], np.int64)
        assert sorted(scan_lags(codes), key=lambda r: (r[0], r[2])) == brute(parts)


def test_splitting_recurses_to_stability():
    rng = random.Random(4)
    run = [1, 2, 3] * 10
    tail = [10 + i for i in range(30)]
    codes = np.array(tail[:20] + run + tail + [1, 2] + tail[20:], np.int64)
    assert split_rare(codes) == [(20, 50)]
    # 7 is frequent enough as long as the whole is one segment, and too rare once the rare 8 has split it
    left, right = [5, 6] * 12 + [7], [7] + [5, 6, 6] * 9 + [7]
    pieces = split_rare(np.array(left + [8] + right, np.int64))
    assert pieces == [(0, 24), (27, 54)]
    assert split_rare(np.array([rng.randrange(10**6) for _ in range(500)], np.int64)) == []
    assert split_rare(np.array([], np.int64)) == []


def test_long_periodic_texts():
    assert runs_of([b"a"] * 300_000) == [(0, 300_000, 1)]
    unit = [b"%d" % i for i in range(7_001)]
    assert runs_of(unit * 4) == [(0, 28_004, 7_001)]
    assert runs_of(([b"a"] * 30 + [b"b"]) * 200)[:2] == [(0, 30, 1), (0, 6_200, 31)]


def test_operator_on_awkward_rows(spark):
    data = rows() + [(77, "x y z " * 30, "en", "hot", 1, *rows()[0][5:])]
    found = periodic_runs(frame(spark, data)).collect()
    assert len(found) == len(data)
    want = [(r[0], len(p := (r[1] or "").encode().split()), [] if len(p) > 20_000 else brute(p), p) for r in data]
    key = lambda r: repr(r)
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.text) for r in found), key=key) == sorted(
        ((i, n, runs, b" ".join(collapse(p, runs)).decode()) for i, n, runs, p in want), key=key)
    assert periodic_runs(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(frame(spark, []), times=2)


def test_query_against_brute_force(spark, sf_dir):
    """All rows of the smallest tables, and awkward rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = QUERIES["op12_periodic_runs"](spark, sf_dir).collect()
    # the scan of the long texts is trusted here: brute force takes too long on them, and runs_of is compared above
    want = [digests(i, p := damaged(i, t), brute(p) if len(p) < 1_500 else runs_of(p)) for i, t in docs]
    assert sorted(map(tuple, found)) == sorted(want)
    assert sum(r[1] > 0 for r in want) > len(docs) / 20
    odd = [(i, t) for i, t, *_ in rows() if len(t or "") < 9_000]
    odd += [(i, t) for i in (8, 12, 31, 44, 66, 71) for t in ("", None, " ", "w", "a b", "a b c d " * 40)]
    got = run_digests(repeat_words(spark.createDataFrame(odd, "doc_id long, text string"))).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(digests(i, p := damaged(i, t), brute(p))) for i, t in odd)
