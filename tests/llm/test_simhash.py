from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
import xxhash

from foldsmith.llm import simhash
from foldsmith.llm.simhash import fingerprint, keep_one, near_duplicates, near_links
from tests.llm.tables import frame, rows, sentence


def naive(text: str | None, n: int = 3) -> int:
    parts = [w.lower() for w in (text or "").encode().split()]
    runs = [parts[i:i + n] for i in range(len(parts) - n + 1)] if len(parts) >= n else [parts] if parts else []
    hashes = [xxhash.xxh64(b" ".join(r), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def brute(marks: list[tuple]) -> list[int | None]:
    """Least id reachable, row by row, by comparing all pairs."""
    group = list(range(len(marks)))
    for i, (_, a) in enumerate(marks):
        for j in range(i):
            if bin(a ^ marks[j][1]).count("1") <= 2:
                old, to = group[i], group[j]
                group = [to if g == old else g for g in group]
    least = {}
    for (doc, _), g in zip(marks, group):
        if doc is not None:
            least[g] = min(doc, least.get(g, doc))
    return [least.get(g) for g in group]


def test_fingerprints(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 50)
    for _, text, *_ in rows():
        if len(text or "") < 20_000:
            assert fingerprint(text) == naive(text)
    assert fingerprint("A b C d") == fingerprint("a B\tc\nD") and fingerprint("É b c") != fingerprint("é b c")


def test_documents_against_brute_force(spark):
    data = rows()
    found = near_duplicates(frame(spark, data))
    marks = [(r[0], fingerprint(r[1])) for r in data]
    signed = [f - (1 << 64) if f >> 63 else f for _, f in marks]
    want = Counter(zip((d for d, _ in marks), signed, brute(marks)))
    assert Counter(map(tuple, found.collect())) == want
    assert near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("segments, cell_limit", [(16, 64), (16, 2), (32, 6)])
def test_links_keep_every_component(spark, segments, cell_limit):
    rng = random.Random(segments + cell_limit)
    points = set()
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(25):
            points.add(at)
            for bit in rng.sample(range(64), rng.choice([1, 1, 2, 2, 3])):
                at ^= 1 << bit
    centre = rng.getrandbits(64)
    points |= {centre ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)}
    points = sorted(points)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    links = near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), 2, segments, cell_limit).collect()
    mask = (1 << 64) - 1
    assert all(bin((r["a"] ^ r["b"]) & mask).count("1") <= 2 for r in links)
    root = {p: p for p in points}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for r in links:
        a, b = top(r["a"] & mask), top(r["b"] & mask)
        root[max(a, b)] = min(a, b)
    classes = defaultdict(set)
    for p, g in zip(points, brute(list(zip(points, points)))):
        classes[g].add(top(p))
    assert all(len(c) == 1 for c in classes.values()) and len({*map(top, points)}) == len(classes)


def test_one_of_each_group_stays(spark):
    docs = frame(spark)
    left = keep_one(docs)
    assert left.columns == docs.columns
    marks = [(r[0], fingerprint(r[1])) for r in rows()]
    stays = {(d, t[1]) for (d, _), t, g in zip(marks, rows(), brute(marks)) if d is not None and d == g}
    kept = left.where("doc_id IS NOT NULL").collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in kept) == sorted((d, t or "") for d, t in stays)
    assert left.where("doc_id IS NULL").count() == 3
    assert keep_one(docs.limit(0)).count() == 0


def test_repeated_ids_with_other_texts(spark):
    """A row counts by its id and text: each component keeps one row, also where ids repeat or two components share their least id."""
    rng = random.Random(6)
    a, b, c = (sentence(rng, 90) for _ in range(3))
    near = a.replace("a", "A")  # same words in lower case, so the same fingerprint
    data = [(0, b), (1, a), (1, b), (2, b), (3, c), (3, c), (4, near), (5, a), (5, c), (7, ""), (7, None), (7, " ")]
    docs = spark.createDataFrame([(i, t, "x", f"{i}") for i, t in data], "doc_id long, text string, fp string, one string")
    left = keep_one(docs)
    assert left.columns == docs.columns
    found = sorted(((r["doc_id"], (r["text"] or "").strip()) for r in left.collect()), key=str)
    assert found == sorted([(0, b), (1, a), (3, c), (7, "")], key=str)
    shared = spark.createDataFrame([(5, a), (5, b), (6, a), (6, b), (6, b)], "doc_id long, text string")
    assert sorted(map(tuple, keep_one(shared).collect())) == sorted([(5, a), (5, b)])


def test_one_repeated_row_holds_a_third(spark):
    rng = random.Random(3)
    hot, others = sentence(rng, 70), [sentence(rng, 70) for _ in range(40)]
    docs = spark.createDataFrame([(9, hot)] * 200 + [(100 + i, t) for i, t in enumerate(others)], "doc_id long, text string")
    assert Counter(r["doc_id"] for r in keep_one(docs.repartition(8)).collect()) == Counter([9, *(100 + i for i in range(40))])


def test_odd_distances_are_refused(spark):
    with pytest.raises(ValueError):
        near_links(spark.createDataFrame([(1,)], "fp long"), 1)
