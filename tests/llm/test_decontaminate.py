from __future__ import annotations

import random

from foldsmith.llm.decontaminate import best_match, budget, contamination, drop_contaminated, normal, pattern_masks, pieces
from tests.llm.tables import frame, plain, sentence


def brute(item: str, text: str) -> int:
    """Least edit distance of the item to any substring, by the plain matrix."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        diagonal, row[0] = row[0], 0
        for i, p in enumerate(item, 1):
            diagonal, row[i] = row[i], min(diagonal + (p != c), row[i] + 1, row[i - 1] + 1)
        best = min(best, row[-1])
    return best


def test_bit_parallel_distance():
    rng = random.Random(3)
    for _ in range(300):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 150)))
        if rng.random() < 0.5:
            text = text[:20] + item[:rng.randint(0, 90)] + text[20:]
        best, end = best_match(pattern_masks(item), len(item), text, 0)
        assert best == brute(item, text)
        assert brute(item, text[:end]) == best


def test_pieces_cover_the_item():
    for item, errors in (("abcdefghij", 3), ("ab", 5), ("x", 0)):
        found = pieces(item, errors)
        assert "".join(p for _, p in found) == item and all(item[a:a + len(p)] == p and p for a, p in found)


def edited(rng: random.Random, text: str, errors: int) -> str:
    out = list(text)
    for _ in range(errors):
        at = rng.randrange(len(out))
        rng.choice([lambda: out.pop(at), lambda: out.insert(at, "q"), lambda: out.__setitem__(at, "z")])()
    return "".join(out)


def test_against_brute_force(spark):
    rng = random.Random(9)
    items = {i: sentence(rng, 30).replace("ß", "b") for i in range(6)}
    docs = {}
    for d in range(40):
        hidden = [edited(rng, items[i], rng.randint(0, int(0.12 * len(items[i])))) for i in rng.sample(range(6), rng.randint(0, 2))]
        docs[d] = " ".join([sentence(rng, 20), *hidden, sentence(rng, 20)]).upper().replace(" ", "\n ", 3)
    items |= {7: None, 8: "", 9: "tiny"}
    bench = spark.createDataFrame([*items.items(), (1, items[1]), (None, items[2])], "item_id long, text string")
    want = set()
    for d, text in docs.items():
        for i, item in items.items():
            if normal(item):
                far = brute(normal(item), normal(text))
                if far <= budget(len(normal(item)), 0.08):
                    want.add((d, i, far))
    found = contamination(plain(spark, docs), bench)
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 10
    clean = drop_contaminated(plain(spark, docs), bench)
    assert {r["doc_id"] for r in clean.collect()} == set(docs) - {d for d, _, _ in want}


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rng = random.Random(2)
    items = {i: sentence(rng, 20) for i in range(8)}
    docs = plain(spark, {i: sentence(rng, 5) + " " + t for i, t in items.items()})
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    whole = sorted(contamination(docs, bench).collect())
    monkeypatch.setattr("foldsmith.llm.decontaminate.item_blocks.__defaults__", (100,))
    assert sorted(contamination(docs, bench).collect()) == whole and len(whole) == 8


def test_items_without_an_id(spark, monkeypatch):
    rng = random.Random(4)
    texts = [sentence(rng, 20) for _ in range(5)]
    docs = plain(spark, {i: f"{sentence(rng, 5)} {t} {sentence(rng, 5)}" for i, t in enumerate(texts)} | {9: sentence(rng, 30)})
    bench = spark.createDataFrame([(0, texts[0]), (None, texts[0].upper()), (None, texts[1]), (None, texts[1].replace(" ", "  ")), (None, texts[2]),
                                   (None, None), (None, " "), (3, texts[3])], "item_id long, text string")
    for size in (4_000_000, 100):
        monkeypatch.setattr("foldsmith.llm.decontaminate.item_blocks.__defaults__", (size,))
        found = {(r["doc_id"], r["item_id"], r["distance"]) for r in contamination(docs, bench).collect()}
        assert found == {(0, 0, 0), (1, None, 0), (2, None, 0), (3, 3, 0)} and contamination(docs, bench).count() == 4
        assert {r["doc_id"] for r in drop_contaminated(docs, bench).collect()} == {4, 9}


def test_awkward_tables(spark):
    docs = frame(spark)
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(docs, none).count() == 0
    assert drop_contaminated(docs, none).count() == docs.count()
    one = spark.createDataFrame([(1, docs.where("doc_id = 2").first()["text"])], "item_id long, text string")
    kept = drop_contaminated(docs, one)
    assert kept.columns == docs.columns and kept.where("doc_id = 2").count() == 0 and kept.where("doc_id IS NULL").count() == 3
    assert contamination(docs.limit(0), one).count() == 0
