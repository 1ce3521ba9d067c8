"""Benchmark items found in documents within an error budget: exact piece hits, then Myers' bit-parallel distance."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldsmith.llm.common import map_batches, slices, write_table

BLOCK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    """Lower case, runs of white space as one blank."""
    return " ".join(text.lower().split()) if text else ""


def budget(length: int, share: float) -> int:
    """Errors allowed in an item of so many characters."""
    return int(length * share)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length with their offsets: with no more errors, one of them is intact."""
    count = min(errors + 1, len(item))
    cuts = [len(item) * i // count for i in range(count + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def pattern_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def best_match(masks: dict[str, int], size: int, text: str, stop_at: int) -> tuple[int, int]:
    """Least edit distance of the whole pattern to any substring of ``text``, and where that substring ends.

    Myers' algorithm: a column of the distance matrix is two bit vectors of vertical differences, held in one Python
    integer each whatever the pattern's length. The first end with the least distance is returned; ``stop_at`` ends the search early.
    """
    full, top = (1 << size) - 1, 1 << size - 1
    plus, minus, score = full, 0, size
    best, end = size, 0
    for at, c in enumerate(text, 1):
        equal = masks.get(c, 0)
        vertical = equal | minus
        equal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (full & ~(equal | plus))
        down = plus & equal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score < best:
            best, end = score, at
            if best <= stop_at:
                break
    return best, end


class Matcher:
    """A block of test items, ready to be looked for in texts."""

    def __init__(self, items: list[tuple[int | None, str]], share: float) -> None:
        self.items = [(i, t, budget(len(t), share)) for i, t in items]
        self.masks: dict[int, dict[str, int]] = {}
        self.hits = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, errors) in enumerate(self.items):
            for at, piece in pieces(text, errors):
                found.setdefault(piece, []).append((k, at))
        for piece, where in found.items():
            self.hits.add_word(piece, (len(piece), where))
        if found:
            self.hits.make_automaton()

    def search(self, text: str) -> Iterator[tuple[int | None, int]]:
        """(item id, least distance) of every item within its budget somewhere in the normalised ``text``.

        A piece hit fixes where the item would start, give or take the budget. Starts of one item that lie close are merged
        into one window, so a long run of hits is verified once.
        """
        if not len(self.hits):
            return
        starts: dict[int, set[int]] = {}
        for end, (size, where) in self.hits.iter(text):
            for k, at in where:
                starts.setdefault(k, set()).add(end + 1 - size - at)
        for k, found in starts.items():
            name, item, errors = self.items[k]
            size, best = len(item), errors + 1
            masks = self.masks.get(k) or self.masks.setdefault(k, pattern_masks(item))
            low = high = None
            for at in [*sorted(found), None]:
                if low is not None and (at is None or at > high + 2 * errors):
                    window = text[max(0, low - errors):max(0, high + size + errors)]
                    best = min(best, best_match(masks, size, window, 0)[0])
                    low = None
                if at is not None:
                    low, high = at if low is None else low, at
            if best <= errors:
                yield name, best


def item_blocks(benchmark: DataFrame, share: float, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int | None, str]]]:
    """Normalised non-empty items in blocks of about ``block_chars`` characters, so that what a task holds is bounded.

    Items without an id are items too, each text once; one whose text also has an id goes by that id.
    """
    plain = benchmark.select("item_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([normal(t.as_py()) for t in part.column(1)], pa.string())],
                                             names=["item_id", "text"])

    items = write_table(plain.transform(map_batches, run, plain.schema).where("text <> ''").distinct(), "items")
    named = items.where("item_id IS NOT NULL")
    items = named.unionByName(items.where("item_id IS NULL").join(named.select("text"), "text", "left_anti"))
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    place = F.xxhash64("item_id", F.when(F.col("item_id").isNull(), F.col("text")))
    for block in range(blocks):
        rows = items.where(F.pmod(place, F.lit(blocks)) == block).collect()
        yield [(r["item_id"], r["text"]) for r in rows]


def contamination(documents: DataFrame, benchmark: DataFrame, share: float = 0.08) -> DataFrame:
    """(doc_id, item_id, distance) for every row of ``documents`` and item of ``benchmark`` (item_id, text) that it contains.

    A document contains an item if some substring is within ``share`` of the item's length in edit distance, both
    lower-cased and with runs of white space as one blank; distance is the least over all substrings. Texts are searched whole. Items
    are broadcast in bounded blocks, each a pass over the documents. Null or blank texts and items match nothing; items of one id
    count as one, repeated documents are reported as often as they came in. An item without an id is reported with a null item_id, a row for
    each normalised text, or under its id if that text also has one. Other columns are ignored.
    """
    docs = documents.select("doc_id", "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long, distance long"
    out = None
    for items in item_blocks(benchmark, share):
        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, share)
            for part in slices(batches):
                ids, names, far = [], [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                    best: dict[int, int] = {}
                    nameless = []
                    for name, distance in matcher.search(normal(text.as_py())):
                        if name is None:
                            nameless.append(distance)
                        else:
                            best[name] = min(distance, best.get(name, distance))
                    ids += [doc] * (len(best) + len(nameless))
                    names += [*best, *[None] * len(nameless)]
                    far += [*best.values(), *nameless]
                yield pa.RecordBatch.from_arrays([pa.array(ids, part.column(0).type), pa.array(names, pa.int64()),
                                                  pa.array(far, pa.int64())], names=["doc_id", "item_id", "distance"])
        found = docs.transform(map_batches, run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, share: float = 0.08) -> DataFrame:
    """The rows of ``documents`` that contain no item, with an id or without; rows are judged where they lie, without a shuffle.

    Containing is as in `contamination`. Null and empty texts contain nothing and stay; so do rows without doc_id that contain
    nothing; repeated rows stay or go together. An empty benchmark or table changes nothing.
    """
    out, at = documents, documents.columns.index("text")
    for items in item_blocks(benchmark, share):
        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, share)
            for part in slices(batches):
                clean = [next(matcher.search(normal(t.as_py())), None) is None for t in part.column(at)]
                yield part.filter(pa.array(clean, pa.bool_()))
        out = out.transform(map_batches, run, documents.schema)
    return out
