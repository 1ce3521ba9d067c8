"""SimHash near-duplicates, joined through a grid over segment popcounts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from foldsmith.llm.common import drop_table, map_batches, pack, slices, unpack, words, write_table
from foldsmith.llm.graph import connected_components

CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the shingles' XXH64, A-Z lower-cased; 0 for a text without words.

    A bit is set if it is set in over half of the hashes, repeats included. A text of fewer words than ``shingle``
    has one shingle, the whole sequence. Hashes are counted in chunks, so a long text needs little memory.
    """
    parts = [w.lower() for w in words(text)]
    if not parts:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    runs = zip(*(parts[i:] for i in range(shingle))) if len(parts) >= shingle else iter([parts])
    ones, total = np.zeros(64, np.int64), 0
    while chunk := [digest(join(run), seed) for run in islice(runs, CHUNK)]:
        bits = np.unpackbits(np.array(chunk, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(chunk)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            marks = np.array([fingerprint(t.as_py(), shingle) for t in part.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(marks.view(np.int64))], names=["doc_id", "fp"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").transform(map_batches, run, f"doc_id {kind}, fp long")


def cells(fp: np.ndarray, segments: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``fp``, cell) for the grid cells within Manhattan distance ``radius`` of each fingerprint's vector of
    segment popcounts; a cell's code packs its popcounts."""
    bits = 64 // segments
    width = np.uint64(bits.bit_length())
    shifts = np.arange(segments, dtype=np.uint64)
    parts = fp.view(np.uint64)[:, None] >> shifts * np.uint64(bits) & np.uint64((1 << bits) - 1)
    points, owner = np.bitwise_count(parts).astype(np.int8), np.arange(len(fp))
    for _ in range(radius):
        moved = [points]
        for i in range(segments):
            for step in (-1, 1):
                near = points.copy()
                near[:, i] += step
                moved.append(near)
        owner = np.tile(owner, len(moved))
        points = np.concatenate(moved)
        inside = ((points >= 0) & (points <= bits)).all(axis=1)
        points, owner = points[inside], owner[inside]
    codes = np.bitwise_or.reduce(points.astype(np.uint64) << shifts * width, axis=1).view(np.int64)
    if radius > 1:
        owner, codes = np.unique(np.stack([owner, codes]), axis=1)
    return owner, codes


def spread(points: DataFrame, segments: int, radius: int) -> DataFrame:
    """(fp, cell) rows of the distinct fingerprints in column ``fp``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1024):
            fp = part.column(0).to_numpy()
            owner, codes = cells(fp, segments, radius)
            yield pa.RecordBatch.from_arrays([pa.array(fp[owner]), pa.array(codes)], names=["fp", "cell"])

    return points.select("fp").transform(map_batches, run, "fp long, cell long")


def near_links(marks: DataFrame, max_bits: int = 2, segments: int = 16, cell_limit: int = 64) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``fp``) that join all pairs at ``max_bits`` or fewer bits.

    A fingerprint becomes the vector of its segments' popcounts; the Manhattan distance of two vectors is never above
    the bit distance. Every fingerprint enters the grid cells within ``max_bits / 2`` steps of its vector, so vectors within
    ``max_bits`` of each other meet in a cell, and pairs that meet are verified by bit distance. Cells of up to
    ``cell_limit`` fingerprints are paired. Fingerprints of fuller cells go to the finest grid, one bit a segment,
    where the vector is the fingerprint: all that meet in a cell are within ``max_bits``, so each is linked to the cell's
    least one and no pairs are made. No link between components is lost; ``max_bits`` must be even.
    """
    if max_bits % 2 or segments not in (16, 32, 64):
        raise ValueError("max_bits must be even and segments 16, 32 or 64")
    radius = max_bits // 2
    keyed = spread(marks, segments, radius)
    met = write_table(keyed.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high"))
                      .where("n > 1"), "cells")
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= max_bits
    twos = met.where("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b")).where(near(F.col("a"), F.col("b")))
    more = write_table(keyed.join(met.where("n > 2").select("cell", (F.col("n") > cell_limit).alias("full")), "cell"), "members")
    some = more.where("NOT full").groupBy("cell").agg(F.collect_list("fp").alias("all")).select("all", F.explode("all").alias("a"))
    some = some.select("a", F.explode(F.filter("all", lambda b: (b > F.col("a")) & near(F.col("a"), b))).alias("b"))
    fine = more.where("full").select("fp").distinct()
    fine = write_table(spread(fine, 64, radius), "fine")
    least = write_table(fine.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("a")).where("n > 1").drop("n"), "least")
    stars = fine.join(least, "cell").where("fp <> a").select("a", F.col("fp").alias("b"))
    links = write_table(twos.unionByName(some).unionByName(stars).distinct(), "links")
    for table in (met, more, fine, least):
        drop_table(table)
    return links


def _classes(documents: DataFrame, shingle: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (fp, root, component_id) of every fingerprint; a component's root is a fingerprint."""
    marks = write_table(fingerprints(documents, shingle), "marks")
    points = write_table(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "points")
    tied = connected_components(near_links(points, max_bits))
    tied = write_table(tied.join(points, tied["node"] == points["fp"]).select("fp", "component", "first_id"), "tied")
    least = write_table(tied.groupBy("component").agg(F.min("first_id").alias("component_id")), "least")
    tied = tied.join(least, "component").select("fp", "component", "component_id")
    return marks, write_table(points.join(tied, "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"), F.coalesce("component_id", "first_id").alias("component_id")),
                              "classes")


def near_duplicates(documents: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``documents``: the least doc_id reachable over links of ``max_bits`` or fewer bits.

    Copies are reduced to distinct fingerprints by a map-side combined aggregate before any link is sought, so a large
    group of copies is one grid point. Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows
    come back as often as they came in. A row without doc_id takes part and gets its component's least id, null if
    no member has one. Other columns are ignored.
    """
    marks, classes = _classes(documents, shingle, max_bits)
    return marks.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def _with_fingerprint(packed: DataFrame, shingle: int) -> DataFrame:
    at = packed.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            marks = np.array([fingerprint(t.as_py(), shingle) for t in part.column(at)], np.uint64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(marks.view(np.int64))], names=[*part.schema.names, "_fp"])

    return packed.transform(map_batches, run, StructType([*packed.schema, StructField("_fp", LongType())]))


def keep_one(documents: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``documents`` with one row left of each component: one with the least doc_id.

    Of the component's rows with that id, one of the least fingerprint and then of the least text hash stays. Ids may repeat, with
    equal or other texts: rows are told apart by their fingerprints, and a repeated row is reduced by a map-side combined
    aggregate. Null and empty texts are one component. A row without doc_id stays, as no id can stand for it. An empty table
    stays empty.
    """
    marks, classes = _classes(documents, shingle, max_bits)
    least = marks.join(classes.hint("merge"), "fp").where("doc_id = component_id").groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("one"))
    stay = write_table(least.select(F.col("one.doc_id").alias("_id"), F.col("one.fp").alias("_mark")), "stay")
    often = marks.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    often = write_table(often.select(F.col("doc_id").alias("_often")), "often")
    packed = pack(documents, "doc_id", "text")
    alone = stay.join(often.hint("merge"), F.col("_id") == F.col("_often"), "left_anti")
    kept = packed.join(alone.hint("merge"), F.col("doc_id") == F.col("_id"), "left_semi").unionByName(packed.where("doc_id IS NULL"))
    if often.limit(1).count():
        several = stay.join(often.hint("merge"), F.col("_id") == F.col("_often"), "left_semi")
        rows = packed.join(several.select("_id").distinct().hint("merge"), F.col("doc_id") == F.col("_id"), "left_semi").transform(_with_fingerprint, shingle)
        rows = rows.join(several.hint("merge"), (F.col("doc_id") == F.col("_id")) & (F.col("_fp") == F.col("_mark")), "left_semi")
        one = rows.groupBy("doc_id", "_fp").agg(F.min_by(F.struct("text", "_row"), F.xxhash64("text")).alias("one"))
        kept = kept.unionByName(one.select("doc_id", "one.text", "one._row"))
    return unpack(kept, documents.columns, "doc_id", "text")
