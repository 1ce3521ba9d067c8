"""Periodic runs of words: recursive frequency splitting, then a lag scan of what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from foldsmith.llm.common import map_batches, slices, words

LEAST, TIMES = 24, 3
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

RUN = "struct<start:long,length:long,period:long>"
RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def split_rare(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """(start, end) of the segments that may hold a run of at least ``least`` words and ``times`` periods.

    Every word of such a run occurs ``times`` times in it, so a word that occurs less often in its segment is in no run of
    it and splits it. The pieces are counted anew, all of a round at once, until no piece has a rare word.
    """
    done: list[tuple[int, int]] = []
    starts, ends = np.array([0]), np.array([len(codes)])
    span = int(codes.max(initial=0)) + 1
    while True:
        long = ends - starts >= least
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return sorted(done)
        sizes = ends - starts
        first = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(starts)), sizes)
        at = np.arange(len(owner)) + np.repeat(starts - first, sizes)
        if len(starts) == 1:
            often = np.bincount(codes[at], minlength=span)[codes[at]] >= times
        else:
            _, where, n = np.unique(owner * span + codes[at], return_inverse=True, return_counts=True)
            often = n[where] >= times
        stable = np.logical_and.reduceat(often, first)
        done += zip(starts[stable].tolist(), ends[stable].tolist())
        often &= ~np.repeat(stable, sizes)
        inner = np.ones(len(at), bool)
        inner[first] = False  # has a left neighbour in its segment
        opens = often & ~(inner & np.concatenate([[False], often[:-1]]))
        closes = often & ~np.concatenate([(often & inner)[1:], [False]])
        starts, ends = at[opens], at[closes] + 1


def _agree(codes: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many words from ``at`` on, going right (step 1) or left (-1), equal the word ``lag`` further right."""
    end, total, width = (len(codes) - lag - at if step > 0 else at + 1), 0, 64
    while total < end:
        width = min(2 * width, end - total)
        low = at + total if step > 0 else at - total - width + 1
        same = (codes[low:low + width] == codes[low + lag:low + lag + width])[::step]
        if not same.all():
            return total + int(same.argmin())
        total += width
    return total


def scan_lags(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a segment, every lag being tried.

    A run of period q and three or more periods holds two equal neighbouring blocks of q words that start at multiples of q, so for each lag
    only such blocks are compared, by prefix sums of a polynomial hash: n log n comparisons over all lags. What they hit
    is compared word by word and extended to both sides. Lags rise, so a stretch whose smallest period divides the lag has
    been found before.
    """
    n = len(codes)
    powers = np.cumprod(np.full(n + 1, BASE, np.uint64)) * pow(int(BASE), -1, 1 << 64)
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * powers[:n])])
    found: list[tuple[int, int, int]] = []
    known = np.empty((0, 3), np.int64)  # start, end, period
    for lag in range(1, n // times + 1):
        block = np.diff(sums[::lag])
        hits = np.flatnonzero(block[:-1] * powers[lag] == block[1:]) * lag
        if not len(hits):
            continue
        cover = known[lag % known[:, 2] == 0]
        k = 0
        while k < len(hits):
            at = int(hits[k])
            over = cover[(cover[:, 0] <= at) & (cover[:, 1] >= at + 2 * lag)]
            if len(over):
                k = max(k + 1, int(np.searchsorted(hits, over[:, 1].max() - 2 * lag, "right")))
                continue
            right = _agree(codes, at, lag, 1)
            start, end = at - (_agree(codes, at - 1, lag, -1) if at else 0), at + right + lag
            if end - start >= max(least, times * lag) and not ((known[:, 0] == start) & (known[:, 1] == end)).any():
                found.append((start, end - start, lag))
                known = np.vstack([known, [[start, end, lag]]])
            k = max(k + 1, int(np.searchsorted(hits, at + right - lag, "right")))
    return found


def runs_of(parts: list[bytes], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text's words, by start, then period."""
    if len(parts) < max(least, times):
        return []
    number = {w: i for i, w in enumerate(dict.fromkeys(parts))}
    codes = np.fromiter(map(number.__getitem__, parts), np.int64, len(parts))
    out = [(low + s, length, q) for low, high in split_rare(codes, least, times) for s, length, q in scan_lags(codes[low:high], least, times)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(parts: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains behind its first period."""
    if not runs:
        return parts
    keep = np.ones(len(parts), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [parts[i] for i in np.flatnonzero(keep)]


def periodic_runs(documents: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, n_words, runs (start, length, period), text without repeats.

    Words are runs of characters other than ASCII white space. A run is a maximal stretch of at least ``least`` words and ``times``
    (three or more) of its smallest period; runs are listed by start, then period, overlapping ones too. The text is its words joined by
    one blank, without those that a run contains behind its first period. Null and empty texts have no words, no runs and an
    empty text. Rows without doc_id and repeated rows are treated like any other; other columns are ignored. A text is worked on
    whole, by one task.
    """
    if times < 3 or least < 1:
        raise ValueError("a run needs at least three periods")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            n, runs, texts = [], [], []
            for text in part.column(1):
                parts = words(text.as_py())
                found = runs_of(parts, least, times)
                n.append(len(parts))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                texts.append(b" ".join(collapse(parts, found)).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(runs, pa.list_(RUN_TYPE)), pa.array(texts, pa.string())],
                                             names=["doc_id", "n_words", "runs", "text"])

    schema = StructType([documents.schema["doc_id"], StructField("n_words", LongType()),
                         StructField("runs", documents.sparkSession.range(0).select(F.lit(None).cast(f"array<{RUN}>").alias("r")).schema["r"].dataType),
                         StructField("text", StringType())])
    return documents.select("doc_id", "text").transform(map_batches, run, schema)


def strongest(runs: Column) -> Column:
    """The run of greatest exact length / period, of equals the one of least start, then period; null without runs."""
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def repeat_words(documents: DataFrame) -> DataFrame:
    """``documents`` with repetition put into a tenth of the texts, chosen and shaped by the CRC-32 of doc_id.

    From word a on, such a text goes on with copies of its p words from a. Texts without words or doc_id stay as they are.
    """
    chosen = F.crc32(F.col("doc_id").cast("string"))
    parts = documents.withColumn("_h", chosen).withColumn("_words", F.when(
        F.col("_h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    sized = parts.withColumn("_n", F.size("_words")).withColumn("_g", F.expr("_h div 10"))
    placed = sized.withColumn("_a", F.expr("IF(_n > 0, _g % _n, 0)")).withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    text = F.expr("""IF(_n > 0, concat_ws(' ', slice(concat(slice(_words, 1, CAST(_a AS INT)), flatten(array_repeat(
        slice(_words, CAST(_a + 1 AS INT), CAST(_p AS INT)), CAST(1 + (_n - _a) div _p AS INT)))), 1, _n)), text)""")
    return placed.withColumn("text", text).select(documents.columns)
