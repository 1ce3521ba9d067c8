"""Quality rules whose thresholds come from the documents' own language and source."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from foldsmith.llm.common import drop_table, map_batches, pack, slices, unpack, words, write_table

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(set(range(256)) - set(range(65, 91)))

# metric: numerator, denominator, and the least the numerator grows by: a repeated window shows in two places, of three words each
METRICS = {
    "symbols": ("n_symbols", "n_words", 1),
    "dup_lines": ("n_dup_lines", "n_lines", 1),
    "repeats": ("n_repeat_words", "n_words", 6),
    "word_length": ("word_chars", "n_words", 1),
    "capitals": ("n_upper", "word_chars", 1),
    "marks": ("n_marks", "n_words", 1),
}


def counts(text: str | None) -> tuple[int, ...]:
    """The values of `COUNTS` of a whole text; all 0 for null."""
    if not text:
        return (0,) * len(COUNTS)
    raw, parts = text.encode("utf-8", "surrogatepass"), words(text)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    blank = len(raw) - sum(map(len, parts))
    return (len(parts), len(text) - blank, sum(map(raw.count, (bytes([s]) for s in SYMBOLS))), len(lines) - len(set(lines)),
            _repeat_words(parts), len(lines), len(raw.translate(None, CAPITALS)), raw.count(b"!"))


def _repeat_words(parts: list[bytes], width: int = 3) -> int:
    """Words inside a window of ``width`` words that occurs twice or more."""
    windows = list(zip(*(parts[i:] for i in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    total, end = 0, 0
    for i, window in enumerate(windows):
        if often[window] > 1:
            total += i + width - max(i, end)
            end = i + width
    return total


def measure(documents: DataFrame) -> DataFrame:
    """``documents`` with the columns of `COUNTS` added in place of any of these names."""
    plain = documents.drop(*COUNTS)
    at = plain.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = list(zip(*(counts(t.as_py()) for t in part.column(at)))) or [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(r, pa.int64()) for r in rows)],
                                             names=[*part.schema.names, *COUNTS])

    return plain.transform(map_batches, run, StructType([*plain.schema, *(StructField(name, LongType()) for name in COUNTS)]))


def bucket(value: Column) -> Column:
    """Sketch bucket of a non-negative long: exact below 64, then 32 buckets for every doubling."""
    shift = F.greatest(F.length(F.bin(value)) - F.lit(6), F.lit(0))
    return (shift * 32).cast("long") + F.call_function("shiftright", value, shift)


def bucket_floor(code: Column) -> Column:
    """The least value of a bucket."""
    shift = F.greatest(F.floor(code / F.lit(32)) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", code - (shift * 32).cast("long"), shift)


def metric(name: str) -> Column:
    """Thousandths, rounded down; null where the denominator is 0."""
    over, under, _ = METRICS[name]
    return F.expr(f"CASE WHEN {under} > 0 THEN ({over} * 1000) div {under} END")


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): a quantile sketch per group and metric.

    A sketch is its bucket counts. Counts of any two sketches add up to the sketch of their union, whatever the order, so
    partitions, sources and languages merge exactly; a quantile is off by at most 1/32 of its value. A group has at
    most some hundred buckets a metric, however many documents it has, and a hot source is combined map-side.
    """
    cells = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), bucket(metric(m)).alias("bucket")) for m in METRICS)))
    return (measured.select("lang", "source", cells.alias("c")).where("c.bucket IS NOT NULL")
            .groupBy("lang", "source", "c.metric", "c.bucket").agg(F.count("*").alias("n")))


def _quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, size, low, high, top): quartiles and ninth decile of each group's merged sketch.

    The lower quartile is the floor of its bucket, the others stand for the whole of theirs.
    """
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "metric")
    run = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("size", F.sum("n").over(group))
    at = lambda share: F.min(F.when(F.col("upto") * 20 >= F.col("size") * share, F.col("bucket")))
    cut = run.groupBy(*keys, "metric").agg(F.max("size").alias("size"), at(5).alias("low"), at(15).alias("high"), at(18).alias("top"))
    last = lambda c: bucket_floor(F.col(c) + 1) - 1
    return cut.select(*keys, "metric", "size", bucket_floor(F.col("low")).alias("low"), last("high").alias("high"), last("top").alias("top"))


QUANTILES = ("low", "high", "top")


def _shrunk(weight: int, parent: str) -> dict[str, Column]:
    """A group's quantiles drawn towards its parent's as if ``weight`` documents of the parent were among its own."""
    return {q: F.expr(f"(size * {q} + {weight} * {parent}{q}) div (size + {weight})") for q in QUANTILES}


def thresholds(sketch: DataFrame, spread: int = 6, weight: int = 100) -> DataFrame:
    """(lang, source, and per metric the slopes and offsets of two bounds on a document's thousandfold numerator).

    The quantiles of a language and source are drawn towards their language's, and a language's towards the whole corpus's, by
    ``weight`` documents. Where the lower quartile is above 0, a value may lie ``spread`` quartile distances above the upper quartile.
    Where a quarter of the documents has none of what is counted, quartiles say little: the numerator may reach ``spread``
    times what the ninth decile lets expect (rounded up to the next thousandth, as values are rounded down), plus ``spread`` events. No bound is above that of the whole corpus, so a group that is
    largely junk does not set its own.
    """
    sketch = write_table(sketch, "sketch")
    named = lambda df, prefix: df.withColumnsRenamed({c: prefix + c for c in df.columns})
    whole = named(_quantiles(sketch, []).drop("size"), "w_")
    lang = _quantiles(sketch, ["lang"]).join(whole, F.col("metric") == F.col("w_metric")).withColumns(_shrunk(weight, "w_"))
    lang = named(lang.drop("size", "w_metric"), "l_")
    group = (_quantiles(sketch, ["lang", "source"]).join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("metric") == F.col("l_metric")))
             .withColumns(_shrunk(weight, "l_")))

    def bound(prefix: str) -> tuple[Column, Column]:
        low, high, top = (F.col(prefix + q) for q in QUANTILES)
        unit = F.create_map(*(F.lit(x) for m, (_, _, u) in METRICS.items() for x in (m, u)))[F.col("metric")]
        return F.when(low > 0, high + spread * (high - low)).otherwise(spread * (top + 1)), F.when(low > 0, 0).otherwise(1000 * spread * unit)

    (slope, offset), (most_slope, most_offset) = bound(""), bound("l_w_")
    bounds = {"slope": slope, "offset": offset, "most_slope": most_slope, "most_offset": most_offset}
    wide = group.withColumns(bounds).groupBy("lang", "source").agg(
        *(F.max(F.when(F.col("metric") == m, F.col(b)).cast("long")).alias(f"{b}_{m}") for m in METRICS for b in bounds))
    table = write_table(wide, "thresholds")
    drop_table(sketch)
    return table


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with base_failed and kept; joined with the thresholds of its language and source, nulls being equal."""
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    within = F.lit(True)
    for m, (over, under, _) in METRICS.items():
        least = F.least(*(F.col(f"{kind}slope_{m}") * F.col(under) + F.col(f"{kind}offset_{m}") for kind in ("", "most_")))
        within &= F.coalesce((F.col(under) == 0) | (1000 * F.col(over) <= least), F.lit(True))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return joined.withColumn("base_failed", base).withColumn("kept", ~base & within).drop(
        "_lang", "_source", *(c for c in limits.columns if c.partition("slope_")[2] in METRICS or c.partition("offset_")[2] in METRICS))


def quality_verdicts(documents: DataFrame, spread: int = 6, weight: int = 100) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text, lang, source): doc_id, lang, source, the counts, base_failed, kept.

    Base rules reject a text of fewer than 50 words or with over half of its words in repeated windows. Others are kept if no
    metric is above the adaptive threshold of their language and source (`thresholds`). Null text counts as empty (rejected as too
    short); null languages and sources are groups of their own; repeated rows are judged alike. Other columns are ignored.
    """
    measured = write_table(measure(documents.select("doc_id", "text", "lang", "source")).drop("text"), "measured")
    return judge(measured, thresholds(sketches(measured), spread, weight))


def keep_good(documents: DataFrame, spread: int = 6, weight: int = 100) -> DataFrame:
    """The rows of ``documents`` that `quality_verdicts` keeps, with all their columns.

    Null and empty texts go, as too short; null languages and sources are groups of their own; repeated rows are judged alike and all
    stay or go; rows without doc_id are judged like others. An empty table stays empty.
    """
    own = ("text", "lang", "source")
    measured = write_table(measure(pack(documents, *own)), "measured")
    kept = judge(measured, thresholds(sketches(measured), spread, weight)).where("kept")
    return unpack(kept, documents.columns, *own)
