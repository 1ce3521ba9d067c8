"""Source mixing by temperature: a bisected exponent, token budgets, and permutations in blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from foldsmith.llm.common import map_batches, pack, unpack, write_table

WORD = r"[^\x20\x09-\x0D]+"
STEPS, ROUNDS, DIGITS = 32, 6, 6


def hash_key(*parts: Column) -> Column:
    """60-bit number from the MD5 of the parts joined by ``|``, null as empty text."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, 15), 16, 10).cast("long")


def with_keys(documents: DataFrame, seed: int) -> DataFrame:
    """``documents`` with _n, the words of the whole text, and _key, which gives each source's permutation."""
    return documents.withColumn("_n", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")).withColumn(
        "_key", hash_key(F.lit(seed), F.col("doc_id"), F.col("text")))


def solve_exponent(sources: DataFrame, repetition: float | None = 2.0, entropy: float | None = None) -> float:
    """The exponent in [0, 1] that meets the target, for ``sources`` with a share column ``p``.

    With ``repetition``, the least exponent whose most repeated source is read at most so many times as often as the
    least repeated one. With ``entropy`` (a share of the largest possible entropy), the largest exponent that reaches
    it, or 0. Both change one way with the exponent, so the bracket is cut in `STEPS` equal parts by one aggregate a round; the
    shares stay in Spark however many sources there are. Rounded to `DIGITS` digits on the side that meets the target.
    """
    if (repetition is None) == (entropy is None):
        raise ValueError("give either repetition or entropy")
    shares = sources.where("p > 0")
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / STEPS for i in range(STEPS + 1)]
        a, log = F.col("a"), F.log("p")
        rows = (shares.select("p", F.explode(F.array(*map(F.lit, grid))).alias("a")).groupBy("a").agg(
            F.sum(F.exp(a * log)).alias("z"), F.sum(F.exp(a * log) * a * log).alias("s"), F.count("*").alias("n"),
            (F.max((a - 1) * log) - F.min((a - 1) * log)).alias("r")).orderBy("a").collect())
        if not rows:
            return 1.0
        if repetition is not None:
            good = [r["r"] <= math.log(repetition) + 1e-12 for r in rows]
            first = good.index(True)
            if first == 0:
                return grid[0]
            low, high = grid[first - 1], grid[first]
        else:
            good = [math.log(r["z"]) - r["s"] / r["z"] >= entropy * math.log(r["n"]) - 1e-12 for r in rows]
            last = max((i for i, g in enumerate(good) if g), default=0)
            if last == STEPS:
                return grid[-1]
            low, high = grid[last], grid[last + 1]
    scale = 10 ** DIGITS
    return math.ceil(high * scale) / scale if repetition is not None else math.floor(low * scale) / scale


def budgets(facts: DataFrame, repetition: float | None = 2.0, entropy: float | None = None) -> DataFrame:
    """(source, tokens, weight, budget) from (source, _n).

    Weights are the shares to the solved power, normalised. The budget of all tokens is the least that reads every
    document of every source once; each source's part of it is its budget in tokens.
    """
    sources = write_table(facts.groupBy("source").agg(F.sum("_n").alias("tokens")), "sources")
    total, most = sources.agg(F.sum("tokens"), F.max("tokens")).first()
    if not total:
        return sources.withColumns({"weight": F.lit(0.0), "budget": F.lit(0).cast("long")})
    shares = write_table(sources.withColumn("p", F.col("tokens") / F.lit(total)), "shares")
    power = solve_exponent(shares, repetition, entropy)
    lifted = F.when(F.col("p") > 0, F.pow("p", F.lit(power))).otherwise(0.0)
    norm = shares.agg(F.sum(lifted)).first()[0]
    least = F.pow(F.col("tokens") / F.lit(most), F.lit(power - 1))
    budget = F.when(F.col("tokens") > 0, F.greatest("tokens", F.floor(F.col("tokens") * least).cast("long"))).otherwise(0)
    return write_table(shares.select("source", "tokens", F.round(lifted / F.lit(norm), 9).alias("weight"), budget.alias("budget")),
                       "budgets")


def offsets(facts: DataFrame, part_rows: int = 1 << 20) -> DataFrame:
    """``facts`` (source, _key, _n and others) with _start: the tokens of the source's rows with a smaller key.

    Rows are range-partitioned by source and key, so a hot source spreads over many tasks; each task keeps a running sum,
    and a small table with one row per source and partition shifts them. Rows of one source and key share a start.
    """
    parts = max(facts.sparkSession.sparkContext.defaultParallelism, -(-facts.count() // part_rows))
    ordered = facts.repartitionByRange(parts, "source", "_key").sortWithinPartitions("source", "_key")
    names = ordered.columns
    s, k, n = (names.index(c) for c in ("source", "_key", "_n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, key, total, start = TaskContext.get().partitionId(), object(), None, 0, 0
        for batch in batches:
            out = np.empty(batch.num_rows, np.int64)
            for i, (source, at, tokens) in enumerate(zip(*(batch.column(j).to_pylist() for j in (s, k, n)))):
                if source != last:
                    last, key, total = source, None, 0
                if at != key:
                    key, start = at, total
                out[i] = start
                total += tokens
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out), pa.array([part] * batch.num_rows, pa.int32())],
                                             names=[*names, "_start", "_part"])

    schema = StructType([*ordered.schema, StructField("_start", LongType()), StructField("_part", IntegerType())])
    placed = write_table(ordered.transform(map_batches, run, schema), "placed")
    sums = placed.groupBy("source", "_part").agg(F.sum("_n").alias("_sum"))
    sums = write_table(sums.withColumnsRenamed({"source": "_source", "_part": "_p"}).withColumn(
        "_before", F.expr("sum(_sum) OVER (PARTITION BY _source ORDER BY _p) - _sum")).drop("_sum"), "sums")
    joined = placed.join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("_start", F.col("_start") + F.col("_before")).drop("_source", "_p", "_part", "_before")


def mixture(documents: DataFrame, repetition: float | None = 2.0, entropy: float | None = None, block_tokens: int = 1_000_000,
            seed: int = 7) -> DataFrame:
    """The mixed corpus in reading order: (doc_id, source, n_tokens, weight, epoch, block, slot), a row per reading of a document.

    A source's documents lie in the order of a keyed hash of doc_id and text and are read round and round until the
    source's budget is used; a reading belongs to the block in which it begins. Every block takes from each source its
    weight's share of ``block_tokens``; within a block readings are ordered by ``slot``, a hash of block, epoch and document.
    Every document is read at least once, and no source is read more than ``repetition`` times as often as another (for a
    target ``entropy`` there is no such limit).

    Tokens are words between ASCII white space, not a tokenizer's tokens: text without word spaces counts for little, and a source of it
    gets a wrong weight and budget.

    Null text has 0 tokens. A source without tokens is read once; a document without tokens in another source is read as often as the budget
    reaches its place, at least once. A null source is a source of its own. Rows that
    agree in doc_id and text share a place and are read equally often. Other columns are ignored.
    """
    facts = write_table(with_keys(documents.select("doc_id", "text", "source"), seed).drop("text"), "facts")
    limits = budgets(facts, repetition, entropy)
    whole = limits.agg(F.sum("budget")).first()[0] or 0
    blocks = max(1, -(-whole // block_tokens))
    limits = limits.withColumnRenamed("source", "_source")
    rows = offsets(facts).join(limits, F.col("source").eqNullSafe(F.col("_source")))
    readings = F.when(F.col("tokens") > 0, F.greatest(F.lit(1), F.ceil((F.col("budget") - F.col("_start")) / F.col("tokens")))).otherwise(1)
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), readings.cast("long") - 1)))
    at = F.expr(f"least({blocks - 1}, ((epoch * tokens + _start) * {blocks}L) div greatest(budget, 1L))").cast("long")
    rows = rows.withColumn("block", at)
    return rows.select("doc_id", "source", F.col("_n").alias("n_tokens"), "weight", "epoch", "block",
                       hash_key(F.col("block"), F.col("epoch"), F.col("_key")).alias("slot"))


def mix_documents(documents: DataFrame, repetition: float | None = 2.0, entropy: float | None = None, seed: int = 7) -> DataFrame:
    """``documents`` with every row as often as `mixture` reads it.

    How often follows from the row's source and key alone: whole rounds, and one more up to the key where the budget ends. So
    only a row per source is joined to the texts. Rows are not dealt to blocks or ordered; block, epoch and slot are `mixture`'s.

    A null source is a source of its own. Null and empty texts have no words, take nothing of the budget, and are read at least once; repeated rows
    and rows without doc_id are read like others. An empty table stays empty.
    """
    own = ("doc_id", "text", "source")
    keyed = with_keys(pack(documents, *own), seed)
    facts = write_table(keyed.select("source", "_key", "_n"), "facts")
    limits = budgets(facts, repetition, entropy).withColumnRenamed("source", "_source")
    placed = offsets(facts).join(limits, F.col("source").eqNullSafe(F.col("_source")))
    rest = F.expr("CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END")
    # rows behind all tokens of a source whose budget is whole rounds: documents without words that begin no last round
    behind = (F.col("tokens") > 0) & (F.col("_start") >= F.col("tokens")) & (rest == 0)
    cuts = placed.where((F.col("_start") < rest) | behind).groupBy("_source").agg(
        F.max(F.when(F.col("_start") < rest, F.col("_key"))).alias("_cut"), F.min(F.when(behind, F.col("_key"))).alias("_tail"))
    table = limits.alias("l").join(cuts.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")), "left")
    table = write_table(table.select("_source", F.expr("CASE WHEN tokens > 0 THEN budget div tokens ELSE 1 END").alias("_full"), "_cut", "_tail"),
                        "cuts")
    rows = keyed.join(table, F.col("source").eqNullSafe(F.col("_source")))
    often = F.col("_full") + F.coalesce((F.col("_key") <= F.col("_cut")).cast("long"), F.lit(0))
    often = F.greatest(F.lit(1), often - F.coalesce((F.col("_key") >= F.col("_tail")).cast("long"), F.lit(0)))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), often))).transform(
        unpack, documents.columns, *own)
