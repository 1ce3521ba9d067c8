"""Conversation structure repair: cheapest edits by a parallel Viterbi search whose chunks converge in rank."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foldsmith.llm.common import drop_table, map_batches, slices, write_table

# what has been written so far: nothing, a system row, a user row, an assistant row
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = (USER, USER, ASSISTANT, USER)  # the role that an inserted or reroled row takes, and the state after it
ROLES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
END = (0, 4, 2, 0)  # cheapest inserts that finish a conversation in each state
GUESS = (0, 0, 0, 0)
BLOCK_BITS = 8  # a chunk has at most 256 rows

Vector = tuple[int, int, int, int]


def _kept(code: str, state: int) -> int | None:
    """The state after a row of ``code`` is kept as it is; None where its role may not follow."""
    at = {"s": (SYSTEM, (START,)), "u": (USER, (START, SYSTEM, ASSISTANT)), "a": (ASSISTANT, (USER,))}.get(code.lower())
    return at[0] if at and state in at[1] else None


@lru_cache(maxsize=1 << 16)
def _edits(code: str, state: int) -> tuple[tuple[str, int, int], ...]:
    """(initial, cost, next state) of the edits of a row, in ASCII order.

    A code is the row's role initial, ``x`` for other roles, in upper case for a truncated row, or ``d`` for one to delete.
    """
    out = [("D", DELETE, state)]
    if code != "d":
        extra = TRUNCATED if code.isupper() else 0
        if (after := _kept(code, state)) is not None:
            out.append(("K", extra, after))
        out.append(("R", REROLE + extra, FOLLOWS[state]))
    return tuple(out)


@lru_cache(maxsize=1 << 16)
def back(code: str, right: Vector) -> tuple[Vector, int]:
    """Costs to go before a row, less their least, and that least, from those behind it.

    Vectors without their least are few, since an insert or two lead from any state to any other but the start, so this is
    mostly a lookup.
    """
    raw = [min(cost + right[after] for _, cost, after in _edits(code, state)) for state in range(4)]
    user, assistant = min(raw[USER], INSERT + raw[ASSISTANT]), min(raw[ASSISTANT], INSERT + raw[USER])
    raw = [min(raw[START], INSERT + user), min(raw[SYSTEM], INSERT + user), user, assistant]
    least = min(raw)
    return tuple(v - least for v in raw), least


def sweep(codes: str, right: Vector) -> tuple[list[Vector], list[int]]:
    """Vectors before each row of a chunk, with the one behind the last row at the end, and what each row adds."""
    vectors, added = [right], []
    for code in reversed(codes):
        vector, least = back(code, vectors[-1])
        vectors.append(vector)
        added.append(least)
    return vectors[::-1], added[::-1]


@lru_cache(maxsize=1 << 16)
def _step(code: str, state: int, here: Vector, added: int, behind: Vector) -> tuple[str, int]:
    """The ASCII-least cheapest edits up to a row, inserts and then its own, and the state after them."""
    done = ""
    while True:
        moves = [(initial, after) for initial, cost, after in _edits(code, state) if cost + behind[after] == here[state] + added]
        if here[FOLLOWS[state]] + INSERT == here[state] and (not moves or moves[0][0] > "I"):
            done, state = done + "I", FOLLOWS[state]
        else:
            return done + moves[0][0], moves[0][1]


def trace(codes: str, right: Vector, state: int, last: bool) -> tuple[list[str], int]:
    """Edits of each row (inserts before it, then its own; behind the last row those that end the conversation), and the state."""
    vectors, added = sweep(codes, right)
    out = []
    for i, code in enumerate(codes):
        edits, state = _step(code, state, vectors[i], added[i], vectors[i + 1])
        out.append(edits)
    if last:
        tail = END[state] // INSERT
        out[-1] += "I" * tail
        for _ in range(tail):
            state = FOLLOWS[state]
    return out, state


def _mapped(df: DataFrame, run: Callable[[dict], tuple], names: list[str]) -> DataFrame:
    """``df`` with the columns ``names`` replaced by what ``run`` makes of a row."""
    rest = df.drop(*names).columns
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    kinds = [arrow[df.schema[n].dataType.simpleString()] for n in names]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            columns = list(zip(*map(run, part.to_pylist()))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                                             names=[*rest, *names])

    return df.select(*rest, *names).transform(map_batches, batches, StructType([df.schema[n] for n in [*rest, *names]]))


def _settle(table: DataFrame, run: Callable[[dict], tuple], given: str, result: str, others: dict[str, str], toward: str) -> DataFrame:
    """Rerun the chunks whose neighbour's ``result`` is not what they took as ``given``, until none is left.

    ``toward`` names the column with the neighbour's chunk, ``others`` what else a run gives. A pass joins narrow rows on that key, so
    the chunks of a hot conversation lie in many tasks; all that reaches the driver is whether a chunk is stale.
    """
    table = table.withColumns({n: F.lit(None).cast(kind) for n, kind in others.items()} | {"stale": F.lit(True)})
    names = list(others)
    current = write_table(_mapped(table, run, names), "settle")
    while True:
        near = current.select(F.col("chunk").alias("_near"), F.col(result).alias("_result"))
        told = current.join(near.hint("merge"), F.col(toward) == F.col("_near"), "left").drop("_near")
        told = told.withColumn("_fresh", F.coalesce("_result", given)).withColumn("stale", F.col("_fresh") != F.col(given))
        told = write_table(told.withColumn(given, F.col("_fresh")).drop("_fresh", "_result"), "told")
        if not told.where("stale").limit(1).count():
            drop_table(told)
            return current
        old, current = current, write_table(_mapped(told, run, names), "settle")
        drop_table(old)
        drop_table(told)


class Repair(NamedTuple):
    """``report``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. ``rows``: the repaired rows, conv_id,
    chunk, place, role, text, in the order of (chunk, place)."""

    report: DataFrame
    rows: DataFrame


def _ordered(conversations: DataFrame) -> DataFrame:
    """Rows in the order of conversation and turn, ``at`` being their number in it; range-partitioned, written once."""
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    name = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))
    sign = F.md5(F.concat(F.length(name).cast("string"), name, F.length("role").cast("string"), F.lit(":"), "role", "text"))
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("sign").asc(), F.col("tie").asc()]
    dealt = rows.withColumn("sign", sign).withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    dealt = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    return write_table(dealt.withColumn("at", F.monotonically_increasing_id()), "ordered")


def _coded(rows: DataFrame) -> DataFrame:
    """Per row: conv_id, at, code, initial, fault."""
    bare = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    narrow = rows.select("conv_id", "at", "sign", F.substring("role", 1, 1).alias("initial"), (bare == "").alias("empty"),
                         (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open"))
    again = narrow.groupBy("sign").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = write_table(again, "again")
    known = narrow.join(again.hint("merge"), "sign", "left")
    fault = F.when(F.col("empty"), "blank").when(F.col("at") > F.col("first"), "duplicate").when(F.col("open"), "truncated")
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(initial)).otherwise(initial)
    return known.withColumn("fault", fault).select("conv_id", "at", code.alias("code"), initial.alias("initial"), "fault")


def _chunks(coded: DataFrame) -> DataFrame:
    """Runs of at most 256 rows of a conversation: conv_id, chunk (its first row), ahead, behind, codes, initials, and fault counts."""
    packed = coded.groupBy("conv_id", F.shiftright("at", BLOCK_BITS).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("at", "code", "initial"))).alias("r"),
        *(F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")))
    joined = lambda name: F.array_join(F.transform("r", lambda x: x[name]), "")
    packed = packed.select("conv_id", F.col("r")[0]["at"].alias("chunk"), joined("code").alias("codes"), joined("initial").alias("initials"),
                           "blank", "duplicate", "truncated")
    line = Window.partitionBy("conv_id").orderBy("chunk")
    return write_table(packed.withColumn("behind", F.lead("chunk").over(line)).withColumn("ahead", F.lag("chunk").over(line))
                       .withColumn("_seen", F.coalesce(F.substring(F.lag("initials").over(line), -1, 1), F.lit(""))), "chunks")


def _illegal() -> Column:
    """Neighbours in a chunk, and across its left edge, that are not system-user, user-assistant or assistant-user."""
    line = F.concat("_seen", "initials")
    pairs = F.transform(F.sequence(F.lit(1), F.length(line) - 1), lambda i: F.substring(line, i, F.lit(2)))
    return F.when(F.length(line) > 1, F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))).otherwise(0)


def _left(row: dict) -> tuple:
    if not row["stale"]:
        return row["right"], row["left"], row["added"]
    right = tuple(row["right"] or (GUESS if row["behind"] is not None else END))
    vectors, added = sweep(row["codes"], right)
    return list(right), list(vectors[0]), sum(added)


def _traced(row: dict) -> tuple:
    if not row["stale"]:
        return row["state"], row["leaves"], row["edits"]
    state = row["state"] if row["state"] is not None else START if row["ahead"] is None else ASSISTANT
    edits, leaves = trace(row["codes"], tuple(row["right"]), state, row["behind"] is None)
    return state, leaves, edits


def repair_conversations(conversations: DataFrame) -> Repair:
    """Make every conversation's role initials read ``(s?(ua)+)?`` at least cost, and report what was wrong.

    Rows (conv_id, turn, role, text) are taken by turn, nulls first; rows of one turn by role, then by a hash of their text. A row
    has one fault at most: blank (nothing but ASCII white space), duplicate (role and text seen earlier in the conversation)
    or truncated (the last other character is none of ``.!?``). Edits: K keeps a row for 0, R gives it the role user or assistant for 2,
    D deletes it for 3 (a must for blank and duplicate rows), I inserts an empty user or assistant row for 2; a truncated row that stays
    adds 1. ``audit`` has the initials of the cheapest edits in order, the ASCII-least of equals.

    Costs to go are swept backwards in chunks of at most 256 rows, all at once: a chunk starts from a guessed vector behind its
    last row, and passes rerun the chunks whose right neighbour has since given a vector that differs by more than a constant.
    The constants add up to the cost. Edits are then traced forwards, chunk by chunk at once from guessed states, in passes
    likewise.

    Null roles and texts count as one space; null turns come first and are left out of ``gaps`` (missing turn numbers); rows without
    conv_id are a conversation of their own; repeated rows are duplicates. A conversation of blank rows ends up without rows. An
    empty table gives empty results. Other columns are ignored. A conversation may be longer than a task holds, a text is one value.
    """
    rows = _ordered(conversations)
    chunks = _chunks(_coded(rows))
    swept = _settle(chunks, _left, "right", "left", {"right": "array<int>", "left": "array<int>", "added": "bigint"}, "behind")
    traced = _settle(swept, _traced, "state", "leaves", {"state": "int", "leaves": "int", "edits": "array<string>"}, "ahead")

    turns = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("_")).groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    first = F.when(F.col("ahead").isNull(), F.element_at("left", START + 1)).otherwise(0)
    audits = F.array_sort(F.collect_list(F.struct("chunk", F.array_join("edits", "").alias("audit"))))
    found = traced.withColumn("_bad", _illegal()).groupBy("conv_id").agg(
        *(F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")), F.sum("_bad").cast("long").alias("illegal"),
        F.sum(F.col("added") + first).cast("long").alias("cost"), F.array_join(F.transform(audits, lambda a: a["audit"]), "").alias("audit"))
    turns = turns.withColumnRenamed("conv_id", "_conv")
    report = found.join(turns, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return Repair(report, _repaired(rows, traced))


def _repaired(rows: DataFrame, traced: DataFrame) -> DataFrame:
    """The rows that the edits leave and insert."""
    def places(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("role", pa.string()), ("own", pa.bool_())]))
        for part in slices(parts):
            for row in part.to_pylist():
                state, out = row["state"], []
                for code, edits in zip(row["codes"], row["edits"]):
                    line = []
                    for edit in edits:
                        if edit == "K":
                            state = _kept(code, state)
                            line.append({"role": None, "own": True})
                        elif edit in "RI":
                            state = FOLLOWS[state]
                            line.append({"role": ROLES[state], "own": edit == "R"})
                    out.append(line)
                n = len(out)
                yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]] * n, pa.int64()), pa.array(range(row["chunk"], row["chunk"] + n), pa.int64()),
                                                  pa.array(out, kind)], names=["chunk", "_at", "line"])

    lines = traced.select("chunk", "state", "codes", "edits").transform(
        map_batches, places, "chunk long, _at long, line array<struct<role:string,own:boolean>>").where(F.size("line") > 0)
    met = rows.select("conv_id", "at", "role", "text").join(lines.hint("merge"), F.col("at") == F.col("_at"))
    every = met.select("conv_id", "chunk", "at", F.col("role").alias("_role"), "text", F.posexplode("line").alias("_nth", "_new"))
    return every.select("conv_id", "chunk", F.struct(F.col("at"), F.col("_nth").alias("nth")).alias("place"),
                        F.coalesce(F.col("_new.role"), F.col("_role")).alias("role"),
                        F.when(F.col("_new.own"), F.col("text")).otherwise("").alias("text"))


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of `Repair.rows`: the hash of a conversation's ``role:text`` lines.

    Lines are joined chunk by chunk. The hash of a long conversation has to read its chunks in order, which is one task's work, but
    a stream: no more than a batch is held.
    """
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, kind = None, None, None
        for part in parts:
            kind = part.schema.field(0).type
            for conv, text in zip(part.column(0).to_pylist(), part.column(2)):
                if digest is not None and conv == at[0]:
                    digest.update(b"\n" + text.as_py().encode("utf-8", "surrogatepass"))
                    continue
                if digest is not None:
                    yield row(at[0], digest, kind)
                at, digest = (conv,), hashlib.sha256(text.as_py().encode("utf-8", "surrogatepass"))
        if digest is not None:
            yield row(at[0], digest, kind)

    def row(conv, digest, kind):
        return pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])

    line = F.struct("place", F.concat_ws(":", "role", "text").alias("line"))
    blobs = rows.groupBy("conv_id", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("text"))
    blobs = write_table(blobs, "blobs")
    many = blobs.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("_many"))
    many = write_table(many, "many")
    same = F.col("conv_id").eqNullSafe(F.col("_many"))
    short = blobs.join(many.hint("merge"), same, "left_anti").select("conv_id", F.sha2("text", 256).alias("repaired_sha256"))
    long = blobs.join(many.hint("merge"), same, "left_semi").repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return short.unionByName(long.select("conv_id", "chunk", "text").transform(map_batches, run, f"conv_id {kind}, repaired_sha256 string"))


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) with faults put in by the CRC-32 of ``conv_id:turn``, nulls being one space.

    Of twenty rows one each is dropped, loses its text, loses its full stops, comes twice, or becomes a user's.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (rows.where("_kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy"))
            .drop("_copy"))
