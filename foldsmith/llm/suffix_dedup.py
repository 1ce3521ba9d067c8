"""Removal of repeated byte strings with a range-partitioned suffix array."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldsmith.llm.common import drop_table, map_batches, slices, write_table

GRAM = 32  # leading bytes by which suffixes are dealt out
STRETCH = 1 << 20  # windows of a long text that are worked on at a time
SEEN = 1 << 17  # bundles that a task remembers
FILTER_BITS = 1 << 27
HOT_BITS = 1 << 24
SLICES = 64
HOT = 2_000  # bundles with one lead above which each suffix is dealt out by itself
BUCKET_ROWS = 1 << 14
WINDOWS = 1 << 17  # suffixes sorted at a time
LEAST_ID = -(1 << 63)

C = [np.uint64(c) for c in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def grams_of(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the `GRAM` bytes from each position on."""
    eight = np.ascontiguousarray(np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,)))
    n = len(raw) - GRAM + 1
    h = eight[:n] * C[0]
    for i in range(1, GRAM // 8):
        h += eight[8 * i:8 * i + n] * C[i]
        h ^= h >> np.uint64(29)
    h *= C[4]
    h ^= h >> np.uint64(32)
    return h


def bundles(raw: bytes, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first window, number of windows, lead, hash of the lead), a long text in several parts.

    A window is a suffix cut to ``length`` bytes. Of the `GRAM`-byte strings inside it, the one of least hash (of equals the leftmost) is its
    lead, so equal windows have equal leads at equal places. Neighbouring windows with one lead are a bundle: all suffixes of a text
    fall into bundles of some 35, and a bundle needs little more room than one of its suffixes.
    """
    data = np.frombuffer(raw, np.uint8)
    width = length - GRAM + 1
    for base in range(0, len(data) - length + 1, STRETCH):
        part = data[base:base + STRETCH + length - 1]
        h = grams_of(part)
        least = h & ~np.uint64(0xFFFFFF) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[:span - width], least[width - span:])
        lead = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(lead)) + 1])
        count = np.diff(first, append=len(lead))
        yield first + base, count, lead[first] + base, h[lead[first]]


def _places(grams: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mixed = grams * C[1]
    mixed ^= mixed >> np.uint64(31)
    mask = np.uint64(bits - 1)
    return mixed & mask, mixed * C[2] >> np.uint64(64 - bits.bit_length() + 1)


def _holds(filter_: np.ndarray, grams: np.ndarray) -> np.ndarray:
    a, b = _places(grams, 8 * len(filter_))
    bit = lambda p: filter_[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1
    return (bit(a) & bit(b)).astype(bool)


def _filter(grams: DataFrame, bits: int) -> bytes:
    """Bloom filter of a table of lead hashes: a fixed number of bits, set slice by slice on the executors."""
    slots = bits // SLICES

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            p = np.unique(np.concatenate(_places(part.column(0).to_numpy().view(np.uint64), bits))).astype(np.int64)
            cuts = np.searchsorted(p, np.arange(SLICES + 1) * slots)
            rows = [(i, (p[a:b] - i * slots).astype(np.int32).tobytes()) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                                                 names=["slice", "at"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for part in slices(batches, 16):
            for i, at in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                made.setdefault(i, np.zeros(slots, bool))[np.frombuffer(at, np.int32)] = True
        for i, flags in made.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())],
                                             names=["slice", "bits"])

    dealt = grams.select("gram").transform(map_batches, deal, "slice int, at binary").repartition(SLICES, "slice")
    out = bytearray(bits // 8)
    for row in dealt.transform(map_batches, fill, "slice int, bits binary").collect():  # `bits` bits in all
        out[row.slice * slots // 8:(row.slice + 1) * slots // 8] = row.bits
    return bytes(out)


def _leads(documents: DataFrame, length: int) -> DataFrame:
    """(gram, n): hashes of leads that occur in two bundles or more, bundles of equal content in one task counting as one or two."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, bool] = {}
        for part in slices(batches):
            found = []
            for text in part.column(0):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                for first, count, _, gram in bundles(raw, length) if len(raw) >= length else ():
                    for s, n, g in zip(first.tolist(), count.tolist(), gram.tolist()):
                        sign = xxhash.xxh3_128_digest(raw[s:s + n + length - 1])
                        again = seen.get(sign)
                        if not again:  # not yet, or once: two are told, so that a lead of equal bundles counts as repeated
                            seen[sign] = again is False
                            found.append(g)
                    if len(seen) > SEEN:
                        seen.clear()
            gram, n = np.unique(np.array(found, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])

    told = documents.select("text").transform(map_batches, run, "gram long, n long")
    return write_table(told.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1"), "leads")


class _Out:
    """Rows of `_candidates`."""

    def __init__(self):
        self.key, self.lead, self.doc, self.mark, self.start, self.n, self.text = [], [], [], [], [], [], []

    def add(self, key, lead, doc, mark, start, n, text):
        for column, value in zip((self.key, self.lead, self.doc, self.mark, self.start, self.n, self.text), (key, lead, doc, mark, start, n, text)):
            column.append(value)

    def known(self, doc, mark, start, n):
        """Windows that are repeats for certain; those that follow one another make one row."""
        if self.key and self.key[-1] is None and self.doc[-1] == doc and self.mark[-1] == mark and self.start[-1] + self.n[-1] == start:
            self.n[-1] += n
        else:
            self.add(None, 0, doc, mark, start, n, None)

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(self.key, pa.binary()), pa.array(self.lead, pa.int32()), pa.array(self.doc, pa.int64()), pa.array(self.mark, pa.int64()),
             pa.array(self.start, pa.int64()), pa.array(self.n, pa.int64()), pa.array(self.text, pa.binary())],
            names=["key", "lead", "doc", "mark", "start", "n", "text"])


CANDIDATE = "key binary, lead int, doc long, mark long, start long, n long, text binary"


def _candidates(documents: DataFrame, length: int) -> DataFrame:
    """Bundles whose lead occurs again, with their bytes; a bundle that its task has met at an earlier place is only told as repeated.

    The suffixes of a bundle with a hot lead are told one by one, with the whole window as their key; the others' key is the lead.
    """
    spark = documents.sparkSession
    leads = _leads(documents.select("text"), length)
    total = leads.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = max(HOT, total >> 20)  # so at most a million leads are hot
    shared = spark.sparkContext.broadcast((_filter(leads, FILTER_BITS), _filter(leads.where(F.col("n") > often), HOT_BITS)))
    drop_table(leads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again, hot = (np.frombuffer(b, np.uint8) for b in shared.value)
        seen: dict[bytes, tuple] = {}

        def met(sign: bytes, place: tuple) -> int:
            """0 if the bytes are new here or at an earlier place than before, 1 if they are repeats, 2 if the row itself comes twice."""
            if (before := seen.get(sign)) is None or place < before:
                seen[sign] = place
                return 0
            return 2 if place == before else 1

        for part in slices(batches):
            out = _Out()
            for doc, mark, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                raw = (text or "").encode("utf-8", "surrogatepass")
                order = (doc is not None, LEAST_ID if doc is None else doc, mark)
                for first, count, lead, gram in bundles(raw, length) if len(raw) >= length else ():
                    wanted = np.flatnonzero(_holds(again, gram))
                    single = _holds(hot, gram[wanted])
                    for s, n, at, each in zip(first[wanted].tolist(), count[wanted].tolist(), lead[wanted].tolist(), single.tolist()):
                        piece = raw[s:s + n + length - 1]
                        known = met(xxhash.xxh3_128_digest(piece), (order, s))
                        if known:
                            if known == 1:
                                out.known(doc, mark, s, n)
                        elif not each:
                            out.add(raw[at:at + GRAM], at - s, doc, mark, s, n, piece)
                        else:
                            for i in range(n):
                                window = piece[i:i + length]
                                known = met(xxhash.xxh3_128_digest(window), (order, s + i)) if n > 1 else 0
                                if known == 1:
                                    out.known(doc, mark, s + i, 1)
                                elif not known:
                                    out.add(window, -1, doc, mark, s + i, 1, None)
                    if len(seen) > SEEN:
                        seen.clear()
            yield out.batch()

    return write_table(documents.select("doc", "mark", "text").transform(map_batches, run, CANDIDATE), "candidates")


def multikey_sort(data: np.ndarray, at: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings ``data[at:at + length]`` by ``group`` and content, and where each class of equal strings starts in it.

    Multikey quicksort over characters of four bytes. All blocks of a depth are partitioned together, by one quicksort of (block,
    character); only blocks of two or more go on to the next character. Lengths are equal within a group, and at least 4.
    """
    four = data[:-3].astype(np.uint32) << 24 | data[1:-2].astype(np.uint32) << 16 | data[2:-1].astype(np.uint32) << 8 | data[3:]
    order = np.argsort(group, kind="stable")
    starts = np.ones(len(order), bool)
    starts[1:] = np.diff(group[order]) != 0
    active, depth = np.arange(len(order)), 0
    while len(active):
        opens = starts[active]
        ends = np.append(opens[1:], True)
        many = ~(opens & ends)  # alone in its block
        many &= length[order[active]] > depth
        active = active[many]
        if not len(active):
            break
        item = order[active]
        character = four[at[item] + np.minimum(depth, length[item] - 4)]
        block = np.cumsum(starts[active], dtype=np.uint64)
        both = block << np.uint64(32) | character
        sort = np.argsort(both)
        order[active] = item[sort]
        both = both[sort]
        starts[active[1:]] |= both[1:] != both[:-1]
        depth += 4
    return order, np.flatnonzero(starts)


def _least_rank(rank: np.ndarray, order: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per string, whether its place is behind the earliest of its class; and per class the string at that place."""
    ranks = rank[order]
    least = np.minimum.reduceat(ranks, starts)
    sizes = np.diff(starts, append=len(order))
    late = np.empty(len(order), bool)
    late[order] = ranks > np.repeat(least, sizes)
    by_rank = np.lexsort((ranks, np.repeat(np.arange(len(starts)), sizes)))
    return late, order[by_rank[starts]]


def _runs(flags: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of the runs of set flags that stay within one owner."""
    edge = np.concatenate([[True], np.diff(owner) != 0])
    opens = flags & (edge | ~np.concatenate([[False], flags[:-1]]))
    closes = flags & np.concatenate([edge[1:] | ~flags[1:], [True]])
    first = np.flatnonzero(opens)
    return first, np.flatnonzero(closes) - first + 1


def _sort_bucket(key: list[bytes], lead: np.ndarray, place: np.ndarray, start: np.ndarray, n: np.ndarray, text: list[bytes],
                 length: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, bytes]]]:
    """Repeated windows of a bucket as (row, first window, number), and the edge classes of its hot suffixes as (row, window).

    Bundles are sorted first: of equal ones only the earliest goes on. The suffixes of bundles that share their lead with
    another are then sorted in turn.
    """
    number = {k: i for i, k in enumerate(dict.fromkeys(key))}
    keys = np.fromiter(map(number.__getitem__, key), np.int64, len(key))
    sizes = np.fromiter(map(len, text), np.int64, len(text))
    at = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(text) + bytes(4), np.uint8)
    group = np.unique(np.stack([keys, lead, n]), axis=1, return_inverse=True)[1].ravel()
    order, starts = multikey_sort(data, at, sizes, group)
    late, firsts = _least_rank(place, order, starts)
    out = [(r, int(start[r]), int(n[r])) for r in np.flatnonzero(late).tolist()]
    hot = [(r, text[r]) for r in firsts[lead[firsts] < 0].tolist()]
    edges = [min(hot, key=lambda x: x[1]), max(hot, key=lambda x: x[1])] if hot else []
    # suffixes of the bundles left
    left = np.sort(firsts[lead[firsts] >= 0])
    left = left[np.bincount(keys[left], minlength=len(number))[keys[left]] > 1]
    left = left[np.argsort(keys[left], kind="stable")]
    cut = 0
    while cut < len(left):
        upto = int(np.searchsorted(np.cumsum(n[left[cut:]]), WINDOWS)) + cut
        same = keys[left]
        end = int(np.searchsorted(same, same[min(upto, len(left) - 1)], "left")) if upto < len(left) else len(left)
        if end <= cut:
            end = int(np.searchsorted(same, same[cut], "right"))
        some = left[cut:end]
        out += _sort_windows(some, keys, lead, place, start, n, at, data, length)
        cut = end
    return out, edges


def _sort_windows(some, keys, lead, place, start, n, at, data, length) -> Iterator[tuple[int, int, int]]:
    """Repeated windows of the bundles ``some``; a large set by the place of the lead, so that few are held at a time."""
    total = int(n[some].sum())
    parts = max(1, -(-total // (4 * WINDOWS)))
    back = lead[some]  # place of the lead in the first window; one less in each window that follows
    bounds = np.unique(np.linspace(0, int(back.max()) + 1, parts + 1).astype(np.int64))
    for low, high in zip(bounds, bounds[1:]):
        skip = np.maximum(back - high + 1, 0)
        count = np.minimum(n[some], back - low + 1) - skip
        use = count > 0
        rows, skips, counts = some[use], skip[use], count[use]
        if not len(rows):
            continue
        first = np.cumsum(counts) - counts
        owner = np.repeat(np.arange(len(rows)), counts)
        inside = np.arange(len(owner)) - np.repeat(first - skips, counts)
        row = rows[owner]
        group = keys[row] * (1 << 20) + lead[row] - inside
        order, starts = multikey_sort(data, at[row] + inside, np.full(len(row), length), group)
        late = _least_rank(place[row], order, starts)[0]
        for i, m in zip(*(x.tolist() for x in _runs(late, owner))):
            yield int(row[i]), int(start[row[i]] + inside[i]), m


def _bucket(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [part for part in batches if part.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        key, text = table["key"].to_pylist(), table["text"].to_pylist()
        text = [k if t is None else t for k, t in zip(key, text)]
        lead, start, n = (table[c].to_numpy().astype(np.int64) for c in ("lead", "start", "n"))
        mark, void = table["mark"].to_numpy(), table["doc"].is_null().to_numpy(zero_copy_only=False)
        doc = table["doc"].fill_null(LEAST_ID).to_numpy()
        anchor = start + np.maximum(lead, 0)
        order = np.lexsort((anchor, mark, doc, ~void))
        step = np.zeros(len(order), np.int64)
        for column in (anchor, mark, doc, void):
            step[1:] |= column[order][1:] != column[order][:-1]
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(step)
        found, edges = _sort_bucket(key, lead, place, start, n, text, length)
        rows = np.array([r for r, *_ in found] + [r for r, _ in edges], np.int64)
        if not len(rows):
            return
        ids, k = table["doc"].take(pa.array(rows)), len(edges)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids.to_pylist(), pa.int64()), pa.array(mark[rows]), pa.array([f[1] for f in found] + [int(start[r]) for r, _ in edges], pa.int64()),
             pa.array([f[2] for f in found] + [1] * k, pa.int64()), pa.array([None] * len(found) + [w for _, w in edges], pa.binary()),
             pa.array([TaskContext.get().partitionId()] * len(rows), pa.int32())],
            names=["doc", "mark", "start", "n", "window", "bucket"])

    return run


def _repeats(documents: DataFrame, length: int) -> DataFrame:
    """(doc, mark, start, n): windows start ... start + n - 1 of a document are repeats."""
    table = _candidates(documents, length)
    sought = table.where("key IS NOT NULL")
    buckets = 1 + sought.count() // BUCKET_ROWS
    alone = F.col("lead") < 0
    ties = [F.when(alone, F.col(c)).asc_nulls_first() for c in ("doc", "mark", "start")]
    dealt = sought.repartitionByRange(buckets, F.col("key").asc(), *ties)
    found = write_table(dealt.transform(map_batches, _bucket(length), "doc long, mark long, start long, n long, window binary, bucket int"), "found")
    # a class of hot suffixes that began in an earlier bucket: its earliest here is a repeat too
    edges = found.where("window IS NOT NULL").select("doc", "mark", "start", "n", "bucket", F.min("bucket").over(Window.partitionBy("window")).alias("from"))
    spans = ("doc", "mark", "start", "n")
    return (table.where("key IS NULL").select(*spans).unionByName(found.where("window IS NULL").select(*spans))
            .unionByName(edges.where("bucket > from").select(*spans)))


def remove_repeats(documents: DataFrame, length: int = 100) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, n_bytes, spans (start, n_bytes of each maximal removed run), kept.

    Texts are bytes of UTF-8; ``kept`` is what is left, in order. A byte is removed if a string of ``length`` bytes over it also starts earlier,
    in a document of smaller doc_id or before it in the same one; strings are those of the input, may overlap, and never
    cross documents.

    Every position's suffix, cut to ``length`` bytes, takes part. Suffixes go in bundles that share a lead of 32 bytes; bundles
    whose lead occurs nowhere else hold no repeat and stay behind, by a filter of fixed size that may let others through. The
    rest is range-partitioned by its leading bytes at splitters that Spark samples; buckets sort by multikey quicksort. Suffixes
    with a hot lead are dealt out singly and by place as well, so equal ones may fill many buckets, and a bucket's first class is
    compared with the classes at the edges of earlier ones. Tasks pass on one of the equal bundles they meet.

    Null texts count as empty, texts shorter than ``length`` bytes stay whole. Rows without doc_id come before all others. Rows of one doc_id are ordered by
    a hash of their text; of rows equal in doc_id and text, the first is judged and the others are repeats of it. Other
    columns are ignored. Ids must be whole numbers.
    """
    if length < GRAM + 4:
        raise ValueError(f"length must be at least {GRAM + 4}")
    text = F.coalesce(F.col("text"), F.lit(""))
    named = documents.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))
    spans = _repeats(named, length).groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "n")).alias("windows"))
    spans = spans.select(F.col("doc").alias("_doc"), F.col("mark").alias("_mark"), "windows")
    same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark"))
    met = named.join(spans.hint("merge"), same, "left").select("doc", "mark", "text", "windows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("n_bytes", pa.int64())]))
        for part in slices(batches):
            sizes, cuts, kept = [], [], []
            for text, windows in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                sizes.append(len(raw))
                gone = merged([(w["start"], w["start"] + w["n"] + length - 1) for w in windows or ()])
                cuts.append([{"start": a, "n_bytes": b - a} for a, b in gone])
                ends = [0, *(b for _, b in gone)]
                kept.append(b"".join(raw[a:b] for a, b in zip(ends, [*(a for a, _ in gone), len(raw)])))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(cuts, kind), pa.array(kept, pa.binary())],
                                             names=["doc", "mark", "n_bytes", "spans", "kept"])

    done = met.transform(map_batches, run, "doc long, mark long, n_bytes long, spans array<struct<start:long,n_bytes:long>>, kept binary")
    kind = documents.schema["doc_id"].dataType
    return _repeated_rows(named, done, length).withColumn("doc_id", F.col("doc").cast(kind)).select("doc_id", "n_bytes", "spans", "kept")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans, touching ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _repeated_rows(named: DataFrame, done: DataFrame, length: int) -> DataFrame:
    """``done`` with the repeats of whole rows, all but one of each, removed throughout.

    Repeated rows are counted on ids and hashes; where there are none, which is the rule, nothing more is done.
    """
    again = named.groupBy("doc", "mark").agg(F.count("*").alias("rows")).where("rows > 1")
    again = write_table(again.select(F.col("doc").alias("_doc"), F.col("mark").alias("_mark"), "rows"), "again")
    if not again.limit(1).count():
        return done
    same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark"))
    single = done.join(again.hint("merge"), same, "left_anti")
    # the rows of a group are alike: one each is taken by its task's number, the others of the task are counted
    many = done.join(again.hint("merge"), same, "left_semi").withColumn("task", F.spark_partition_id())
    packed = many.groupBy("doc", "mark", "task").agg(F.count("*").alias("rows"), *(F.first(c).alias(c) for c in ("n_bytes", "spans", "kept")))
    packed = write_table(packed, "packed")
    first = packed.groupBy("doc", "mark").agg(F.min("task").alias("_first")).withColumnsRenamed({"doc": "_doc", "mark": "_mark"})
    each = packed.join(first.hint("merge"), same).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    whole = ((F.col("nth") > 1) | (F.col("task") > F.col("_first"))) & (F.col("n_bytes") >= length)
    span = F.expr("array(named_struct('start', 0L, 'n_bytes', n_bytes))")
    return single.unionByName(each.select("doc", "mark", "n_bytes", F.when(whole, span).otherwise(F.col("spans")).alias("spans"),
                                          F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept")))
