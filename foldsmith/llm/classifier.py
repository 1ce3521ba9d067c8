"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldsmith.llm.common import map_batches, slices, words, write_table

FEATURES = ("log_words", "word_length", "long_words", "short_words", "distinct_words", "top_word", "repeat_bigrams", "dup_lines",
            "line_words", "capitals", "capital_words", "digits", "commas", "stops", "marks", "symbols", "pipes", "other_ascii", "non_ascii",
            "lower_starts", "end_marks")
CLASSES = {"capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "commas": b",;:", "stops": b".", "marks": b"!?",
           "symbols": b"#*$%&<>", "pipes": b"|", "other_ascii": b"\"'()+-/=@[\\]^_`{}~"}


def statistics(text: str | None) -> tuple[float, ...]:
    """The values of `FEATURES` of a whole text; all 0 for a text without words."""
    parts = words(text)
    if not parts:
        return (0.0,) * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    n, size = len(parts), len(raw)
    sizes = np.fromiter(map(len, parts), np.int64, n)
    often = Counter(parts)
    pairs = set(zip(parts, parts[1:]))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    share = {name: (size - len(raw.translate(None, chars))) / size for name, chars in CLASSES.items()}
    ascii_only = len(raw.translate(None, bytes(range(128, 256))))
    last = raw.rstrip()[-1:]
    return (float(np.log1p(n)), float(sizes.mean()), float((sizes > 12).mean()), float((sizes < 3).mean()), len(often) / n,
            max(often.values()) / n, 1 - len(pairs) / max(1, n - 1) if n > 1 else 0.0, 1 - len(set(lines)) / len(lines), float(np.log1p(n / len(lines))),
            share["capitals"], sum(w.isupper() for w in parts) / n, share["digits"], share["commas"], share["stops"], share["marks"],
            share["symbols"], share["pipes"], share["other_ascii"], 1 - ascii_only / size,
            sum(line[:1].islower() for line in lines) / len(lines), float(last in b".!?"))


def document_statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, stats) per row, from the text alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [statistics(t.as_py()) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "stats"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").transform(map_batches, run, f"doc_id {kind}, stats array<double>")


@dataclass
class Forest:
    """Trees as arrays: node i of a tree has children 2i + 1 and 2i + 2; a row goes right if its feature is above the cut."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of every row, all trees a level at a time."""
        trees, rows = np.arange(len(self.feature)), np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(trees)), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
        return self.base + self.value[trees, node].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0,
        least_rows: int = 10) -> Forest:
    """Boosted trees of one depth on log loss, split by gradient histograms over quantile bins.

    Rows weigh the same. A node that no split improves sends all rows left. Without rows, or with one class, there are no trees and the
    score is the smoothed share of label 1.
    """
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if len(np.unique(y)) < 2:
        return Forest(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 1)), 0, base)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1], method="lower")) for c in x.T]
    code = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    cells = code + np.arange(x.shape[1]) * bins
    width, inner = x.shape[1] * bins, (1 << depth) - 1
    features, cuts = np.zeros((trees, 2 * inner + 1), np.int64), np.full((trees, 2 * inner + 1), np.inf)
    values, margin = np.zeros((trees, 2 * inner + 1)), np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess, node = p - y, p * (1 - p), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * width + cells).ravel()
            sums = [np.bincount(at, np.repeat(v, x.shape[1]), count * width).reshape(count, x.shape[1], bins) for v in (grad, hess, np.ones(len(y)))]
            g, h, n = (s.cumsum(axis=2) for s in sums)
            g_all, h_all, n_all = g[:, :1, -1:], h[:, :1, -1:], n[:, :1, -1:]
            gain = g ** 2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all ** 2 / (h_all + ridge)
            gain[(n < least_rows) | (n_all - n < least_rows)] = -np.inf
            best = gain.reshape(count, -1).argmax(axis=1)
            worth = gain.reshape(count, -1)[np.arange(count), best] > 1e-6
            f, b = np.divmod(best, bins)
            features[t, first:first + count] = f
            cuts[t, first:first + count] = [edges[i][j] if w else np.inf for i, j, w in zip(f, b, worth)]
            mine = node - first
            node = 2 * node + 1 + (worth[mine] & (code[np.arange(len(y)), f[mine]] > b[mine]))
        g, h = (np.bincount(node, v, 2 * inner + 1) for v in (grad, hess))
        values[t] = -rate * g / (h + ridge)
        margin += values[t, node]
    return Forest(features, cuts, values, depth, base)


def held_out(doc_id: str) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1


def training_rows(stats: DataFrame, labels: DataFrame, max_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and label of at most ``max_rows`` labelled ids, those of the least hash; held-out ids are left out.

    An id that several rows share gives one row, its least statistics, so no more than ``max_rows`` rows reach the driver.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = stats.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("stats").alias("stats"), F.max("quality").alias("quality")).toArrow()
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    x = np.array(rows["stats"].to_pylist(), float).reshape(-1, len(FEATURES))
    return x[order], rows["quality"].to_numpy().astype(float)[order]


def quality_scores(documents: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``documents``.

    The trees learn ``labels`` (doc_id, quality) from a bounded sample of at most ``max_rows`` labelled ids, never from ids whose
    CRC-32 as text leaves 1 when divided by 3; statistics and scores cover every whole text. Scores come from the text alone. The model is
    some thousand numbers and is sent to the tasks whole.

    A null or blank text has the statistics 0 and gets a score too; null ids are not held out and can't be learned from; null labels are left
    out and repeated ones count once (the larger). Repeated documents get a row each. Other columns are ignored.
    """
    stats = write_table(document_statistics(documents), "stats")
    model = fit(*training_rows(stats, labels, max_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    scored = stats.transform(map_batches, run, f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
