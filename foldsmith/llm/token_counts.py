"""Unigram token counts by forward dynamic programming over a trie of pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from foldsmith.llm.common import map_batches, slices, words

MARK = "▁"
KNOWN = 200_000  # distinct pre-tokens whose counts a task keeps from batch to batch


def vocabulary(path: str) -> dict[str, float]:
    """Pieces of a public vocabulary with log probabilities by Zipf's law over its order; control and byte pieces are left out."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    norm = math.log(math.fsum(1 / (k + 1) for k in range(len(pieces))))
    return {p: -math.log(k + 1) - norm for k, p in enumerate(pieces)}


class TrieCounter:
    """Token counts of pre-tokens under a unigram model.

    A node of the trie is a prefix of some pre-token. Its forward value, the best (log probability, fewest tokens) over
    segmentations of the prefix, is computed once when the node is made, from values on its path; a pre-token ends with
    its count stored at its last node. The trie starts anew beyond ``limit`` nodes, which bounds memory and changes no result. A
    character that no piece starts or covers counts as its UTF-8 bytes, at a log probability 10 below the least.
    """

    def __init__(self, pieces: dict[str, float], limit: int = 400_000) -> None:
        self.pieces, self.limit = pieces, limit
        self.suffixes = {p[i:] for p in pieces for i in range(len(p))}
        self.unknown = min(pieces.values(), default=0.0) - 10
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.tokens = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Tokens of one pre-token, its mark included."""
        known = self.terminal.get(word)
        if known is not None:
            return known
        if len(self.score) > self.limit:
            self.clear()
        node, path = 0, [0]
        for end, c in enumerate(word, 1):
            following = self.child.get((node, c))
            if following is None:
                following = self._grow(word, end, path)
                self.child[node, c] = following
            node = following
            path.append(node)
        self.terminal[word] = self.tokens[node]
        return self.tokens[node]

    def _grow(self, word: str, end: int, path: list[int]) -> int:
        get, score, tokens = self.pieces.get, self.score, self.tokens
        last = path[end - 1]
        best, fewest = score[last] + self.unknown, tokens[last] + len(word[end - 1].encode("utf-8", "surrogatepass"))
        for start in range(end - 1, -1, -1):
            part = word[start:end]
            if part not in self.suffixes:  # nor is anything longer that ends here the end of a piece
                break
            own = get(part)
            if own is not None:
                at = path[start]
                value = score[at] + own
                if value > best or value == best and tokens[at] + 1 < fewest:
                    best, fewest = value, tokens[at] + 1
        score.append(best)
        tokens.append(fewest)
        return len(score) - 1


_counters: dict[str, TrieCounter] = {}


def counter(path: str) -> TrieCounter:
    """One trie for a worker process."""
    if path not in _counters:
        _counters[path] = TrieCounter(vocabulary(path))
    return _counters[path]


def count_tokens(documents: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, n_words, n_tokens) per row of ``documents``, over whole texts.

    Pre-tokens are the words between ASCII white space, each behind the vocabulary's word mark. A task's distinct pre-tokens are
    counted once, a batch's new ones in sorted order, so that shared prefixes meet in the trie; a document's count is a sum over its words. Rows stay where
    they are: nothing is shuffled, and no task holds more than its trie.

    Null and blank texts have 0 of both; ids may be null or repeat; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, counts = counter(vocabulary_path), {}
        for part in slices(batches, 512):
            rows = [words(t.as_py()) for t in part.column(1)]
            if len(counts) > KNOWN:
                counts.clear()
            for w in sorted({w for row in rows for w in row} - counts.keys()):
                counts[w] = trie.count(MARK + w.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(r) for r in rows], pa.int64()),
                 pa.array([sum(map(counts.__getitem__, r)) for r in rows], pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").transform(map_batches, run, f"doc_id {kind}, n_words long, n_tokens long")
