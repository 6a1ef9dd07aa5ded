"""Token counts by a linear longest-match automaton.

Greedy word-piece matching takes the longest piece of the vocabulary that
begins the rest of a word, again and again. The automaton is the trie of the
pieces; each node has a failure link to the node that stands for what is left
after the pieces that matching must give off there, and the number of these
popped pieces. A word is read once from left to right, and the number of its
pieces is a sum of popped counts; pieces are never built.
"""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.tables import releasing, small_batches, table

VOCABULARY = "piece_bpe_32k.model"
#: Fixed value: the sign that opens a word in the vocabulary file.
OPEN = "▁"
#: Distinct words whose counts a worker remembers, about 150 bytes each; then it starts anew.
MEMORY = 400_000


def read_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model; those for unknown, control and byte fallback are not matched."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]


class Automaton:
    """next: by node, its children by character. fail and popped: by node, where matching goes on and how many pieces it gave off; -1: nowhere."""

    def __init__(self, pieces: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        ends = [False]
        for piece in pieces:
            node = 0
            for c in piece:
                child = self.next[node].get(c)
                if child is None:
                    child = len(self.next)
                    self.next[node][c] = child
                    self.next.append({})
                    ends.append(False)
                node = child
            ends[node] |= node > 0
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for c, child in self.next[node].items():
                if ends[child]:
                    self.fail[child], self.popped[child] = 0, 1
                else:
                    at, popped = self.fail[node], self.popped[node]
                    while at >= 0 and c not in self.next[at]:
                        popped += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[child], self.popped[child] = self.next[at][c], popped
                queue.append(child)

    def count(self, word: str) -> int:
        """The number of pieces of the greedy match; 1, the unknown piece, where none covers the word."""
        node, total = 0, 0
        for c in word:
            while c not in self.next[node]:
                total += self.popped[node]
                node = self.fail[node]
                if node < 0:
                    return 1
            node = self.next[node][c]
        while node > 0:
            total += self.popped[node]
            node = self.fail[node]
        return total if node == 0 else 1


class _Memo(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = out = self.automaton.count(OPEN + word)
        return out


@functools.cache
def _memo(pieces: tuple[str, ...]) -> _Memo:
    """One for each Python worker and vocabulary."""
    return _Memo(Automaton(pieces))


def _count(pieces):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(pieces.value)
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column(1):
                words = (text.as_py() or "").split()
                n_words.append(len(words))
                n_tokens.append(sum(map(memo.__getitem__, words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], schema=schema)

    return run


def count_tokens(docs: DataFrame, pieces: list[str]) -> DataFrame:
    """doc_id, n_words and n_tokens of every row of `docs` (doc_id, text).

    Words are what white space parts in the whole text; each is matched with
    the opening sign before it. A word without a match is one unknown token.
    Null and empty texts have none of either. The pieces, whose number the
    vocabulary file bounds, are broadcast.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(pieces))
    return docs.select("doc_id", "text").mapInArrow(releasing(_count(shared)), "doc_id long, n_words long, n_tokens long")


def op5_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """All rows; null and empty texts have no words and no tokens."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    return count_tokens(table(spark, sf_dir, "documents"), read_pieces(vocabulary))


QUERIES = {"op5_token_counts": op5_token_counts}
ORACLE: dict[str, str] = {}
