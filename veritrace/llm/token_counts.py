"""Word-piece token counts by a linear longest-match automaton."""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

#: Word counts that a worker remembers before it starts anew.
CACHE_WORDS = 200_000


def word_piece_vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """(pieces that begin a word, pieces inside a word) of a vocabulary file of lines "base64 rank".

    A token that begins with a space begins a word, without that space; every other token is an inner piece.
    """
    first, inner = [], []
    with open(path, "rb") as lines:
        for line in lines:
            if fields := line.split():
                token = base64.b64decode(fields[0])
                if token[:1] == b" ":
                    first.append(token[1:])
                else:
                    inner.append(token)
    return [x for x in first if x], [x for x in inner if x]


class LongestMatch:
    """Counts the pieces of greedy longest-match-first word-piece segmentation in one pass over a word.

    Two tries (of first and of inner pieces) share one node table; node 0 is the root of first
    pieces, node 1 that of inner ones. When no child fits the next byte, `fail` leads to the node
    that stands for what is left after the pieces matched so far are taken off, and `popped` says
    how many pieces those are. fail = -1: the word can't be segmented and counts as one
    unknown token.
    """

    def __init__(self, first: Iterable[bytes], inner: Iterable[bytes]):
        self.step: dict[int, int] = {}
        ends = [False, False]
        for root, pieces in ((0, first), (1, inner)):
            for piece in pieces:
                node = root
                for byte in piece:
                    key = node << 8 | byte
                    if key not in self.step:
                        self.step[key] = len(ends)
                        ends.append(False)
                    node = self.step[key]
                ends[node] = True
        self.fail, self.popped = [-1] * len(ends), [0] * len(ends)
        children: list[list[tuple[int, int]]] = [[] for _ in ends]
        for key, child in self.step.items():
            children[key >> 8].append((key & 255, child))
        queue = deque([0, 1])
        while queue:
            parent = queue.popleft()
            for byte, node in children[parent]:
                if ends[node]:
                    self.fail[node], self.popped[node] = 1, 1
                else:
                    at, popped = self.fail[parent], self.popped[parent]
                    while at >= 0 and (at << 8 | byte) not in self.step:
                        popped += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[node], self.popped[node] = self.step[at << 8 | byte], popped
                queue.append(node)

    def count(self, word: bytes) -> int:
        """Number of pieces of a word; 1 for a word that has no segmentation, 0 for an empty one."""
        if not word:
            return 0
        step, fail, popped = self.step, self.fail, self.popped
        node = n = 0
        for byte in word:
            while (to := step.get(node << 8 | byte)) is None:
                if fail[node] < 0:
                    return 1
                n += popped[node]
                node = fail[node]
            node = to
        while node != 1:
            if fail[node] < 0:
                return 1
            n += popped[node]
            node = fail[node]
        return n


class _Remembered(dict):
    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        n = self[word] = self.count(word)
        return n


def token_counts(docs: DataFrame, vocabulary: tuple[list[bytes], list[bytes]]) -> DataFrame:
    """Count words and word-piece tokens of every text.

    docs: doc_id, text; other columns are ignored. vocabulary: first and inner pieces (bytes), of
    fixed size whatever the number of documents; the automaton is broadcast. Words are
    runs of non-white-space (ASCII), case counts. Returns one row per input row: doc_id,
    n_words long, n_tokens long. Null and empty texts have 0 of both; repeated rows are
    counted each; a null doc_id stays null. Texts of any length are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(LongestMatch(*vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Remembered(shared.value.count)
        for batch in batches:
            words, tokens = [], []
            for text in pc.fill_null(batch.column("text").cast(pa.large_binary()), b""):
                parts = text.as_py().split()
                words.append(len(parts))
                tokens.append(sum(map(known.__getitem__, parts)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    rows = texts_of(docs)
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
