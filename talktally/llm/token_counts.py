"""Token counts by a linear longest-match automaton.

Greedy word-piece splitting takes the longest piece at each place. The vocabulary is a trie; where the text
leaves it, a failure link leads to the node at which matching goes on, and carries the number of pieces that
are settled on the way. Each character moves forward once or follows links already paid for, so a
word costs time in proportion to its length, and no piece is built.

Words are whole stretches without white space, in lower case (A-Z only). Pieces that start a word carry the
vocabulary's word mark. The vocabulary has a fixed size and is broadcast.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from talktally.llm.base import chunks, held, map_arrow, query, table, texts_of
from talktally.llm.bpe import tokenizer_path

MARK = "▁"
CACHED = 300_000
DEAD = -1


def pieces_of(path: str) -> list[str]:
    """The ordinary pieces of a sentence-piece vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(f(i) for f in odd)]


class Automaton:
    """Nodes are numbers; node 0 begins a word (before its mark), node 1 continues one."""

    def __init__(self, pieces: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        self.accepts = [False, False]
        for piece in pieces:
            starts = piece.startswith(MARK)
            node, rest = (0, piece[len(MARK) :]) if starts else (1, piece)
            if not rest:
                continue  # a mark alone would be a piece without a character
            for char in rest:
                to = self.next[node].get(char)
                if to is None:
                    to = self.next[node][char] = len(self.next)
                    self.next.append({})
                    self.accepts.append(False)
                node = to
            self.accepts[node] = True
        self._link()

    def _link(self) -> None:
        """fail[node]: where to go on if no child fits; popped[node]: pieces settled by going there.

        A node that is a piece settles itself and goes on at node 1. Otherwise the text since the parent's link
        is followed from there, adding what is settled on the way; without such a place the text has no split.
        """
        self.fail, self.popped = [DEAD] * len(self.next), [0] * len(self.next)
        queue = deque([0, 1])
        while queue:
            parent = queue.popleft()
            for char, node in self.next[parent].items():
                queue.append(node)
                if self.accepts[node]:
                    self.fail[node], self.popped[node] = 1, 1
                    continue
                at, settled = self.fail[parent], self.popped[parent]
                while at != DEAD and char not in self.next[at]:
                    settled += self.popped[at]
                    at = self.fail[at]
                if at != DEAD:
                    self.fail[node], self.popped[node] = self.next[at][char], settled

    def length(self, word: str) -> int:
        """Number of pieces of a word; 0 if it has no greedy split."""
        step, fail, popped = self.next, self.fail, self.popped
        node, count = 0, 0
        for char in word:
            while char not in step[node]:
                count += popped[node]
                node = fail[node]
                if node == DEAD:
                    return 0
            node = step[node][char]
        # The end of the word: settle what is open.
        while node != 1:
            count += popped[node]
            node = fail[node]
            if node == DEAD:
                return 0
        return count


_sent: dict = {}


def _broadcast(spark: SparkSession, path: str):
    key = (spark.sparkContext.applicationId, path)
    if key not in _sent:
        _sent[key] = spark.sparkContext.broadcast(pieces_of(path))
    return _sent[key]


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown (words without a split, one token each) of every row.

    Null and empty texts have none. Repeated rows are counted each; a long text is one row like any other.
    """
    path = path or tokenizer_path("piece_bpe_32k.model")
    shared = _broadcast(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, cache = held(f"pieces {path}", lambda: (Automaton(shared.value), {}))
        for batch in chunks(batches, most=2 << 20):
            words = [t.lower().split() for t in texts_of(batch)]
            seen = set().union(*words)
            new = seen.difference(cache)
            if len(cache) + len(new) > CACHED:
                cache.clear()
                new = seen
            for word in new:
                cache[word] = automaton.length(word.decode())
            each = np.fromiter(map(len, words), "int64", len(words))
            lengths = np.fromiter(map(cache.__getitem__, chain.from_iterable(words)), "int64", int(each.sum()))
            ends = np.concatenate(([0], np.cumsum(each)))
            unknown = np.concatenate(([0], np.cumsum(lengths == 0)))
            tokens = np.concatenate(([0], np.cumsum(lengths)))
            missing = unknown[ends[1:]] - unknown[ends[:-1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(each), pa.array(tokens[ends[1:]] - tokens[ends[:-1]] + missing), pa.array(missing)],
                names=["doc_id", "n_words", "n_tokens", "n_unknown"],
            )

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_tokens bigint, n_unknown bigint")


@query("op6_token_counts")
def op6_token_counts(spark, sf_dir):
    """Every document's number of word pieces."""
    return count_tokens(table(spark, sf_dir, "documents"))
