"""BPE encoding and decoding by traversal of a trie of distinct words.

In byte-pair encoding, a word's prefix has exactly one last token: the one suffix in the vocabulary
that stands validly behind the last token of what comes before it. So a trie node needs only its last
token, which follows from its ancestors' ones. The distinct words of a block of documents are walked in
sorted order, which is the depth-first order of their trie; the stack holds the states of the current path,
and a shared prefix is worked out once. A word's tokens are then read backwards along the path.

The vocabulary file is read on the driver and broadcast: its size is fixed, whatever the data.
"""

from __future__ import annotations

import gc
import json
import os
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talktally.llm.base import chunks, held, map_arrow, query, table

# Fixed values of the word-end tokenizer: contraction endings, letters, single digits, and the rest.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# Separators to str.split() that are no white space to the tokenizer.
CONTROLS = regex.compile("[\x1c-\x1f]")
WHITE = regex.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
END = "</w>"
LAST = 0x10000  # added to the last character of a word, so that it is a symbol of its own
MARKS = ".,;:!?"
CACHED = 250_000  # encoded stretches, and words, a worker keeps between blocks


def tokenizer_path(name: str = "word_bpe_49k.json", folder: str = "/opt/tokenizers") -> str:
    return os.path.join(folder, name)


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where it is printable Latin-1, else the next free one above 255."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and the validity of neighbouring tokens."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.names = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        ids = {self.symbols(t): i for t, i in model["vocab"].items()}
        self.rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = (model["vocab"][left], model["vocab"][right])
            if pair not in self.rank:
                self.rank[pair] = rank
                parts.setdefault(model["vocab"][left + right], pair)
        self.parts = parts
        self.left, self.right = {}, {}
        for i in ids.values():
            self.left[i], self.right[i] = self.spine(i, 0), self.spine(i, 1)
        # Tokens that encoding their own letters gives, by their symbols.
        self.ids = {s: i for s, i in ids.items() if len(s) == 1 or i in parts and self.stands(*parts[i], self.rank[parts[i]])}
        # Every end of a token: its id if it is a token itself, else -1.
        self.tails = dict.fromkeys((s[k:] for s in self.ids for k in range(len(s))), -1) | self.ids
        self.known: dict[int, bool] = {}
        self.packed: dict[str | int, bytes] = {}  # ids of words and of special ids, as four bytes each
        self.letters, self.table = byte_letters(), None
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    @staticmethod
    def symbols(token: str) -> str:
        return token[: -len(END) - 1] + chr(ord(token[-len(END) - 1]) + LAST) if token.endswith(END) and token != END else token

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The parts at one edge of a token, smallest first, each with the rank of the merge that consumes it."""
        out, rank = [], float("inf")
        while True:
            out.append((token, rank))
            if token not in self.parts:
                return out[::-1]
            rank = self.rank[self.parts[token]]
            token = self.parts[token][side]

    def stands(self, a: int, b: int, before: float = float("inf")) -> bool:
        """Whether no merge below rank `before` crosses the border between neighbours a and b.

        Merges happen in the order of their ranks, so the parts at the border grow along the two edges; of
        equal ranks the left one is first.
        """
        right, left, i, j = self.right[a], self.left[b], 0, 0
        while True:
            (x, until_x), (y, until_y) = right[i], left[j]
            m = self.rank.get((x, y), float("inf"))
            if m < before and m < until_x and m <= until_y:
                return False
            if until_x <= until_y:
                if until_x == float("inf"):
                    return True
                i += 1
            else:
                j += 1

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The texts of rows of ids: the tokens' names with a space between."""
        if self.table is None:
            self.table = pa.array([self.names.get(i, "") for i in range(max(self.names) + 1)])
        return pc.binary_join(pa.ListArray.from_arrays(offsets, self.table.take(pa.array(ids))), " ")

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Token ids of distinct words, given as symbols."""
        tails, known = self.tails, self.known
        if len(known) > 200_000:
            known.clear()
        out, path = {}, ""
        last, length = [0], [0]  # of the prefix of each length on the current path
        for word in sorted(words):
            size, shared, most = len(word), 0, min(len(word), len(path))
            while shared < most and word[shared] == path[shared]:
                shared += 1
            del last[shared + 1 :], length[shared + 1 :]
            for n in range(shared + 1, size + 1):
                k = n - 1
                while True:
                    token = tails.get(word[k:n])
                    if token is None:
                        raise ValueError(f"no token ends {word[:n]!r}")
                    if token >= 0:
                        if k == 0:
                            break
                        pair = last[k] << 20 | token
                        fits = known.get(pair)
                        if fits is None:
                            fits = known[pair] = self.stands(last[k], token)
                        if fits:
                            break
                    k -= 1
                last.append(token)
                length.append(n - k)
            path, n, tokens = word, len(word), []
            while n:
                tokens.append(last[n])
                n -= length[n]
            out[word] = tokens[::-1]
        return out

    def pieces(self, chunk: str) -> list[str | int]:
        """Words, as symbols, and special ids of a stretch without white space."""
        low = chunk.lower()
        if chunk.isascii() or "Σ" not in chunk and unicodedata.is_normalized("NFC", chunk):
            # The usual case, letters and at most one mark behind them, needs no pattern.
            if low.isalpha():
                return [self.word(low)]
            if low[-1] in MARKS and low[:-1].isalpha():
                return [self.word(low[:-1]), self.word(low[-1])]
        out: list[str | int] = []
        parts = self.splitter.split(chunk) if self.splitter else [chunk]
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
                continue
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            out.extend(map(self.word, PIECES.findall(part)))
        return out

    def word(self, piece: str) -> str:
        """A piece as symbols."""
        if not (piece.isascii() and piece.isalpha()):
            piece = "".join(map(self.letters.__getitem__, piece.encode()))
        return piece[:-1] + chr(ord(piece[-1]) + LAST)

    def encode_chunks(self, stretches: Iterable[str]) -> dict[str, bytes]:
        """Ids, as four bytes each, of distinct stretches without white space."""
        cut = {s: self.pieces(s) for s in stretches}
        packed, words = self.packed, {p for pieces in cut.values() for p in pieces}
        new = words.difference(packed)
        if len(packed) + len(new) > CACHED:
            packed.clear()
            new = words
        special = new.intersection(self.special.values())
        packed.update((i, np.array([i], "<i4").tobytes()) for i in special)
        packed.update((w, array("i", t).tobytes()) for w, t in self.encode_words(new - special).items())
        return {s: packed[pieces[0]] if len(pieces) == 1 else b"".join([packed[p] for p in pieces]) for s, pieces in cut.items()}


@contextmanager
def uncollected() -> Iterator[None]:
    """Without searches for cycles, which would go through the vocabulary again and again; nothing within makes any."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def split_white(text: str) -> list[str]:
    return [x for x in WHITE.split(text) if x] if CONTROLS.search(text) else text.split()


_sent: dict = {}


def _worker_state(shared) -> tuple[Vocabulary, dict[str, bytes]]:
    """One vocabulary and one bounded cache per worker process and broadcast."""
    key = shared._jbroadcast_id if hasattr(shared, "_jbroadcast_id") else hash(shared.value)
    return held(f"bpe {key}", lambda: (Vocabulary(json.loads(shared.value)), {}))


def _broadcast(spark: SparkSession, path: str | None):
    """One broadcast of a file per session, so that its workers build its vocabulary once."""
    key = (spark.sparkContext.applicationId, path or tokenizer_path())
    if key not in _sent:
        with open(key[1], encoding="utf-8") as file:
            _sent[key] = spark.sparkContext.broadcast(file.read())
    return _sent[key]


def _fields(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *more])


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """The columns of `docs` and their texts' token ids (array<int>); with `decoded`, also what these decode to.

    Null and empty texts, and those of white space only, have no ids. A long text is one row like any other;
    repeated rows are encoded each. A column already named like a new one is replaced.
    """
    kept = docs.drop(ids, *filter(None, [decoded]))
    shared = _broadcast(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, cache = _worker_state(shared)
        for batch in chunks(batches, text, 2 << 20):
            split = [split_white(t or "") for t in batch.column(text).to_pylist()]
            seen = set().union(*split)
            new = seen.difference(cache)
            if len(cache) + len(new) > CACHED:
                cache.clear()
                new = seen
            with uncollected():
                cache.update(vocabulary.encode_chunks(new))
            packed = [b"".join(map(cache.__getitem__, s)) for s in split]
            offsets = np.zeros(len(packed) + 1, "int32")
            np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
            values = np.frombuffer(b"".join(packed), "<i4")
            columns, names = [*batch.columns, pa.ListArray.from_arrays(offsets, values)], [*batch.schema.names, ids]
            if decoded:
                columns, names = [*columns, vocabulary.decode(offsets, values)], [*names, decoded]
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_arrow(kept, run, _fields(kept, f"`{ids}` array<int>", *([f"`{decoded}` string"] if decoded else [])))


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The columns of `rows` and the text of their ids: the tokens' names, joined by a space.

    Null ids give an empty text, unknown ones nothing.
    """
    kept = rows.drop(text)
    shared = _broadcast(rows.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _worker_state(shared)[0]
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                lists = [[i for i in x or () if i in vocabulary.names] for x in part.column(ids).to_pylist()]
                offsets = np.cumsum([0, *map(len, lists)]).astype("int32")
                texts = vocabulary.decode(offsets, np.array([i for x in lists for i in x], "int32"))
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, text])

    return map_arrow(kept, run, _fields(kept, f"`{text}` string"))


def digests(rows: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids as text and of the decoded text."""
    as_text = F.array_join(F.col(ids).cast("array<string>"), " ")
    return rows.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(as_text, 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    )


@query("op4_bpe")
def op4_bpe(spark, sf_dir):
    """Every text encoded and decoded; digests of both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode(docs, decoded="decoded"))
