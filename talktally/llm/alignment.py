"""Cross-tokenizer alignment by lockstep merging.

Two tokenizers cut the same bytes of a text in two ways. The ends of both are merged as two sorted lists: the two
tokens under the pointers overlap (a link), equal ends are a cut, and whichever token ends first is left behind.
No token of either side goes over a single space between other characters, so texts are cut there into parts, and each
distinct part of a block of documents is encoded and merged once. All parts do this together: one NumPy vector holds the
pointers of every part, each step advances them and emits its links, and finished parts are taken out of the vector. A
long part is several lanes of that vector, each beginning at its own A token, because where a lane's B pointer starts
follows from a search of the ends; so the number of steps does not follow the longest part. A document's tokens, links and
groups are those of its parts one after the other. Tokenizers that may go over a space get texts as one part.

How many documents hold an id pair is counted over all rows. A block of documents writes its distinct pairs once, the
pairs meet their counts by joins, and the counts come back to the block: neither a frequent pair nor a long document
makes one task large, and nothing is broadcast.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talktally.llm.base import chunks, held, map_arrow, query, stored, table
from talktally.llm.bpe import byte_letters, tokenizer_path

LANE = 256  # A tokens of a lane
BLOCK = 4 << 20  # bytes of text in a block
PIECE = 1 << 16  # characters encoded at once
B_BITS = 32  # an id pair is A << 32 | B
# A single space between other characters always begins a new word of the byte-level tokenizer.
SPACE = re.compile(r"(?<=\S) (?=\S)")
# Where no white space follows a space, every space inside a text begins one.
RUN = re.compile(r" \s")
MEASURES = ("n_a", "n_b", "n_groups", "n_links")
RESULTS = (*MEASURES, "n_best", "count_sum", "groups_sha256")
FULL = {
    "tokens_a": "array<int>",
    "tokens_b": "array<int>",
    "links": "array<struct<a:int,b:int>>",
    "cuts": "array<struct<a:int,b:int>>",
}


class Tokenizers:
    """Both tokenizers, and the bytes and the texts of their ids."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        with open(path_a, encoding="utf-8") as file:
            spec = json.load(file)
        names = {i: t for t, i in spec["model"]["vocab"].items()}
        entries = {i: bytes(map(byte_of.__getitem__, t)) for i, t in names.items()}
        entries |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.bytes_a = pa.array([entries.get(i, b"") for i in range(max(entries) + 1)], pa.binary())
        pieces = [(self.b.is_byte(i), self.b.id_to_piece(i)) for i in range(len(self.b))]
        self.bytes_b = pa.array([bytes([int(p[3:5], 16)]) if raw else p.replace("▁", " ").encode() for raw, p in pieces], pa.binary())
        most = max(len(self.bytes_a), len(self.bytes_b))
        # Ids as text with what follows them: another id of the same side, the other side, the next group, nothing.
        self.digits = pa.array([f"{i}{after}".encode() for after in (",", "|", ";", "") for i in range(most)], pa.binary())
        self.most = most
        self.cut_a = self._byte_level(spec)
        self.cut_both = self.cut_a and self._merges_within_words([p for raw, p in pieces if not raw])

    @staticmethod
    def _byte_level(spec: dict) -> bool:
        """Whether A looks for tokens within the words of the byte-level pattern only."""
        words = {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False}
        return spec["normalizer"] is None and words.items() <= (spec["pre_tokenizer"] or {}).items() and all(t["special"] for t in spec["added_tokens"])

    def _merges_within_words(self, pieces: list[str]) -> bool:
        """Whether B takes a text as it is, behind a space, and merges (scores are ranks) nothing over the space after a word."""
        as_it_is = self.b.normalize("ﬁ  ² ") == "▁ﬁ▁▁²▁"
        return as_it_is and all(self.b.get_score(i).is_integer() for i in range(len(self.b))) and not any("▁" in p.lstrip("▁") for p in pieces)

    def parts(self, text: str) -> list[str]:
        """The text in parts, a space between them, whose tokens are those of the text on both sides."""
        if not self.cut_both:
            return [text]
        if text[0] == " " or text[-1] == " " or RUN.search(text):
            return SPACE.split(text)
        return text.split(" ")

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts one after the other and how many each has, under A, behind a space, and under B."""
        parts, owner = [], []
        for k, text in enumerate(texts):
            cut = cut_at_spaces(f" {text}") if self.cut_a and len(text) >= PIECE else [f" {text}"]
            parts += cut
            owner += [k] * len(cut)
        none = np.zeros(0, "int32")
        groups = list(self._in_groups(parts))
        ids_a, sizes = (np.concatenate([none, *x]) for x in (zip(*groups, strict=True) if groups else ((), ())))
        n_a = np.zeros(len(texts), "int64")
        np.add.at(n_a, owner, sizes)
        ids_b = self.b.encode(list(texts), num_threads=1)
        n_b = np.fromiter(map(len, ids_b), "int64", len(ids_b))
        return ids_a, n_a, np.fromiter(chain.from_iterable(ids_b), "int32", n_b.sum()), n_b

    def _in_groups(self, parts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of some parts one after the other, and their numbers; the library's results are large, so few are held at a time."""
        start = 0
        while start < len(parts):
            end, size = start, 0
            while end < len(parts) and (end == start or size + len(parts[end]) <= 4 * PIECE):
                size += len(parts[end])
                end += 1
            ids = [one.ids for one in self.a.encode_batch_fast(parts[start:end], add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), "int32", len(ids))
            yield np.fromiter(chain.from_iterable(ids), "int32", sizes.sum()), sizes
            start = end


def cut_at_spaces(text: str, most: int = PIECE) -> list[str]:
    """The text in parts of about `most` characters, cut only where no token crosses; whole where there is no such place."""
    parts, start = [], 0
    while len(text) - start > most:
        found = SPACE.search(text, start + most)
        if found is None:
            break
        parts.append(text[start : found.start()])
        start = found.start()
    return [*parts, text[start:]]


def token_bytes(names: pa.Array, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The joined bytes of all ids and the place where each ends."""
    if not len(ids):
        return b"", np.zeros(0, "int64")
    taken = names.take(pa.array(ids))
    ends = np.frombuffer(taken.buffers()[1], "int32")[1 : len(ids) + 1].astype("int64")
    return taken.buffers()[2].to_pybytes(), ends


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, rows: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (A place, B place) and cuts (A place, B place) of documents whose token ends lie one after the other.

    Both sides cover the same bytes of each document; `rows` are the documents' first A places and the end of the last one.
    """
    sizes = np.diff(rows)
    lanes = -(-sizes // lane)
    first = np.repeat(rows[:-1], lanes)
    i = first + lane * (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    stop = np.minimum(i + lane, np.repeat(rows[1:], lanes))
    begin = np.where(i > 0, ends_a[i - 1], 0)
    j = np.searchsorted(ends_b, begin, side="right")
    link_a, link_b = [], []
    while i.size:
        end_a, end_b = ends_a[i], ends_b[j]
        link_a.append(i)
        link_b.append(j)
        i, j = i + (end_a <= end_b), j + (end_b <= end_a)
        unfinished = i < stop
        if not unfinished.all():
            i, j, stop = i[unfinished], j[unfinished], stop[unfinished]
    # Of links in order, the sum of both places grows from one to the next, so it is a slot of its own.
    slots = np.full(len(ends_a) + len(ends_b), -1)
    for x, y in zip(link_a, link_b, strict=True):
        slots[x + y] = x
    taken = np.flatnonzero(slots >= 0)
    a = slots[taken]
    b = taken - a
    cut = ends_a[a] == ends_b[b]
    return a, b, a[cut], b[cut]


def starts(sizes: np.ndarray) -> np.ndarray:
    """Where each of consecutive rows begins, and the end of the last one."""
    return np.concatenate([[0], np.cumsum(sizes)])


def entries(rows: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Places of the chosen rows' entries, one row after the other."""
    sizes = np.diff(rows)[chosen]
    ends = starts(sizes)
    return np.repeat(rows[chosen] - ends[:-1], sizes) + np.arange(ends[-1])


class Parts:
    """Both sides' tokens of distinct parts of texts, and how they meet."""

    def __init__(self, tokenizers: Tokenizers, parts: list[str]):
        self.a, n_a, self.b, n_b = tokenizers.encode(parts)
        # A part whose tokens' bytes are not its own behind a space has no tokens.
        want = [f" {x}".encode() for x in parts]
        self.same = self._equal(tokenizers.bytes_a, self.a, n_a, want) & self._equal(tokenizers.bytes_b, self.b, n_b, want)
        self.a, self.b = self.a[np.repeat(self.same, n_a)], self.b[np.repeat(self.same, n_b)]
        self.rows_a, self.rows_b = starts(n_a * self.same), starts(n_b * self.same)
        ends_a, ends_b = token_bytes(tokenizers.bytes_a, self.a)[1], token_bytes(tokenizers.bytes_b, self.b)[1]
        self.link_a, self.link_b, self.cut_a, self.cut_b = lockstep(ends_a, ends_b, self.rows_a)
        # Places of the parts' first links and cuts; both are in order of their A place.
        self.rows_links, self.rows_cuts = (np.searchsorted(x, self.rows_a) for x in (self.link_a, self.cut_a))

    @staticmethod
    def _equal(names: pa.Array, ids: np.ndarray, sizes: np.ndarray, want: list[bytes]) -> np.ndarray:
        """Whether the joined bytes of each part's ids are the wanted ones."""
        data, ends = token_bytes(names, ids)
        borders = np.concatenate([[0], ends])[starts(sizes)].tolist()
        return np.array([data[x:y] == w for x, y, w in zip(borders[:-1], borders[1:], want, strict=True)], bool)

    def groups(self, tokenizers: Tokenizers) -> list[bytes]:
        """Every part's groups as text."""
        n_a, n_b = len(self.a), len(self.b)
        after_a, after_b = np.zeros(n_a, "int64"), np.zeros(n_b, "int64")
        after_a[self.cut_a] = 1
        after_b[self.cut_b] = 2
        # A token's place in the text follows from the number of tokens before it and of groups that are done.
        done_a = np.cumsum(after_a) - after_a  # cuts before the token's own group ends
        done_b = (np.cumsum(after_b) - after_b) // 2
        before_b = np.concatenate([[0], self.cut_b + 1])[done_a]  # B tokens of finished groups
        upto_a = (self.cut_a + 1)[done_b]  # A tokens up to this group's end
        after_b[self.rows_b[1:][np.diff(self.rows_b) > 0] - 1] = 3
        codes = np.empty(n_a + n_b, "int64")
        codes[np.arange(n_a) + before_b] = self.a + after_a * tokenizers.most
        codes[np.arange(n_b) + upto_a] = self.b + after_b * tokenizers.most
        data, ends = token_bytes(tokenizers.digits, codes)
        borders = np.concatenate([[0], ends])[self.rows_a + self.rows_b].tolist()
        return [data[x:y] for x, y in zip(borders[:-1], borders[1:], strict=True)]


class Block:
    """The alignment of a block of texts, put together from their parts."""

    def __init__(self, tokenizers: Tokenizers, texts: Sequence[str | None]):
        cut = [tokenizers.parts(t) if t else [] for t in texts]
        number = {x: k for k, x in enumerate(dict.fromkeys(chain.from_iterable(cut)))}
        self.parts = Parts(tokenizers, list(number))
        sizes = np.fromiter(map(len, cut), "int64", len(cut))
        places = np.fromiter(map(number.__getitem__, chain.from_iterable(cut)), "int64", sizes.sum())
        # Only texts whose parts all have their own bytes have tokens.
        same = np.diff(starts(~self.parts.same[places])[starts(sizes)]) == 0
        self.places, self.rows = places[np.repeat(same, sizes)], starts(sizes * same)
        self.n_a, self.n_b, self.n_links, self.n_groups = (
            np.diff(starts(np.diff(x)[self.places])[self.rows]) for x in (self.parts.rows_a, self.parts.rows_b, self.parts.rows_links, self.parts.rows_cuts)
        )

    def digests(self, tokenizers: Tokenizers) -> list[str]:
        """SHA-256 of every document's groups as text; of a document without tokens, an empty string."""
        groups, out = self.parts.groups(tokenizers), []
        for start, end in zip(self.rows[:-1], self.rows[1:], strict=True):
            text = b";".join(map(groups.__getitem__, self.places[start:end].tolist()))
            out.append(hashlib.sha256(text).hexdigest() if text else "")
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct id pairs, documents with each, and per document: offsets, places in the pairs, times linked."""
        parts, n = self.parts, len(self.n_a)
        keys = parts.a[parts.link_a].astype("int64") << B_BITS | parts.b[parts.link_b]
        pairs, place = np.unique(keys, return_inverse=True)
        document = np.repeat(np.arange(n), self.n_links)
        width = max(len(pairs), 1)
        own, times = np.unique(document * width + place[entries(parts.rows_links, self.places)], return_counts=True)
        places = own % width
        offsets = np.searchsorted(own, np.arange(n + 1) * width)
        holders = np.bincount(places, minlength=len(pairs))
        met = holders > 0  # others are of texts without tokens
        return pairs[met], holders[met], offsets, (np.cumsum(met) - 1)[places], times


def _lists(offsets: np.ndarray, values: np.ndarray, kind: str) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.astype(kind)))


def _positions(offsets: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
    places = pa.StructArray.from_arrays([pa.array(a.astype("int32")), pa.array(b.astype("int32"))], ["a", "b"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), places)


def _full(block: Block) -> list[pa.Array]:
    """Ids, links as token numbers of the document, and cuts as numbers of tokens in front of them."""
    parts, places = block.parts, block.places
    # Tokens of the document in front of each of its parts.
    in_front = []
    for rows, sizes in ((parts.rows_a, block.n_a), (parts.rows_b, block.n_b)):
        before = starts(np.diff(rows)[places])[:-1] - np.repeat(starts(sizes)[:-1], np.diff(block.rows))
        in_front.append(before - rows[places])
    columns = [_lists(starts(n), x[entries(rows, places)], "int32") for n, x, rows in ((block.n_a, parts.a, parts.rows_a), (block.n_b, parts.b, parts.rows_b))]
    for n, rows, a, b, more in ((block.n_links, parts.rows_links, parts.link_a, parts.link_b, 0), (block.n_groups, parts.rows_cuts, parts.cut_a, parts.cut_b, 1)):
        at, sizes = entries(rows, places), np.diff(rows)[places]
        columns.append(_positions(starts(n), a[at] + np.repeat(in_front[0], sizes) + more, b[at] + np.repeat(in_front[1], sizes) + more))
    return columns


def _aligned(docs: DataFrame, text: str, keep: Sequence[str], full: bool, paths: tuple[str, str]) -> DataFrame:
    """One row a document; the first one of a block also has the block's pairs and how many documents hold each."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    more = FULL if full else {}
    names = ["row", "block", *MEASURES, "groups_sha256", "places", "times", "pairs", "holders", *more]
    kinds = ["long"] * 5 + ["string", "array<int>", "array<int>", "array<long>", "array<int>", *more.values()]
    fields = [f"row {rows.schema['row'].dataType.simpleString()}", *(f"{n} {k}" for n, k in zip(names[1:], kinds, strict=True))]
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL(", ".join(fields[1:])).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = held(f"alignment {paths}", lambda: Tokenizers(*paths))
        task, number = TaskContext.get().partitionId(), 0
        for batch in chunks(batches, "text", BLOCK):
            if not batch.num_rows:
                continue
            block = Block(tokenizers, batch.column("text").to_pylist())
            pairs, holders, offsets, places, times = block.pairs()
            first = np.zeros(batch.num_rows + 1, "int32")
            first[1:] = len(pairs)
            columns = [
                batch.column("row"),
                pa.array(np.full(batch.num_rows, task << 24 | number)),
                *(pa.array(x.astype("int64")) for x in (block.n_a, block.n_b, block.n_groups, block.n_links)),
                pa.array(block.digests(tokenizers)),
                _lists(offsets, places, "int32"),
                _lists(offsets, times, "int32"),
                _lists(first, pairs, "int64"),
                _lists(first, holders, "int32"),
                *(_full(block) if full else []),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)
            number += 1

    return map_arrow(rows, run, schema)


def _known(aligned: DataFrame) -> DataFrame:
    """Per block: the count of each of its pairs and whether it is its A id's highest."""
    entries = F.posexplode(F.arrays_zip("pairs", "holders")).alias("place", "entry")
    held_pairs = aligned.where(F.size("pairs") > 0).select("block", entries).select(
        "block", "place", F.col("entry.pairs").alias("pair"), F.col("entry.holders").alias("holders")
    )
    counts = held_pairs.groupBy("pair").agg(F.sum("holders").alias("count")).withColumn("a", F.shiftright("pair", B_BITS))
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    rated = counts.join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    return held_pairs.select(F.col("block").alias("home"), "place", "pair").join(rated, "pair").select("home", "place", "count", "best")


def _sums(docs: pa.Table, known: pa.Table) -> pa.Table:
    """Both sums of a block's documents."""
    place = known.column("place").to_numpy()
    count, best = np.zeros(len(place), "int64"), np.zeros(len(place), "int64")
    count[place], best[place] = known.column("count").to_numpy(), known.column("best").to_numpy(zero_copy_only=False)
    lists = docs.column("places").combine_chunks()
    places, times = lists.flatten().to_numpy(), docs.column("times").combine_chunks().flatten().to_numpy().astype("int64")
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    for name, value in (("n_best", best), ("count_sum", count)):
        running = np.concatenate([[0], np.cumsum(value[places] * times)]) if len(places) else np.zeros(1, "int64")
        docs = docs.append_column(name, pa.array(running[ends[1:]] - running[ends[:-1]]))
    return docs.drop_columns(["block", "places", "times"])


def align(
    docs: DataFrame,
    text: str = "text",
    keep: Sequence[str] | None = None,
    full: bool = False,
    path_a: str | None = None,
    path_b: str | None = None,
) -> DataFrame:
    """The columns `keep` of `docs` (all by default) and how their texts' A and B tokens meet.

    n_a, n_b, n_groups, n_links; n_best and count_sum of the links, whose counts are of rows that hold the id pair
    linked, over all of `docs`; the SHA-256 of the groups. With `full` also the ids of both sides, the links as pairs of token
    numbers and the cuts as numbers of A and B tokens in front of them.
    Texts that are null or empty, or whose tokens' bytes on either side are not the text's behind a space, have no tokens: zeros, and
    an empty string for the digest. Repeated rows count each; a text of any length is one row. A kept column named like a
    new one is replaced. An empty table gives an empty one.
    """
    keep = list(docs.columns if keep is None else keep)
    paths = (path_a or tokenizer_path("byte_bpe_50k.json"), path_b or tokenizer_path("piece_bpe_32k.model"))
    aligned = stored(_aligned(docs, text, keep, full, paths), "alignment")
    carried = aligned.drop("pairs", "holders")
    new = [*RESULTS, *(FULL if full else {})]
    dropped = {"block", "places", "times"}
    fields = [*(f for f in carried.schema if f.name not in dropped), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())]
    together = carried.groupBy("block").cogroup(_known(aligned).groupBy("home"))
    summed = together.applyInArrow(_sums, T.StructType(fields))
    return summed.select(*(_field(c) for c in keep if c not in new), *new)


def _field(name: str) -> Column:
    return F.col("row").getField(name).alias(name)


@query("op11_alignment")
def op11_alignment(spark, sf_dir):
    """Both tokenizers' tokens of every text, met: groups, links, and the links' counts in the corpus."""
    return align(table(spark, sf_dir, "documents"), keep=["doc_id"])
