"""Language-model scores from a log-frequency Bloom filter.

Counts of word pairs are quantised on a logarithmic scale, rounded down; a pair of code q is put into the filter q
times, as (pair, 1) .. (pair, q). A code is read back by probing these in turn until one is missing, so errors
only raise a code. The probability of a word after another is its quantised share of what followed that word, plus what
is left (counts lost to rounding and to pairs met less than `least` times, and a prior weight) spread by discounted
single-word probabilities. All words never met in training are one outcome, as in the base.

After any word the probabilities of all outcomes add up to 1, but for the filter's errors. Each word of the vocabulary is
a chance of error at the first level, so that level has as many hash functions as keep the weight that all errors after a
word are expected to add below a hundredth, whatever the size of the vocabulary; the levels above only meet pairs that are there.

The filter is built in segments by tasks, each from the pairs its hash selects. Filter and word counts are broadcast
while they stay below `limit` bytes. Beyond, each block of texts sends its distinct words and pairs to the segments they would be looked
up in, and gets counts and codes back in the same order, without the keys: the same filter and the same codes, so the same scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talktally.llm.base import chunks, map_arrow, query, release, stored, table, texts_of
from talktally.llm.tokens import ODD, hash64, hashed_texts, mixed

LEAST, BASE, PRIOR = 2, 1.5, 2.0  # pairs met less often are left out; step of the scale; weight of single words
HASHES, MARGIN = 16, 6  # hash functions of a level; those of the first one beyond the bits of the number of words
PLACE_BITS = 20
SEGMENT_BITS = 1 << PLACE_BITS
SLICE = 1 << 15  # keys probed at a time at the first level
PART = 1 << 18  # bytes of text scored at a time
BLOCK = 16 << 20  # bytes of text that ask the segments together
ROUNDS = 2  # shares of the segments that are asked one after the other, each with half of the keys on disk
LIMIT = 256 << 20
END = np.uint64(hash64(b"\0end of text"))


def code_of(n: Column, least: int = LEAST) -> Column:
    """The code of a count from `least` up: 1 for the first step."""
    return (F.floor(F.log(n / least) / F.log(F.lit(BASE)) + 1e-9) + 1).cast("int")


def value_of(code, least: int = LEAST):
    """The smallest count of a code, of a Column or array; of 0, 0."""
    if isinstance(code, Column):
        return F.when(code > 0, least * F.pow(F.lit(BASE), code - 1)).otherwise(0.0)
    return np.where(code > 0, least * BASE ** (code - 1.0), 0.0)


def _sequences(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, the token before each, tokens per text): words and one end a text; before the first stands an end."""
    words, counts = hashed_texts(texts_of(batch))
    tokens = np.insert(words, np.cumsum(counts), END)
    before = np.empty_like(tokens)
    before[0], before[1:] = END, tokens[:-1]
    return tokens, before, counts + 1


def pair_key(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """One hash of both words' full ones."""
    return before * ODD + tokens


def _counted(kind: int, keys: np.ndarray, heads: np.ndarray) -> pa.RecordBatch:
    """(kind, key, half, n) of distinct keys; half is the upper half of `heads`, which is equal where keys are."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    half = (heads[order[first]] >> np.uint64(32)).astype("uint32").view("int32")
    n = np.diff(np.append(first, len(keys))).astype("int32")
    columns = [np.full(len(first), kind, "int32"), keys[first].view("int64"), half, n]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "key", "half", "n"])


def count(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(kind, key, half, n): words (0) by hash, and pairs (1) met `least` times and more by pair key, over all texts.

    `half` is half of the hash of the word, of a pair's first one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=1 << 20):
            tokens, before, _ = _sequences(batch)
            yield _counted(0, tokens, tokens)
            yield _counted(1, pair_key(before, tokens), before)

    counted = map_arrow(docs.select("text"), run, "kind int, key bigint, half int, n int")
    counted = counted.groupBy("kind", "key", "half").agg(F.sum("n").alias("n"))
    return stored(counted.where((F.col("kind") == 0) | (F.col("n") >= least)), "lm-counts")


def single(n, discount: float, kinds: int, total: int):
    """Probability of a word by its count, which may be 0: all unknown words together."""
    lost = (discount * kinds + 1) / (total + 1)
    if isinstance(n, Column):
        return F.when(n > 0, (n - discount) / (total + 1)).otherwise(lost)
    return np.where(n > 0, (n - discount) / (total + 1), lost)


class Model:
    """Tables of a trained model and the numbers that go with them; `least` 1 keeps all pairs.

    Words that share half of their hash (one in a thousand of ten million) are taken to be followed by what follows
    either; their probabilities then add up to less than 1.
    """

    def __init__(self, docs: DataFrame, least: int = LEAST):
        self.least = least
        counts = count(docs, least)
        self.pairs = counts.where("kind = 1").select("key", "half", code_of(F.col("n"), least).alias("code"))
        followed = self.pairs.groupBy("half").agg(F.sum(value_of(F.col("code"), least)).cast("float").alias("followed"))
        words = counts.where("kind = 0").select("key", F.col("n").cast("int").alias("n"), "half").join(followed, "half", "left")
        self.words = stored(words.select("key", "n", F.coalesce("followed", F.lit(0.0).cast("float")).alias("followed")), "lm-words")
        n = F.col("n")
        t = self.words.agg(
            F.count("*").alias("v"), F.sum("n").alias("n"), F.count_if(n == 1).alias("once"), F.count_if(n == 2).alias("twice"), F.count_if(n >= least).alias("paired")
        ).first()
        self.kinds, self.total = t.v, t.n or 0
        self.discount = t.once / (t.once + 2 * t.twice) if t.once else 0.0
        self.first_hashes = int(t.paired).bit_length() + MARGIN
        pairs, inserted = self.pairs.agg(F.count("*"), F.coalesce(F.sum("code"), F.lit(0))).first()
        needed = (pairs * self.first_hashes + (inserted - pairs) * HASHES) / np.log(2)
        self.segments = int(needed // SEGMENT_BITS) + 1

    @property
    def bytes(self) -> int:
        return self.kinds * 16 + self.segments * SEGMENT_BITS // 8  # at most: words met once take 8

    def in_segments(self, keys: DataFrame, key: str = "key") -> DataFrame:
        """Segments follow the order of the keys' upper halves."""
        return keys.withColumn("segment", F.shiftrightunsigned(F.shiftrightunsigned(key, 32) * F.lit(self.segments), 32))

    def filter(self) -> np.ndarray:
        """The filter's segments one after the other, each built by a task."""
        first = self.first_hashes

        def build(group: pa.Table) -> pa.Table:
            release()
            return pa.table({"segment": group.column("segment")[:1], "bits": [_segment(group, first).tobytes()]})

        map_arrow(self.pairs.limit(0), lambda b: b, self.pairs.schema)  # the package's path, for grouped tasks too
        pairs = self.in_segments(self.pairs.select("key", "code"))
        built = pairs.groupBy("segment").applyInArrow(build, "segment bigint, bits binary").toArrow()
        out = np.zeros((self.segments, SEGMENT_BITS // 8), "uint8")
        for segment, bits in zip(built.column("segment").to_pylist(), built.column("bits"), strict=True):
            out[segment] = np.frombuffer(bits.as_buffer(), "uint8")
        return out.reshape(-1)

    def answers(self, asked: DataFrame, share: int) -> DataFrame:
        """Counts, what followed and codes for the words and pairs of rows (block, segment, words, pairs), in their order.

        All are of one of the `ROUNDS` shares of the segments.
        """
        first = self.first_hashes

        def meet(known: pa.Table, asked: pa.Table) -> pa.Table:
            release()
            words, pairs = (known.filter(pc.equal(known.column("kind"), kind)) for kind in (0, 1))
            order = np.argsort(words.column("key").to_numpy().view("uint64"))
            among, n, followed = (words.column(c).to_numpy()[order] for c in ("key", "n", "followed"))
            keys, cuts = _joined(asked.column("words"))
            found, at = _found(keys, among.view("uint64"))
            all_n, all_followed = np.zeros(len(keys), "int32"), np.zeros(len(keys), "float32")
            all_n[found], all_followed[found] = n[at], followed[at]
            keys, pair_cuts = _joined(asked.column("pairs"))
            codes = np.zeros(len(keys), "uint8")
            if pairs.num_rows and len(keys):
                codes = probe(_segment(pairs, first), 1, keys, first).astype("uint8")
            return pa.table(
                {
                    "block": asked.column("block"),
                    "segment": asked.column("segment"),
                    "n": _cut(all_n, cuts),
                    "followed": _cut(all_followed, cuts),
                    "codes": _cut(codes, pair_cuts),
                }
            )

        none = {"n": F.lit(0), "followed": F.lit(0.0).cast("float"), "code": F.lit(0)}
        pairs = self.pairs.select(F.lit(1).alias("kind"), "key", "code").withColumns({c: none[c] for c in ("n", "followed")})
        words = self.words.select(F.lit(0).alias("kind"), "key", "n", "followed").withColumn("code", none["code"])
        known = self.in_segments(pairs.unionByName(words)).where(F.col("segment") % ROUNDS == share).groupBy("segment")
        fields = "block bigint, segment bigint, n binary, followed binary, codes binary"
        return known.cogroup(asked.groupBy("segment")).applyInArrow(meet, fields)


def _joined(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(the keys of all rows one after the other, where each row's begin and end)."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "uint64"), np.cumsum([0, *(len(r) // 8 for r in rows)])


def _cut(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.array([values[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())


def _segment(pairs: pa.Table, first: int) -> np.ndarray:
    """The packed bits of one segment's pairs."""
    bits = np.zeros(SEGMENT_BITS, "bool")
    keys, codes = (pairs.column(c).to_numpy() for c in ("key", "code"))
    for level in range(1, int(codes.max()) + 1):
        h = keys[codes >= level].view("uint64") ^ _turn(level)
        for i in range(_hashes(level, first)):
            h, at = _place(h, i)
            bits[at] = True
    return np.packbits(bits, bitorder="little")


def _turn(level: int) -> np.uint64:
    return np.uint64(level * int(ODD) & 0xFFFFFFFFFFFFFFFF)


def _hashes(level: int, first: int) -> int:
    return first if level == 1 else HASHES


def _place(h: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """The state and the bits within a segment of hash function i, given the state before: three places a mixing."""
    if i % 3 == 0:
        h = h + ODD
        mixed(h, out=h)
    at = h >> np.uint64(i % 3 * PLACE_BITS)
    at &= np.uint64(SEGMENT_BITS - 1)
    return h, at


def _there(bits: np.ndarray, keys: np.ndarray, start: np.ndarray, level: int, first: int) -> np.ndarray:
    """Which keys, by position, the filter holds at a level; `start` is the first bit of each key's segment.

    Keys that are not there are taken out once they are more than a quarter; a few are cheaper to carry along.
    """
    alive, h, there = np.arange(len(keys)), keys ^ _turn(level), None
    for i in range(_hashes(level, first)):
        h, at = _place(h, i)
        at += start
        bit = at.astype("uint8")
        bit &= 7
        at >>= np.uint64(3)
        found = bits.take(at.view("int64"))
        found >>= bit
        found &= 1
        if there is not None:
            found &= there
        there, left = found, np.count_nonzero(found)
        if not left:
            return alive[:0]
        if left < 0.75 * len(found):
            kept = np.flatnonzero(found)
            alive, h, start, there = alive[kept], h[kept], start[kept], None
    return alive if there is None else alive[there.view("bool")]


def probe(bits: np.ndarray, segments: int, keys: np.ndarray, first: int) -> np.ndarray:
    """Codes of pair keys; 0 for pairs not in the filter.

    In the order of the keys, equal ones are probed once, and all places of a slice of them lie in few segments.
    """
    distinct, back = np.unique(keys, return_inverse=True)
    codes = np.zeros(len(distinct), "int32")
    start = ((distinct >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)) * np.uint64(SEGMENT_BITS)
    for at in range(0, len(distinct), SLICE):
        codes[at + _there(bits, distinct[at : at + SLICE], start[at : at + SLICE], 1, first)] = 1
    alive, level = np.flatnonzero(codes), 2
    while len(alive):
        alive = alive[_there(bits, distinct[alive], start[alive], level, first)]
        codes[alive] = level
        level += 1
    return codes[back]


_COLUMNS = "n_tokens bigint, n_known bigint, base_score double, score double"


def score(docs: DataFrame, model: Model, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10) of every row.

    Null and empty texts are one end. Without training texts every probability is 1 and scores are 0. Repeated rows
    are scored each, alike.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return _score_broadcast(rows, model) if model.bytes <= limit else _score_joined(rows, model)


def _tables(model: Model) -> tuple[bytes, bytes, bytes, bytes, bytes]:
    """Words in the order of their hashes, counts, what followed them, words met once that nothing followed, the filter.

    As bytes, which workers load without copies.
    """
    alone = (F.col("n") == 1) & (F.col("followed") == 0)
    words = model.words.where(~alone).toArrow()
    keys = words.column("key").to_numpy().view("uint64")
    order = np.argsort(keys)
    known = keys[order].tobytes()
    del keys
    counts, followed = (words.column(c).to_numpy()[order].tobytes() for c in ("n", "followed"))
    del words, order
    once = np.sort(model.words.where(alone).select("key").toArrow().column("key").to_numpy().view("uint64")).tobytes()
    return known, counts, followed, once, model.filter().tobytes()


def _found(words: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the words are there, their places); `among` is in order."""
    if not len(among):
        return np.zeros(0, "int64"), np.zeros(0, "int64")
    at = np.minimum(np.searchsorted(among, words), len(among) - 1)
    there = np.flatnonzero(among[at] == words)
    return there, at[there]


class _Numbers:
    """What scoring needs of a model besides its tables."""

    def __init__(self, model: Model):
        self.total, self.kinds, self.discount, self.least = model.total, model.kinds, model.discount, model.least

    def scores(self, doc_ids: pa.Array, each: np.ndarray, n: np.ndarray, lost: np.ndarray, back: np.ndarray, head: int, codes_at) -> pa.RecordBatch:
        """Scored texts. `n` and `lost` are of words, `back` the place of each token's word among these, `head` the end's.

        `codes_at` gives the codes of the pairs at some tokens.
        """
        n_word, p_word = n[back], single(n, self.discount, self.kinds, self.total)[back]
        back_before = np.concatenate(([head], back[:-1]))
        n_before, lost_before = n[back_before], lost[back_before]
        share = np.zeros(len(back))
        try_ = np.flatnonzero((n_word >= self.least) & (n_before >= self.least))
        share[try_] = value_of(codes_at(try_), self.least)
        share = np.minimum(share, np.minimum(n_before, n_word))
        p = np.minimum((share + (lost_before + PRIOR) * p_word) / (n_before + PRIOR), 1.0)
        starts = np.concatenate(([0], np.cumsum(each)[:-1]))
        return pa.RecordBatch.from_arrays(
            [
                doc_ids,
                pa.array(each),
                pa.array(np.add.reduceat((n_word > 0).astype("int64"), starts)),
                pa.array(np.add.reduceat(np.log10((n_word + 1) / (self.total + self.kinds + 1)), starts)),
                pa.array(np.add.reduceat(np.log10(p), starts)),
            ],
            names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
        )


def _score_broadcast(rows: DataFrame, model: Model) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(_tables(model))
    numbers, segments, first = _Numbers(model), model.segments, model.first_hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, counts, followed, once, bits = map(np.frombuffer, shared.value, ("uint64", "int32", "float32", "uint64", "uint8"))
        for batch in chunks(batches, most=PART):
            tokens, before, each = _sequences(batch)
            distinct, back = np.unique(tokens, return_inverse=True)
            n = np.zeros(len(distinct))
            n[_found(distinct, once)[0]] = 1
            there, at = _found(distinct, vocabulary)
            n[there] = counts[at]
            lost = n.copy()
            lost[there] = np.maximum(n[there] - followed[at], 0)
            head = int(np.searchsorted(distinct, END))
            codes_at = lambda at, b=before, t=tokens: probe(bits, segments, pair_key(b[at], t[at]), first)
            yield numbers.scores(batch.column("doc_id"), each, n, lost, back, head, codes_at)

    return map_arrow(rows, run, f"doc_id bigint, {_COLUMNS}")


def _distinct(texts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words and pair keys of texts, in order."""
    words, pairs = [], []
    for batch in chunks(iter(texts.to_batches()), most=1 << 20):
        if batch.num_rows:
            tokens, before, _ = _sequences(batch)
            words.append(np.unique(tokens))
            pairs.append(np.unique(pair_key(before, tokens)))
    return np.unique(np.concatenate(words)), np.unique(np.concatenate(pairs))


def _score_joined(rows: DataFrame, model: Model) -> DataFrame:
    """The same with tables that stay in segments; texts are dealt to blocks, and rows that repeat are scored each."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A task deals its own rows by their contents, so copies of one row in many tasks don't meet in one block.
    block = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(size // BLOCK + 1))
    texts = stored(rows.withColumn("block", block), "lm-texts", compression="zstd")
    numbers, segments = _Numbers(model), model.segments

    def asked(share: int) -> DataFrame:
        def ask(group: pa.Table) -> pa.Table:
            release()
            words, pairs = _distinct(group)
            places = [(keys >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32) for keys in (words, pairs)]
            mine = [place % np.uint64(ROUNDS) == share for place in places]
            (words, pairs), places = (words[mine[0]], pairs[mine[1]]), [p[m] for p, m in zip(places, mine, strict=True)]
            used = np.unique(np.concatenate(places))
            cuts = [np.append(np.searchsorted(place, used), len(place)) for place in places]
            home = pa.array(np.full(len(used), group.column("block")[0].as_py(), "int64"))
            return pa.table({"block": home, "segment": used.astype("int64"), "words": _cut(words, cuts[0]), "pairs": _cut(pairs, cuts[1])})

        return texts.groupBy("block").applyInArrow(ask, "block bigint, segment bigint, words binary, pairs binary")

    def score_block(group: pa.Table, known: pa.Table) -> pa.Table:
        release()
        words, pairs = _distinct(group)
        order = np.argsort(known.column("segment").to_numpy())
        kinds = ("n", "int32"), ("followed", "float32"), ("codes", "uint8")
        n, followed, codes = (np.frombuffer(b"".join(known.column(c).take(order).to_pylist()), kind) for c, kind in kinds)
        n = n.astype("float64")
        lost, head, scored = np.maximum(n - followed, 0), int(np.searchsorted(words, END)), []
        for batch in chunks(iter(group.to_batches()), most=PART):
            if batch.num_rows:
                tokens, before, each = _sequences(batch)
                codes_at = lambda at, b=before, t=tokens: codes[np.searchsorted(pairs, pair_key(b[at], t[at]))]
                scored.append(numbers.scores(batch.column("doc_id"), each, n, lost, np.searchsorted(words, tokens), head, codes_at))
        return pa.Table.from_batches(scored)

    map_arrow(rows.limit(0), lambda b: b, rows.schema)  # the package's path, for grouped tasks too
    known = reduce(DataFrame.union, [stored(model.answers(asked(share), share), "lm-answers") for share in range(ROUNDS)])
    return texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(score_block, f"doc_id bigint, {_COLUMNS}")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


@query("op1_lm_scoring")
def op1_lm_scoring(spark, sf_dir):
    """Every document's score under the model of those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = Model(docs.where(~held_out()))
    scored = score(docs, model)
    return scored.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score"
    )
