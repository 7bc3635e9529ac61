"""Toxicity by noisy-channel deobfuscation and learned word evidence.

Writers hide a word by look-alike characters (1d10t), separators (i.d.i.o.t, i d i o t) and repetition
(idiooot). A disguised stretch becomes a lattice: every character offers itself, the letters it may stand
for, or nothing, and every gap or mark a border between words or nothing. Viterbi search under a character trigram model of
undisguised words picks the likeliest reading. The restored words are scored by the share of toxic documents
among those that hold them.

Both models are learned from all labelled rows. Words are counted, weighed and cut into trigrams by tasks; only the evidence
words and the trigrams, which follow the words worth hiding and the alphabet, reach the driver and are broadcast.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talktally.llm.base import chunks, held, map_arrow, query, stored, table
from talktally.session import config_table

# Letters that a look-alike may stand for.
LOOKS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
FRINGE = "!¡|+(.,;:?\"'`´*_-~^#%&=<>/\\[]{})…“”„«»¿"
NOT_LETTERS = FRINGE + "".join(LOOKS) + "2"
COSTS = {"itself": 0.0, "look": 1.0, "kept": 6.0, "dropped": 0.7, "lost": 5.0, "joined": 1.5, "apart": 0.5, "repeated": 2.5}
EDGE = " "
SPLITS = 5
IDS = 1 << 20  # labelled ids that are broadcast; more of them are joined
PENDING = 500_000  # distinct words a task counts before it hands them on
BEGINNINGS = (4, 5, 6)
Z, LEAST_DOCS = 3.0, 5
CACHED = 200_000
PIECE, OVERLAP = 2_000, 200  # characters of a stretch decoded at once, and how far pieces overlap
SINGLES = re.compile(r"(?<!\S)[^\s](?:[ \t]+[^\s]){2,}(?!\S)")
HIDDEN = re.compile(r"[^\W\d_]")
TWICE = re.compile(r"^([^\w\s])\1+|([^\w\s])\2+$")
THRICE = re.compile(r"([^\W\d_])\1\1")


def plain(token: str) -> str:
    """A token in lower case without the marks around it, nor marks set twice and more at an end."""
    if token.isalpha():
        return (token if token.isascii() else unicodedata.normalize("NFC", token)).lower()
    return TWICE.sub("", unicodedata.normalize("NFC", token).lower().strip(FRINGE)).strip(FRINGE)


def disguised(token: str) -> bool:
    """Whether a stripped token has letters and, within or beside them, other characters or a letter thrice."""
    if token.isalpha():
        return THRICE.search(token) is not None
    return sum(map(str.isalpha, token)) >= 2 or (len(token) <= 24 and len(HIDDEN.findall(token)) >= 1)


class Letters:
    """Character trigrams within words, interpolated with shorter ones."""

    def __init__(self, counts: dict[str, int]):
        """counts: of strings of 1 to 3 characters, words being framed by two spaces before and one behind."""
        self.counts = counts
        self.total = sum(n for g, n in counts.items() if len(g) == 1)
        self.kinds = max(2, sum(len(g) == 1 for g in counts))
        self.known: dict[str, float] = {}

    def cost(self, before: str, letter: str) -> float:
        key = before + letter
        found = self.known.get(key)
        if found is None:
            get = self.counts.get
            p = (get(letter, 0) + 0.5) / (self.total + 0.5 * self.kinds)
            for context in (before[1:], before):
                n = get(context + "\0", 0)  # how often the context was followed by anything
                p = (get(context + letter, 0) + 4 * p) / (n + 4)
            found = self.known[key] = -math.log(p)
        return found


def traits(word: str) -> list[str]:
    """What may be evidence: the word, and its beginnings, since inflected words share those."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if n < len(word) and word[:n].isalpha())]


def count_letters(words: dict[str, int]) -> Counter:
    out: Counter = Counter()
    for word, n in words.items():
        framed = EDGE * 2 + word + EDGE
        for i in range(2, len(framed)):
            for size in (1, 2, 3):
                out[framed[i - size + 1 : i + 1]] += n
            out[framed[i - 1 : i] + "\0"] += n
            out[framed[i - 2 : i] + "\0"] += n
    return out


def pieces(stretch: str) -> list[str]:
    """A long stretch in pieces that overlap by more than a word's length; a shorter one whole."""
    if len(stretch) <= PIECE:
        return [stretch]
    return [stretch[k : k + PIECE] for k in range(0, len(stretch) - OVERLAP, PIECE - OVERLAP)]


def restore(stretch: str, letters: Letters) -> list[str]:
    """The likeliest words behind a disguised stretch of any length; of overlapping pieces, those of each."""
    return [word for piece in pieces(stretch) for word in decode(piece, letters)[1]]


def decode(stretch: str, letters: Letters) -> tuple[float, list[str]]:
    """Cost and words of the cheapest way through the lattice of a stretch; single spaces in it may be borders or padding.

    A state is the last two letters and the character that is being repeated, so their number is bounded by what one
    character can stand for; none is left out.
    """
    states: dict[tuple[str, str], tuple[float, tuple | None]] = {(EDGE * 2, ""): (0.0, None)}

    def offer(to, state, cost, trail, letter):
        old = to.get(state)
        if old is None or cost < old[0]:
            to[state] = (cost, (letter, trail) if letter else trail)

    for char in stretch + EDGE:
        to: dict[tuple[str, str], tuple[float, tuple | None]] = {}
        final = char == EDGE
        for (before, run), (cost, trail) in states.items():
            if final:
                if before[1] != EDGE:
                    offer(to, (EDGE * 2, ""), cost + COSTS["apart"] + letters.cost(before, EDGE), trail, EDGE)
                    offer(to, (before, ""), cost + COSTS["joined"], trail, "")
                else:
                    offer(to, (before, ""), cost, trail, "")
                continue
            if char.isalpha():
                if run == char:
                    offer(to, (before, char), cost + COSTS["repeated"], trail, "")
                offer(to, (before[1] + char, char), cost + COSTS["itself"] + letters.cost(before, char), trail, char)
                continue
            for letter in LOOKS.get(char, ""):
                if run == letter:
                    offer(to, (before, letter), cost + COSTS["repeated"], trail, "")
                offer(to, (before[1] + letter, letter), cost + COSTS["look"] + letters.cost(before, letter), trail, letter)
            offer(to, (before, run), cost + COSTS["lost" if char in LOOKS else "dropped"], trail, "")
            if not char.isalnum() and before[1] != EDGE:
                offer(to, (EDGE * 2, ""), cost + COSTS["apart"] + letters.cost(before, EDGE), trail, EDGE)
            if char.isdigit():
                offer(to, (before[1] + char, char), cost + COSTS["kept"] + letters.cost(before, char), trail, char)
        states = to

    def whole(end: tuple) -> float:
        (before, _), (cost, _) = end
        return cost + (0 if before[1] == EDGE else letters.cost(before, EDGE))

    last = min(states.items(), key=whole)
    out, trail = [], last[1][1]
    while trail is not None:
        out.append(trail[0])
        trail = trail[1]
    return whole(last), "".join(reversed(out)).split()


def spaced_out(text: str) -> list[str]:
    """Runs of three and more single characters, at least two of them letters."""
    return [" ".join(m.split()) for m in SINGLES.findall(text) if sum(map(str.isalpha, m)) >= 2]


class Reader:
    """The strongest evidence in tokens and texts, with a bounded memory of tokens."""

    def __init__(self, letters: Letters, evidence: dict[str, float]):
        self.letters, self.evidence, self.cache = letters, evidence, {}

    def weigh(self, words: list[str]) -> float:
        return max((self.evidence.get(t, 0.0) for w in words for t in traits(w)), default=0.0)

    def token(self, token: str) -> float:
        """Of a token as written, without what is around its letters, and as restored."""
        found = self.cache.get(token)
        if found is None:
            if len(self.cache) >= CACHED:
                self.cache.clear()
            bare = plain(token)
            words = [bare] if bare else []
            core = bare.strip(NOT_LETTERS) if not bare.isalpha() else bare
            if core != bare and core.isalpha():
                words.append(core)
            if bare and disguised(bare):
                words += restore(bare, self.letters)
            found = self.cache[token] = self.weigh(words)
        return found

    def document(self, text: str) -> float:
        best = max(map(self.token, set(text.split())), default=0.0)
        for run in spaced_out(text.lower()):
            best = max(best, self.weigh(restore(run, self.letters)))
        return best


def learn(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, int], dict[str, float], float]:
    """(letter counts, evidence per word, share of toxic documents) of all labelled texts.

    `labels` holds doc_id and toxic; rows with null toxic or text teach nothing.
    """
    known = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = F.broadcast(known) if known.count() <= IDS else known
    texts = docs.where("text IS NOT NULL").select("doc_id", "text").join(known, "doc_id").select("text", "toxic")
    documents = texts.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    share = ((documents.toxic or 0) + 0.5) / (documents.n + 1)
    least = max(0.4, 1.5 * share)
    counted = stored(word_counts(texts).where(F.col("clean") + F.col("toxic") >= LEAST_DOCS), "toxicity-words")

    whole = counted.where(~F.endswith("word", F.lit("*")) & (lower_bound(F.col("toxic"), F.col("clean") + F.col("toxic")) > least)).collect()
    # A beginning counts without the words that are evidence by themselves.
    without: dict[str, tuple[int, int]] = {}
    for row in whole:
        for part in traits(row.word)[1:]:
            c, t = without.get(part, (0, 0))
            without[part] = (c + row.clean, t + row.toxic)
    columns = {"word": list(without), "less_clean": [c for c, _ in without.values()], "less_toxic": [t for _, t in without.values()]}
    fewer = config_table(docs.sparkSession, columns, pa.schema([("word", pa.string()), ("less_clean", pa.int64()), ("less_toxic", pa.int64())]))
    begun = counted.where(F.endswith("word", F.lit("*"))).join(fewer, "word", "left")
    begun = begun.select("word", *(F.greatest(F.lit(0), F.col(c) - F.coalesce(f"less_{c}", F.lit(0))).alias(c) for c in ("clean", "toxic")))
    begun = begun.where("clean + toxic > 0").where(lower_bound(F.col("toxic"), F.col("clean") + F.col("toxic")) > least).collect()
    evidence = {r.word: bound_of(r.toxic, r.clean + r.toxic) for r in [*whole, *begun]}
    return letter_counts(counted, evidence), evidence, share


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, clean, toxic): in how many distinct lines of clean and of toxic texts each trait is found."""
    # Equal lines teach once, and as clean ones if any is clean: copies of a text are no further evidence.
    lines = texts.select(F.explode(F.split("text", "\n")).alias("text"), "toxic")
    lines = lines.groupBy(F.xxhash64("text").alias("_line")).agg(F.first("text").alias("text"), F.min("toxic").alias("toxic"))

    def handed(kinds: tuple[Counter, Counter]) -> pa.RecordBatch:
        words = list(kinds[0].keys() | kinds[1].keys())
        return pa.RecordBatch.from_pydict({"word": words, "clean": [kinds[0][w] for w in words], "toxic": [kinds[1][w] for w in words]})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, seen = (Counter(), Counter()), {}
        for batch in chunks(batches):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found = set()
                for token in set(text.split()):
                    each = seen.get(token)
                    if each is None:
                        bare = plain(token)
                        each = seen[token] = traits(bare) if bare else []
                    found.update(each)
                kinds[1 if toxic else 0].update(found)
            if len(seen) > CACHED:
                seen.clear()
            if len(kinds[0]) + len(kinds[1]) > PENDING:
                yield handed(kinds)
                kinds = (Counter(), Counter())
        if kinds[0] or kinds[1]:
            yield handed(kinds)

    counted = map_arrow(lines.select("text", F.col("toxic").cast("int")), count, "word string, clean bigint, toxic bigint")
    return counted.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def letter_counts(counted: DataFrame, evidence: dict[str, float]) -> dict[str, int]:
    """Counts of the strings of letters of all counted words; what is worth hiding weighs more in the model of what may be hidden."""
    heavy = frozenset(evidence)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            rows = zip(*(batch.column(n).to_pylist() for n in ("word", "n")), strict=True)
            total.update(count_letters({w: n * (50 if w in heavy else 1) for w, n in rows if w.isalpha() and not THRICE.search(w)}))
        yield pa.RecordBatch.from_pydict({"letters": list(total), "n": list(total.values())}, pa.schema([("letters", pa.string()), ("n", pa.int64())]))

    cuts = map_arrow(counted.select("word", (F.col("clean") + F.col("toxic")).alias("n")), cut, "letters string, n bigint")
    found = cuts.groupBy("letters").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(found.column("letters").to_pylist(), found.column("n").to_pylist(), strict=True))


def lower_bound(hits: Column, n: Column, z: float = Z) -> Column:
    """Wilson's lower bound of a share; n is above 0."""
    p, zz = hits / n, z * z
    return (p + zz / (2 * n) - z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)


def bound_of(hits: int, n: int, z: float = Z) -> float:
    """The same of single numbers."""
    p, zz = hits / n, z * z
    return (p + zz / (2 * n) - z * math.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)


def score_texts(docs: DataFrame, letters: dict[str, int], evidence: dict[str, float], share: float, column: str = "score") -> DataFrame:
    """The columns of `docs` and a score from 0 to 1: its strongest evidence.

    A text without evidence, also a null or empty one, gets a small score. A column already named so is replaced.
    """
    kept = docs.drop(column)
    shared, name = docs.sparkSession.sparkContext.broadcast((letters, evidence)), uuid.uuid4().hex
    base = min(0.2, share / 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = held(f"toxicity {name}", lambda: Reader(Letters(shared.value[0]), shared.value[1]))
        for batch in chunks(batches):
            scores = [(reader.document(t) if t else 0.0) or base for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, column])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"`{column}` double"])
    return map_arrow(kept, run, fields)


def for_learning(labels: DataFrame) -> DataFrame:
    """The labels that are not held out."""
    return labels.where(~held_out()).select("doc_id", "toxic")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % SPLITS == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, column: str = "score") -> DataFrame:
    """The columns of `docs` and their texts' scores, learned from the labels that are not held out."""
    return score_texts(docs, *learn(docs, for_learning(labels)), column=column)


@query("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    """Every document's toxicity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
