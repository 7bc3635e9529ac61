"""Every operator on awkward tables, against a plain version of what it promises."""

from __future__ import annotations

import collections
import hashlib
import json
import math
import random
import sys
import zlib
from math import comb
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent))

import cases  # noqa: E402

from talktally.llm.tokens import hash64  # noqa: E402
from talktally.llm import (  # noqa: E402
    bpe,
    line_dedup,
    lm_scoring,
    minhash,
    mixing,
    nearest,
    quality_model,
    quality_rules,
    token_counts,
    tokens,
    toxicity,
)

ROWS = cases.rows()
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return cases.documents(spark, [])


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), LABELS)


def bag(rows):
    return collections.Counter(map(tuple, rows))


# 1: language-model scores


@pytest.mark.parametrize("limit", [lm_scoring.LIMIT, 0])
def test_scores_count_exactly_and_add_up(spark, docs, limit):
    train = docs.where(~lm_scoring.held_out())
    got = lm_scoring.score(docs, lm_scoring.Model(train), limit).collect()
    counts = collections.Counter()
    for d in ROWS:
        if d[0] is None or zlib.crc32(str(d[0]).encode()) % 7 != 2:
            counts.update([*cases.low(d[1]), None])
    total, kinds = sum(counts.values()), len(counts)
    want = collections.Counter()
    for d in ROWS:
        tokens = [*cases.low(d[1]), None]
        base = sum(math.log10((counts[t] + 1) / (total + kinds + 1)) for t in tokens)
        want[d[0], len(tokens), sum(counts[t] > 0 for t in tokens), round(base, 6)] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.score <= 0 for r in got)


def test_word_hashes_in_array_steps():
    r = np.random.default_rng(3)
    letters = [*b"abcdABCD \t\n\x0b\x0c\r\x00\x1c\x85", *"é\u00a0".encode()]
    texts = [bytes(r.choice(letters, size).tolist()) for size in r.integers(0, 60, 3000)] + [b"", b" ", b"a", "Ünï".encode() * 3, b"ab " * 400_000, b"x" * 1_000_000]
    for some in (texts, [b""], [b" \n"], [texts[-2] * 8]):
        got, counts = tokens.hashed_texts(some)
        words = [w for t in some for w in t.lower().split()]
        assert counts.tolist() == [len(t.split()) for t in some] and len(got) == len(words)
        pairs = set(zip(words, got.tolist(), strict=True))
        assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})


def _scores(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize("least", [1, 2])
def test_broadcast_and_joined_scores_are_the_same(spark, docs, least):
    model = lm_scoring.Model(docs.where(~lm_scoring.held_out()), least)
    assert _scores(lm_scoring.score(docs, model)) == _scores(lm_scoring.score(docs, model, 0))


def test_joined_scoring_moves_keys_not_rows(spark, docs, tmp_path, monkeypatch):
    """Beyond the limit a block sends each of its words and pairs once, eight bytes each, and the answers have no keys; nothing shuffled stays."""
    kept, stored = {}, lm_scoring.stored
    monkeypatch.setattr(lm_scoring, "BLOCK", 1 << 14)
    monkeypatch.setattr(lm_scoring, "stored", lambda df, name, **o: kept.setdefault(name, []).append(stored(df, name, **o)) or kept[name][-1])
    model = lm_scoring.Model(docs)
    same = docs.union(docs.limit(3))
    assert _scores(lm_scoring.score(same, model, 0)) == _scores(lm_scoring.score(same, model))
    assert "lm-pairs" not in kept and len(kept["lm-answers"]) == lm_scoring.ROUNDS
    blocks = kept["lm-texts"][0].select("block").distinct().count()
    answers = [r for part in kept["lm-answers"] for r in part.collect()]
    assert blocks > 2 and {r.block for r in answers} == {r.block for r in kept["lm-texts"][0].select("block").collect()}
    assert all(len(r.n) == len(r.followed) for r in answers) and len({(r.block, r.segment) for r in answers}) == len(answers)


def _sequence(text):
    return [None, *cases.low(text), None]


def _plain_model(texts, least):
    """n of words, value of pairs, probability of single words: what the filter would say without errors."""
    n, pairs = collections.Counter(), collections.Counter()
    for text in texts:
        tokens = _sequence(text)
        n.update(tokens[1:])
        pairs.update(zip(tokens, tokens[1:], strict=False))
    value = {k: least * lm_scoring.BASE ** math.floor(math.log(c / least) / math.log(lm_scoring.BASE) + 1e-9) for k, c in pairs.items() if c >= least}
    once, twice = sum(c == 1 for c in n.values()), sum(c == 2 for c in n.values())
    discount = once / (once + 2 * twice) if once else 0.0
    total = sum(n.values())
    return n, value, lambda w: ((n[w] - discount) if n[w] else discount * len(n) + 1) / (total + 1)


@pytest.mark.parametrize("least", [1, 2])
def test_scores_equal_a_plain_dictionary(spark, docs, least):
    texts = [d[1] for d in ROWS if d[0] is None or zlib.crc32(str(d[0]).encode()) % 7 != 2]
    n, value, single = _plain_model(texts, least)
    followed = collections.Counter()
    for (before, _), v in value.items():
        followed[before] += v

    def score(text):
        tokens = _sequence(text)
        steps = zip(tokens, tokens[1:], strict=False)
        return sum(math.log10((value.get((h, w), 0) + (n[h] - followed[h] + lm_scoring.PRIOR) * single(w)) / (n[h] + lm_scoring.PRIOR)) for h, w in steps)

    want = sorted((d[0] is None, d[0] or 0, len(_sequence(d[1])) - 1, round(score(d[1]), 6)) for d in ROWS)
    got = _scores(lm_scoring.score(docs, lm_scoring.Model(docs.where(~lm_scoring.held_out()), least)))
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all(abs(x[3] - y[3]) <= 0.01 for x, y in zip(got, want, strict=True))


def test_filter_never_loses_a_pair_and_seldom_adds_one(spark, docs):
    model = lm_scoring.Model(docs)
    pairs = {r.key: r.code for r in model.pairs.collect()}
    keys = np.array(list(pairs), "int64").view("uint64")
    codes = lm_scoring.probe(model.filter(), model.segments, keys, model.first_hashes)
    assert (codes >= np.array(list(pairs.values()))).all() and (codes > np.array(list(pairs.values()))).mean() < 0.05
    strange = np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype("uint64")
    assert (lm_scoring.probe(model.filter(), model.segments, strange, model.first_hashes) > 0).mean() < 2 / (len(pairs) * 2)


def test_probabilities_after_a_word_add_up_to_one(spark):
    """Summed over a whole vocabulary, after rare words and common ones, from the filter itself."""
    r = np.random.default_rng(5)
    words = np.minimum(r.zipf(1.3, 120_000), 20_000)
    texts = [" ".join(f"w{x}" for x in words[i : i + 60]) for i in range(0, len(words), 60)]
    model = lm_scoring.Model(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = model.words.collect()
    keys = np.array([x.key for x in rows], "int64").view("uint64")
    n, followed = (np.array([x[c] for x in rows], "float64") for c in ("n", "followed"))
    single = lm_scoring.single(n, model.discount, model.kinds, model.total)
    unknown = float(lm_scoring.single(np.zeros(1), model.discount, model.kinds, model.total)[0])
    assert abs(single.sum() + unknown - 1) < 1e-9
    bits, paired = model.filter(), n >= model.least
    sums = []
    for at in [*np.flatnonzero(n == 2)[:150], *np.flatnonzero(n == 5)[:50], *np.argsort(-n)[:50], *np.flatnonzero(n == 1)[:5]]:
        share = np.zeros(len(keys))
        if paired[at]:
            found = lm_scoring.probe(bits, model.segments, lm_scoring.pair_key(np.full(paired.sum(), keys[at]), keys[paired]), model.first_hashes)
            share[paired] = np.minimum(lm_scoring.value_of(found), np.minimum(n[at], n[paired]))
        lost = n[at] - followed[at] + lm_scoring.PRIOR
        sums.append((share.sum() + lost * (single.sum() + unknown)) / (n[at] + lm_scoring.PRIOR))
    assert abs(np.mean(sums) - 1) < 0.01 and max(sums) < 1.6 and min(sums) > 1 - 1e-6


def test_scores_of_an_empty_table_and_without_training(spark, docs, empty):
    model = lm_scoring.Model(empty)
    assert lm_scoring.score(empty, model).count() == 0
    assert {r.score for r in lm_scoring.score(docs, model).select("score").collect()} == {0.0}


# 2: quality rules


def _measured(text):
    w = cases.words(text)
    seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if cases.words(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_measures_and_base_rule(spark, docs):
    got = quality_rules.judged(docs, labels(spark)).collect()
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert bag((r.doc_id, *(r[c] for c in columns)) for r in got) == bag((d[0], *_measured(d[1])) for d in ROWS)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    assert all(r.kept == (not r.base_failed) for r in got)  # no labels, no cutoffs


def test_binomial_tail_is_exact(spark):
    for k, n, p in ((0, 50, 0.1), (3, 100, 0.1), (40, 1000, 0.05), (999, 1000, 0.5)):
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k < n * p else 1.0
        assert got == pytest.approx(want, rel=1e-8)


def test_cutoffs_keep_their_promise(spark):
    r = np.random.default_rng(2)
    rows = [(i, " ".join(["word%d" % j for j in r.integers(0, 10**6, 60)]) + " #" * int(i % 50 == 0), "en") for i in range(6000)]
    rows += [(i, " ".join(["w%d#####" % j for j in r.integers(0, 10**6, 60)]), "en") for i in range(6000, 6300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality_rules.judged(docs, labels(spark, [(i, int(i < 6000), 0) for i in range(0, 6300)])).collect()
    good = [x for x in got if x.doc_id < 6000]
    assert sum(not x.kept for x in good) <= 0.01 * len(good)
    assert not any(x.kept for x in got if x.doc_id >= 6000)


def test_cutoffs_reach_small_languages(spark):
    r = np.random.default_rng(3)
    prose = lambda mark: " ".join(f"w{j}{mark}" for j in r.integers(0, 10**6, 60))
    # Per language 600 good and 60 bad ones, and as many without labels; one language has too few good ones.
    rows, marks = [], []
    for lang, n in (("de", 600), ("fr", 600), (None, 600), ("es", 200)):
        for k in range(2 * n + 120):
            bad = k >= 2 * n
            rows.append((len(rows), prose("#####" if bad else ""), lang))
            if k % 2:
                marks.append((len(rows) - 1, int(not bad), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality_rules.judged(docs, labels(spark, marks)).collect()
    for lang in ("de", "fr", None):
        mine = [x for x in got if x.lang == lang]
        bad = [x for x in mine if x.n_symbols > 0]
        assert not any(x.kept for x in bad) and sum(not x.kept for x in mine) - len(bad) <= 0.01 * len(mine)
    assert all(x.kept for x in got if x.lang == "es")


def test_rules_on_an_empty_table(spark, empty):
    assert quality_rules.judged(empty, labels(spark)).count() == 0


# 3: near-duplicates


def test_components_equal_those_of_all_pairs(spark, docs, empty):
    got = minhash.near_duplicates(docs).collect()
    want = [(d, n, c, d == c) for d, n, c in cases.near_components(ROWS)]
    assert bag((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == bag(want)
    assert minhash.near_duplicates(empty).count() == 0


def test_one_row_of_each_group_stays(spark, docs):
    left = [r.doc_id for r in minhash.without_near_duplicates(docs).collect()]
    assert len([x for x in left if x is not None]) == len({x for x in left if x is not None})
    assert {7, 9}.issubset(left) and not {8, 10}.intersection(left)


def test_one_row_stays_of_each_group_without_or_with_one_id(spark):
    r = np.random.default_rng(6)
    prose = lambda n: " ".join(f"w{x}" for x in r.integers(0, 10**6, n))
    one, two, three, four, five = (prose(n) for n in (40, 60, 50, 30, 70))
    near = one + " more"
    rows = [(None, one), (None, near), (None, two), (None, two), (None, ""), (None, None), (None, None), (7, three), (7, four), (7, three), (7, None), (8, five), (None, five)]
    docs = cases.documents(spark, [(d, t, "en", "a", 1) for d, t in rows])
    left = minhash.without_near_duplicates(docs)
    assert left.columns == docs.columns
    want = [(None, near), (None, two), (None, ""), (None, None), (7, three), (7, four), (7, None), (8, five)]
    assert bag((x.doc_id, x.text) for x in left.collect()) == bag(want)


def test_signature_estimates_similarity():
    r = np.random.default_rng(4)
    one = np.unique(r.integers(0, 1 << 63, 900).astype("uint64"))
    two = np.unique(np.concatenate([one[:600], r.integers(0, 1 << 63, 300).astype("uint64")]))
    signed = minhash.signatures([one, two], 512)
    assert abs((signed[0] == signed[1]).mean() - 0.5) < 0.08


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i.to_bytes(2, "big"), (i + 1).to_bytes(2, "big")) for i in range(60)], "a binary, b binary")
    assert {bytes(r.component) for r in minhash.components(links).collect()} == {(0).to_bytes(2, "big")}


def test_a_large_group_of_near_copies_is_not_compared_pair_by_pair(spark, monkeypatch):
    r = random.Random(7)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]

    def near():
        words = list(base)
        for _ in range(r.randint(1, 7)):
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
        return " ".join(words)

    rows = [(k, near(), "en", "a", 1) for k in range(400)]
    stored, counts = minhash.stored, []

    def counted(df, name):
        out = stored(df, name)
        if name == "pairs":
            counts.append(out.count())
        return out

    monkeypatch.setattr(minhash, "stored", counted)
    got = minhash.near_duplicates(cases.documents(spark, rows)).collect()
    want = cases.near_components(rows)
    assert len({c for _, _, c in want}) > 40
    assert bag((x.doc_id, x.component_id) for x in got) == bag((d, c) for d, _, c in want)
    assert sum(counts) < 10 * len(rows)


# 4: encoding


def test_ids_and_texts_equal_the_library(spark, docs, empty):
    library = Tokenizer.from_file(bpe.tokenizer_path())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for d in ROWS:
        ids = library.encode(d[1] or "", add_special_tokens=False).ids
        want.append((d[0], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert bag(bpe.digests(bpe.encode(docs, decoded="decoded")).collect()) == bag(want)
    apart = bpe.decode(bpe.encode(docs).select("doc_id", "ids"))
    assert bag(bpe.digests(apart).collect()) == bag(want)
    assert bpe.encode(empty).count() == 0


def test_a_word_is_encoded_once_whatever_stands_around_it(monkeypatch):
    vocabulary = bpe.Vocabulary(json.loads(Path(bpe.tokenizer_path()).read_text()))
    encode_words, encoded = vocabulary.encode_words, []
    monkeypatch.setattr(vocabulary, "encode_words", lambda words: encoded.extend(words) or encode_words(words))
    first = vocabulary.encode_chunks({"Harbour", "sea<|endoftext|>"})
    again = vocabulary.encode_chunks({"harbour,", "HARBOUR", "sea", "<|endoftext|>"})
    assert len(encoded) == len(set(encoded)) == 3
    assert first["Harbour"] == again["HARBOUR"] == again["harbour,"][:-4]
    assert first["sea<|endoftext|>"] == again["sea"] + again["<|endoftext|>"]


def test_random_strings_equal_the_library():
    import json
    import random

    r = random.Random(5)
    letters = "abcdefghijklmnop" * 4 + "ABÉéßΣσςİı中文字1234 \t\n  \x1c.,!?-_#@😀̧́'sd"
    texts = ["".join(r.choices(letters, k=r.randint(0, 50))) for _ in range(4000)] + ["a" * k for k in range(1, 50)]
    vocabulary = bpe.Vocabulary(json.loads(Path(bpe.tokenizer_path()).read_text()))
    library = Tokenizer.from_file(bpe.tokenizer_path())
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        parts = bpe.split_white(text)
        packed = vocabulary.encode_chunks(set(parts))
        assert np.frombuffer(b"".join(packed[p] for p in parts), "<i4").tolist() == want.ids, text


# 5: lines


def test_later_runs_go(spark, docs, empty):
    got = line_dedup.dedup_lines(docs)
    assert {"n_lines", "n_deleted"} | set(docs.columns) == set(got.columns)
    want = cases.repeated_runs_removed(ROWS)
    assert bag((r.doc_id, r.text) for r in got.collect()) == bag((d[0], want.get((d[0], d[1]))) for d in ROWS)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_repeated_runs_go_to_their_ends(spark):
    r = np.random.default_rng(5)
    line = lambda n: " ".join(f"w{x}" for x in r.integers(0, 10**6, n))
    run = [line(60), line(10), "", line(10)]
    two = [line(30), line(15), line(30), line(20)]
    texts = ["\n".join(run), "\n".join(run), "\n".join([line(5), *run, line(5)]), "\n".join(two), "\n".join([*two[:3], line(7), *two[1:]]), "\n".join([two[1], two[0]])]
    # Lines put at random, so that runs are met forwards, backwards and within one text.
    some = [line(n) for n in (9, 14, 21, 33, 50)]
    texts += ["\n".join(some[k] for k in r.integers(0, 5, 12)) for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(docs).collect()}
    assert got == cases.maximal_runs_removed(texts)
    assert got[1] == "" and got[2].count("\n") == 1


# 6: token counts


def _greedy(word, pieces, most):
    i = n = 0
    while i < len(word):
        j = min(len(word), i + most)
        while j > i and (token_counts.MARK if i == 0 else "") + word[i:j] not in pieces:
            j -= 1
        if j == i:
            return 0
        i, n = j, n + 1
    return n


def test_counts_equal_greedy_splitting(spark, docs, empty):
    pieces = set(token_counts.pieces_of(bpe.tokenizer_path("piece_bpe_32k.model")))
    want = []
    for d in ROWS:
        n = [_greedy(w.decode(), pieces, 20) for w in cases.low(d[1])]
        want.append((d[0], len(n), sum(n) + n.count(0), n.count(0)))
    assert bag(token_counts.count_tokens(docs).collect()) == bag(want)
    assert token_counts.count_tokens(empty).count() == 0


def test_automaton_on_random_vocabularies():
    import random

    r = random.Random(6)
    for _ in range(100):
        pieces = {r.choice(["", token_counts.MARK]) + "".join(r.choices("abc", k=r.randint(1, 5))) for _ in range(12)}
        automaton = token_counts.Automaton(sorted(pieces))
        for _ in range(50):
            word = "".join(r.choices("abc", k=r.randint(1, 12)))
            assert automaton.length(word) == _greedy(word, pieces, 6), (word, pieces)


# 7: perplexity


def _kneser_ney(trained, wanted):
    """Log probabilities from the definition, order by order."""
    counts = {5: collections.Counter(trained)}
    for order in (4, 3, 2, 1):
        counts[order] = collections.Counter()
        for g in counts[order + 1]:
            counts[order][g[1:]] += 1

    def discounts(c):
        n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        if not n[0] or not n[1]:
            return [0.5, 0.75, 0.9]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(k, max(0.05, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else 0.5 * k for k in (1, 2, 3)]

    d = {k: discounts(counts[k]) for k in (2, 3, 4, 5)}
    cut = lambda n, k: 0.0 if n == 0 else d[k][min(n, 3) - 1]

    def p(g):
        if len(g) == 1:
            return (counts[1][g] + 1) / (sum(counts[1].values()) + len(counts[1]) + 1)
        same = [n for h, n in counts[len(g)].items() if h[:-1] == g[:-1]]
        if not same:
            return p(g[1:])
        n = counts[len(g)][g]
        return max(n - cut(n, len(g)), 0) / sum(same) + sum(cut(m, len(g)) for m in same) / sum(same) * p(g[1:])

    return {g: math.log(p(g)) for g in wanted}


def test_probabilities_follow_the_definition(spark):
    texts = ["abab abc", "abd bca abc", "cab abab"]
    trained = collections.Counter(g for t in texts for w in t.split() for g in quality_model.grams(w))
    wanted = {*trained, *quality_model.grams("zabq"), *quality_model.grams("bab")}
    got = quality_model.probabilities(
        spark.createDataFrame(list(trained.items()), "gram string, n long"), spark.createDataFrame([(g,) for g in wanted], "gram string")
    )
    want = _kneser_ney(trained, wanted)
    found = {r.gram: r.logp for r in got.collect()}
    assert found.keys() == want.keys() and all(found[g] == pytest.approx(want[g], abs=1e-9) for g in want)


def test_gram_counts_and_perplexity_equal_plain_ones(spark, docs, monkeypatch):
    monkeypatch.setattr(quality_model, "PENDING", 50)
    more = [(900, "İ\u0130 a\x00b \x00 Straße \u2003x\U0001f600y a\x00b"), (901, "\u00a0 \n")]
    rows = [(d[0], d[1]) for d in ROWS] + more
    plain = lambda t: [g for w in (t or "").lower().split() for g in quality_model.grams(w)]
    df = spark.createDataFrame([(i, t, i is not None and i % 2 == 0, "en") for i, t in rows], "doc_id long, text string, taught boolean, lang string")
    counted = quality_model.gram_counts(df)
    want = collections.Counter(g for _, t in rows for g in plain(t))
    taught = collections.Counter(g for i, t in rows if i is not None and i % 2 == 0 for g in plain(t))
    assert {r.gram: (r.n, r.taught) for r in counted.collect()} == {g: (n, taught[g]) for g, n in want.items()}
    logp = {g: -1.0 - (hash64(g.encode()) % 1000) / 256 for g in want}
    model = spark.createDataFrame(list(logp.items()), "gram string, logp double")
    losses = sorted((i or 0, len(plain(t)), round(-sum(logp[g] for g in plain(t)) + 0.0, 2)) for i, t in rows)
    for limit in (quality_model.LIMIT, 0):
        got = sorted((r.doc_id or 0, r.n_grams, round(r.loss, 2)) for r in quality_model.text_sums(df, model, limit).collect())
        assert [x[:2] for x in got] == [x[:2] for x in losses]
        assert all(x[2] == pytest.approx(y[2], rel=1e-5, abs=0.02) for x, y in zip(got, losses, strict=True))


def test_perplexity_on_awkward_rows(spark, docs, empty):
    good = labels(spark, [(d[0], 1, 0) for d in ROWS if d[0] and d[0] >= 20] + [(None, 1, 0), (20, 1, 1)])
    one = quality_model.perplexities(docs, good).collect()
    two = quality_model.perplexities(docs, good, limit=0).collect()
    key = lambda r: (r.doc_id, r.n_grams, None if r.perplexity is None else round(math.log(r.perplexity), 3), r.kept)
    assert collections.Counter(map(key, one)) == collections.Counter(map(key, two)) and len(one) == len(ROWS)
    assert all(r.kept for r in one if r.perplexity is None or r.lang == "fr")
    assert quality_model.perplexities(empty, labels(spark)).count() == 0


# 8: mixing


def test_targets_share_all_and_keep_their_limits(spark, docs):
    got = mixing.mix(docs).collect()
    assert bag((r.doc_id, r.size) for r in got) == bag((d[0], len(cases.words(d[1]))) for d in ROWS)
    names = sorted({d[3] for d in ROWS} - {None}) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    size = collections.Counter()
    for d in ROWS:
        size[d[3]] += len(cases.words(d[1]))
    target, open_ = dict.fromkeys(names, 0.0), set(names)
    left = float(sum(size.values()))
    while left > 1e-9 and open_:
        share, left = left / sum(weight[s] for s in open_), 0.0
        for s in list(open_):
            target[s] += share * weight[s]
            if target[s] >= 3 * size[s]:
                left += target[s] - 3 * size[s]
                target[s] = 3.0 * size[s]
                open_.discard(s)
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source] and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    together = collections.Counter()
    for d in ROWS:
        together[d[3], d[0]] += len(cases.words(d[1]))
    for (s, _), n in together.items():
        largest[s] = max(largest[s], n)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in names)
    assert bag(got) == bag(mixing.mix(docs).collect())


def test_smaller_budgets_are_nested_and_rows_repeat(spark, docs, empty):
    once = collections.Counter(r.doc_id for r in mixing.mixed(docs).collect())
    want = collections.Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.copies
    assert once == +want
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


# 9: nearest neighbours


def test_recall_and_ties(spark):
    r = np.random.default_rng(7)
    m = r.standard_normal((1500, 24))
    m[200:900] = m[200]  # a third and more are one vector
    rows = [(i, [float(x) for x in m[i].astype("float32")]) for i in range(1500)]
    rows += [(2000, None), (2020, [0.0] * 24), (2040, [None] + [1.0] * 23), (2060, [float("nan")] * 24), (None, rows[3][1]), rows[5], (2080, [1.0])]
    table = spark.createDataFrame([(*x, 1, "q") for x in rows], "vec_id long, embedding array<float>, score int, class string")
    got = collections.defaultdict(list)
    for x in nearest.search(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    m = m.astype("float32").astype("float64")
    hits = 0
    for q in range(0, 1500, 20):
        scores = np.array([math.fsum(a * b for a, b in zip(m[q], v, strict=True)) for v in m])
        order = [i for i in np.lexsort((np.arange(1500), -np.round(scores, 9))) if i != q][:20]
        hits += len({v for v, _ in got[q]} & set(order))
        assert len(got[q]) == 20 and [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
        assert all(abs(s - scores[v]) < 1e-9 for v, s in got[q])
    assert got.keys() == set(range(0, 1500, 20)) and hits >= 0.9 * 20 * 75
    assert [v for v, _ in got[220]] == [*range(200, 220)]


def test_few_and_no_vectors(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [tuple(x) for x in nearest.search(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 20, 0.0), (20, 1, 1, 0.5), (20, 2, 0, 0.0)]
    assert nearest.search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_what_grows_is_not_broadcast(spark, monkeypatch):
    """An explode makes 1,000 rows of a query; the planner would broadcast them by the size of the file."""
    plans, stored = {}, nearest.stored

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, name)

    monkeypatch.setattr(nearest, "stored", seen)
    rows = spark.range(60).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda x: F.sin(x * (F.col("id") % 50 + 1)).cast("float")).alias("embedding"))
    found = nearest.search(rows, F.col("vec_id") % 5 == 0, nearest=3)
    assert "Join" in plans["ann-levels"] and not [name for name, plan in plans.items() if "Broadcast" in plan]
    last = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in last and last.count("BroadcastHashJoin") <= 2  # the prefixes in use, counted before
    assert found.count() == 36
    monkeypatch.setattr(nearest, "FEW", 0)
    again = nearest.search(rows, F.col("vec_id") % 5 == 0, nearest=3)
    assert "Broadcast" not in again._jdf.queryExecution().executedPlan().toString()
    assert bag(map(tuple, again.collect())) == bag(map(tuple, found.collect()))


# 10: toxicity


@pytest.fixture(scope="module")
def toxic_model(spark):
    r = np.random.default_rng(8)
    vocabulary = ["".join(r.choice(list("abdeghilmnorstu"), r.integers(3, 8))) for _ in range(500)]
    bad = ["idiot", "moron", "worthless", "scum"]
    rows, marks = [], []
    for i in range(900):
        toxic = int(i % 5 == 0)
        text = list(r.choice(vocabulary, 40)) + ([bad[i // 5 % 4]] if toxic else [])
        rows.append((i, " ".join(text)))
        marks.append((i, 1, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return toxicity.learn(docs, toxicity.for_learning(labels(spark, marks))), vocabulary


@pytest.mark.parametrize("hidden", ["idiot", "IDIOT!", "1d10t", "i.d.i.o.t", "i d i o t", "idiooot", "m0r0n###", "w0rthl3ss", "s-c-u-m", "sssscum"])
def test_disguised_words_are_read(spark, toxic_model, hidden):
    (letters, evidence, share), vocabulary = toxic_model
    texts = [(1, f"{vocabulary[0]} {hidden} {vocabulary[1]}"), (2, f"{vocabulary[0]} {vocabulary[2]}, {vocabulary[1]}")]
    scored = toxicity.score_texts(spark.createDataFrame(texts, "doc_id long, text string"), letters, evidence, share)
    score = {r.doc_id: r.score for r in scored.collect()}
    assert score[1] >= 0.5 > score[2]


def test_toxicity_on_awkward_rows(spark, docs, empty, toxic_model):
    scored = toxicity.score_texts(docs, *toxic_model[0])
    assert scored.columns == [*(c for c in docs.columns if c != "score"), "score"] and scored.count() == len(ROWS)
    assert scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity.toxicity(docs, labels(spark)).where("score >= 0.5").count() == 0
    assert toxicity.toxicity(empty, labels(spark)).count() == 0


def test_held_out_labels_teach_nothing(spark):
    rows = labels(spark, [(i, 1, i % 2) for i in range(50)] + [(None, 1, 1)])
    got = {r.doc_id for r in toxicity.for_learning(rows).collect()}
    assert got == {i for i in range(50) if zlib.crc32(str(i).encode()) % 5} | {None}


def test_all_labels_teach(spark):
    ids = spark.range(24_000).orderBy(F.xxhash64("id"), "id").toPandas()["id"].tolist()
    rows = [(i, f"plain{k % 50}" if k < 23_950 else f"plain{k % 50} gnarl", int(k >= 23_950)) for k, i in enumerate(ids)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(-1, "no label")], "doc_id long, text string")
    letters, evidence, share = toxicity.learn(docs, labels(spark, [(i, 1, x) for i, _, x in rows]))
    assert share == 50.5 / 24_001
    assert "gnarl" in evidence and not any(w.startswith("plain") for w in evidence)
    assert letters["gna"] == 50 * 50
