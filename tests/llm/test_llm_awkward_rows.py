"""Repeated rows, missing ids, sources without words and very long tokens, against plain versions."""

from __future__ import annotations

import itertools
import sys
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import cases  # noqa: E402

from talktally.llm import line_dedup, mixing, quality_rules, toxicity  # noqa: E402

# 2: quality rules


def test_a_text_is_one_trial_however_often_it_occurs(spark):
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words[(7 * k + j) % 400] for j in range(80)) + f" t{k}" for k in range(320)]
    bad = [" ".join(words[(3 * k + j) % 400] for j in range(80)) + " # # # $ $ %" * 4 + f" b{k}" for k in range(60)]
    rows = [(k, t, "en") for k, t in enumerate([*texts, *bad])]
    marks = [(k, int(k < 320), 0) for k in range(380)]
    # The same rows three times, and copies of some under other ids and labels.
    more = rows * 3 + [(1000 + k, texts[k], "en") for k in range(150)]
    more_marks = marks + [(1000 + k, k % 2, 0) for k in range(150)]

    def limits(data, labels):
        docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
        measured = quality_rules.measures(docs)
        found = quality_rules.cutoffs(measured, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        return sorted(map(tuple, found.collect()))

    once = limits(rows, marks)
    assert once and limits(more, more_marks) == once
    # 150 good texts are too few for a promise, and do not become enough by being repeated.
    few = [(k, t, "en") for k, t in enumerate(texts[:150])] + [(500 + k, t, "en") for k, t in enumerate(bad)]
    few_marks = [(k, 1, 0) for k in range(150)] + [(500 + k, 0, 0) for k in range(60)]
    assert limits(few, few_marks) == limits(few * 3, few_marks) == []


# 5: line dedup


def test_the_query_deletes_repeated_runs_to_both_ends(spark, tmp_path):
    line = lambda k, n: " ".join(f"p{k}q{j}" for j in range(n))
    shared = [line(1, 60), line(2, 10), line(3, 10)]
    rows = [(1, "\n".join(["own start", *shared, "own end"])), (2, "\n".join(shared)), (3, "\n".join([line(4, 5), *reversed(shared)])), (4, None), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_deleted) for r in line_dedup.op5_line_dedup(spark, str(tmp_path)).collect()}
    want = cases.maximal_runs_removed([t for _, t in rows[:3]])
    assert [got[k][0] for k in (1, 2, 3)] == [want[k] for k in range(3)]
    assert got[2] == ("", 3) and got[4] == (None, 0) and got[5] == ("", 0)


# 8: mixing


def test_targets_are_met_without_ids_and_without_words(spark):
    rows = [(None, f"w{k} " * 10, "a") for k in range(200)] + [(7, f"x{k} " * 5, "b") for k in range(100)]
    rows += [(k, "y z", "d") for k in range(300)] + [(900, None, "c"), (901, "", "c"), (902, " \n", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sums, counts = defaultdict(lambda: [0, 0.0]), defaultdict(int)
    for r in mixing.mix(docs).collect():
        assert r.taken is not None and r.copies is not None and r.taken <= 3 * r.size
        sums[r.source][0] += r.taken
        sums[r.source][1] = r.target
        counts[r.source] += r.copies
    for source, (taken, target) in sums.items():
        assert abs(taken - target) <= {"a": 10, "b": 5, "d": 2}.get(source, 0)
    assert counts["c"] == counts[None] == 0
    kept = mixing.mixed(docs.withColumn("_cut", F.lit(1))).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in kept} == {s: n for s, n in counts.items() if n}


# 10: toxicity


@pytest.fixture(scope="module")
def letters():
    words = {"idiot": 30, "hello": 40, "there": 25, "a": 20, "toll": 9, "dog": 12, "dig": 7, "it": 22, "so": 15}
    return toxicity.Letters(toxicity.count_letters(words))


def every_reading(stretch, letters):
    """Cost of the cheapest reading, by trying all of them."""
    edge, costs = toxicity.EDGE, toxicity.COSTS

    def ways(char, before, run):
        border = costs["apart"] + letters.cost(before, edge), (edge * 2, "")
        if char == edge:
            return [border, (costs["joined"], (before, ""))] if before[1] != edge else [(0.0, (before, ""))]
        if char.isalpha():
            again = [(costs["repeated"], (before, char))] if run == char else []
            return [*again, (costs["itself"] + letters.cost(before, char), (before[1] + char, char))]
        out = [(costs["lost" if char in toxicity.LOOKS else "dropped"], (before, run))]
        for x in toxicity.LOOKS.get(char, ""):
            out += [(costs["repeated"], (before, x))] if run == x else []
            out.append((costs["look"] + letters.cost(before, x), (before[1] + x, x)))
        if char.isdigit():
            out.append((costs["kept"] + letters.cost(before, char), (before[1] + char, char)))
        elif before[1] != edge:
            out.append(border)
        return out

    def cheapest(k, before, run):
        if k == len(stretch) + 1:
            return 0.0 if before[1] == edge else letters.cost(before, edge)
        return min(cost + cheapest(k + 1, *state) for cost, state in ways((stretch + edge)[k], before, run))

    return cheapest(0, edge * 2, "")


def test_decoding_finds_the_cheapest_of_all_readings(letters):
    found = itertools.chain(itertools.product("i1. ", repeat=4), itertools.product("d0!_", repeat=4), [tuple("1d10t"), tuple("i.d.i.o.t"), tuple("iddi00t")])
    for chars in found:
        stretch = "".join(chars).strip()
        cost, words = toxicity.decode(stretch, letters)
        assert abs(cost - every_reading(stretch, letters)) < 1e-9, stretch
    assert toxicity.restore("1d10t", letters) == toxicity.restore("i.d.i.o.t", letters) == ["idiot"]


@pytest.mark.parametrize(("at", "hidden"), [(0, "1d10t"), (333, "i.d.i.o.t"), (832, "1d10t")])
def test_a_hidden_word_is_found_anywhere_in_a_long_token(letters, at, hidden):
    parts = ["hello"] * 833
    parts[min(at, 832)] = hidden
    token = "_".join(parts)
    assert len(token) > 4_900 and "idiot" in toxicity.restore(token, letters)
    assert toxicity.Reader(letters, {"idiot": 0.9}).document("some_hello_there_ text") == 0.0


def test_long_runs_of_spaced_letters(letters):
    reader = toxicity.Reader(letters, {"idiot": 0.9})
    assert reader.document("text i d i o t") == 0.9 and reader.document("text h e l l o") == 0.0
    assert toxicity.pieces("a" * 5_000)[0] == "a" * toxicity.PIECE and "".join(p[toxicity.OVERLAP if k else 0 :] for k, p in enumerate(toxicity.pieces("ab" * 2_500))) == "ab" * 2_500
