"""Turn-taking: ordinary and split transcripts give the same numbers."""

import random

import pytest
from helpers import DAY, as_dict
from pyspark.sql import functions as F

from talktally.operators.emit import emit_timing
from talktally.operators.gold import rollup
from talktally.operators.timing import as_struct, timing, typed_sentences

SCHEMA = "tenant_id string, transcript_sid string, sentence_index int, start_time string, end_time string, media_channel int"


def sentences(spark, *triples, sid="s"):
    rows = [("t", sid, i, str(s), str(e), c) for i, (s, e, c) in enumerate(triples)]
    return typed_sentences(spark.createDataFrame(rows, SCHEMA))


CASES = [
    ([(0, 5, 1), (6, 12, 2), (13, 20, 1)], (20, 1, 1, 3, 2, 1)),
    ([(5, 10, 1)], (5, 0, 0, 1, 1, 0)),
    ([(0, 3, 1), (4, 8, 2), (11, 15, 1)], (15, 3, 1, 3, 2, 1)),
    ([(0, 5, 1), (7, 12, 2)], (12, 0, 2, 2, 1, 1)),
    ([(0, 5, 1), (7, 12, 2), (14, 18, 1), (22, 28, 2)], (28, 2, 3, 4, 2, 2)),
    ([(0, 10, 1), (8, 15, 2)], (15, 0, 0, 2, 1, 1)),
    ([(0, 5, 1), (6, 10, 1), (11, 15, 1)], (15, 0, 0, 3, 3, 0)),
    ([(0, 3.333, 1), (5.777, 9.111, 2)], (9.11, 0, 2.44, 2, 1, 1)),
    ([(0.74, 14.49, 1), (14.11, 17.42, 2), (19.92, 30.84, 1)], (30.1, 2.5, 0, 3, 2, 1)),
    ([(0, 1, 1), (2, 3, 3), (4, 5, 2), (6, 7, 1)], (7, 0, 1, 4, 2, 1)),
    ([(6, 7, 2), (0, 5, 1)], (7, 0, 1, 2, 1, 1)),
]


@pytest.mark.parametrize(("given", "expected"), CASES)
def test_timing(spark, given, expected):
    rows = sentences(spark, *given)
    for options in ({}, {"hot_rows": None}, {"hot_rows": 1, "ranges": 3}):
        assert tuple(timing(rows, **options).collect()[0])[2:] == expected


@pytest.mark.parametrize("given", [[(0, 7201, 1)], [(10, 5, 1)]])
def test_implausible_duration_gives_no_row(spark, given):
    assert timing(sentences(spark, *given)).count() == 0


def test_split_transcript_equals_window(spark):
    """One transcript with most of the rows, ties and copies, cut into many ranges."""
    random.seed(7)
    triples = [(random.randint(0, 400) / 4, 0, random.choice([1, 2, 2, 3])) for _ in range(600)]
    triples = [(s, s + random.randint(0, 8) / 4, c) for s, _, c in triples]
    hot = sentences(spark, *triples).unionByName(sentences(spark, *triples[:200])).withColumn("sentence_index", F.lit(0))
    rows = hot.unionByName(sentences(spark, (0, 1, 1), (2, 3, 2), sid="small"))
    plain = sorted(map(tuple, timing(rows, hot_rows=None).collect()))
    split = sorted(map(tuple, timing(rows, hot_rows=50, ranges=32).collect()))
    assert plain == split and len(plain) == 2


def test_daily_timing_skips_zero_and_counts_transcript_once(spark):
    one = as_struct(timing(sentences(spark, (0, 5, 1))))
    rows = one.withColumn("received_at", F.lit(DAY)).unionByName(one.withColumn("received_at", F.lit(DAY)))
    once = as_dict(rollup(emit_timing(rows)), "metric_name", "value")
    assert once == {
        "handling_time_sum": 5, "handling_time_count": 1, "sentence_count_total": 1, "agent_sentence_count": 1, "customer_sentence_count": 0,
    }
    assert as_dict(rollup(emit_timing(rows, grain="fire")), "metric_name", "value")["handling_time_sum"] == 10
