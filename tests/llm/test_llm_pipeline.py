"""The pipeline's stages, each against its operator's plain version, and the registered queries."""

from __future__ import annotations

import collections
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import cases  # noqa: E402
import corpus_pipeline  # noqa: E402

import __spark_entry__  # noqa: E402
from checks import compare  # noqa: E402
from talktally.llm import bpe, toxicity  # noqa: E402
from talktally.llm.registry import ORACLES, QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
ROWS = cases.rows()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    problem = compare.check(spark, compare.connect(SF_DIR), name, QUERIES[name], ORACLES.get(name), SF_DIR)
    assert problem is None


def test_all_queries_are_registered():
    names = __spark_entry__.queries().keys()
    assert {n.split("_")[0] for n in names if n[:2] == "op" and n[2].isdigit()} == {f"op{k}" for k in range(1, 14)}
    assert "pipeline" in names


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    cases.documents(spark).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(20, 1, 0), (21, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_keep_the_columns_and_do_their_work(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "minhash", "mixing", "bpe"]

    kept = stages["toxicity"](spark, docs, folder)
    scores = toxicity.toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet"), column="s")
    assert kept.columns == docs.columns and kept.count() == scores.where("s < 0.5").count() == len(ROWS)

    lines = stages["line_dedup"](spark, docs, folder)
    want = cases.repeated_runs_removed(ROWS)
    assert lines.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text) for r in lines.collect()) == collections.Counter((d[0], want.get((d[0], d[1]))) for d in ROWS)
    assert all(r.n_chars == len(r.text) for r in lines.where("doc_id = 8").collect())

    single = stages["minhash"](spark, docs, folder)
    components = {d: c for d, _, c in cases.near_components(ROWS) if d is not None}
    assert single.columns == docs.columns
    assert sorted(r.doc_id for r in single.where("doc_id IS NOT NULL").collect()) == sorted({d for d, c in components.items() if d == c})

    mixed = stages["mixing"](spark, docs, folder)
    assert mixed.columns == docs.columns
    ids = stages["bpe"](spark, docs, folder)
    assert {"doc_id", "n_tokens", "ids"} <= set(ids.columns) and ids.count() == len(ROWS)
    assert ids.where("n_tokens <> size(ids)").count() == 0
    assert {r.decoded for r in bpe.decode(ids).where("doc_id IN (1, 2, 3)").collect()} == {""}


def test_run_and_an_empty_table(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_hidden_import_errors_are_not_swallowed():
    assert "except" not in Path(corpus_pipeline.__file__).read_text()
