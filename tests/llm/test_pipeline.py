import collections

import pytest

import __spark_entry__
import corpus_pipeline
from buslens.llm.oracles import ORACLES
from tests.llm.helpers import DOCS, ODD_DOCUMENTS, with_clashes
from tools.check_oracle import compare, connect

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The input of each stage and the last result."""
    from buslens.scale import materialise

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], sf_dir), f"test-{name}"))
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "packing"]
    for docs in stages[:-1]:
        assert docs.columns == COLUMNS
        assert docs.dtypes == stages[0].dtypes


def test_decisions_take_effect(spark, stages, sf_dir):
    from buslens.llm.jaccard import near_duplicates
    from buslens.llm.quality import verdicts
    from buslens.llm.repeats import removal_digests

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = {r.doc_id for r in verdicts(stages[0], labels).where("kept").collect()}
    assert {r.doc_id for r in stages[1].collect()} == kept and 0 < len(kept) < stages[0].count()
    groups = collections.defaultdict(list)
    for r in near_duplicates(stages[1]).collect():
        groups[r.class_id].append(r.doc_id)
    assert {r.doc_id for r in stages[2].collect()} == {min(g) for g in groups.values()}
    assert {r.n_links for r in near_duplicates(stages[2]).collect()} == {0}
    removed = {r.doc_id: r.n_removed for r in removal_digests(stages[2]).collect()}
    before, after = ({r.doc_id: r for r in t.collect()} for t in stages[2:4])
    assert before.keys() == after.keys()
    for doc, r in after.items():
        assert len(before[doc].text.split()) - len(r.text.split()) == removed[doc] and r.n_chars == len(r.text)
    assert {r.doc_id for r in stages[4].collect()} == after.keys()


def test_odd_documents_pass(spark, sf_dir):
    docs = with_clashes(spark.createDataFrame(ODD_DOCUMENTS * 2, DOCS))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert "a.b" in docs.columns
        docs.collect()
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).collect() == []


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    assert compare(spark, duck, sf_dir, name) == ""


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names}
    assert set(__spark_entry__.oracle_sql()) <= set(names)
