"""Registered queries against their SQL, and the pipeline's stages against the operators' plain results."""

import pytest
from oracle_check import compare, connect

from barscope.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    n, err = compare(spark, con, SF, QUERIES[name].run, QUERIES[name].sql)
    assert err is None and n > 0, err


def test_names():
    import __spark_entry__ as e

    names = list(e.queries())
    assert "pipeline" in names and all(sum(x.startswith(f"op{n}_") for x in names) == 1 for n in range(1, 14))


def test_pipeline(spark):
    import corpus_pipeline as p

    from barscope.llm.common import table
    from barscope.llm.q_toxicity import op4

    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, {r.doc_id for r in docs.collect()}
    assert [name for name, _ in p.STAGES][0] == "toxicity" and len(p.STAGES) == 5
    now = docs
    toxic = {r.doc_id for r in op4(spark, SF).where("predicted = 1").collect()}
    for name, stage in p.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == columns
        now = spark.createDataFrame(now.collect(), docs.schema)
        left = {r.doc_id for r in now.collect()}
        assert left <= kept and len(left) > 0.8 * len(kept)
        if name == "toxicity":
            assert left == kept - toxic
        if name == "line_dedup":
            assert left == kept
        kept = left
    last = {r.doc_id for r in p.STAGES[-1][1](spark, now, SF).collect()}
    assert last == kept == {r.doc_id for r in p.run(spark, SF).collect()}
