import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from conftest import SF_DIR
from credlens.llm import cuckoo, mixing, oracle, queries, repetition, simhash

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in glob.glob(f"{SF_DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return con


def test_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(oracle.ORACLE) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    want = duck.sql(oracle.ORACLE[name])
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(want.select(*[f'"{c}"' for c in columns]).fetchall(), key=str)


def test_pipeline_against_its_stages_by_hand(spark):
    """Each stage's rows, held against the operator's own verdicts on that stage's input."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "simhash_near_dedup", "mix_sources", "sentencepiece"]
    decide = [
        lambda d: {r.doc_id: int(r.kept) for r in repetition.judge_repetition(d).collect()},
        lambda d: {r.doc_id: int(r.kept) for r in cuckoo.exact_duplicates(d).collect()},
        lambda d: {r.doc_id: int(r.doc_id == r.component_id) for r in simhash.near_duplicates(d).collect()},
        lambda d: {r.doc_id: r.taken // r.size if r.size else 0 for r in mixing.mix_sources(d).collect()},
    ]
    for (name, stage), verdicts in zip(corpus_pipeline.STAGES, decide):
        want = sorted(i for i, times in verdicts(docs).items() for _ in range(times))
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert sorted(r.doc_id for r in docs.collect()) == want and want, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    assert len(last) == docs.count() and all(r.round_trip and r.n_tokens for r in last)
    whole = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in whole) == sorted((r.doc_id, r.n_tokens) for r in last)
