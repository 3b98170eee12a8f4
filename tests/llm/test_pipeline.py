"""Every stage on its own input, and registered queries against their statements."""

import duckdb
import pytest
from check_queries import compare

import __spark_entry__ as contract
import corpus_pipeline as pipeline
from terrascope.llm import queries

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = [docs]
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, found[-1], FOLDER).write.parquet(path)
        found.append(spark.read.parquet(path))
    return found


def test_stage_columns_and_order(stages):
    assert [name for name, _ in pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mixture", "packing"]
    assert all(sorted(df.columns) == sorted(COLUMNS) for df in stages[:-1])


def test_decisions_take_effect(spark, stages):
    from terrascope.llm.circulant_minhash import near_duplicates

    docs, good, single, masked, mixed, packed = stages
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in stages[:-1]]
    assert ids[0] > ids[1] > ids[2] == ids[3] >= ids[4] == {r.doc_id for r in packed.select("doc_id").collect()}
    assert good.exceptAll(docs).isEmpty() and single.exceptAll(good).isEmpty()
    assert near_duplicates(single).where("not kept").isEmpty()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 1")
    clean = docs.join(labels, "doc_id", "left_semi")
    assert clean.join(good, "doc_id", "left_anti").count() <= 0.05 * clean.count()
    assert masked.where("text rlike 'AKIA[A-Z0-9]{14,}' or text rlike '[0-9a-f]{16,}'").isEmpty()
    words = lambda df: sum(len((r.text or "").split()) for r in df.select("text").collect())
    assert words(mixed) == pytest.approx(1.5 * words(masked), rel=0.05)


def test_empty_table_passes(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, more int")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0


def test_registered():
    names = contract.queries()
    for n in range(1, 14):
        assert len([k for k in names if k.startswith(f"op{n}_")]) == 1
    assert names["pipeline"] is pipeline.run


@pytest.mark.parametrize("key", sorted(queries.CHECKS))
def test_query_matches_check(spark, key):
    db = duckdb.connect()
    for name in ("documents", "pages"):
        db.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    assert compare(queries.QUERIES[key](spark, FOLDER).toArrow(), db.execute(queries.CHECKS[key]).to_arrow_table()) == "ok"
