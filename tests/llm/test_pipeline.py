"""The pipeline's stages and the registered queries."""

import __spark_entry__
import corpus_pipeline
import duckdb
import pytest
from plainframe.llm import queries

from .conftest import SCHEMA, prose, row

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, SF)
        assert step.columns == docs.columns, name
        counts.append(step.count())
    assert counts[0] >= counts[1] == counts[2] > counts[3] == counts[4] > 0.6 * counts[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, step, SF)
    assert packed.select("doc_id").distinct().count() == counts[-1]


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 100


def tables(spark, folder, rows, labels):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_with_nulls_ties_and_clashing_names(spark, tmp_path, odd_rows):
    bad = [row(1000 + i, prose(i, 30) + (" moronic worthless scum" if i % 2 else ""), f"s{i % 3}") for i in range(60)]
    rows = odd_rows + bad
    sf = tables(spark, tmp_path, rows, [(1000 + i, 1, i % 2) for i in range(60)] + [(None, 1, 1), (0, None, None), (1001, 1, 1)])
    step = spark.read.parquet(f"{sf}/documents.parquet")
    names = step.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, step = step.count(), stage(spark, step, sf)
        assert step.columns == names and step.count() <= before, name
        texts = {r.text for r in step.select("text").collect()}
        assert None in texts and "" in texts, name
        if name == "toxicity":
            assert not any("moronic" in (t or "") for t in texts) and step.count() == len(rows) - 30
        if name == "minhash_near_dedup":
            assert len([t for t in texts if t and t.startswith(prose(1, 120))]) == 1
    packed = corpus_pipeline.STAGES[-1][1](spark, step, sf)
    assert packed.filter("doc_id IS NULL").count() >= 1 and packed.count() >= step.count()
    run = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, run.drop("sequence_id", "offset").collect())) == sorted(map(str, packed.drop("sequence_id", "offset").collect()))


def test_stages_of_empty_tables(spark, tmp_path):
    sf = tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{k}" for k in range(1, 11)] and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    r = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in r.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, r.fetchall())) == sorted(str(tuple(x)) for x in df.select(*columns).collect())
