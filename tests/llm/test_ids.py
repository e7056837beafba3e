"""Every operator with ids of any type, with very long texts, and what is left in the shared folder."""

from pathlib import Path

import public_tokenizers as P
import pytest
from plainframe.llm import bpe, exact_dedup, line_dedup, near_dedup, packing, quality_rules, secret_scan, shared, substring_dedup, token_counts, toxicity
from pyspark.sql import functions as F

from .conftest import SCHEMA, prose, row

BYTES, WORDS, RANKS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")


def labels(docs):
    return docs.select("doc_id", F.col("text").contains("alpha").cast("int").alias("toxic"), F.col("text").contains("beta").cast("int").alias("quality"))


OPERATORS = {
    "toxicity": lambda docs: toxicity.score(docs, toxicity.fit(docs, labels(docs))),
    "drop_toxic": lambda docs: toxicity.drop_toxic(docs, toxicity.fit(docs, labels(docs))),
    "substring_dedup": substring_dedup.substring_dedup,
    "line_dedup": lambda docs: line_dedup.line_dedup(docs, "source"),
    "packing": lambda docs: packing.pack(docs, WORDS),
    "near_dedup": near_dedup.near_dedup,
    "keep_one": near_dedup.keep_one,
    "exact_dedup": exact_dedup.exact_dedup,
    "token_counts": lambda docs: token_counts.token_counts(docs, BYTES),
    "bpe": lambda docs: bpe.encode_and_decode(docs, RANKS, P.PATTERN),
    "secret_scan": lambda docs: secret_scan.secret_scan(docs, "source", "doc_id"),
    "redact": lambda docs: secret_scan.redact(docs, "source", "doc_id"),
    "quality_rules": lambda docs: quality_rules.quality_rules(docs, quality_rules.fit(docs, labels(docs))),
}
FEWER = {"drop_toxic", "keep_one"}


@pytest.mark.parametrize("kind", ["string", "int"])
@pytest.mark.parametrize("name", OPERATORS)
def test_ids_of_any_type(spark, odd, name, kind):
    made = F.date_add(F.lit("2020-01-01"), F.col("doc_id").cast("int")) if kind == "date" else F.col("doc_id").cast(kind)
    docs = odd.withColumn("doc_id", made)
    out = OPERATORS[name](docs)
    assert dict(out.dtypes)["doc_id"] == kind
    got = {r.doc_id for r in out.select("doc_id").collect()}
    wanted = {r.doc_id for r in docs.select("doc_id").collect()}
    assert got <= wanted if name in FEWER else got == wanted


@pytest.mark.parametrize("name", OPERATORS)
def test_texts_of_megabytes(spark, name):
    """A text of 5 MB of words, one of a single word of 2 MB, one of 200,000 lines."""
    texts = [prose(1, 900_000), "ab" * 1_000_000, "\n".join(f"line {i % 500}" for i in range(200_000)), prose(2, 80), prose(2, 80)]
    docs = spark.createDataFrame([row(i, t, "s") for i, t in enumerate(texts)], SCHEMA)
    out = OPERATORS[name](docs)
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert ids <= set(range(5)) if name in FEWER else ids == set(range(5))


@pytest.mark.parametrize("name", OPERATORS)
def test_scratch_leaves_nothing_behind(spark, odd, tmp_path, name):
    folder = Path(shared.shared_dir(spark).removeprefix("file://"))
    before = {x.name for x in folder.iterdir()}
    with shared.scratch(spark):
        out = OPERATORS[name](odd)
        out.write.parquet(str(tmp_path / "out"))
    assert {x.name for x in folder.iterdir() if not x.name.startswith(".")} <= before
    assert spark.read.parquet(str(tmp_path / "out")).columns == out.columns


def test_a_cluster_needs_a_shared_folder():
    class Cluster:
        conf = {}

        class sparkContext:
            applicationId, master = "none", "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Cluster)
