"""The corpus pipeline: five stages, each over all that the one before it kept, written as Parquet in between.

Cases, the same for every stage: columns beyond doc_id, source and text are carried through the first four
whatever their names, and never read. A null text is no document to drop: it stays null until it is
packed as its end token; an empty text is as near a copy of another as two texts without words are, not at
all. Null ids and sources are values of their own. Rows repeated as a whole are copies, of which near-duplicate
detection keeps one. An empty table of documents, or of labels, gives an empty result, or one from
which nothing toxic is dropped.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plainframe.llm import line_dedup, near_dedup, packing, secret_scan, toxicity
from plainframe.llm.shared import drop_table, scratch, table, write_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples vote toxic go."""
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, index)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that too many documents of one source contain go from the texts; sources stand for hosts."""
    return line_dedup.line_dedup(docs, "source")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near-equal sets of five-word shingles, the one of the smallest id stays."""
    return near_dedup.keep_one(docs, shingle=5, percent=80)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are replaced in the texts; values that many sources or documents copy stay."""
    return secret_scan.redact(docs, "source", "doc_id")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts' token ids and their places in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("secret_scans", remove_secrets),
    ("best_fit_packing", pack_sequences),
]
#: SQL can't express the vote of nearest neighbours or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, over documents. Tables of a stage go once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as kept:
            written = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}", even=False)
            kept.append(written)
        drop_table(docs)
        docs = written
    return STAGES[-1][1](spark, docs, sf_dir)
