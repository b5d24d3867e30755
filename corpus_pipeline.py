"""A training corpus from raw documents: filter, deduplicate, redact, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. docs is a table: read again, it gives the same rows in the same partitions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwright.llm import mixing, packing, quality, secrets, shingles
from inkwright.llm.common import materialize, unused


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list]:
    """docs with columns of these names under others, which an operator doesn't use, and how to
    select the columns of docs again."""
    held = docs
    for c in docs.columns:
        if c.lower() in names:
            held = held.withColumnRenamed(c, unused(held, f"_{c}"))
    return held, [F.col(f"`{h}`").alias(c) for h, c in zip(held.columns, docs.columns)]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rates good; its labels are the table labels.

    Null and blank texts go. Repeated rows are judged alike and stay repeated; a tie of 0.5 stays. An
    empty table gives no rows; further columns keep their values, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held, back = _aside(docs, "scores", "keep")
    return quality.classify(held, labels).filter("keep").select(back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, whose five-word shingles have a Jaccard similarity
    of 0.8 or more: the one with the smallest doc_id.

    Null and empty texts are equal to each other. Of repeated rows one stays; a null doc_id counts as
    the largest. An empty table gives no rows; further columns keep their values.
    """
    return shingles.drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in text and n_chars set anew where one was.

    Null and empty texts stay as they are, repeated rows are masked alike, long texts are read whole.
    An empty table gives no rows; further columns keep their values, whatever their names.
    """
    forest = secrets.train(secrets.labelled_findings(spark), secrets.Vocabulary.load(public_tokenizers.path("word_bpe_49k.json")))
    held, back = _aside(docs, "secrets", "redacted")
    found, hit = secrets.scan(held, forest), F.size("secrets") > 0
    new = {"text": F.col("redacted"), "n_chars": F.when(hit, F.length("redacted").cast("long")).otherwise(F.col("n_chars"))}
    return found.select(*[new[c].alias(c) if c in new else x for c, x in zip(docs.columns, back)])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target takes it.

    Null is a source of its own; documents without words are not taken. Repeated rows are documents of
    their own. An empty table gives no rows; further columns keep their values, whatever their names.
    """
    held, back = _aside(docs, "size", "source_size", "target", "copies", "taken", "finish_times", "finish_time")
    return mixing.mixed_rows(mixing.mix(held), held.columns).select(back)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix cut into pieces and packed into sequences of 4096 ids.

    Null and empty texts are the end id alone; repeated rows are packed each; long texts give as many
    pieces as they need. An empty table gives no rows; further columns play no part.
    """
    found = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return packing.pack(found).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix", mix_sources),
    ("pack", pack),
]

#: The stages hold a trained model, 64-bit hashes and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
