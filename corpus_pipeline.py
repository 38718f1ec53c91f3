"""Training-data pipeline over documents: low quality out, one of each near-duplicate group, benchmark passages out,
sources mixed to their weights, the mix as token ids.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. A stage's result is written
as Parquet and read again as the next one's docs.

Stages decide by row, not by doc_id: a null or repeated id keeps or loses no other row. Null and empty texts, texts of
white space and very long texts are documents like any other until the mix, which takes no row without words. Ties and
repeated rows give the same rows at every run. Extra columns stay, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import common, decontaminate, jaccard, mixing, quality, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; equal texts are decided alike."""
    return quality.accepted(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest doc_id; rows alike in id and text stay together, rows without words stay."""
    return jaccard.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows of one id are told apart by their texts."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, in the order of virtual finish times; a document that it takes twice is there twice, one without words not at all."""
    return mixing.schedule(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the mix, read back from the token files; a null text is the end id alone."""
    return tokens.token_table(docs)


STAGES = [
    ("quality classifier", accept_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]

#: The classifier is a fitted network and the token ids are a tokenizer's, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
