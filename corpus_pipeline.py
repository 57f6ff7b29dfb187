"""A training corpus from documents: toxic ones go, copies and near copies are reduced to one, sources are mixed, texts encoded.

STAGES are (name, function); each function takes (spark, docs, sf_dir), docs being all that the stage before it kept, and
returns a DataFrame, which is written as Parquet and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftfold.llm import exact_dedup, mixing, ngram_join, sentencepiece_nbest, toxicity
from siftfold.llm.common import table, written
from siftfold.storage import mark, release

#: SQL can't express the classifier, the MinHash join or the lattice search.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects by the threshold of their language.

    It is trained on the documents of this stage that have labels; where there are none of both kinds, all documents stay.
    Null and empty texts are scored as texts without words; repeated rows and equal texts are decided alike; texts count
    whole; an empty table gives an empty result; columns may have any name.
    """
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.reject_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (A-Z lower-cased, null as empty): that of the smallest id.

    Rows equal in id and text count as one; a null id stays only where the whole group has null ids; texts count whole; an
    empty table gives an empty result; columns may have any name.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarities of 0.8 or more on five-word shingles connect: that of the smallest id.

    Null texts and texts without words are in no group and stay; rows equal in id and text count as one; a null id stays only
    where all of the group are null; texts count whole; an empty table gives an empty result; columns may have any name.
    """
    return ngram_join.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: complete epochs of a source, then a weighted sample of it.

    Null texts and texts without words are not taken; null is a source of its own; of equal keys the smaller id comes first;
    repeated rows are mixed each; an empty table gives an empty result; columns may have any name.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per row: ids of the best segmentation, its score, and those of the next best ones.

    Null and empty texts have no ids; repeated rows are encoded each; texts count whole; an empty table gives an empty
    result; other columns than doc_id and text are not read.
    """
    return sentencepiece_nbest.encode_nbest(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage and those before it have written is deleted when its result is there."""
    docs = table(spark, sf_dir, "documents")
    first = mark(spark)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, first, mark(spark) - 1)
    return docs
