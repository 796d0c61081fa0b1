"""A pipeline over the documents: clean, identify, deduplicate, mix and pack.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame, which is written as Parquet and reread as the next one's docs.  All but the last return
the columns of documents.

Edge cases, the same in every stage: nulls may be in any column and other columns are kept (by all but the last);
repeated rows are judged alike; an empty table gives an empty result.  Null, empty and letterless texts pass
toxicity (their score is the bias's), are rejected by the language stage if any row has a lang, link with nothing, have no
tokens to mix and are packed as their end token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import langid, mixing, ngram_join, packing, toxicity
from parlance.llm.common import drop_stored, fold, new_path, read
from parlance.session import ship


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier scores 0.5 or more go.

    A null label trains nothing; without any training row every document has the score of the prior and stays.
    """
    ship(spark)
    labels = read(spark, sf_dir, "labels")
    return toxicity.clean(docs, toxicity.train(docs, labels.where(fold(F.col("doc_id"), 5) != 0)))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those whose text is surely in another language than they say.

    A document without a lang stays if it has a letter; where no row has a lang, the stage rejects nothing.
    """
    ship(spark)
    return langid.agreeing(docs, langid.train(docs.where(fold(F.col("doc_id"), 4) != 2)))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the least id.

    Documents without a word are in no group and stay, as do rows without an id; of rows that share the id one stays.
    """
    ship(spark)
    return ngram_join.one_of_each(docs, n=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are raised towards equal shares, none used more than twice; every document is used once at least.

    A null source is a source of its own; documents without tokens follow their source's passes.
    """
    ship(spark)
    return mixing.mixed(docs, max_repeats=2.0)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens; a null or empty text is its end token."""
    ship(spark)
    return packing.packed(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can express none of the first three stages.  tests/llm holds run() against plain Python over a whole small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return out
        path = new_path(spark, f"stage-{number}")
        out.write.parquet(path)
        if number:
            drop_stored(docs)  # what the stage before kept
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
