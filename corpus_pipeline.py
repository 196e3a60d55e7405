"""From raw documents to packed training sequences: each stage is written as Parquet and reread as the next one's documents.

A stage owns the tables that it writes to the shared folder. They stay until the next stage begins, since what a stage returns may
still read them while it is written; then they are deleted. So a stage's result has to be written before the next one is called.

Awkward rows: null and empty texts have the models' score of a text without words, are copies of one another
for the join, so that one of them stays, hold no personal data and no words, so the mix takes none of them. Rows that repeat a doc_id
are documents of their own; columns of any name are kept up to the mix. Empty tables give empty results, and without labels of both
classes nothing is toxic.
"""

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import mixing, packing, pii, set_join, toxicity
from tracewell.llm.common import numbered, table
from tracewell.session import drop_stage, prepare, recording, release, stage

#: folders of the stage that ran last
_LEFT: list[str] = []


def owner(apply):
    @wraps(apply)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _LEFT)
        with recording() as paths:
            out = apply(spark, docs, sf_dir)
        _LEFT.extend(paths)
        return out

    return run


@owner
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models do not call toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).where("predicted = 0").select(*docs.columns)


@owner
def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that with the smallest id."""
    return set_join.one_of_each(docs)


@owner
def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data replaced by its kind; n_chars follows."""
    return pii.masked(docs, pii.fit(docs)).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


@owner
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources as documents, once for every round in which the mix takes words of them."""
    return mixing.mixed(numbered(docs))


@owner
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents with their sequence and place."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", one_of_near_duplicates), ("pii", mask_personal_data), ("mix_sources", mix_sources), ("best_fit_packing", pack_sequences)]
#: SQL cannot express the learned stages; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        before, docs = docs, stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
        drop_stage(before)
    return STAGES[-1][1](spark, docs, sf_dir)
