"""A training corpus from ``documents``: quality rules, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet and reads them
again for the next. All but the last return the columns of ``documents``. Other columns of the input come along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfolio.llm import mixing, neardup, packing, pii, quality
from kinfolio.llm.common import free_names, small_batches, table, written
from kinfolio.session import ship

#: Rejected ids that are sent to every task; beyond, both sides are shuffled.
BROADCAST_IDS = 2_000_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null and empty texts have no words and go; very long texts are read whole; repeated rows are judged alike; a null doc_id
    is no reason to go. An empty table stays empty; without labels the base rule alone decides.
    """
    ship(spark)
    small_batches(spark)
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 the smallest doc_id stays.

    Rows of one doc_id are one document: the one with the smallest text stays, of equal texts the smallest in its other
    columns, so reruns agree. Null and empty texts link with nothing and stay, rows of null doc_id stay all, very long texts
    are compared whole. An empty table stays empty.
    """
    ship(spark)
    small_batches(spark)
    found = neardup.link(docs, width=5, similarity=0.8)
    gone = written(found.where("NOT kept").select("doc_id").distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")
    again = written(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id IS NOT NULL AND n > 1").select("doc_id"), "again")
    if again.isEmpty():
        return kept
    (row,) = free_names(docs.columns, "row")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    once = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(whole, F.struct("text", F.to_json(whole))).alias(row))
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(f"{row}.*"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind in brackets.

    Every row stays. Null and empty texts stay as they are, very long texts are read whole, repeated rows change alike. An
    empty table stays empty.
    """
    ship(spark)
    small_batches(spark)
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents left out, repeated, and one a source repeated in part.

    Null and empty texts have no words and stay once, as do rows of null doc_id; a null source is one of the sources. Ties in
    the seeded order are between equal rows. An empty table stays empty.
    """
    ship(spark)
    return mixing.repeated(docs, mixing.mix(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of the permitted lengths: which words of which document stand where.

    Null and empty texts have no words and no place; very long texts are cut at the longest length; repeated rows and rows
    of null doc_id are copies of one another. An empty table packs to none.
    """
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Trained rules, regular-expression spans and best fit are not SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
