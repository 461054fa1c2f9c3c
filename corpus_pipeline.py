"""A pipeline over documents: stages that each apply one operator of axonframe.llm.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stage
before it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.llm import copies, decontaminate, packing, quality, substring
from axonframe.llm.common import fresh, read, sized, stored

#: Documents that score lower are rejected.
LEAST_QUALITY = 0.7


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier does not reject.

    Labels of documents whose crc32 of the id, mod 4, is 2 stay unseen, as in the query.
    A null text is judged as an empty one; rows that repeat are judged alike; without
    enough labels nothing is rejected. Columns of any name come through as they are.
    """
    labels = read(spark, sf_dir, "labels").where(~quality.held_out(4, 2))
    model = quality.fit(docs, labels)
    column = fresh("quality_score", docs.columns)
    return quality.score(docs, model, column).where(F.col(column) >= LEAST_QUALITY).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by five-word shingles at 0.8.

    Null and empty texts are copies of one another; the least doc_id of a group stays, a
    null id counting as least; rows equal in id and text count as one document.
    Columns of any name come through as they are.
    """
    return copies.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that repeated windows cover; n_chars, if there, follows. No document goes.

    Null texts stay null and texts of which nothing goes stay as they are. Columns of any name come through.
    """
    kept = substring.cut_repeats(docs, [c for c in docs.columns if c not in ("doc_id", "text")])
    kind = dict(docs.dtypes)

    def column(c: str):
        if c in ("doc_id", "text"):
            return F.col(c).cast(kind[c])
        if c == "n_chars":
            return F.when(F.col("n_removed") > 0, F.length("text").cast(kind[c])).otherwise(F.col("extra")[c]).alias(c)
        return F.col("extra")[c].alias(c)

    return kept.select(*map(column, docs.columns))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; rows that share id and text go or stay together.
    Columns of any name come through as they are.
    """
    found = decontaminate.find_items(docs, read(spark, sf_dir, "benchmark")).select("doc_id", "text_hash").distinct()
    found = stored(found, "contaminated")
    named = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("hash"))
    return named.join(sized(found, 24), F.expr("hash = text_hash and id <=> doc_id"), "left_anti").select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, packed into sequences; a null text is one token, rows that repeat are packed each."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Fingerprints, a fitted model and a genetic algorithm are beyond SQL: tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each result written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
