"""Documents made ready for training, in five stages: toxicity, near copies, private values, mixture, piece ids.

Each stage takes what its predecessor kept and returns the columns of documents, the last one the piece ids. Stages
keep every column they do not change, extra ones included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfolio.llm.common import let_tasks_import, stored, table
from gridfolio.llm.dart_minhash import near_duplicates
from gridfolio.llm.pseudonyms import pseudonymised
from gridfolio.llm.soft_mixing import mixed
from gridfolio.llm.toxic_crf import fit, held_out
from gridfolio.llm.toxic_crf import toxicity as toxic_score
from gridfolio.llm.viterbi import encoded

#: Names the rows of a stage's input; no column of documents.
ROW = "_near_copies_row"
#: Documents whose score reaches this are rejected, as in the operator's own query.
TOXIC = 0.7


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose whole text scores below ``TOXIC``; texts that are null or empty stay."""
    let_tasks_import(spark)
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    return docs.where(toxic_score(model, F.col("text"))["score"] < TOXIC)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, that of the smallest doc_id; rows of a null doc_id stay.

    Rows are compared one by one, whatever their ids: of rows that repeat a doc_id only those go whose texts are near
    copies of a text that stays, and rows of one doc_id with unrelated texts all stay.
    """
    let_tasks_import(spark)
    numbered = stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")  # the number is read back, never made again
    named = numbered.where("doc_id is not null").select(ROW, "doc_id", "text")
    classes = stored(near_duplicates(named, ROW), "classes")
    members = classes.join(named.select(F.col(ROW).alias("id"), "doc_id").hint("merge"), "id")
    first = members.groupBy("class_id").agg(F.min(F.struct("doc_id", "id")).alias("first")).select("first.id")
    gone = stored(members.join(first.hint("merge"), "id", "left_anti").select(F.col("id").alias("gone")), "gone")
    # the dropped rows grow with the corpus, so the join is stated: the same plan at every size
    return numbered.join(gone.hint("merge"), numbered[ROW] == gone["gone"], "left_anti").select(*[numbered[f"`{c}`"] for c in docs.columns])


def private_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for the private values in their texts."""
    let_tasks_import(spark)
    return pseudonymised(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of domains below their share more often."""
    return mixed(docs, table(spark, sf_dir, "labels"))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_ids, round_trip) of every row."""
    let_tasks_import(spark)
    return encoded(docs)


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("private_values", private_values), ("mixture", mixture), ("piece_ids", piece_ids)]

#: SQL states neither the fitted scores nor the ids; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
