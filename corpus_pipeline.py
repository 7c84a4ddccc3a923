"""A corpus pipeline: five stages over documents, each on all that its predecessor kept.

``STAGES`` are written and reread one after another; all but the last return the columns of
``documents``. The order: low quality goes, one document of each group of near
duplicates stays, bytes that repeat an earlier passage go, secrets are masked, and what is
left is packed into sequences. Each row is a document of its own: rows with null or repeated ids are
judged by their own texts, and no stage drops or multiplies them for their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoroll.llm import packing, rule_ensemble, secret_scan, shingle_join, suffix_dedup
from chronoroll.llm.common import Stash, by_row, documents
from chronoroll.llm.text_stats import with_statistics

#: SQL can't express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, row by row; empty texts are rejected like any other."""
    labels = documents(spark, sf_dir, "labels").where(rule_ensemble.remainder(5) != 0)
    model = rule_ensemble.fit(with_statistics(docs.join(labels.select("doc_id"), "doc_id", "left_semi")), labels)
    stats = with_statistics(docs.select(F.struct(*docs.columns).alias("whole"), "text"), "whole")
    return rule_ensemble.scored(stats, model).where("predicted = 1").select("whole.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one row of the smallest id; a null id only where no other is linked."""
    rows, _ = by_row(docs, "doc_id", "text", Stash(spark, "keyed"))
    linked = shingle_join.join(spark, rows.select("row", "text"), id_col="row")
    return rows.join(linked.where("row = component_id").select("row"), "row", "left_semi").select("whole.*")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat an earlier passage; a character that is cut goes as a whole.

    Rows are documents, whatever their ids. Those of which bytes went and nothing but white space is left go; the others stay.
    """
    rows, _ = by_row(docs, "doc_id", "text", Stash(spark, "keyed"))
    kept = suffix_dedup.dedup(spark, rows.select("row", "text"), id_col="row")
    text = F.expr("try_validate_utf8(kept)")
    cut = F.coalesce(text, F.regexp_replace(F.expr("make_valid_utf8(kept)"), "�", ""))
    uncut = F.size("removed") == 0
    left = kept.select("row", uncut.alias("uncut"), F.when(uncut, F.decode("kept", "UTF-8")).otherwise(cut).alias("left"))
    out = rows.join(left.where(F.col("uncut") | F.col("left").rlike(r"[^ \t-\r]")), "row")
    some = F.col("whole.text").isNotNull()
    n_chars = F.when(some, F.length("left").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("whole.n_chars"))
    return out.select(F.col("whole").withField("text", F.when(some, F.col("left"))).withField("n_chars", n_chars).alias("whole")).select("whole.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets masked."""
    return secret_scan.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences and offsets."""
    return packing.pack(spark, docs)


STAGES = [("quality_classifier", quality), ("ngram_jaccard_join", near_duplicates), ("suffix_array_dedup", passages), ("secret_scans", secrets), ("best_fit_packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stash = documents(spark, sf_dir), Stash(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = stash.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
