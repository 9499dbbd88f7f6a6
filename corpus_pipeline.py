"""The corpus pipeline: quality, near-duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwatch.llm import mixing, pieces, quality, secrets, simhash
from ringwatch.llm.common import discard, materialize, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, accepts."""
    return quality.keep_good(docs, quality.fit_on(docs, table(spark, sf_dir, "labels")))


#: Ids of dropped documents up to this size are broadcast, so that no text is shuffled; more are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Bytes that an id takes in the relation that Spark builds of broadcast ids, at most.
ID_BYTES = 64


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest doc_id.

    Where doc_ids repeat, rows with the same doc_id and fingerprint are one document; a group's smallest doc_id may
    then stay once for each of its fingerprints."""
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    groups = materialize(simhash.simhash_groups(docs).select(F.col("doc_id").alias("id"), F.col("fp").alias("print"), first.alias("first")))
    n = groups.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"), F.count_if(~F.col("first")).alias("dropped")).first()
    if n["rows"] == n["ids"]:
        dropped = groups.filter(~F.col("first")).select("id")
        return docs.join(F.broadcast(dropped) if ID_BYTES * n["dropped"] <= BROADCAST_BYTES else dropped, docs["doc_id"] == dropped["id"], "left_anti")
    kept = groups.filter("first").select("id", "print").distinct()
    rows = simhash.add_fingerprints(docs, "_print")
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(kept["id"]) & (rows["_print"] == kept["print"]), "left_semi")
    return rows.dropDuplicates(["doc_id", "_print"]).drop("_print")


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with what the secret scan finds replaced by a mark."""
    return secrets.redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequence: documents as often as their source's target takes them, by training position."""
    return mixing.mix_sources(docs, mixing.production_schedule)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of SentencePiece ids of each text, the digests of the ids and of the decoded text, and the text's place in the
    training sequence that the mix wrote."""
    return pieces.token_digests(mixing.training_order(docs), pieces.model_path(), ["position"])


STAGES = [("quality classifier", keep_quality), ("SimHash near-dedup", keep_distinct), ("secret scans", hide_secrets), ("source mixing", mix), ("SentencePiece", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again; a stage's table is deleted when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        kept = materialize(stage(spark, docs, sf_dir))
        if k:
            discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
