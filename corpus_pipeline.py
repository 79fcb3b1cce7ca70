"""The corpus pipeline: from raw documents to packed training sequences.

Stages, each over all that the one before kept, written as Parquet and read again:

1. toxicity: a classifier fitted on the given labels; documents it predicts toxic go.
2. near_dedup: of every class of copies and near copies the document of the smallest id stays.
3. secrets: owner-specific, live-looking credentials are replaced by a mark; no document goes. Owners and repositories are
   counted over the raw table, copies that went before included, as copies are what marks an example.
4. mixing: documents are sampled towards flatter source, language and topic shares.
5. packing: the documents' token ids are cut and packed; a row for each piece, with its ids.

All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bagminhash, mixing, packing, secrets, toxicity
from quire.llm.common import Stage, table, whole_text


#: Workers live through all stages and keep some memory of each, so the last one remembers less.
MEMO = 300_000
#: Rows that a task decodes of a Parquet file at once, and those it hands to Python at once. It holds both, and texts are whole.
BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": 256, "spark.sql.execution.arrow.maxRecordsPerBatch": 512}


def small_batches(spark: SparkSession) -> None:
    """Lower the session's batches to ``BATCHES``; smaller ones stay. A lazy result is read with them too, so they aren't put back."""
    for key, most in BATCHES.items():
        if not 0 < int(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, names=("__score", "__predicted")).filter("__predicted = 0").select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bagminhash.deduplicated(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    raw = table(spark, sf_dir, "documents")
    out = secrets.redact(docs, owner=F.col("source"), repo=F.concat_ws("/", "source", "lang"), corpus=raw)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic_of(whole_text("text"))}
    return mixing.mixed(docs, dims)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=True, memo=MEMO)


STAGES = [("toxicity", toxicity_stage), ("near_dedup", near_dedup_stage), ("secrets", secrets_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: SQL can't express a fitted classifier, signatures, raking by iteration or packing: tests hold every
#: stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    stage = Stage(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage.keep(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
