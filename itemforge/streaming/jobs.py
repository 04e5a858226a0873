"""Streaming extensions (the bank's work is batch): document intake and job states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bank import BankStore, import_documents
from ..sources.files import payload_questions

EVENT = "job_id STRING, seq LONG, stage INT, state STRING, message STRING, at TIMESTAMP"
PAYLOAD_HEAD = "hash_pdf STRING, arquivo STRING, tipo STRING, titulo STRING, disciplina STRING, topico STRING"


def latest_state(events: DataFrame) -> DataFrame:
    """The last event of each job, for batch and for streams in update mode: a maximum
    by sequence, combined before the shuffle."""
    last = F.max_by(F.struct("stage", "state", "message", "at"), "seq").alias("last")
    return events.groupBy("job_id").agg(last).select("job_id", "last.*")


def state_windows(events: DataFrame, length: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events per state and window; windows close once the watermark passes them."""
    return events.withWatermark("at", late).groupBy(F.window("at", length), "state").agg(F.count(F.lit(1)).alias("n"))


def import_stream(spark: SparkSession, folder: str, root: str, checkpoint: str):
    """A query that imports payload files (one JSON document per file) as they come. Each
    batch is one version of the bank; a batch that is tried again finds its hashes there
    and changes nothing, so every document counts once."""
    files = spark.readStream.format("text").option("wholetext", True).load(folder).withColumnRenamed("value", "payload")

    def take(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        head = batch.select(F.from_json("payload", PAYLOAD_HEAD, {"mode": "FAILFAST"}).alias("h")).select(F.col("h.hash_pdf").alias("hash"), F.col("h.arquivo").alias("file"), F.col("h.tipo").alias("kind"), F.col("h.titulo").alias("title"), F.col("h.disciplina").alias("discipline"), F.col("h.topico").alias("topic"))
        import_documents(BankStore(batch.sparkSession, root), head.dropDuplicates(["hash"]), payload_questions(batch).dropDuplicates(["hash", "number"]))

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
