"""Message streams: decode, validate, process, and route what cannot go on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import filters as FL
from tidewire.operators.runs import latest_payload
from tidewire.session import cut
from tidewire.sources.messages import decode

ENVELOPE = ("topic", "partition", "offset", "key", "value")
ROUTES = ("done", "dead", "retry")


@dataclass
class MessageHandler:
    """What to do with the messages of a topic.

    ``reject`` gives the reason to refuse a decoded message, or NULL.
    ``process`` maps good messages to output rows; rows it cannot do carry a
    ``process_error`` and come back for retry.  With ``always_mark`` a message
    that is refused counts as done, else it comes back too.
    """

    reject: Callable[[DataFrame], Column]
    process: Callable[[DataFrame], DataFrame] = lambda df: df
    always_mark: bool = True


def _creation_reject(_: DataFrame) -> Column:
    return FL.message_reject(F.col("status"), F.col("uuid"))


def _run_reject(_: DataFrame) -> Column:
    return F.when(~FL.payload_valid(F.col("uuid")), "missing uuid")


CREATION = MessageHandler(_creation_reject)
RUNS = MessageHandler(_run_reject)


def judge(envelopes: DataFrame, handler: MessageHandler) -> DataFrame:
    """Decoded messages with ``reject_reason``; good ones have NULL there."""
    decoded = decode(envelopes)
    return decoded.withColumn(
        "reject_reason", F.coalesce("decode_error", handler.reject(decoded))
    ).drop("decode_error")


def route(envelopes: DataFrame, handler: MessageHandler) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(done, dead, retry)`` of a batch of envelopes, which is decoded once."""
    judged = cut(judge(envelopes, handler), "judged")
    good = judged.where("reject_reason is null").drop("reject_reason")
    bad = judged.where("reject_reason is not null").select(*envelopes.columns, "reject_reason")
    out = handler.process(good)
    if "process_error" in out.columns:
        failed = out.where("process_error is not null")
        retry = failed.select(*envelopes.columns, F.col("process_error").alias("reject_reason"))
        out = out.where("process_error is null").drop("process_error")
    else:
        retry = bad.limit(0)
    if not handler.always_mark:
        return out, bad.limit(0), retry.unionByName(bad)
    return out, bad, retry


def message_stream(
    stream: DataFrame,
    handler: MessageHandler,
    out: str,
    checkpoint: str,
    every: str | None = None,
    split_by: str | None = None,
    take_up: bool = False,
):
    """Run ``handler`` over a stream into ``out``: one table, split by ``batch`` and ``route``
    (done, dead, retry), read back with ``routed``.

    Each batch replaces its own folder, so a batch that runs twice is written once, and all its
    routes in one write.  ``split_by`` fans the output out by a column, such as the topic.  With
    ``take_up`` a batch begins with the messages that the one before it left for retry; those of
    the last one wait for the next start.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*ENVELOPE)
        if take_up and batch_id > 0:
            last = routed(batch.sparkSession, out, "retry", f"batch = {batch_id - 1}")
            if last is not None:
                rows = last.select(*ENVELOPE).unionByName(rows)
        named = [r.withColumn("route", F.lit(n)) for n, r in zip(ROUTES, route(rows, handler), strict=True)]
        whole = named[0].unionByName(named[1], allowMissingColumns=True).unionByName(named[2], allowMissingColumns=True)
        parts = ["route", *([split_by] if split_by else [])]
        whole.write.mode("overwrite").partitionBy(*parts).parquet(f"{out}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def routed(spark: SparkSession, out: str, name: str, where: str = "true") -> DataFrame | None:
    """What ``message_stream`` has written on one route; None before its first batch."""
    try:
        rows = spark.read.option("mergeSchema", "true").parquet(out)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return rows.where((F.col("route") == name) & F.expr(where)).drop("batch", "route")


def latest_state_stream(stream: DataFrame, by: list[str], out: str, checkpoint: str, every: str | None = None):
    """Keep the latest payload per run: a running arg-max, changed runs written per batch.

    ``out`` holds one partition per batch; the newest offset of a run is its state.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = (
        latest_payload(stream, by)
        .writeStream.outputMode("update")
        .foreachBatch(each)
        .option("checkpointLocation", checkpoint)
    )
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()
