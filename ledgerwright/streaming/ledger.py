"""The usage ledger as a stream: files of JSON lines in, windowed sums, running totals and alerts out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerwright.sources.readers import LEDGER


def stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """New ledger files as they arrive. `at` is the UTC instant of lines that carry one in ISO form, else null."""
    d = spark.readStream.schema(LEDGER).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_batch).json(path)
    return d.withColumn("at", F.try_to_timestamp("ts"))


def windowed(lines: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """window, caller, calls, unknown, tokens: sums per window and caller; lines later than the watermark are left out."""
    d = lines.where("at IS NOT NULL").withWatermark("at", late)
    return d.groupBy(F.window("at", size), F.coalesce("caller", F.lit("unknown")).alias("caller")).agg(F.count("*").alias("calls"), F.sum(F.col("total_tokens").isNull().cast("int")).alias("unknown"), F.sum("total_tokens").alias("tokens"))


def once(lines: DataFrame, late: str = "1 hour") -> DataFrame:
    """Lines without those collected again within the watermark."""
    return lines.where("at IS NOT NULL").withWatermark("at", late).dropDuplicatesWithinWatermark(["ts", "pid", "model", "caller", "total_tokens"])


def alerts(lines: DataFrame, budget: int) -> DataFrame:
    """pid, tokens, step: a row whenever a writer's running total passes a multiple of the budget. State: one number a writer."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0
        before = total // budget
        for b in batches:
            total += int(b["total_tokens"].fillna(0).sum())
        state.update((total,))
        if total // budget > before:
            yield pd.DataFrame({"pid": [key[0]], "tokens": [total], "step": [total // budget]})

    return lines.select("pid", "total_tokens").groupBy("pid").applyInPandasWithState(step, "pid int, tokens long, step long", "total long", "update", GroupStateTimeout.NoTimeout)


def sessions(lines: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """pid, started, ended, calls: sessions of writers, closed by a pause."""
    d = lines.where("at IS NOT NULL").withWatermark("at", late)
    s = d.groupBy("pid", F.session_window("at", gap).alias("s")).agg(F.count("*").alias("calls"))
    return s.select("pid", F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "calls")


def keep_totals(lines: DataFrame, path: str, checkpoint: str):
    """Writes each batch's sums by writer and date; a batch that is run again replaces itself, so totals count it once."""

    def write(batch: DataFrame, epoch: int) -> None:
        sums = batch.groupBy("pid", "date").agg(F.count("*").alias("calls"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
