"""Status feeds as streams. Each runs over what is there (availableNow), checkpointed in the shared folder."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from waymark.functions.rounds import new_path

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def state() -> Column:
    kind = F.col("event_type")
    return F.when(kind == "view", "open").when(kind == "click", "restricted").when(kind == "error", "closed").otherwise("unknown")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream."""
    return spark.readStream.schema(SCHEMA).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def _run(stream: DataFrame, mode: str, each=None) -> str:
    """Runs the stream to its end; returns the folder of its output, a folder for each batch."""
    spark, path = stream.sparkSession, new_path(stream.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is repeated after a failure replaces its own folder
        (each(batch, number) if each else batch).write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return f"{path}/out"


def latest_status(spark: SparkSession, sf_dir: str, stale_hours: int = 24) -> DataFrame:
    """Latest state of each pass, of readings of one instant that of the largest id, kept as streaming state; stale ones are
    marked against the newest reading. Each batch writes the passes that changed, and the last row of a pass counts."""
    agg = feed(spark, sf_dir).groupBy(F.col("user_id").alias("pass_id")).agg(F.max_by(state(), F.struct("ts", "event_id")).alias("state"), F.max(F.unix_micros("ts")).alias("seen"))
    last = spark.read.parquet(_run(agg, "update")).groupBy("pass_id").agg(F.max_by("state", "batch").alias("state"), F.max("seen").alias("seen"))
    newest = last.agg(F.max("seen")).first()[0] or 0  # one number
    return last.select("pass_id", "state", "seen", (F.col("seen") < newest - stale_hours * 3_600_000_000).alias("stale"))


def stale_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each pass, state and day: repeats within the watermark are dropped."""
    rows = feed(spark, sf_dir).withWatermark("ts", "40 days").select("ts", F.col("user_id").alias("pass_id"), state().alias("state"), F.unix_date(F.to_date("ts")).cast("long").alias("day"))
    kept = rows.dropDuplicatesWithinWatermark(["pass_id", "state", "day"]).select("pass_id", "state", "day")
    return spark.read.parquet(_run(kept, "append")).drop("batch")


def freshness_gate(spark: SparkSession, sf_dir: str, clock: str = "2024-01-30 12:00:00") -> DataFrame:
    """Readings against a clock: fresh within 72 h and five minutes ahead, else late or future."""
    age = F.unix_micros(F.lit(clock).cast("timestamp")) - F.unix_micros("ts")
    verdict = F.when(age > 72 * 3_600_000_000, "late").when(age < -300_000_000, "future").otherwise("fresh")
    rows = feed(spark, sf_dir).select(F.col("event_id").alias("id"), verdict.alias("verdict"))
    return spark.read.parquet(_run(rows, "append")).drop("batch")


#: Of each key: load since the last break, readings since it, breaks so far, and the newest reading.
BREAK_STATE = "total double, since int, number long, newest long"


def breaks_due(readings: DataFrame, threshold: float = 120.0, rest: int = 4) -> DataFrame:
    """readings(pass_id, ts, event_id, value), a stream: a break is due once the load since the last one passes the threshold,
    `rest` readings after it or more (the cool-down). Readings of a batch are taken in order of time; one older than the
    newest of an earlier batch is dropped, as its place in the order has gone by."""

    def step(key, frames, held):
        total, since, number, newest = held.get if held.exists else (0.0, 0, 0, -1 << 62)
        batch = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        at = batch["ts"].astype("int64").to_numpy()
        fine = at >= newest
        loads, ids = batch["value"].to_numpy()[fine], batch["event_id"].to_numpy()[fine]
        upto, i, out = np.concatenate(([0.0], np.cumsum(loads))), 0, []
        while i < len(loads):
            # the first reading from which both the cool-down and the threshold are passed; loads may be negative
            first = max(i, i + rest - since - 1)
            over = np.flatnonzero(total + upto[first + 1 :] - upto[i] > threshold)
            if not len(over):
                total, since = total + upto[-1] - upto[i], since + len(loads) - i
                break
            j = first + int(over[0])
            number += 1
            out.append((key[0], number, int(ids[j])))
            total, since, i = 0.0, 0, j + 1
        held.update((float(total), int(since), number, int(max(newest, at[fine].max(initial=newest)))))
        yield pd.DataFrame(out, columns=["pass_id", "number", "event_id"])

    return readings.groupBy("pass_id").applyInPandasWithState(step, "pass_id long, number long, event_id long", BREAK_STATE, "append", GroupStateTimeout.NoTimeout)


def break_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """breaks_due() over the events table as a stream."""
    readings = feed(spark, sf_dir).select(F.col("user_id").alias("pass_id"), "ts", "event_id", "value")
    return spark.read.parquet(_run(breaks_due(readings), "append")).drop("batch")


def cache_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price claims merged batch by batch: the newest claim of each key, manual keys (value under 5) left alone."""
    place = F.struct("ts", "event_id")
    claims = feed(spark, sf_dir).where("event_type = 'purchase'")

    def each(batch: DataFrame, number: int) -> DataFrame:
        return batch.groupBy(F.col("user_id").alias("key")).agg(F.max_by("value", place).alias("price"), F.max(place).alias("place"))

    merged = spark.read.parquet(_run(claims, "append", each=each)).groupBy("key").agg(F.max_by("price", "place").alias("price"))
    prices = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("old"), "p_size")
    return prices.join(merged, "key", "left").select("key", F.when((F.col("p_size") >= 5) & F.col("price").isNotNull(), F.col("price")).otherwise(F.col("old")).alias("price"))
