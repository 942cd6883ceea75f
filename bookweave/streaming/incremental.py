"""Incremental forms: staging of new files, and the latest observation per key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookweave.plans.scratch import scratch_root
from bookweave.sources.staging import Draft, parse_files


def stage_new_files(spark: SparkSession, drop: str, out: str, checkpoint: str, session: str = "drop", most_bytes: int = 64 << 20) -> Draft:
    """Adds the files that are new below the drop folder to the draft at out, each content once.

    Files are told apart by path, contents by SHA-256 against the draft's table of sources,
    a row per file. A batch that runs again after a failure replaces what it had written.
    Files of no bytes are not seen.
    """
    draft = Draft(spark, out)

    def keep(batch: DataFrame, number: int) -> None:
        draft.append(parse_files(batch, session, most_bytes), f"{number:08d}", each_content_once=True)

    kind = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(kind).option("recursiveFileLookup", "true").load(drop)
    query = files.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return draft


def latest_batch(events: DataFrame) -> DataFrame:
    """Last value and its time per key; ties go to the larger event id."""
    return events.where("value is not null").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n"))


def latest_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """The same from a stream over the files of a folder, run to its end; the state is a row per key."""
    root = f"{scratch_root(spark)}/latest-{uuid.uuid4().hex}"
    events = spark.readStream.schema(schema).parquet(path)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/table/batch={number:08d}")

    query = latest_batch(events).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{root}/table")
    last = out.agg(F.max("batch").alias("b"))
    return out.join(F.broadcast(last), F.col("batch") == F.col("b")).drop("batch", "b")
