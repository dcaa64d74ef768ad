"""Structured Streaming forms of the sketches. Batches are micro-batches of files, or numbers that rows carry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.operators import sketches
from quern.plans import views
from quern.staging import fresh_path


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A Parquet table (a folder, or a single file of one) as a stream of its files."""
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        folder, _, name = path.rpartition("/")
        return stream.option("pathGlobFilter", name).parquet(folder)
    return stream.parquet(path)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process all that is there, batch by batch, with progress kept in ``checkpoint``."""
    done = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    done.awaitTermination()


def _staged(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    """The rows of ``stream`` as a table of the shared folder; a replayed micro-batch overwrites its own folder."""
    root = fresh_path(spark, label)
    schema = stream.schema
    run_available(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{root}/rows/micro={n}"), f"{root}/progress")
    return spark.read.schema(schema).parquet(f"{root}/rows").select(*schema.names)


def bloom_stream(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """``bloom_rates`` over a stream of batch_id, seq, key. A batch needs just the keys of the one before, which staged rows give."""
    keys = _staged(spark, stream.select("batch_id", "key"), "bloom")
    return sketches.bloom_rates(keys)


def fm_stream(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """``fm_estimates`` over a stream of batch_id, seq, key."""
    return sketches.fm_estimates(_staged(spark, stream.select("batch_id", "key"), "fm"))


RESERVOIR = "stream string, n long, size long, slots array<long>"
_STATE = "n long, slots array<long>"


def reservoir_step(size: int = 100, seed: int = 553, reject_present: bool = True):
    """State function of a reservoir: the first ``size`` keys fill it; the n-th is accepted with probability size/n.

    With ``reject_present`` a key that is in it already is not accepted again. Draws are hashes of the position.
    """

    def draw(n: int, salt: int) -> float:
        return xxhash.xxh64_intdigest(f"{n}:{salt}", seed=seed) / 2**64

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, slots = state.get if state.exists else (0, [])
        slots = list(slots)
        rows = pd.concat(list(parts)).sort_values("seq")["key"].tolist()  # one micro-batch, whose size the trigger bounds
        for x in rows:
            n += 1
            if len(slots) < size:
                slots.append(x)
            elif draw(n, 0) < size / n and not (reject_present and x in slots):
                slots[int(draw(n, 1) * size)] = x
        state.update((n, slots))
        yield pd.DataFrame({"stream": [key[0]], "n": [n], "size": [len(slots)], "slots": [slots]})

    return step


def reservoir_stream(stream: DataFrame, size: int = 100, seed: int = 553, reject_present: bool = True) -> DataFrame:
    """A row per logical stream and micro-batch: n seen so far and the reservoir. ``stream``: stream, seq, key."""
    return stream.groupBy("stream").applyInPandasWithState(reservoir_step(size, seed, reject_present), RESERVOIR, _STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, time_col: str = "ts", key_col: str = "event_type", width: str = "1 day", late: str = "1 day") -> DataFrame:
    """start, key, n per tumbling window; rows later than ``late`` are left out and a window is final when the watermark passes it."""
    timed = stream.withColumn("_t", F.col(time_col).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", width), key_col).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key_col, "n")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return views.stream_rows(read_stream(spark, f"{d}/events.parquet"))


def bloom_over_events(spark: SparkSession, d: str) -> DataFrame:
    return bloom_stream(spark, _events(spark, d))


def fm_over_events(spark: SparkSession, d: str) -> DataFrame:
    return fm_stream(spark, _events(spark, d))


def reservoir_over_events(spark: SparkSession, d: str) -> DataFrame:
    """n, size and slots 0, 20, 40, 60 and 80 after each micro-batch."""
    kept = reservoir_stream(_events(spark, d).withColumn("stream", F.lit("events")))
    out = _staged(spark, kept, "reservoir")
    return out.select("n", "size", *(F.get("slots", F.lit(k)).alias(f"slot_{k}") for k in (0, 20, 40, 60, 80)))
