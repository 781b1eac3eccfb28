"""The keyed states of ``lexweave.operators.state`` over streams.

``run_available`` drives a stream over everything that has arrived and gives the
final state as a batch DataFrame; each micro-batch's state is written to the
shared folder, the last one holds – of lists, the last one of each owner.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from lexweave.sources.tables import shared_dir


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A parquet table as a stream of its files."""
    schema = spark.read.parquet(path).schema
    parent, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(f"{parent}/{name}*")


def latest(stream: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The last value of each key, kept incrementally."""
    return stream.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value), F.count("*").alias("n_events"))


def toggled(stream: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Keys switched an odd number of times."""
    return stream.groupBy(*keys).agg(F.count("*").alias("n"), F.max(at).alias("since")).filter("n % 2 = 1").drop("n")


def windowed_counts(stream: DataFrame, at: str, by: str, length: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Events per window and kind; windows close when the watermark passes them."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness).groupBy(F.window(at, length).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def bounded_lists(stream: DataFrame, owner: str, item: str, at: str, closed: str, size: int = 8) -> DataFrame:
    """The bounded recency list of each owner after every batch that touches the owner, one row a listed item.

    The state is the list itself, at most ``size`` entries.  An emptied list is
    one row with null ``place`` and ``item``, so that it replaces the one before;
    ``last_lists`` keeps the last list of each owner.  Events without an owner
    or a time are left out; those of an owner count in order of time within a
    batch, so files are to arrive in that order.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        items, times = (list(x) for x in state.get) if state.exists else ([], [])
        moves = pd.concat(list(batches)).sort_values(["at", "tie"], kind="stable")  # of one owner and micro-batch
        for name, when, gone in zip(moves["item"], moves["at"], moves["closed"]):
            stamp = int(pd.Timestamp(when).value // 1000)
            if name in items:
                k = items.index(name)
                if gone:
                    del items[k], times[k]
                else:
                    times[k] = stamp
            elif not gone:
                if len(items) >= size:
                    k = times.index(min(times))
                    del items[k], times[k]
                items.append(name)
                times.append(stamp)
        state.update((items, times))
        if not items:
            yield pd.DataFrame({"owner": [key[0]], "place": [None], "item": [None], "last_at": [pd.NaT]})
            return
        yield pd.DataFrame({"owner": key[0], "place": range(len(items)), "item": items, "last_at": [pd.Timestamp(t * 1000) for t in times]})

    moves = stream.select(F.col(owner).alias("owner"), F.col(item).cast("string").alias("item"), F.col(at).alias("at"), F.coalesce(F.col(closed), F.lit(False)).alias("closed"), F.col("event_id").alias("tie"))
    moves = moves.filter("owner IS NOT NULL AND at IS NOT NULL")
    return moves.groupBy("owner").applyInPandasWithState(
        fold, "owner long, place int, item string, last_at timestamp", "items array<string>, times array<long>", "append", GroupStateTimeout.NoTimeout
    )


def last_lists(lists: DataFrame) -> DataFrame:
    """The lists of ``bounded_lists`` after all that has arrived, as a batch: of each owner those of its last micro-batch."""
    return run_available(lists, "append", "owner").filter("place IS NOT NULL")


def run_available(stream: DataFrame, mode: str = "complete", last_of: str | None = None) -> DataFrame:
    """The result of a stream over all that has arrived, as a batch: the last state, or every appended row.

    Of appended rows, ``last_of`` names the key of which only the rows of its last micro-batch hold.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("epoch", IntegerType())])
    out = spark.read.schema(schema).option("basePath", f"{base}/out").parquet(f"{base}/out")
    if last_of:
        newest = out.groupBy(last_of).agg(F.max("epoch").alias("epoch"))
        return out.join(newest, [last_of, "epoch"]).select(*stream.columns)
    if mode == "append":
        return out.drop("epoch")
    last = out.agg(F.max("epoch").alias("m"))
    return out.join(F.broadcast(last), F.col("epoch") == F.col("m")).drop("epoch", "m")
