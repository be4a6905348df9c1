"""Streams into versioned tables, windows over event time, custom keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.sources.store import VersionedTable


def file_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 16) -> DataFrame:
    """A table's Parquet files as a stream; the schema is read from the files."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # a table may be one file or a folder of files; a pattern that only its name matches covers both
    only = f"{sf_dir.rstrip('/')}/[{name[0]}]{name[1:]}.parquet"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").parquet(only)


def upsert_stream(stream: DataFrame, target: VersionedTable, checkpoint: str, prepare: Callable[[DataFrame], DataFrame], mode: str = "append") -> None:
    """Run the stream to its end; each batch is one commit, marked by its number, so a batch that is tried again is not applied twice."""

    def apply(batch: DataFrame, number: int) -> None:
        mark = f"{checkpoint}#{number}"
        if not target.done(mark):
            target.write(prepare(batch), mark)

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start()
    run.awaitTermination()


def instants(events: DataFrame, time_col: str) -> DataFrame:
    """Watermarks need instants; times without a zone count as the session's."""
    return events.withColumn(time_col, F.col(time_col).cast("timestamp"))


def windowed_counts(events: DataFrame, time_col: str, size: str, by: list[str], value: str | None, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count (and sum of ``value``) per window and key; with a stream, rows later than ``late`` are dropped."""
    source = instants(events, time_col)
    source = source.withWatermark(time_col, late) if events.isStreaming else source
    window = F.window(time_col, size, slide) if slide else F.window(time_col, size)
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return source.groupBy(window.alias("w"), *by).agg(*aggs).select(F.col("w.start").alias("window_start"), *by, "n", *(["total"] if value else []))


def session_counts(events: DataFrame, time_col: str, gap: str, by: list[str], late: str = "1 hour") -> DataFrame:
    source = instants(events, time_col)
    source = source.withWatermark(time_col, late) if events.isStreaming else source
    return source.groupBy(F.session_window(time_col, gap).alias("s"), *by).agg(F.count(F.lit(1)).alias("n")).select(
        *by, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n",
    )


def running_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """Per key the count and sum so far, after every batch: keyed state in pandas."""

    def step(keys: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in parts:
            n, total = n + len(pdf), total + float(pdf[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [keys[0]], "n": [n], "total": [total]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, total double", "n long, total double", "update", "NoTimeout")
