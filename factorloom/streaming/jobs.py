"""Structured Streaming jobs over filing listings and price corrections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.filings import match_documents
from ..sources.commits import CommitTable
from ..sources.store import work_dir


def filing_stream(listings: DataFrame, delay: str | None = None) -> DataFrame:
    """Listings (docID, submitDateTime, ...) with each docID once, whenever repeats come; the ids seen are the state. With a delay only repeats within it are dropped, and ids that are older leave the state."""
    if delay is None:
        return listings.dropDuplicates(["docID"])
    return listings.withWatermark("submitDateTime", delay).dropDuplicatesWithinWatermark(["docID"])


def run_available(df: DataFrame, name: str) -> DataFrame:
    """All that is there now, through the stream, as a table in the shared folder."""
    spark = df.sparkSession
    out, state = work_dir(spark, name), work_dir(spark, f"{name}_state")
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def matched_filings(listings: DataFrame, codes: Callable[[int], DataFrame], name: str, delay: str | None = None) -> DataFrame:
    """Listings (docID, secCode, submitDateTime) whose stock code is wanted when they come, each docID once, as (docID, submitDateTime, code, epoch).

    codes: gives the list of stock codes that holds for a batch; it is read anew for each, so it may change while the
    stream runs. Repeats are dropped before the match: an id counts as seen even if its code was not wanted then. A batch
    that is run again replaces the folder it has written, so nothing is appended twice."""
    spark = listings.sparkSession
    out, state = work_dir(spark, name), work_dir(spark, f"{name}_state")

    def append(batch: DataFrame, epoch: int) -> None:
        match_documents(batch, codes(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    filing_stream(listings, delay).writeStream.foreachBatch(append).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def upsert_stream(updates: DataFrame, table: CommitTable, source: str, state: str) -> int:
    """Streams updates into a table that keeps the latest arrival of each key; returns its version. Batches that are run again change nothing."""

    def merge(batch: DataFrame, epoch: int) -> None:
        table.upsert(batch, (source, epoch))

    updates.writeStream.foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return table.commit_of()["version"]
