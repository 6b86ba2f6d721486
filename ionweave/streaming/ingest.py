"""Staging of peak files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..operators.preprocess import process_spectra
from ..sinks.writers import stage
from ..sources.mgf import END, RECORD, with_headers


def stream_mgf(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the records of MGF files that come into a folder; a micro-batch has whole files."""
    text = spark.readStream.option("lineSep", END).option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return text.selectExpr(*RECORD)


def stage_stream(records: DataFrame, path: str, checkpoint: str, s: Settings = Settings()) -> StreamingQuery:
    """Parses and cleans the records of a stream and adds the spectra to staged Parquet, a folder for each micro-batch.

    A batch that runs again replaces its own folder, so each spectrum is staged once; its number is part of each ``sid``.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = process_spectra(with_headers(batch.sparkSession, batch).where("not bad"), s).where("valid")
        stage(rows, f"{path}/batch={number}", "overwrite", number)

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
