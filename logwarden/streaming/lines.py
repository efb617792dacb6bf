"""Log lines as a stream: text files as they arrive, parsed into requests, with a second table of rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.sources import logs
from logwarden.sources.scratch import broadcast_if_small, materialise, temporary_tables

#: Names of so many files are broadcast at most.
FILES = 100_000
REJECTS = "value string, file string, fmt string, reject string"


def stream_lines(spark: SparkSession, paths: str, files_a_batch: int | None = None) -> DataFrame:
    """(value, file, block): a stream of the lines of text files that appear in a folder, compressed ones too; see logs.read_lines()."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else spark.readStream
    return reader.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def start_parsing(lines: DataFrame, path: str, by_file: bool = False, fmt: str | None = None):
    """Parse a stream of lines; returns the query.

    A batch writes requests to path/requests and lines that hold none, with their reason and file, to
    path/rejects, both under its number: a batch that is repeated after a failure replaces its own
    files. Formats are found line by line, or, ``by_file``, by the head of each file, which arrives
    with the rest of it; path/formats keeps what was found. Every line is in one of the two tables.
    """

    def run(batch: DataFrame, number: int) -> None:
        with temporary_tables():
            if by_file:
                found = broadcast_if_small(logs.detect_formats(batch), "formats", FILES)
                found.write.mode("overwrite").parquet(f"{path}/formats/batch={number}")
                batch = batch.join(found, "file")
            parsed = materialise(logs.parse_lines(batch, fmt), "parsed")
            logs.requests(parsed).write.mode("overwrite").parquet(f"{path}/requests/batch={number}")
            parsed.filter("reject is not null").select("value", "file", "fmt", "reject").write.mode("overwrite").parquet(f"{path}/rejects/batch={number}")

    return lines.writeStream.foreachBatch(run).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()


def parsed_requests(spark: SparkSession, path: str) -> DataFrame:
    """The requests that start_parsing() has written so far."""
    return spark.read.parquet(f"{path}/requests").select(*logs.REQUEST_COLUMNS)


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines that it found no request in."""
    return spark.read.schema(f"{REJECTS}, batch long").parquet(f"{path}/rejects").drop("batch")
