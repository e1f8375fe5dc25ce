"""Sources and sinks: JSON lines with a header row, recipient tables, binary documents, gzip CSV, event sinks."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITERS = (",", ";", "\t")


def metric_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a metric file, without its header (the row that has ``measure``)."""
    return spark.read.schema(f"measure string, {schema}").json(path).filter("measure IS NULL").drop("measure")


def metric_header(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("measure string, schema string, metric string, oracle string, corpus string, docs long").json(path).filter("measure IS NOT NULL")


def same_header(a: DataFrame, b: DataFrame) -> bool:
    """Whether two metric files can be compared; a header is one row."""
    keys = ("measure", "schema", "metric", "oracle")
    x, y = a.select(*keys).first(), b.select(*keys).first()
    return x is not None and x == y


def sniff(text: str, most_lines: int = 8) -> str:
    """The delimiter met most often outside quotes in the first lines; the first of equals."""
    counts, quoted, line = dict.fromkeys(DELIMITERS, 0), False, 0
    for c in text.removeprefix("﻿"):
        if c == '"':
            quoted = not quoted
        elif not quoted and c == "\n":
            line += 1
            if line >= most_lines:
                break
        elif not quoted and c in counts:
            counts[c] += 1
    return max(DELIMITERS, key=lambda d: (counts[d], -DELIMITERS.index(d)))


def recipients(text: str) -> list[list[str]]:
    """Rows of a recipient table; a quote that is not closed is an error."""
    body = text.removeprefix("﻿")
    if body.count('"') % 2:
        raise ValueError("a quoted cell is not closed")
    return [r for r in csv.reader(io.StringIO(body), delimiter=sniff(text)) if any(x.strip() for x in r)]


def recipient_column(rows: DataFrame, column: int, start: int = 0, most: int = 100) -> DataFrame:
    """Distinct non-empty values of a column from a row on, in order. rows: n, cells."""
    value = F.trim(F.try_element_at("cells", F.lit(column + 1)))
    found = rows.filter(F.col("n") >= start).select("n", value.alias("value")).filter("value IS NOT NULL AND value <> ''")
    return found.groupBy("value").agg(F.min("n").alias("n")).orderBy("n").limit(most)


def documents(spark: SparkSession, path: str, pattern: str = "*.pdf", most_bytes: int = 50 << 20) -> DataFrame:
    """Binary files under a size limit, with their digest."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).filter(F.col("length") <= most_bytes).withColumn("sha256", F.sha2("content", 256))


def external_metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A (gzip) CSV file with a header; one split per file."""
    return spark.read.schema(schema).option("header", True).option("multiLine", False).csv(path)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))


def prefix_hash(content: Column, most: int = 65536) -> Column:
    return F.sha2(F.substring(content, 1, most), 256)


def write_events(stream: DataFrame, path: str, checkpoint: str):
    """A stream of events as Parquet by day, each batch once."""
    return stream.withColumn("day", F.to_date("ts")).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day").trigger(availableNow=True).start()
