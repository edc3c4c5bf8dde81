"""Raw log lines and label files."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from opslog.functions import rules, text
from opslog.operators.ranking import ranked
from opslog.schema import LABELS
from opslog.session import stage

# What tailed and replayed lines are tagged with.
SOURCE_HOST = "app-server-01"
SERVICE = "app"
REPLAY_HOST = "hdfs-datanode-01"

#: Rows of the table of file splits that may be broadcast.
SPLITS_SENT = 1_000_000
LOCAL = "^file:/+"


def clean_line(value: Column) -> Column:
    """Bad bytes become the replacement character; white space is trimmed."""
    return text.strip(F.make_valid_utf8(value))


def clean_lines(lines: DataFrame, keep_blank: bool = False) -> DataFrame:
    lines = lines.withColumn("value", clean_line(F.col("value")))
    return lines if keep_blank else lines.where(F.length("value") > 0)


def file_names(lines: DataFrame) -> list[str]:
    """Names of the files in order. Spark's listing and its metadata write local names with other slashes."""
    return sorted(re.sub(LOCAL, "file:/", f) for f in lines.inputFiles())


def read_log_lines(spark: SparkSession, path: str, keep_blank: bool = False, after: str | None = None,
                   last: str | None = None) -> DataFrame:
    """Lines with the columns that order them: file, start of the split, number in the split.

    ``after`` and ``last`` bound the files by name as ``file_names`` gives it, so that others are not opened.
    """
    file, raw = F.col("_metadata.file_path"), spark.read.text(path)
    named = F.regexp_replace(file, LOCAL, "file:/")
    if after is not None:
        raw = raw.where(named > after)
    if last is not None:
        raw = raw.where(named <= last)
    lines = raw.select(
        file.alias("file"), F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_no"), "value",
    )
    return clean_lines(lines, keep_blank)


def number_lines(lines: DataFrame, name: str = "pos", sent: int = SPLITS_SENT) -> DataFrame:
    """Add the 1-based place in file order to lines just read by ``read_log_lines``.

    The text is neither sorted nor shuffled: a split is read by one task from its start to its end, so
    a line's place is its place in the split plus the lines of all splits before. The lines are staged
    once, as the numbers of tasks must not change between counting and numbering. Only the table of
    splits is sorted; it is broadcast up to ``sent`` rows, and joined as Spark sees fit beyond.
    """
    split = ["file", "block_start"]
    held = stage(lines.withColumn("_at", F.monotonically_increasing_id()), "lines")
    before = W.orderBy(*split).rowsBetween(W.unboundedPreceding, -1)
    splits = stage(held.groupBy(*split).agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).select(
        *split, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "splits")
    if splits.count() <= sent:
        splits = F.broadcast(splits)
    place = F.col("_at") - F.col("_first") + F.col("_before") + 1
    return held.join(splits, split).select(*lines.columns, place.alias(name))


def last_file_of_head(spark: SparkSession, path: str, n: int, keep_blank: bool = False) -> str | None:
    """The file that holds line ``n`` or a later one, ``None`` if all are needed.

    Twice as many files are counted each time, so no more than about twice the needed ones are read.
    """
    files, done, some, total = file_names(spark.read.text(path)), 0, 1, 0
    while done + some < len(files):
        total += read_log_lines(spark, path, keep_blank, files[done - 1] if done else None, files[done + some - 1]).count()
        done, some = done + some, some * 2
        if total >= n:
            return files[done - 1]
    return None


def read_head(spark: SparkSession, path: str, n: int, keep_blank: bool = False) -> DataFrame:
    """The first ``n`` lines of stored files with their place; later files are not opened."""
    if n < 0:
        raise ValueError("n must not be negative")
    last = last_file_of_head(spark, path, n, keep_blank)
    return number_lines(read_log_lines(spark, path, keep_blank, last=last)).where(F.col("pos") <= n)


def head_lines(lines: DataFrame, n: int, order: tuple[str, ...] = ("file", "block_start", "line_no")) -> DataFrame:
    """The first ``n`` lines of any table in the order of its columns; ``read_head`` is the way for files.

    Lines are numbered range by range instead of sorting the head in one task.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    return ranked(lines, [], list(order), "pos").where(F.col("pos") <= n)


def lines_as_logs(lines: DataFrame, at: datetime, source_host: str = REPLAY_HOST,
                  order: tuple[str, ...] = ("file", "block_start", "line_no")) -> DataFrame:
    """Stored lines as logs for training: the id is the place in file order.

    Lines that carry their place already (``pos``) keep it. All share the time ``at``, so ordering by
    time and id is file order.
    """
    message = F.col("value")
    numbered = lines.withColumnRenamed("pos", "id") if "pos" in lines.columns else ranked(lines, [], list(order), "id")
    return numbered.select(
        "id", F.lit(at).cast("timestamp").alias("timestamp"), F.lit(source_host).alias("source_host"),
        rules.level_strict(message).alias("log_level"), message.alias("raw_message"),
        F.lit(None).cast("long").alias("template_id"), F.lit(None).cast("string").alias("parsed_template"),
    )


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label file with header ``BlockId,Label`` as block_id, label, true_label."""
    raw = spark.read.csv(path, header=True, schema=LABELS)
    return raw.select(
        F.col("BlockId").alias("block_id"), F.col("Label").alias("label"),
        rules.label_to_int(F.col("Label")).alias("true_label"),
    )


def tag_lines(lines: DataFrame, source_host: str = SOURCE_HOST, service: str = SERVICE) -> DataFrame:
    """What the tail adds to a line; works on batches and streams alike."""
    return lines.withColumnRenamed("value", "raw_message").select(
        F.lit(source_host).alias("source_host"), F.lit(service).alias("service"),
        rules.level_loose(F.col("raw_message")).alias("log_level"), "raw_message",
    )


def tail_logs(spark: SparkSession, directory: str, source_host: str = SOURCE_HOST,
              service: str = SERVICE) -> DataFrame:
    """Stream of the lines of files that appear in ``directory``."""
    return tag_lines(clean_lines(spark.readStream.text(directory)), source_host, service)


def replay(spark: SparkSession, directory: str, source_host: str = REPLAY_HOST,
           files_per_trigger: int = 1) -> DataFrame:
    """Stream stored lines in small batches as ingest requests."""
    lines = clean_lines(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(directory))
    return lines.select(
        F.lit(source_host).alias("source_host"),
        rules.level_strict(F.col("value")).alias("log_level"), F.col("value").alias("raw_message"),
    )
