"""Streams: ingest with duplicates dropped, latest status, windowed progress (X).

Each job takes a streaming frame and returns one; `drain` runs it over what is there now.
"""

from __future__ import annotations

import csv

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemolens.functions.sequence import seq_hash
from hemolens.session import scratch_path
from hemolens.sources.text import LABEL_NAMES, LABEL_SCHEMA, label_columns


def read_stream(spark: SparkSession, path: str, schema, glob: str | None = None) -> DataFrame:
    """New parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def arriving_lines(spark: SparkSession, path: str, separator: str, files_a_batch: int | None = None) -> DataFrame:
    """(source_file, arrived, value) of newly arriving text files; a file arrives when it was last written."""
    reader = spark.readStream.option("lineSep", separator)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_modification_time").alias("arrived"), "value"
    )


def _per_file(lines: DataFrame, step, schema: str, state: str, keep: str) -> DataFrame:
    """`step(file, chunks, state)` for each file of a batch; its state goes when no file has arrived for `keep`."""

    def run(key, chunks, held):
        if held.hasTimedOut:
            held.remove()
            return
        latest = None
        for out, arrived in step(key[0], chunks, held):
            latest = arrived if latest is None else max(latest, arrived)
            if out is not None:
                yield out
        mark = max(held.getCurrentWatermarkMs(), 0)
        held.setTimeoutTimestamp(max(int(latest.timestamp() * 1000) if latest is not None else 0, mark) + int(pd.Timedelta(keep).total_seconds() * 1000) + 1)

    return lines.withWatermark("arrived", keep).groupBy("source_file").applyInPandasWithState(run, schema, state, "append", "EventTimeTimeout")


def read_fasta_stream(spark: SparkSession, path: str, files_a_batch: int | None = None, keep: str = "1 hour") -> DataFrame:
    """(peptide_id, name, sequence, source_file, arrived) of newly arriving FASTA files.

    The rule of `scan_fasta` holds for every file: one that does not open with `>` stops the stream. Which
    files have opened well is state, one row a file, that expires once `keep` has passed without news. Only a
    mark a record goes there; the records themselves are parsed where they are read.
    """

    def step(file, chunks, held):
        opened, latest = held.exists and held.get[0], None
        for pdf in chunks:
            opened = opened or bool(pdf["opens"].any())
            latest = pdf["arrived"].max() if latest is None else max(latest, pdf["arrived"].max())
        if not opened:
            raise ValueError(f"no FASTA header in {file}")
        held.update((True,))
        if latest is not None:
            yield None, latest

    lines = arriving_lines(spark, path, "\n>", files_a_batch)
    marks = lines.select("source_file", "arrived", F.startswith("value", F.lit(">")).alias("opens"))
    schema = "peptide_id string, name string, sequence string, source_file string, arrived timestamp"
    checked = _per_file(marks, step, schema, "opened boolean", keep)
    blank = r"(?U)[\s\x1c-\x1f]"
    strip = lambda c: F.regexp_replace(c, f"^{blank}+|{blank}+$", "")
    text = F.replace("value", F.lit("\r"), F.lit(""))
    head = F.replace(F.substring_index(text, "\n", 1), F.lit(">"), F.lit(""))
    cut, end = F.instr(head, "|"), F.instr(text, "\n")
    parsed = lines.select(
        strip(F.substring_index(head, "|", 1)).alias("peptide_id"), strip(F.when(cut > 0, F.substring(head, cut + 1, F.length(head)))).alias("name"),
        F.when(end > 0, F.regexp_replace(F.substring(text, end + 1, F.length(text)), blank, "")).otherwise("").alias("sequence"),
        "source_file", "arrived",
    )
    return parsed.unionByName(checked)


def read_label_stream(
    spark: SparkSession, path: str, ident: str | None = None, files_a_batch: int | None = None, keep: str = "1 hour"
) -> DataFrame:
    """(peptide_id, sequence, hc50_um, sequence_length, name, source_file, arrived) of newly arriving label files.

    Columns are found by each file's own header, as in `scan_labels`; a file without a valid one stops the stream. A
    header is state until `keep` has passed without news. A label file is a small table: its lines wait
    in one task until the header is among them.
    """

    def step(file, chunks, held):
        lines = pd.concat(list(chunks))
        header = held.get[0] if held.exists else None
        for line in lines["value"] if header is None else []:
            try:
                label_columns(line, ident)
            except (ValueError, StopIteration):
                continue
            header = line
            break
        if header is None:
            label_columns(str(lines["value"].iloc[0]), ident)  # says what is wrong with it
        names = [c.split()[0].strip("`") for c in label_columns(header, ident).split(", ")]
        rows = [r for r in csv.reader(v for v in lines["value"] if v != header and v.strip("\r")) if len(r) == len(names)]
        out = pd.DataFrame(rows, columns=names, dtype=object).replace("", None)
        out = out.assign(hc50_um=pd.to_numeric(out["hc50_um"], errors="coerce"), sequence_length=pd.to_numeric(out["sequence_length"], errors="coerce"))
        out = out[LABEL_NAMES].assign(source_file=file, arrived=lines["arrived"].max()).astype(object)
        held.update((header,))
        yield out.where(out.notna(), None), lines["arrived"].max()

    schema = f"{LABEL_SCHEMA}, source_file string, arrived timestamp"
    return _per_file(arriving_lines(spark, path, "\n", files_a_batch), step, schema, "header string", keep)


def ingest_stream(records: DataFrame, time: str, seq: str = "sequence", delay: str = "40 days") -> DataFrame:
    """First arrival of every sequence; copies within the delay are dropped, state beyond it is freed."""
    return (
        records.withColumn("seq_hash", seq_hash(F.col(seq)))
        .withWatermark(time, delay)
        .dropDuplicatesWithinWatermark(["seq_hash"])
    )


def latest_status(events: DataFrame, keys: list[str], time: str = "ts", status: str = "status") -> DataFrame:
    """Newest status per key; an older event arriving late never wins. Works on batches and streams."""
    newest = F.max(F.struct(F.col(time).alias("t"), F.col(status).alias("s")))
    return events.groupBy(*keys).agg(newest.alias("_n")).select(*keys, F.col("_n.t").alias(time), F.col("_n.s").alias(status))


def progress_windows(events: DataFrame, time: str, keys: list[str], width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Tumbling counts per key; the watermark bounds the state."""
    return (
        events.withWatermark(time, delay).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), *keys, "n")
    )


def drain(df: DataFrame, keys: list[str] | None, mode: str) -> DataFrame:
    """Run a stream over everything available and return its result table.

    Append results are parquet files. Update results carry a batch number and the last
    one per key stands. Complete results are the last batch.
    """
    spark = df.sparkSession
    out, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "offsets")
    writer = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        writer.format("parquet").start(out).awaitTermination()
        return spark.read.schema(df.schema).parquet(out)

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/_b={number}")

    writer.foreachBatch(sink).start().awaitTermination()
    rows = spark.read.parquet(out).drop("_b")
    if mode == "complete":
        last = rows.agg(F.max("_batch")).scalar()
        return rows.filter(F.col("_batch") == last).drop("_batch")
    values = [c for c in rows.columns if c not in (*keys, "_batch")]
    newest = F.max(F.struct("_batch", *values)).alias("_n")
    return rows.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_n.{c}").alias(c) for c in values])
