"""Streams run over the given event and document files (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hemolens.plans.binding import EPOCH, PEPTIDES_SQL
from hemolens.plans.catalog import query
from hemolens.session import scratch_path
from hemolens.streaming import jobs


def event_stream(t):
    """The events file as a stream; watermarks need a zoned timestamp."""
    schema = t.events.schema
    rows = jobs.read_stream(t.spark, t.sf_dir, schema, "events.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "x01_ingest_stream",
    "SELECT sha256(upper(event_type || '-' || (event_id % 300))) AS seq_hash, count(*) > 0 AS kept FROM events GROUP BY 1",
)
def ingest_stream(t):
    """Records repeat; every distinct one is kept once."""
    text = F.concat("event_type", F.lit("-"), (F.col("event_id") % 300).cast("string"))
    records = event_stream(t).select("ts", text.alias("sequence"))
    return jobs.drain(jobs.ingest_stream(records, "ts"), None, "append").select("seq_hash", F.lit(True).alias("kept"))


@query(
    "x01_fasta_stream",
    f"""WITH {PEPTIDES_SQL}
    SELECT CAST(peptide_id AS VARCHAR) AS peptide_id, name, CAST(length(sequence) AS INTEGER) AS n, md5(sequence) AS seq_md5 FROM peptides""",
)
def fasta_stream(t):
    """Peptides as FASTA files that arrive three at a time."""
    path = scratch_path(t.spark, "arriving")
    record = F.concat(F.lit(">"), F.col("peptide_id").cast("string"), F.lit("|"), "name", F.lit("\n"), "sequence")
    t.peptides().select(record).repartition(8).write.text(path)
    rows = jobs.drain(jobs.read_fasta_stream(t.spark, path, files_a_batch=3), None, "append")
    return rows.select("peptide_id", "name", F.length("sequence").alias("n"), F.md5("sequence").alias("seq_md5"))


@query(
    "x01_label_stream",
    """SELECT CAST(doc_id AS VARCHAR) AS peptide_id, CAST(quality + toxic * 99.5 AS DOUBLE) AS hc50_um, CAST(doc_id % 40 AS INTEGER) AS sequence_length,
      'a, "' || doc_id || '"' AS name FROM labels""",
)
def label_stream(t):
    """Label files with two kinds of header that arrive two at a time."""
    path = scratch_path(t.spark, "labels")
    base = t.labels.select(
        F.col("doc_id").cast("string").alias("amp_id"), F.lit("KLK").alias("SEQUENCE"), (F.col("quality") + F.col("toxic") * 99.5).alias("HC50_uM"),
        (F.col("doc_id") % 40).alias("sequence_length"), F.concat(F.lit('a, "'), F.col("doc_id").cast("string"), F.lit('"')).alias("NAME"),
    )
    odd = F.col("amp_id").cast("long") % 2 == 1
    base.filter(~odd).repartition(3).write.option("escape", '"').csv(path, header=True)
    base.filter(odd).select("NAME", "HC50_uM", F.col("amp_id").alias("SOURCE_ID"), "sequence_length", "SEQUENCE").repartition(2).write.mode("append").option("escape", '"').csv(path, header=True)
    rows = jobs.drain(jobs.read_label_stream(t.spark, path, files_a_batch=2), None, "append")
    return rows.select("peptide_id", "hc50_um", "sequence_length", "name")


@query(
    "x02_latest_status",
    f"""SELECT user_id AS peptide_id, date_diff('microsecond', TIMESTAMP '{EPOCH}', max(ts)) AS t_us, arg_max(event_type, ts) AS status FROM events GROUP BY 1""",
)
def latest_status(t):
    """Update mode: the last emitted row per key is the state."""
    rows = event_stream(t).select(F.col("user_id").alias("peptide_id"), "ts", F.col("event_type").alias("status"))
    out = jobs.drain(jobs.latest_status(rows, ["peptide_id"]), ["peptide_id"], "update")
    since = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{EPOCH}', cast(ts AS timestamp_ntz))")
    return out.select("peptide_id", since.alias("t_us"), "status")


@query(
    "x02_latest_status_batch",
    f"""SELECT user_id AS peptide_id, date_diff('microsecond', TIMESTAMP '{EPOCH}', max(ts)) AS t_us, arg_max(event_type, ts) AS status FROM events GROUP BY 1""",
)
def latest_status_batch(t):
    rows = t.frames().select(F.col("run").alias("peptide_id"), "t_us", F.col("bead").alias("status"))
    return jobs.latest_status(rows, ["peptide_id"], "t_us")


@query(
    "x03_progress_windows",
    f"""SELECT date_diff('microsecond', TIMESTAMP '{EPOCH}', date_trunc('hour', ts)) // 3600000000 AS hour, event_type AS status, count(*) AS n
    FROM events GROUP BY 1, 2""",
)
def progress_windows(t):
    """Update mode: the watermark frees closed windows, and the last count of each stands."""
    rows = event_stream(t).select("ts", F.col("event_type").alias("status"))
    out = jobs.drain(jobs.progress_windows(rows, "ts", ["status"]), ["window_start", "status"], "update")
    hour = F.expr(f"timestampdiff(HOUR, timestamp_ntz'{EPOCH}', cast(window_start AS timestamp_ntz))")
    return out.select(hour.alias("hour"), "status", "n")
