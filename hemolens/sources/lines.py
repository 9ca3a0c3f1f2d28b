"""Lines of text files that are read in byte ranges, with their numbers, and state carried along them.

Spark cuts a file at line starts; each part is a block. A line's number is its place in its block plus
the lines of the blocks before, so one row per block is all that is counted; no file is held in a row
and nothing is read twice in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hemolens.functions import ordered

STRETCH_BITS = 14  # lines of a file that meet in one task for their numbers or what is carried: 16,384

def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line_no, line): every line with its number from 1; `block` is where its byte range starts.

    Lines end with a line feed; a carriage return before it stays in the line. Empty files have no lines.
    """
    read = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"),
    )
    blocks = read.groupBy("file", "block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # the blocks of a file
    shift = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) + 1 - F.col("_first")
    last = F.col("_first") + F.col("_n") - 1
    stretches = F.explode(F.sequence(F.shiftright("_first", STRETCH_BITS), F.shiftright(last, STRETCH_BITS)))
    starts = blocks.select("file", "block", "_first", "_n", shift.alias("_shift")).select("file", "block", "_shift", stretches.alias("_part"))
    read = read.withColumn("_part", F.shiftright(F.col("_id"), STRETCH_BITS))
    return read.join(starts, ["file", "block", "_part"]).select("file", "block", (F.col("_id") + F.col("_shift")).alias("line_no"), "line")


def carried(lines: DataFrame, value: Column, out: str) -> DataFrame:
    """Add `out`: the last non-null `value` up to each line of its file.

    It is filled inside each stretch of `2 ** STRETCH_BITS` lines, whatever the size of the blocks; one row per stretch carries it on.
    """
    marked = lines.withColumns({"_value": value, ordered.BUCKET: F.shiftright("line_no", STRETCH_BITS)})
    return ordered.fill_forward(marked, ["file"], ["line_no"], "_value", out).drop("_value")


def frame_starts(lines: DataFrame) -> DataFrame:
    """(file, frame, start, n): where the frames of coordinate files start, and how many atoms each declares.

    A frame is a title, a count, that many atoms and a box, so each count says where the next one
    is. Only lines that hold nothing but a whole number can be counts; per file, these few are
    followed from the first one. A file ends with the first place that is no count.
    """
    number = F.trim(F.regexp_replace("line", "\r", ""))
    counts = lines.filter(number.rlike("^[0-9]{1,10}$")).select("file", "line_no", number.cast("long").alias("n"))

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_no")
        at, n = pdf.line_no.to_numpy(), pdf.n.to_numpy()
        starts, counts_, want = [], [], 2
        while True:
            k = np.searchsorted(at, want)
            if k == len(at) or at[k] != want:
                break
            starts.append(want - 1)
            counts_.append(n[k])
            want += int(n[k]) + 3
        return pd.DataFrame({"file": pdf.file.iloc[0], "frame": np.arange(len(starts), dtype="int32"), "start": starts, "n": counts_})

    return counts.groupBy("file").applyInPandas(follow, "file string, frame int, start long, n long")


def framed(lines: DataFrame, frames: DataFrame) -> DataFrame:
    """(file, frame, n, offset, line): each line's frame and its place in it from 0; lines outside frames are left out.

    In a file whose frames all have one size the frame is a division; only the lines of other
    files are carried from frame to frame.
    """
    sizes = frames.groupBy("file").agg(F.min("n").alias("_least"), F.max("n").alias("_most"), F.count("*").alias("_frames"))
    known = lines.join(sizes, "file")
    even = known.filter("_least = _most").withColumn("n", F.col("_least"))
    place = F.col("line_no") - 1
    even = even.select(
        "file", F.floor(place / (F.col("n") + 3)).cast("int").alias("frame"), "n", (place % (F.col("n") + 3)).cast("int").alias("offset"), "line", "_frames"
    ).filter("frame < _frames").drop("_frames")
    uneven = known.filter("_least <> _most").select("file", "block", "line_no", "line")
    marks = frames.select("file", F.col("start").alias("line_no"), F.struct("frame", "start", "n").alias("_mark"))
    moved = carried(uneven.join(marks, ["file", "line_no"], "left"), F.col("_mark"), "_at")
    moved = moved.select("file", "_at.frame", "_at.n", (F.col("line_no") - F.col("_at.start")).cast("int").alias("offset"), "line")
    return even.unionByName(moved.filter("offset < n + 3"))
