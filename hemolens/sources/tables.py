"""Feature tables and report tables on disk."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hemolens.functions.ordered import bucket_count

# Header of the reporting table, in order.
PMF_HEADER = (
    "peptide_id", "dG_ads_kJmol", "dG_ads_SE", "dG_insert_kJmol", "dG_insert_SE",
    "dG_barrier_kJmol", "dG_barrier_SE", "z_surf_min_nm", "z_head_min_nm", "hc50_uM",
)


def write_features(df: DataFrame, path: str, by: Sequence[str] = ("occupancy", "replicate"), sort: str = "peptide_id"):
    """Parquet laid out by low-cardinality columns and sorted by peptide inside each file.

    The rebalance hint lets AQE split a layout value that holds much of the data into many
    files and merge small ones, so neither one huge file nor thousands of tiny ones appear.
    """
    df.hint("rebalance", *by).sortWithinPartitions(*by, sort).write.mode("overwrite").partitionBy(*by).parquet(path)


def read_features(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if where is None else df.filter(where)


def write_report_tables(path: str, predictions: DataFrame, metrics: DataFrame | None = None, pmf: DataFrame | None = None):
    predictions.write.mode("overwrite").csv(f"{path}/predictions", header=True)
    if metrics is not None:
        metrics.write.mode("overwrite").json(f"{path}/metrics")
    if pmf is not None:
        pmf.select(*PMF_HEADER).write.mode("overwrite").csv(f"{path}/pmf", header=True)
    return path


def as_pmf_report(features: DataFrame) -> DataFrame:
    """Rename feature columns to the fixed reporting header."""
    ours = (
        "peptide_id", "dg_ads", "dg_ads_se", "dg_insert", "dg_insert_se",
        "dg_barrier", "dg_barrier_se", "z_surf_min", "z_head_min", "hc50_um",
    )
    return features.select(*[F.col(a).alias(b) for a, b in zip(ours, PMF_HEADER)])


def join_parts(spark: SparkSession, parts: str, path: str) -> None:
    """Write one file to `path` for each folder of part files below `parts`, under the folder's name; parts follow by name.

    A task copies a folder's parts in pieces of a megabyte, so neither a file nor its rows are held; both are in the shared folder.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(parts).select("path")
    folder = F.element_at(F.split("path", "/"), -2)
    listed = files.groupBy(folder.alias("folder")).agg(F.array_sort(F.collect_list("path")).alias("parts"))
    below, beside = (p.rstrip("/").rsplit("/", 1)[1] for p in (parts, path))  # two folders of one place

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for name, paths in zip(batch.column("folder").to_pylist(), batch.column("parts").to_pylist()):
                above = paths[0][: paths[0].index(f"/{below}/")]
                where, base = fs.FileSystem.from_uri(above)
                target = f"{base}/{beside}/{name}"
                where.create_dir(target)
                whole = f"{target}/.{uuid.uuid4().hex}"  # a second try of the task writes a file of its own
                with where.open_output_stream(whole) as out:
                    for p in paths:
                        with where.open_input_file(base + p[len(above) :]) as f:
                            while piece := f.read(1 << 20):
                                out.write(piece)
                where.move(whole, f"{target}/part-0.txt")
            yield pa.RecordBatch.from_arrays([batch.column("folder")], ["folder"])

    listed.repartition(bucket_count(listed), "folder").mapInArrow(run, "folder string").count()
