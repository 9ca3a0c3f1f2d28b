"""Set operations (U)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemolens.operators.aggregates import dedupe_sequences


def concat_features(dfs: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables; columns missing on one side are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def union_arms(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def merge_sources(dfs: Sequence[DataFrame], ident: str = "peptide_id", seq: str = "sequence", source: str = "source") -> DataFrame:
    """Union, then one row per sequence with the sources it came from."""
    return dedupe_sequences(concat_features(dfs), ident, seq, source)


def cohort_diff(listed: DataFrame, data: DataFrame, ident: str = "peptide_id", arm: str = "arm") -> DataFrame:
    """(id, problem): listed_only, data_only or wrong_arm."""
    a = listed.select(ident, F.col(arm).alias("_a"), F.lit(True).alias("_in_list"))
    b = data.select(ident, F.col(arm).alias("_b"), F.lit(True).alias("_in_data"))
    problem = (
        F.when(F.col("_in_data").isNull(), "listed_only")
        .when(F.col("_in_list").isNull(), "data_only")
        .when(~F.col("_a").eqNullSafe(F.col("_b")), "wrong_arm")
    )
    return a.join(b, ident, "full").select(ident, problem.alias("problem")).filter("problem IS NOT NULL")
