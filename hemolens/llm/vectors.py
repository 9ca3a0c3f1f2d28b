"""Rows of vectors as whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemolens.session import cut_lineage


def whole_vectors(df: DataFrame, columns: dict, vector: str = "embedding", scale: int = 256) -> tuple[DataFrame, int]:
    """`columns` (name -> Column) and `x`, the floors of the scaled entries as long; and the length of `x`.

    Written to the shared folder. Rows go whose vector is null or empty, or holds a null or
    non-finite entry. All vectors must have one length: those of another length than most
    (of lengths equally frequent, the greatest) count as lacking entries and go too. Entries
    beyond a long are cut to its range. The length is 0 where no row is left.
    """
    entries = F.col(f"`{vector}`")
    odd = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    x = F.transform(entries, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    kept = df.filter(entries.isNotNull()).filter(F.size(entries) > 0).filter(~odd)
    rows = cut_lineage(kept.select(*[c.alias(n) for n, c in columns.items()], x.alias("x")))
    lengths = rows.groupBy(F.size("x").alias("length")).agg(F.count("*").alias("seen"))
    most = lengths.agg(F.max(F.struct("seen", "length"))["length"]).first()[0]
    return rows.filter(F.size("x") == F.lit(most)), most or 0


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """Rows of a list array as an array of long."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
