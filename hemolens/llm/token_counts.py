"""Token counts by source, language and tokenizer version, kept up to date by signed batches.

A batch of changes (insert, delete, revise) is turned into signed numbers, summed per key, and
committed as one small table. Totals are the sums over the committed batches, so they are
additive and never rescan documents. A commit is idempotent: a batch is written aside and then
renamed to a folder with its name, which either happens or not; a batch that is there is left
as it is, so a retry, a lost executor or a second run cannot count twice.
"""

from __future__ import annotations

import base64
import uuid

import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemolens.llm.common import attach

KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens", "n_chars")


def load_ranks(path: str) -> tuple[dict[bytes, int], str]:
    """(ranks, name) of a byte-level BPE vocabulary file: a base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, path.rsplit("/", 1)[-1].split(".")[0]


def count_tokens(df: DataFrame, ranks: dict[bytes, int], pattern: str, columns: dict[str, str]) -> DataFrame:
    """`df` with a token count (0 for null) under each new name of `columns` (name -> text column)."""

    def make():
        codec = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        def count(text):
            return len(codec.encode_ordinary(text)) if text else 0

        return lambda b: [list(map(count, b.column(c).to_pylist())) for c in columns.values()]

    return attach(df, ", ".join(f"`{c}` long" for c in columns), make)


def signed(events: DataFrame) -> DataFrame:
    """Events as additive rows: an insert adds, a delete subtracts, a revision does both.

    `events` has `op` (insert, delete, revise), KEYS, `n_tokens` and `n_chars`; a revision has
    the values that it replaces under `old_` as well. Other columns and unknown ops have no
    effect. Null keys are a key of their own, null counts are 0.
    """
    missing = [f"old_{k}" for k in (*KEYS, *SUMS[1:]) if f"old_{k}" not in events.columns]
    events = events.withColumns({c: F.lit(None) for c in missing}) if missing else events
    one = lambda sign, p="": F.struct(
        *[F.col(p + k).cast("string").alias(k) for k in KEYS], F.lit(sign).cast("long").alias("n_docs"),
        *[(sign * F.coalesce(F.col(p + c), F.lit(0))).cast("long").alias(c) for c in SUMS[1:]],
    )
    rows = (
        F.when(F.col("op") == "insert", F.array(one(1)))
        .when(F.col("op") == "delete", F.array(one(-1)))
        .when(F.col("op") == "revise", F.array(one(1), one(-1, "old_")))
    )
    return events.select(F.explode(rows).alias("row")).select("row.*")


class Rollup:
    """Totals in a folder of the shared store, one sub-folder a committed batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def committed(self, batch: str) -> bool:
        fs, where = self._fs(f"{self.path}/batch={batch}/_SUCCESS")
        return fs.exists(where)

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Apply a batch once; False if it was there already."""
        if self.committed(batch):
            return False
        aside = f"{self.path}/_aside-{uuid.uuid4().hex}"
        delta = signed(events).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        delta.write.parquet(aside)
        fs, source = self._fs(aside)
        _, target = self._fs(f"{self.path}/batch={batch}")
        if not fs.rename(source, target) or fs.exists(self._fs(f"{self.path}/batch={batch}/{source.getName()}")[1]):
            # another writer was first: what was moved in or left aside is not a batch
            for left in (f"{self.path}/batch={batch}/{source.getName()}", aside):
                fs.delete(self._fs(left)[1], True)
            return False
        return True

    def deltas(self) -> DataFrame:
        ddl = ", ".join([f"{k} string" for k in KEYS] + [f"{c} long" for c in SUMS])
        fs, where = self._fs(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        paths = [f"{self.path}/{n}" for n in names if n.startswith("batch=")]
        return self.spark.read.schema(ddl).parquet(*paths) if paths else self.spark.createDataFrame([], ddl)

    def totals(self) -> DataFrame:
        """Sums by key; keys whose sums are all zero are gone."""
        sums = self.deltas().groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        return sums.filter(" or ".join(f"{c} <> 0" for c in SUMS))
