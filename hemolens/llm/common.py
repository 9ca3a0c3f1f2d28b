"""What the operators of this subpackage share: words, row-wise Arrow passes, stable hashes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_A_STEP = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str | None) -> list[bytes]:
    """Runs of anything but space and \\x09-\\x0D, as UTF-8: just what `bytes.split` splits at."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """`words` with A-Z in lower case; `bytes.lower` leaves everything else alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHash(dict):
    """word -> unsigned 64-bit hash that is the same in every process; forgets when full."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser on unsigned 64-bit values; wraps around on purpose."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit hash for every run of `size` word codes, put together from runs of powers of two."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    run, width, at, out = mix(codes), 1, 0, None
    while True:
        if size & width:
            part = run[at : at + n]
            out = part if out is None else mix(out * FACTOR + part)
            at += width
        if width * 2 > size:
            return out
        run = mix(run[:-width] * FACTOR + run[width:])
        width *= 2


def running_minimum(values: np.ndarray, size: int) -> np.ndarray:
    """Least of every `size` neighbours."""
    width = 1
    while width * 2 <= size:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[: len(values) - (size - width)], values[size - width :]) if size > width else values


def attach(
    df: DataFrame, columns: str, make: Callable[[], Callable[[pa.RecordBatch], list]], rows: int = ROWS_A_STEP
) -> DataFrame:
    """`df` and the new `columns` (DDL), made row by row: no shuffle, a bounded step at a time.

    `make()` runs once a task and returns the function from a record batch to one list or
    array per new column; if that has a `close`, it is called when the task is through. An input
    column with the name of a new one is replaced.
    """
    new = T.StructType.fromDDL(columns)
    base = df.drop(*new.fieldNames())
    schema = T.StructType(base.schema.fields + new.fields)
    names = schema.fieldNames()

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        f, kinds = make(), [to_arrow_type(x.dataType) for x in new.fields]
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, rows):
                    part = batch.slice(start, rows)
                    made = [pa.array(v, k) if not isinstance(v, pa.Array) else v for v, k in zip(f(part), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*part.columns, *made], names)
        finally:
            getattr(f, "close", bool)()

    return base.mapInArrow(run, schema)


def checked_broadcast(ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A table of ids for a semi or anti join: broadcast if it has at most `most` rows, else shuffled as usual.

    A count comes first, so pass a written table or one that is cheap to make.
    """
    return F.broadcast(ids) if ids.count() <= most else ids


def lower_ascii(column):
    return F.translate(column, UPPER, LOWER)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
