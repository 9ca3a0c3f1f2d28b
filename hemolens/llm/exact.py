"""Exact duplicates by digest, with frequent digests split off before the shuffle.

A pass writes (row, id, digest) to the shared folder, so texts are read once. Every task runs a
Misra-Gries sketch over its digests; the sketches' lower bounds are summed, and a digest whose sum
is `1 / COUNTERS` of all rows or more is a candidate. The sums of all digests are at most the
number of rows, so there are at most `COUNTERS` candidates, and the sketches' error is small
enough that every digest with `2 / COUNTERS` of the rows is one. An exact pass over the candidates
counts them and finds the row that stays; these winners are broadcast and settle their rows
without a shuffle. The remaining digests are shuffled as usual: none has more than
`2 / COUNTERS` of the rows.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemolens.llm.common import lower_ascii
from hemolens.session import cut_lineage

#: Most candidates; a broadcast winner has about 100 bytes, so all of them stay below 4 MB.
COUNTERS = 32_768


class Sketch:
    """Misra-Gries counters: at most `size` after `trimmed`, each low by at most rows / (size + 1)."""

    def __init__(self, size: int):
        self.size, self.counts = size, {}

    def add(self, values: pa.Array) -> None:
        found = pc.value_counts(values)
        for value, n in zip(found.field(0).to_pylist(), found.field(1).to_pylist()):
            self.counts[value] = self.counts.get(value, 0) + n
        if len(self.counts) > 4 * self.size:
            self.trimmed()

    def trimmed(self) -> dict:
        if len(self.counts) > self.size:
            cut = sorted(self.counts.values(), reverse=True)[self.size]
            self.counts = {v: n - cut for v, n in self.counts.items() if n > cut}
        return self.counts


def frequent(rows: DataFrame, column: str, counters: int) -> DataFrame:
    """(digest): at most `counters` values of the written table `rows`, among them all with 2 / counters of its rows."""

    def run(batches):
        sketch = Sketch(counters)
        for batch in batches:
            sketch.add(batch.column(0))
        kept = sketch.trimmed()
        keys = list(kept)
        for at in range(0, len(keys), 10_000):
            part = keys[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([kept[k] for k in part], pa.int64())], ["digest", "seen"])

    least = max(2.0, rows.count() / counters)
    sums = rows.select(column).mapInArrow(run, "digest binary, seen long").groupBy("digest").agg(F.sum("seen").alias("seen"))
    return cut_lineage(sums.filter(F.col("seen") >= least).select("digest"))


def mark_copies(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", normalise=lower_ascii, carry: Column | None = None, counters: int = COUNTERS
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256[, carried]) of every row.

    Texts are equal when `normalise` (by default A-Z in lower case) makes them identical, by SHA-256.
    A null text counts as empty; empty texts are a group like any other. The row with the largest
    id stays, a null id being smaller than any other; of rows with the same text and id, exactly one
    (the first read) stays. Rows with the same id and different texts belong to different groups. An
    empty table gives an empty result. Only the id, the text and `carry` are read, so extra
    columns of any name are harmless; `carry` is taken along as column `carried`.
    """
    digest = F.unhex(F.sha2(F.encode(normalise(F.coalesce(F.col(text), F.lit(""))), "UTF-8"), 256))
    named = docs.select(
        F.col(id_col).alias("id"), digest.alias("digest"), *([] if carry is None else [carry.alias("carried")])
    )
    rows = cut_lineage(named.withColumn("row", F.monotonically_increasing_id()))
    heavy = frequent(rows, "digest", counters)
    best = F.max(F.struct("id", (-F.col("row")).alias("late"))).alias("best")
    size = F.count("*").alias("size")
    winners = cut_lineage(rows.join(F.broadcast(heavy), "digest", "left_semi").groupBy("digest").agg(best, size))  # `counters` rows at most
    settled = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    group = Window.partitionBy("digest")  # at most 2 / counters of the rows
    shuffled = rest.withColumns({"best": F.max(F.struct("id", (-F.col("row")).alias("late"))).over(group), "size": F.count("*").over(group)})
    return settled.unionByName(shuffled).select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("best.late") == -F.col("row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
        *([] if carry is None else ["carried"]),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns; see `mark_copies`."""
    names = docs.columns
    marked = mark_copies(docs, id_col, text, carry=F.struct(*[F.col(f"`{c}`") for c in names]))
    return marked.filter("kept").select(*[F.col("carried").getField(c).alias(c) for c in names])
