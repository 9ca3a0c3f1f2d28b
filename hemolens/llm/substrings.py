"""Removal of repeated passages of words, by super-k-mer partitioning.

Every window of `size` words has a minimiser, the run of `MER` words in it with the least hash.
Neighbouring windows mostly share theirs, so the stretch of words under such windows travels as
one packed string to the minimiser's bucket, and equal windows always meet there. In the bucket
the windows are sorted, which finds the first start of each exactly: candidates come together by
a 64-bit hash and are then compared word for word.

A first pass sums the bytes that every minimiser would send. It sets the number of buckets from
the volume, and names the heavy minimisers (a passage in a third of all documents): their
windows are sent one by one, by the hash of the window, after each batch has dropped the ones
that it holds twice. No bucket then depends on how often one passage occurs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemolens.llm.common import WordHash, attach, checked_broadcast, mix, running_minimum, shingle_hashes, words
from hemolens.session import cut_lineage

MER = 4
BUCKET_BYTES = 12_000_000
SLOTS = 1 << 24
MOST_HEAVY = 1_000_000
#: Texts whose words are hashed and cut together.
TOGETHER = 100


def minimisers(codes: np.ndarray, size: int) -> np.ndarray:
    """Least hash of a run of `MER` words in every window of `size` words."""
    mers = shingle_hashes(codes, min(MER, size))
    return running_minimum(mers, size - min(MER, size) + 1)


def stretches(codes: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(minimiser, text, first window, one past the last window) of the runs of windows of one text that share one.

    `codes` are those of all texts, one after the other, of `lengths` words, at least `size` each;
    windows are numbered through all of them, and none crosses from one text to the next.
    """
    least = minimisers(codes, size)
    ends = np.cumsum(lengths)
    cut = np.ones(len(least), bool)
    cut[1:] = least[1:] != least[:-1]
    cut[ends[:-1]] = True
    inside = np.ones(len(least), bool)
    for k in range(1, size):
        inside[ends[:-1] - k] = False  # these reach into the next text
    first = np.flatnonzero(cut & inside)
    stop = np.flatnonzero(np.concatenate((cut[1:] | ~inside[1:], [True])) & inside) + 1
    return least[first], np.searchsorted(ends, first, "right"), first, stop


def together(batch: pa.RecordBatch, columns: list[str], size: int):
    """(rows, words, lengths) of `TOGETHER` texts at a time; `columns` end with the text, short texts are left out."""
    for at in range(0, batch.num_rows, TOGETHER):
        part = batch.slice(at, TOGETHER)
        rows, tokens, lengths = [], [], []
        for *row, t in zip(*[part.column(c).to_pylist() for c in columns]):
            mine = words(t)
            if len(mine) >= size and None not in row:
                rows.append(row)
                tokens += mine
                lengths.append(len(mine))
        if rows:
            yield rows, tokens, np.array(lengths)


def slots_of(minimiser: np.ndarray) -> np.ndarray:
    return (minimiser >> np.uint64(40)).astype(np.int64)  # the top 24 bits


def volume(docs: DataFrame, text: str, size: int) -> DataFrame:
    """(slot, bytes): what the minimisers of a slot would send."""

    def run(batches):
        hashed = WordHash()
        for batch in batches:
            slots, sizes = [], []
            for _, tokens, lengths in together(batch, [text], size):
                least, _, first, last = stretches(hashed.of(tokens), lengths, size)
                ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)))
                slots.append(slots_of(least))
                sizes.append(ends[last + size - 1] - ends[first])
            if slots:
                slot, where = np.unique(np.concatenate(slots), return_inverse=True)
                total = np.bincount(where, np.concatenate(sizes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total)], ["slot", "bytes"])

    return docs.select(text).mapInArrow(run, "slot long, bytes long").groupBy("slot").agg(F.sum("bytes").alias("bytes"))


def pack(rows: list[tuple]) -> bytes:
    """Stretches (doc, tag, first window, windows, packed words) as one compressed block."""
    *columns, packed = zip(*rows)
    numbers = [np.array([len(rows)], np.int64), *[np.array(c, np.int64) for c in columns]]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([x.tobytes() for x in numbers]) + b" ".join(packed))


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    rows = int(np.frombuffer(raw, np.int64, 1)[0])
    doc, tag, start, n = np.frombuffer(raw, np.int64, 4 * rows, 8).reshape(4, rows)
    return doc, tag, start, n, raw[8 + 32 * rows :]


def send(docs: DataFrame, id_col: str, text: str, size: int, buckets: int, heavy: frozenset) -> DataFrame:
    """(bucket, block): stretches as (doc, tag, first window, windows, packed words) by bucket.

    `docs` has `_tag` beside the id, which tells rows of one id apart. Within a batch only the earliest of equal stretches travels. The later ones are known to
    repeat it: they go back as (bucket -1, block) with nothing to compare.
    """

    def run(batches):
        hashed = WordHash()
        for batch in batches:
            seen: dict[bytes, tuple[int, int, int, int, int]] = {}
            known: list[tuple] = []
            for rows, tokens, lengths in together(batch, [id_col, "_tag", text], size):
                codes = hashed.of(tokens)
                least, of, first, last = stretches(codes, lengths, size)
                before = (np.cumsum(lengths) - lengths).tolist()
                slots = slots_of(least).tolist()
                to = (mix(least) % np.uint64(buckets)).astype(np.int64).tolist()
                whole = None
                for slot, bucket, k, a, b in zip(slots, to, of.tolist(), first.tolist(), last.tolist()):
                    doc, tag = rows[k]
                    if slot in heavy:
                        if whole is None:
                            whole = mix(shingle_hashes(codes, size)) % np.uint64(buckets)
                        parts = [(int(whole[w]), w, 1) for w in range(a, b)]
                    else:
                        parts = [(bucket, a, b - a)]
                    for where, start, n in parts:
                        packed = b" ".join(tokens[start : start + n + size - 1])
                        mine = (doc, tag, start - before[k], n, where)
                        other = seen.setdefault(packed, mine)
                        if other is not mine:
                            if mine[:3] == other[:3]:
                                continue
                            if mine < other:
                                seen[packed], mine = mine, other
                            known.append((*mine[:4], b""))
            out: dict[int, list] = {}
            for packed, (*mine, where) in seen.items():
                out.setdefault(where, []).append((*mine, packed))
            if known:
                out[-1] = known
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(out), pa.int64()), pa.array([pack(r) for r in out.values()], pa.binary())],
                    ["bucket", "block"],
                )

    return docs.select(id_col, "_tag", text).mapInArrow(run, "bucket long, block binary")


def numbered(packed: bytes) -> np.ndarray:
    """Number of each word, in order of first appearance; words are parted by one space each."""
    data = packed + b" "  # a word's entry ends with its space, which no word holds
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    entries = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return entries.dictionary_encode().indices.to_numpy().astype(np.int64)


def repeats(blocks: list[bytes], size: int) -> np.ndarray:
    """(doc, tag, start) rows of the windows in a bucket that start earlier elsewhere."""
    texts, docs, tags, starts, at, length = [], [], [], [], [], 0
    for block in blocks:
        doc, tag, start, n, packed = unpack(block)
        texts.append(packed)
        before = np.cumsum(n) - n
        inner = np.arange(int(n.sum())) - np.repeat(before, n)  # 0.. within each stretch
        docs.append(np.repeat(doc, n))
        tags.append(np.repeat(tag, n))
        starts.append(np.repeat(start, n) + inner)
        at.append(length + np.repeat(before + np.arange(len(n)) * (size - 1), n) + inner)
        length += int(n.sum()) + len(n) * (size - 1)
    code = numbered(b" ".join(texts))
    doc, tag, start, at = map(np.concatenate, (docs, tags, starts, at))
    key = shingle_hashes(code.astype(np.uint64), size)[at]
    order = np.argsort(key)
    ranked = key[order]
    fresh = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    shared = order[~(fresh & np.concatenate((fresh[1:], [True])))]  # windows whose hash is not alone
    if not len(shared):
        return np.empty((0, 3), np.int64)
    shared = shared[np.lexsort((start[shared], tag[shared], doc[shared], key[shared]))]
    fresh = np.concatenate(([True], key[shared][1:] != key[shared][:-1]))
    head = shared[np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))]
    others = np.flatnonzero(~fresh)  # the head itself needs no comparison
    mine, theirs = at[shared[others]], at[head[others]]
    if all((code[mine + k] == code[theirs + k]).all() for k in range(size)):
        late = shared[~fresh & ((doc[shared] != doc[head]) | (tag[shared] != tag[head]) | (start[shared] != start[head]))]
    else:  # two windows with one hash: go by their words
        first: dict[bytes, int] = {}
        late = []
        for i in shared.tolist():
            j = first.setdefault(code[at[i] : at[i] + size].tobytes(), i)
            if (doc[i], tag[i], start[i]) != (doc[j], tag[j], start[j]):
                late.append(i)
    return np.column_stack((doc[late], tag[late], start[late]))


def runs(late: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, tag, first, count) of the runs of consecutive window starts."""
    doc, tag, start = late[np.lexsort(late.T[::-1])].T
    cut = np.flatnonzero((doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > start[:-1] + 1)) + 1
    first = np.concatenate(([0], cut))
    last = np.concatenate((cut, [len(doc)])) - 1
    return doc[first], tag[first], start[first], start[last] - start[first] + 1


def repeated_windows(docs: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """(doc, tag, start, windows): runs of windows whose words start earlier somewhere.

    Runs of one document may touch or overlap, as they come from several buckets.
    """
    by_slot = cut_lineage(volume(docs, text, size))
    total = by_slot.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(64, -(-total // BUCKET_BYTES))
    heavy_bytes = max(BUCKET_BYTES // 8, total // MOST_HEAVY)
    heavy = frozenset(r[0] for r in by_slot.filter(F.col("bytes") > heavy_bytes).select("slot").collect())

    def find(batches):
        def done(bucket, blocks):
            if bucket == -1:
                found = unpack(blocks[0])[:4]
            else:
                late = repeats(blocks, size)
                found = runs(late) if len(late) else ([],)
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["doc", "tag", "start", "windows"])

        bucket, blocks = None, []
        for batch in batches:
            for b, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if b == -1:  # known repeats need no company
                    yield from done(-1, [block])
                    continue
                if b != bucket and blocks:
                    yield from done(bucket, blocks)
                    blocks = []
                bucket = b
                blocks.append(block)
        if blocks:
            yield from done(bucket, blocks)

    sent = send(docs, id_col, text, size, int(buckets), heavy)
    dealt = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(-1 - F.abs(F.xxhash64("block")) % int(buckets))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(buckets) // 4)
    ordered = sent.withColumn("to", dealt).repartition(parts, "to").sortWithinPartitions("bucket").select("bucket", "block")
    return ordered.mapInArrow(find, "doc long, tag long, start long, windows long")


def tagged(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """`docs` with `_tag`: 0, or a hash of the text where several rows have the id."""
    again = cut_lineage(docs.groupBy(id_col).agg(F.count("*").alias("_rows")).filter("_rows > 1").select(F.col(id_col).alias("_again")))
    if again.isEmpty():
        return docs.withColumn("_tag", F.lit(0).cast("long"))
    there = docs.join(checked_broadcast(again), F.col(id_col) == F.col("_again"), "left")
    return there.withColumn("_tag", F.when(F.col("_again").isNotNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))).drop("_again")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 20, out: str = "kept_text") -> DataFrame:
    """Per row of `docs`: id, `n_words`, `n_removed` and the words left, joined by one space, as `out`.

    A word goes if it is in a window of `size` words whose words also start earlier: in a
    smaller id, or earlier in the same document. All windows are judged on the input. Null,
    empty and short texts lose nothing. A row with a null id is not compared and loses nothing.
    Of rows with one id and different texts, the one whose text has the smaller hash is earlier.
    Rows with one id and one text are one document: neither is earlier, both keep what one would.
    """
    base = tagged(docs.select(F.col(id_col), F.col(text)), id_col, text)
    marks = (
        repeated_windows(base, id_col, text, size)
        .groupBy("doc", "tag")
        .agg(F.collect_list(F.struct("start", "windows")).alias("_runs"))  # no more than the document's windows
        .withColumnsRenamed({"doc": "_doc", "tag": "_of"})
    )
    joined = base.join(marks, (F.col(id_col) == F.col("_doc")) & (F.col("_tag") == F.col("_of")), "left").drop("_doc", "_of", "_tag")

    def make():
        def one(t, found):
            tokens = words(t)
            if not found:
                return len(tokens), 0, b" ".join(tokens).decode("utf-8", "surrogatepass")
            edge = np.zeros(len(tokens) + 1, np.int64)
            np.add.at(edge, [r["start"] for r in found], 1)
            np.add.at(edge, [min(len(tokens), r["start"] + r["windows"] + size - 1) for r in found], -1)
            gone = np.cumsum(edge[:-1]) > 0
            left = [w for w, g in zip(tokens, gone.tolist()) if not g]
            return len(tokens), int(gone.sum()), b" ".join(left).decode("utf-8", "surrogatepass")

        return lambda b: list(zip(*map(one, b.column(text).to_pylist(), b.column("_runs").to_pylist()))) or [[]] * 3

    return attach(joined, f"n_words long, n_removed long, `{out}` string", make).select(id_col, "n_words", "n_removed", out)
