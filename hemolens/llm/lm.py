"""Log-probabilities of whole documents under a recurrent model trained on the corpus.

Counts of all words of all training documents come first. The most frequent words, as many as
make up `COVERED` of all training tokens, are the model's tokens; any other word is the unknown
token, times its share among the unknown words by its count. Training is data-parallel: a start model learns from a bounded sample, every
task then goes on from it over the documents of its own partition, all of them, and the tasks'
models are averaged by the tokens they saw. Scoring carries each document's state through all
of its windows.

Counts of the `KNOWN` most frequent words, or of the model's if those are more, travel with the
tasks; the others of a document are joined to the count table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemolens.llm import recurrent
from hemolens.llm.common import ROWS_A_STEP
from hemolens.session import cut_lineage

KNOWN = 200_000
#: Share of the training tokens that the model knows by name: its vocabulary grows with the corpus.
COVERED = 0.8
END = b""
UNKNOWN_ID, END_ID, FIRST_ID = 0, 1, 2
BLOCK = 4096


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words of these texts one after the other, an empty one for the end of each; their number by text.

    Words are those of `lower_words`: Arrow's ASCII functions know the same blanks and letters.
    """
    plain = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    blank = pc.if_else(pc.equal(pc.binary_length(plain), 0), "", " ")  # behind it, the split finds the empty word
    split = pc.ascii_split_whitespace(pc.binary_join_element_wise(plain, blank, ""))
    return split.flatten().cast(pa.binary()), pc.list_value_length(split).to_numpy()


def slices(batch: pa.RecordBatch, column: str):
    """(words, their number by text) of every `ROWS_A_STEP` rows."""
    for start in range(0, batch.num_rows, ROWS_A_STEP):
        yield tokens_of(batch.column(column).slice(start, ROWS_A_STEP))


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(word, n) over all rows: lower-cased words, and one end a row."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                seen = pa.chunked_array([words for words, _ in slices(batch, "text")]).value_counts()
                yield pa.RecordBatch.from_arrays([seen.field("values"), seen.field("counts")], ["word", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int, share: float = 0.0) -> list[tuple[bytes, int]]:
    """Words with their counts, the most frequent first: all above some count.

    They are at most `most`, or more if only more make up `share` of all tokens.

    Counts fall into sixteen classes a doubling, so a table of about a thousand rows at most tells
    from which class on the words are few enough, and no task sorts or sends more than those.
    """
    kind = F.floor(F.log2("n") * 16).cast("int")
    sizes = counts.groupBy(kind.alias("kind")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).orderBy(F.desc("kind")).collect()
    wanted = share * sum(r["tokens"] for r in sizes)
    least, total, tokens = None, 0, 0
    for r in sizes:
        total += r["words"]
        if total > most and tokens >= wanted:
            break
        least, tokens = r["kind"], tokens + r["tokens"]
    if least is None:
        return []
    rows = counts.filter(kind >= least).collect()
    return sorted(((bytes(r["word"]), r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))


class Vocabulary:
    """Frequent words with their counts, in order of frequency, and the totals of all of them."""

    def __init__(self, frequent: list[tuple[bytes, int]], total: int, distinct: int):
        rank = {w: k for k, (w, _) in enumerate(frequent)}
        self.frequent = pa.array(rank, pa.binary())
        self.counts = np.array([n for _, n in frequent], float)
        self.total, self.distinct = total, distinct
        self.below = total + 0.1 * (distinct + 1)
        #: the last is for words that are not frequent, here and in `ids`
        self.log10 = np.append(np.log10((self.counts + 0.1) / self.below), 0.0)
        ends = self.counts[rank[END]] if END in rank else 0
        others = [(w, n) for w, n in frequent if w != END]
        reached = ends + np.cumsum([n for _, n in others])
        named = [w for w, _ in others[: int(np.searchsorted(reached, COVERED * total)) + 1]]
        #: the model has this number squared of tokens
        self.width = max(2, math.isqrt(len(named) + FIRST_ID - 1) + 1)
        self.ids = np.zeros(len(frequent) + 1, np.int32)
        for k, w in enumerate(named):
            self.ids[rank[w]] = k + FIRST_ID
        if END in rank:
            self.ids[rank[END]] = END_ID
        rest = total - ends - sum(self.counts[rank[w]] for w in named)
        unknown = distinct - (END in rank) - len(named)
        #: log10 of what a share of all tokens has to be raised by to be a share of the unknown ones
        self.raise_unknown = math.log10(self.below / (rest + 0.1 * (unknown + 1)))
        self.token_counts = np.zeros(self.width**2)
        self.token_counts[[UNKNOWN_ID, END_ID]] = rest, ends
        self.token_counts[FIRST_ID : FIRST_ID + len(named)] = [self.counts[rank[w]] for w in named]

    def ranks(self, tokens: pa.Array) -> np.ndarray:
        """Rank of each word and end; -1 for those that are not frequent."""
        return pc.fill_null(pc.index_in(tokens, self.frequent), -1).to_numpy(zero_copy_only=False)

    def tokens(self, ranks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The model's tokens for the words of texts with these numbers of words."""
        ids = self.ids.take(ranks, mode="wrap")
        ids[np.cumsum(sizes) - 1] = END_ID
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        words, sizes = tokens_of(pa.array([text], pa.string()))
        return self.tokens(self.ranks(words), sizes)


def trained_on(docs: DataFrame, text: str, words: Vocabulary, start: np.ndarray, rate: float) -> DataFrame:
    """(block, weight, values): what each task's model is after its partition, in blocks."""

    def run(batches):
        trainer = recurrent.Trainer(recurrent.shaped(start, words.width), rate)
        for batch in batches:
            texts = []
            for found, sizes in slices(batch, "text"):
                texts += np.split(words.tokens(words.ranks(found), sizes), np.cumsum(sizes)[:-1])
            trainer.learn(texts)
        if trainer.seen:
            values = recurrent.flat(trainer.model)
            parts = [values[k : k + BLOCK].tobytes() for k in range(0, len(values), BLOCK)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(parts)), pa.int32()), pa.array([float(trainer.seen)] * len(parts)), pa.array(parts, pa.binary())],
                ["block", "weight", "values"],
            )

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "block int, weight double, values binary")


def averaged(models: DataFrame) -> np.ndarray | None:
    """Mean of the tasks' models, weighted by tokens; a group is one block of each task's model."""

    def mean(rows: pa.Table) -> pa.Table:
        values = np.array([np.frombuffer(v, np.float32) for v in rows["values"].to_pylist()])
        v = np.average(values, axis=0, weights=rows["weight"].to_numpy()).astype(np.float32)
        return pa.table({"block": rows["block"][:1], "v": pa.array([v.tobytes()], pa.binary())})

    rows = models.groupBy("block").applyInArrow(mean, "block int, v binary").collect()  # the size of one model
    rows = sorted(rows, key=lambda r: r["block"])
    return np.concatenate([np.frombuffer(r["v"], np.float32) for r in rows]) if rows else None


def train(docs: DataFrame, text: str, words: Vocabulary, id_col: str, most_start: int = 4_000) -> np.ndarray:
    """Model after the start sample (about `most_start` rows, by a hash of the id) and then all rows."""
    first = recurrent.with_frequencies(recurrent.start_model(width=words.width), words.token_counts)
    share = F.pmod(F.xxhash64(F.col(id_col), F.lit("start")), F.lit(1_000_000_000)) / 1e9
    sample = cut_lineage(docs.filter(share < most_start / max(docs.count(), 1))).coalesce(1)  # all tasks look, one learns
    start = averaged(trained_on(sample, text, words, recurrent.flat(first), 0.01))
    start = recurrent.flat(first) if start is None else start
    after = averaged(trained_on(docs, text, words, start, 0.003))
    return start if after is None else after


def counted_by_text(words: pa.Array, which: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """For each text of `sizes` words, its different words among `which` and how often it has them."""
    at = np.flatnonzero(which)
    codes = words.take(pa.array(at)).dictionary_encode()
    most = max(len(codes.dictionary), 1)
    pairs, times = np.unique(np.repeat(np.arange(len(sizes)), sizes)[at] * most + codes.indices.to_numpy(), return_counts=True)
    structs = pa.StructArray.from_arrays([codes.dictionary.take(pa.array(pairs % most)), pa.array(times, pa.int64())], ["word", "times"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs, np.arange(len(sizes) + 1) * most), pa.int32()), structs)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Rows whose crc32 of the id as text is a multiple of ten are held out of all learning; a null
    id counts as the empty text there. Null and empty texts are the end alone. Without training
    rows all counts are zero and the model is the start model. Repeated rows get equal scores.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    out = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))) % 10 == 0
    training = docs.filter(~out)
    counts = cut_lineage(count_words(training, "text"))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words = Vocabulary(most_frequent(counts, KNOWN, COVERED), total, distinct)
    values = train(training, "text", words, "id")

    def score(batches):
        model = recurrent.shaped(values, words.width)
        for batch in batches:
            if not batch.num_rows:
                continue
            measures, encoded, rare = [], [], []
            for found, sizes in slices(batch, "text"):
                ranks = words.ranks(found)
                ids, logs = words.tokens(ranks, sizes), words.log10.take(ranks, mode="wrap")
                unknown, ends = ids == UNKNOWN_ID, np.cumsum(sizes)
                sums = [np.add.reduceat(x, ends - sizes) for x in ((ranks >= 0).astype(np.int64), logs, np.where(unknown, 0.0, logs), unknown.astype(np.int64))]
                measures.append((sizes.astype(np.int64), *sums))
                encoded += np.split(ids, ends[:-1])
                rare.append(counted_by_text(found, ranks < 0, sizes))
            n, known, base, plain, unknown = (np.concatenate(x) for x in zip(*measures))
            scores = recurrent.score_texts(model, encoded) / math.log(10)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("held_out"), batch.column("key"),
                    *(pa.array(x) for x in (n, known, base, plain, unknown, scores)),
                    pa.concat_arrays(rare),
                ],
                ["id", "held_out", "key", "n", "known", "base", "plain", "unknown", "model", "rare"],
            )

    id_type = docs.schema["id"].dataType.simpleString()
    key = F.sha2(F.concat_ws("\x01", F.coalesce(F.col("id").cast("string"), F.lit("\x02")), F.coalesce("text", F.lit(""))), 256)
    scored = cut_lineage(
        docs.withColumns({"held_out": out, "key": F.unhex(key)}).mapInArrow(
            score,
            f"id {id_type}, held_out boolean, key binary, n long, known long, base double, plain double, "
            "unknown long, model double, rare array<struct<word:binary,times:long>>",
        )
    )
    below = float(words.below)
    # repeated rows share a key: their rare words come once a row, and so does the row's own mark
    rare = scored.filter(F.size("rare") > 0).select("key", F.explode("rare").alias("r")).select("key", "r.word", "r.times")
    marks = scored.filter(F.size("rare") > 0).select("key", F.lit(1).alias("copies"))
    logs = F.log10((F.coalesce("n", F.lit(0)) + 0.1) / below)
    sums = (
        rare.join(counts, "word", "left")
        .select("key", (F.col("times") * logs).alias("log"), F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("known"), F.lit(0).alias("copies"))
        .unionByName(marks.select("key", F.lit(0.0).alias("log"), F.lit(0).cast("long").alias("known"), "copies"))
        .groupBy("key").agg(F.sum("log").alias("log"), F.sum("known").alias("more"), F.sum("copies").alias("copies"))
        .select("key", (F.col("log") / F.col("copies")).alias("log"), (F.col("more") / F.col("copies")).cast("long").alias("more"))
    )
    joined = scored.drop("rare").join(sums, "key", "left")
    base = F.col("base") + F.coalesce("log", F.lit(0.0))
    return joined.select(
        F.col("id").alias(id_col), "held_out", F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("model") + (base - F.col("plain")) + F.col("unknown") * float(words.raise_unknown)).alias("score"),
    )
