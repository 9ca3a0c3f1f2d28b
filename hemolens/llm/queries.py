"""One query for each operator, over whole tables, and SQL for those that DuckDB can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from hemolens.llm import (
    cotraining,
    decontaminate,
    exact,
    jaccard,
    language,
    lm,
    negatives,
    oracles,
    pieces,
    quality_rules,
    secrets,
    substrings,
    token_counts,
    whitening,
)
from hemolens.llm.common import table
from hemolens.session import cut_lineage, scratch_path

QUERIES: dict = {}
ORACLES: dict[str, str] = dict(oracles.ORACLES)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def model_bytes(name: str = "piece_bpe_32k.model") -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@query
def op3_quality_rules(spark, sf_dir):
    """Base checks and the weakly supervised verdict on every document."""
    return quality_rules.filter_quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "votes", "quality",
    )


@query
def op7_sentencepiece(spark, sf_dir):
    """Ids of every document, and the text that they decode to, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_pieces(docs, model_bytes()).select(
        "doc_id",
        (F.octet_length("piece_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("piece_ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


@query
def op9_secret_scans(spark, sf_dir):
    """Secrets of every document: pattern counts and digest, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan_secrets(docs)
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(secrets.PATTERNS)],
        F.sha2(F.encode(secrets.as_text(F.col("base_spans")), "UTF-8"), 256).alias("base_sha256"),
        secrets.as_text(F.col("secret_spans")).alias("spans"),
    )


@query
def op1_decontamination(spark, sf_dir):
    """Benchmark items found in documents, each with its best passage."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"))
    hit = found.select("doc_id", F.explode("item_hits").alias("hit"))
    return hit.select(
        "doc_id", "hit.item_id", "hit.distance", F.col("hit.start").alias("start_at"), F.col("hit.end").alias("end_at"),
        "hit.item_chars",
    )


@query
def op10_substring_dedup(spark, sf_dir):
    """Words left in every document without repeated 20-word windows, as a digest."""
    left = substrings.without_repeats(table(spark, sf_dir, "documents"), size=20)
    return left.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256")
    )


@query
def op4_jaccard_join(spark, sf_dir):
    """Groups of documents that share nine tenths of their three-word shingles."""
    return jaccard.similar_groups(table(spark, sf_dir, "documents"), size=3, percent=90)


@query
def op2_language_id(spark, sf_dir):
    """Language of every document, and whether it is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return language.identify_documents(docs).select(
        "doc_id", "text_language", "language", F.round("language_posterior", 6).alias("posterior"),
        F.col("language_kept").alias("kept"),
    )


@query
def pages_language_id(spark, sf_dir):
    """Language of every raw page, from its text, markup, address suffix and host."""
    return language.identify_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "text_language", "language", F.round("language_posterior", 6).alias("posterior"),
        F.col("language_kept").alias("kept"),
    )


@query
def op6_token_counts(spark, sf_dir):
    """Rollup after all documents came in, those with runs of blanks were recounted, and toxic ones left.

    The second batch revises counts to those of the text with runs of spaces as one; the third
    deletes what is labelled toxic. Every batch is sent twice, as after a lost answer.
    """
    import public_tokenizers

    ranks, version = token_counts.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    docs = docs.withColumn("squeezed", F.regexp_replace("text", " {2,}", " "))
    counted = token_counts.count_tokens(
        docs.withColumn("squeezed", F.when(F.col("squeezed") != F.col("text"), F.col("squeezed"))), ranks,
        public_tokenizers.PATTERN, {"n_raw": "text", "n_squeezed": "squeezed"},
    )
    ledger = cut_lineage(
        counted.select(
            "doc_id", "source", "lang", F.lit(version).alias("tokenizer"), "n_raw", F.col("squeezed").isNotNull().alias("again"),
            F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("raw_chars"),
            F.when(F.col("squeezed").isNull(), F.col("n_raw")).otherwise(F.col("n_squeezed")).alias("n_now"),
            F.coalesce(F.length("squeezed"), F.length("text"), F.lit(0)).cast("long").alias("now_chars"),
        )
    )
    was = {"n_tokens": F.col("n_raw"), "n_chars": F.col("raw_chars")}
    now = {"n_tokens": F.col("n_now"), "n_chars": F.col("now_chars")}
    old = {f"old_{k}": F.col(k) for k in token_counts.KEYS}
    rollup = token_counts.Rollup(spark, scratch_path(spark, "rollup"))
    for _ in range(2):
        rollup.commit("load", ledger.withColumns({"op": F.lit("insert"), **was}))
        rollup.commit(
            "squeeze",
            ledger.filter("again").withColumns(
                {"op": F.lit("revise"), **now, **old, "old_n_tokens": F.col("n_raw"), "old_n_chars": F.col("raw_chars")}
            ),
        )
        gone = ledger.join(toxic, "doc_id", "left_semi")
        rollup.commit("toxic", gone.withColumns({"op": F.lit("delete"), **now}))
    return rollup.totals()


@query
def op5_quality_classifier(spark, sf_dir):
    """Co-trained quality probability of every document."""
    return cotraining.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_lm_scoring(spark, sf_dir):
    """Unigram and recurrent log-probabilities of every document."""
    return lm.score_documents(table(spark, sf_dir, "documents"))


@query
def op11_embedding_whitening(spark, sf_dir):
    """Every vector along the four leading components of the distinct ones."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", components=4)


@query
def op12_hard_negatives(spark, sf_dir):
    """Rows of another label that score just below each positive of every hundredth vector."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label, k=5, share=80)


@query
def op13_exact_dedup(spark, sf_dir):
    """The row that stays for every document, and the size of its group."""
    return exact.mark_copies(table(spark, sf_dir, "documents"))
