"""From raw documents to token ids: language, near copies, test items, secrets, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes every stage's rows
to the shared folder and reads them back as the next one's `docs`. All but the last stage
return the columns that came in. Rows with null or empty texts have no language and go in the
first stage; the stages' own docstrings say how they treat ties, repeated rows and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemolens.llm import decontaminate, jaccard, language, pieces, secrets
from hemolens.llm.common import table
from hemolens.llm.queries import model_bytes
from hemolens.session import cut_lineage


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is known with a posterior of a half or more."""
    columns = docs.columns
    safe = [f"_doc_{i}" for i in range(len(columns))]  # clear of the names that identification makes
    text, lang, source = (F.col(safe[columns.index(c)]) for c in ("text", "lang", "source"))
    found = language.identify(
        docs.toDF(*safe), text=safe[columns.index("text")], declared=F.coalesce(language.markup_language(text), lang), host=source,
        suffix=F.regexp_extract(source, r"\.([a-z0-9-]+)$", 1),
    )
    return found.filter("language_kept").select(*[F.col(n).alias(c) for n, c in zip(safe, columns)])


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group at a Jaccard similarity of 0.8 or more on runs of five words."""
    return jaccard.one_of_each(docs, jaccard.similar_groups(docs, size=5, percent=80))


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no benchmark item within its error budget."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets in every text and states its new length."""
    text = secrets.redacted(F.col("text"), F.col("_secret_spans"))
    found = secrets.scan_secrets(docs, base="_base_spans", spans="_secret_spans")
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and digests of them and of the text that they decode to."""
    kept = docs.select("doc_id", "lang", "source", "text")
    return pieces.encode_pieces(kept, model_bytes(), remember=False).select(
        "doc_id", "lang", "source", (F.octet_length("piece_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("piece_ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_near_copies),
    ("decontamination", without_test_items),
    ("secret_scans", without_secrets),
    ("sentencepiece", token_ids),
]

#: SQL has no trigram models, edit distances or merges; tests compare with a plain Python pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
