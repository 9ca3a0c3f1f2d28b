"""Set operations (U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hemolens.operators import sets
from hemolens.plans.binding import LETTERS_SQL, letters
from hemolens.plans.catalog import query


@query(
    "u01_concat_features",
    """SELECT 'c' || c_custkey AS amp_id, c_acctbal AS balance, c_mktsegment AS segment, NULL::VARCHAR AS label FROM customer
    UNION ALL SELECT 's' || s_suppkey, s_acctbal, NULL, s_name FROM supplier""",
)
def concat_features(t):
    c = t.customer.select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("amp_id"), F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    s = t.supplier.select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("amp_id"), F.col("s_acctbal").alias("balance"),
        F.col("s_name").alias("label"),
    )
    return sets.concat_features([c, s])


@query(
    "u02_union_arms",
    "SELECT doc_id AS peptide_id FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id FROM labels WHERE quality = 1",
)
def union_arms(t):
    ids = F.col("doc_id").alias("peptide_id")
    return sets.union_arms(t.labels.filter("toxic = 1").select(ids), t.labels.filter("quality = 1").select(ids))


@query(
    "u03_merge_sources",
    f"""WITH u AS (SELECT 'd' || doc_id AS peptide_id, {LETTERS_SQL} AS sequence, source FROM documents
      UNION ALL SELECT 'k' || item_id, {LETTERS_SQL}, 'benchmark' FROM benchmark
      UNION ALL SELECT 'x' || doc_id, {LETTERS_SQL}, 'copy' FROM documents)
    SELECT min(peptide_id) AS peptide_id, count(*) AS copies, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM u GROUP BY sequence""",
)
def merge_sources(t):
    """Documents, benchmark items and a second copy of the documents as three sources."""

    def part(df, prefix, ident, source):
        key = F.concat(F.lit(prefix), F.col(ident).cast("string")).alias("peptide_id")
        return df.select(key, letters(F.col("text")).alias("sequence"), source.alias("source"))

    merged = sets.merge_sources(
        [
            part(t.documents, "d", "doc_id", F.col("source")),
            part(t.benchmark, "k", "item_id", F.lit("benchmark")),
            part(t.documents, "x", "doc_id", F.lit("copy")),
        ]
    )
    return merged.select("peptide_id", "copies", F.array_join("sources", ",").alias("sources"))


@query(
    "u04_cohort_diff",
    """WITH a AS (SELECT doc_id AS peptide_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'nontoxic' END AS arm FROM labels),
    b AS (SELECT c_custkey AS peptide_id, CASE WHEN c_acctbal < 0 THEN 'toxic' ELSE 'nontoxic' END AS arm FROM customer)
    SELECT coalesce(a.peptide_id, b.peptide_id) AS peptide_id, CASE WHEN b.peptide_id IS NULL THEN 'listed_only'
      WHEN a.peptide_id IS NULL THEN 'data_only' ELSE 'wrong_arm' END AS problem
    FROM a FULL JOIN b ON a.peptide_id = b.peptide_id WHERE a.arm IS DISTINCT FROM b.arm""",
)
def cohort_diff(t):
    """All labels as the list, all customers as the data, negative balances as the toxic arm."""
    arm = lambda c: F.when(c, "toxic").otherwise("nontoxic").alias("arm")
    listed = t.labels.select(F.col("doc_id").alias("peptide_id"), arm(F.col("toxic") == 1))
    data = t.customer.select(F.col("c_custkey").alias("peptide_id"), arm(F.col("c_acctbal") < 0))
    return sets.cohort_diff(listed, data)
