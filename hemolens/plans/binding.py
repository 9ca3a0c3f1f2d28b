"""Domain tables seen through the given ones, and the same views as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemolens.functions import draws

CANONICAL = "ACDEFGHIKLMNPQRSTVWY"
EPOCH = "2024-01-01 00:00:00"


def letters(text):
    return F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))


def residues(text):
    return F.upper(F.regexp_replace(text, f"[^{CANONICAL}{CANONICAL.lower()}]", ""))


LETTERS_SQL = "upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"
RESIDUES_SQL = f"upper(regexp_replace(text, '[^{CANONICAL}{CANONICAL.lower()}]', '', 'g'))"


def draw_sql(expr: str) -> str:
    """SQL twin of `draws.draw32` for an already joined string."""
    return f"CAST(('0x' || substr(md5({expr}), 1, 8)) AS BIGINT)"


def r6(expr: str) -> str:
    """SQL rounding to six digits without negative zero."""
    return f"(round({expr}, 6) + 0.0)"


def round6(col):
    return F.round(col, 6) + F.lit(0.0)


class Tables:
    """The given parquet tables plus the domain views built on them; all lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def peptides(self) -> DataFrame:
        """Documents as peptides: the letters of the text as the sequence."""
        return self.documents.select(
            F.col("doc_id").alias("peptide_id"),
            F.col("source").alias("name"),
            "lang",
            letters(F.col("text")).alias("sequence"),
        )

    def canonical(self) -> DataFrame:
        """Peptides reduced to the 20 residues; a text without any is left out."""
        return self.documents.select(
            F.col("doc_id").alias("peptide_id"), residues(F.col("text")).alias("sequence")
        ).filter("sequence <> ''")

    def predictions(self) -> DataFrame:
        """Scored labels; scores step by 0.001, so ties exist."""
        docs = self.documents.select("doc_id", "lang", "source")
        return docs.join(self.labels, "doc_id").select(
            F.col("doc_id").alias("peptide_id"),
            "lang",
            "source",
            F.col("toxic").alias("y"),
            (draws.draw32("doc_id") % 1000 / 1000.0).alias("p"),
            (F.col("doc_id") % 5).alias("fold"),
        )

    def frames(self) -> DataFrame:
        """Events as bead observations of a run along time (microseconds from the start)."""
        return self.events.select(
            "event_id",
            F.col("user_id").alias("run"),
            F.col("event_type").alias("bead"),
            F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{EPOCH}', ts)").alias("t_us"),
            "value",
        )

    def samples(self) -> DataFrame:
        """Events as umbrella samples: 5 windows, z mapped into (-1.4, 2.8] nm."""
        window = (
            F.when(F.col("bead") == "click", 0)
            .when(F.col("bead") == "error", 1)
            .when(F.col("bead") == "purchase", 2)
            .when(F.col("bead") == "signup", 3)
            .otherwise(4)
        )
        return self.frames().select(
            "event_id",
            (F.col("run") % 10).alias("peptide_id"),
            (F.col("event_id") % 2 + 1).alias("replicate"),
            window.alias("window_id"),
            "t_us",
            (2.8 - 4.2 * F.col("value") / (F.col("value") + 50.0)).alias("z"),
        )

    def atoms(self) -> DataFrame:
        """Embeddings as atoms: every bead of `beads`, label as molecule."""
        return self.beads().select(
            (F.col("mol") * 21 + F.col("bead")).alias("atom_id"), F.col("run").alias("molecule"), "x", "y", "z"
        )

    def beads(self) -> DataFrame:
        """Embeddings as 21-bead chains: elements 3i..3i+2 of each vector are bead i."""
        e = F.col("embedding")
        return (
            self.embeddings.select(
                F.col("vec_id").alias("mol"),
                F.col("label").alias("run"),
                "embedding",
                F.explode(F.sequence(F.lit(0), F.lit(20))).alias("bead"),
            )
            .select(
                "mol",
                "run",
                "bead",
                *[F.element_at(e, F.col("bead") * 3 + i + 1).cast("double").alias(a) for i, a in enumerate("xyz")],
            )
        )

    def replicates(self) -> DataFrame:
        """Line items as replicate measurements of a feature."""
        return self.lineitem.select(
            F.col("l_suppkey").alias("peptide_id"),
            F.col("l_linenumber").alias("replicate"),
            F.col("l_returnflag").alias("occupancy"),
            F.col("l_extendedprice").alias("value"),
            F.col("l_quantity").alias("se"),
            F.col("l_discount").alias("discount"),
            F.col("l_tax").alias("tax"),
            F.col("l_orderkey").alias("run"),
        )

    def assays(self) -> DataFrame:
        """Orders as HC50 measurements in micromolar."""
        return self.orders.select(
            F.col("o_orderkey").alias("peptide_id"),
            F.col("o_custkey").alias("assay_id"),
            F.col("o_orderstatus").alias("status"),
            (F.col("o_totalprice") / 1000.0).alias("hc50_um"),
        )


PEPTIDES_SQL = f"peptides AS (SELECT doc_id AS peptide_id, source AS name, lang, {LETTERS_SQL} AS sequence FROM documents)"
CANONICAL_SQL = (
    f"canonical AS (SELECT doc_id AS peptide_id, {RESIDUES_SQL} AS sequence FROM documents WHERE {RESIDUES_SQL} <> '')"
)
PREDICTIONS_SQL = f"""predictions AS (
  SELECT d.doc_id AS peptide_id, d.lang, d.source, l.toxic AS y,
         ({draw_sql("CAST(d.doc_id AS VARCHAR)")} % 1000) / 1000.0::DOUBLE AS p, d.doc_id % 5 AS fold
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
FRAMES_SQL = f"""frames AS (
  SELECT event_id, user_id AS run, event_type AS bead,
         date_diff('microsecond', TIMESTAMP '{EPOCH}', ts) AS t_us, value FROM events)"""
SAMPLES_SQL = f"""{FRAMES_SQL},
samples AS (
  SELECT event_id, run % 10 AS peptide_id, event_id % 2 + 1 AS replicate,
         CASE bead WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS window_id,
         t_us, 2.8::DOUBLE - 4.2::DOUBLE * value / (value + 50.0::DOUBLE) AS z
  FROM frames)"""
BEADS_SQL = """beads AS (
  SELECT vec_id AS mol, label AS run, CAST(i AS INTEGER) AS bead, CAST(embedding[3*i+1] AS DOUBLE) AS x,
         CAST(embedding[3*i+2] AS DOUBLE) AS y, CAST(embedding[3*i+3] AS DOUBLE) AS z
  FROM embeddings, (SELECT unnest(range(21)) AS i))"""
ATOMS_SQL = f"{BEADS_SQL}, atoms AS (SELECT mol * 21 + bead AS atom_id, run AS molecule, x, y, z FROM beads)"
REPLICATES_SQL = """replicates AS (
  SELECT l_suppkey AS peptide_id, l_linenumber AS replicate, l_returnflag AS occupancy, l_extendedprice AS value,
         l_quantity AS se, l_discount AS discount, l_tax AS tax, l_orderkey AS run FROM lineitem)"""
ASSAYS_SQL = """assays AS (
  SELECT o_orderkey AS peptide_id, o_custkey AS assay_id, o_orderstatus AS status,
         o_totalprice / 1000.0::DOUBLE AS hc50_um FROM orders)"""
