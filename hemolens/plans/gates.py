"""Filters, predicates, gates (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hemolens.operators import gates
from hemolens.plans.binding import ASSAYS_SQL, ATOMS_SQL, FRAMES_SQL, PEPTIDES_SQL, r6, round6
from hemolens.plans.catalog import query
from hemolens.plans.projections import BAND_SQL

BEST_SQL = "best AS (SELECT user_id AS run, event_type AS model, max(value) AS best_plddt FROM events GROUP BY ALL)"


@query("f01_gate_plddt", f"WITH {BEST_SQL} SELECT run, model, best_plddt, best_plddt >= 80 AS passed FROM best")
def gate_plddt(t):
    best = t.events.groupBy(F.col("user_id").alias("run"), F.col("event_type").alias("model")).agg(
        F.max("value").alias("best_plddt")
    )
    kept = gates.gate_plddt(best, 80.0).withColumn("passed", F.lit(True))
    out = gates.gate_plddt(best, 80.0, rejected=True).withColumn("passed", F.lit(False))
    return kept.unionByName(out)


@query(
    "f02_exclude_borderline",
    f"WITH {ASSAYS_SQL} SELECT peptide_id, {r6('hc50_um')} AS hc50_um FROM assays WHERE {BAND_SQL} <> 'borderline'",
)
def exclude_borderline(t):
    return gates.exclude_borderline(t.assays()).select("peptide_id", round6("hc50_um").alias("hc50_um"))


@query(
    "f03_length_range",
    f"WITH {PEPTIDES_SQL} SELECT peptide_id, length(sequence)::INTEGER AS n FROM peptides WHERE length(sequence) BETWEEN 10 AND 400",
)
def length_range(t):
    return gates.length_range(t.peptides(), 10, 400).select("peptide_id", F.length("sequence").alias("n"))


@query(
    "f04_production_window",
    f"""WITH {FRAMES_SQL}, s AS (SELECT *, max(t_us) OVER (PARTITION BY run) AS hi, min(t_us) OVER (PARTITION BY run) AS lo FROM frames)
    SELECT event_id, run, 'start' AS form FROM frames WHERE t_us >= 2000000000000
    UNION ALL SELECT event_id, run, 'fraction' FROM s WHERE t_us >= hi - 0.2 * (hi - lo)""",
)
def production_window(t):
    cols = ("event_id", "run")
    start = gates.production_window(t.frames(), "t_us", start=2_000_000_000_000)
    last = gates.production_window(t.frames(), "t_us", ["run"], fraction=0.2)
    return start.select(*cols, F.lit("start").alias("form")).unionByName(last.select(*cols, F.lit("fraction").alias("form")))


NAMED_SQL = f"""{ATOMS_SQL}, named AS (SELECT *, CASE molecule % 3 WHEN 0 THEN 'POPC' WHEN 1 THEN 'PSM' ELSE 'CHOL' END AS resname,
  CASE WHEN atom_id % 2 = 0 THEN 'PO4' ELSE 'NC3' END AS atom FROM atoms)"""


def named_atoms(t):
    return t.atoms().withColumns(
        {
            "resname": F.when(F.col("molecule") % 3 == 0, "POPC").when(F.col("molecule") % 3 == 1, "PSM").otherwise("CHOL"),
            "atom": F.when(F.col("atom_id") % 2 == 0, "PO4").otherwise("NC3"),
        }
    )


@query(
    "f05_leaflet_select",
    f"WITH {NAMED_SQL} SELECT atom_id, resname, atom FROM named WHERE resname IN ('POPC','PSM') AND atom = 'PO4' AND z > 0.05",
)
def leaflet_select(t):
    return gates.leaflet_select(named_atoms(t), zmin=0.05).select("atom_id", "resname", "atom")


@query(
    "f06_dataset_gate",
    f"""WITH {PEPTIDES_SQL}, j AS (SELECT p.*, l.toxic FROM peptides p LEFT JOIN labels l ON p.peptide_id = l.doc_id),
    v AS (SELECT avg((toxic IS NULL)::INTEGER) AS m, avg(regexp_matches(sequence, '^[A-Z]+$')::INTEGER) AS g FROM j)
    SELECT {r6('m')} AS missing_share, {r6('g')} AS valid_share, m <= 0.05 AND g >= 0.8 AS passed FROM v""",
)
def dataset_gate(t):
    joined = t.peptides().join(t.labels, F.col("peptide_id") == F.col("doc_id"), "left")
    row = gates.dataset_gate(joined, F.col("sequence").rlike("^[A-Z]+$"), hc50="toxic")
    return row.select(round6("missing_share").alias("missing_share"), round6("valid_share").alias("valid_share"), "passed")


#: Measures to nine digits: a mean that lies on its limit must not pass or fail by the order of a sum.
QC_SQL = """q AS (SELECT user_id AS run, round(avg(value) / 500, 9) AS overlap, count(*) * 4 AS n_eff,
  round(abs(avg(CASE WHEN event_id % 2 = 0 THEN value END) - avg(CASE WHEN event_id % 2 = 1 THEN value END)) / 5, 9) AS half_diff,
  CASE WHEN count(*) > 60 THEN round(stddev_samp(value) / 25, 9) END AS rep_diff FROM events GROUP BY 1)"""


@query(
    "f07_qc_gate",
    f"""WITH {QC_SQL}, f AS (SELECT run, list_filter([CASE WHEN coalesce(overlap > 0.10, false) THEN NULL ELSE 'overlap' END,
      CASE WHEN coalesce(n_eff >= 200, false) THEN NULL ELSE 'n_eff' END, CASE WHEN coalesce(half_diff < 2, false) THEN NULL ELSE 'halves' END,
      CASE WHEN coalesce(rep_diff <= 2, false) THEN NULL ELSE 'replicates' END], lambda x: x IS NOT NULL) AS failed FROM q)
    SELECT run, array_to_string(failed, ',') AS failed, len(failed) = 0 AS passed FROM f""",
)
def qc_gate(t):
    """Measures are rounded to nine digits, so that a run on a limit is judged by its values, not by the order of their sum."""
    parity = F.col("event_id") % 2
    halves = F.abs(F.avg(F.when(parity == 0, F.col("value"))) - F.avg(F.when(parity == 1, F.col("value")))) / 5
    measures = t.events.groupBy(F.col("user_id").alias("run")).agg(
        F.round(F.avg("value") / 500, 9).alias("overlap"),
        (F.count("*") * 4).alias("n_eff"),
        F.round(halves, 9).alias("half_diff"),
        F.when(F.count("*") > 60, F.round(F.stddev_samp("value") / 25, 9)).alias("rep_diff"),
    )
    return gates.qc_gate(measures).select("run", F.array_join("failed", ",").alias("failed"), "passed")


@query(
    "f08_stage_ready",
    """SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
    GROUP BY 1""",
)
def stage_ready(t):
    stages = t.orders.select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.when(F.col("o_orderstatus") == "F", "npt_completed").otherwise("nvt_running").alias("stage"),
    )
    runs = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return gates.stage_ready(runs, stages, "l_orderkey")


@query(
    "f09_metric_gate",
    f"""WITH m AS (SELECT d.source, avg(l.quality) AS roc_auc, 1 - avg(l.toxic) AS pr_auc, avg(l.toxic) * 3 AS mae
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1)
    SELECT source, {r6('roc_auc')} AS roc_auc, {r6('pr_auc')} AS pr_auc, {r6('mae')} AS mae,
      roc_auc >= 0.85 AND pr_auc >= 0.80 AND mae <= 0.5 AS passed FROM m""",
)
def metric_gate(t):
    metrics = (
        t.documents.select("doc_id", "source").join(t.labels, "doc_id").groupBy("source").agg(
            F.avg("quality").alias("roc_auc"), (1 - F.avg("toxic")).alias("pr_auc"), (F.avg("toxic") * 3).alias("mae")
        )
    )
    gated = gates.metric_gate(metrics)
    return gated.select("source", *[round6(c).alias(c) for c in ("roc_auc", "pr_auc", "mae")], "passed")
