"""Window functions, sorts, top-k (W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hemolens.operators import windows
from hemolens.plans.binding import ATOMS_SQL, FRAMES_SQL, PREDICTIONS_SQL, REPLICATES_SQL, r6, round6
from hemolens.plans.catalog import query

MODELS_SQL = "models AS (SELECT source AS run_name, doc_id AS rank, lang AS model, n_chars % 97 AS mean_plddt FROM documents)"


def models(t):
    return t.documents.select(
        F.col("source").alias("run_name"), F.col("doc_id").alias("rank"), F.col("lang").alias("model"),
        (F.col("n_chars") % 97).alias("mean_plddt"),
    )


@query(
    "w01_select_best_model",
    f"""WITH {MODELS_SQL} SELECT * FROM models QUALIFY row_number() OVER (PARTITION BY run_name ORDER BY mean_plddt DESC, rank, model) = 1""",
)
def select_best_model(t):
    return windows.select_best_model(models(t))


@query(
    "w02_top_models",
    f"""WITH {MODELS_SQL} SELECT *, CAST(row_number() OVER (PARTITION BY run_name ORDER BY mean_plddt DESC, rank, model) AS INTEGER) AS place
    FROM models QUALIFY place <= 5""",
)
def top_models(t):
    return windows.top_models(models(t), 5)


@query(
    "w03_carry_section",
    f"""WITH {FRAMES_SQL} SELECT event_id, run, last_value(CASE WHEN value > 100 THEN bead END IGNORE NULLS) OVER (
      PARTITION BY run ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM frames""",
)
def carry_section(t):
    """A value above 100 opens a section named by its bead."""
    rows = t.frames().select("event_id", "run", "t_us", F.when(F.col("value") > 100, F.col("bead")).alias("header"))
    return windows.carry_section(rows, ["run"], ["t_us", "event_id"], "header").select("event_id", "run", "section")


@query(
    "w04_renumber_atoms",
    f"""WITH {ATOMS_SQL} SELECT molecule, atom_id, row_number() OVER (PARTITION BY molecule ORDER BY atom_id % 2, atom_id) AS new_id FROM atoms""",
)
def renumber_atoms(t):
    rows = t.atoms().select("molecule", "atom_id", (F.col("atom_id") % 2).alias("kind"))
    return windows.renumber_atoms(rows, "molecule", "kind", "atom_id").select("molecule", "atom_id", "new_id")


@query(
    "w05_flip_flops",
    f"""WITH {FRAMES_SQL}, s AS (SELECT run, bead, t_us, event_id, sign(value - 50) AS side FROM frames WHERE value <> 50),
    l AS (SELECT *, lag(side) OVER (PARTITION BY run, bead ORDER BY t_us, event_id) AS prev FROM s)
    SELECT run, bead, count(*) FILTER (WHERE prev IS NOT NULL AND prev <> side) AS flips, count(*) AS frames FROM l GROUP BY 1, 2""",
)
def flip_flops(t):
    return windows.flip_flops(t.frames(), ["run", "bead"], ["t_us", "event_id"], F.col("value") - 50)


@query(
    "w06_average_rank",
    f"""WITH {REPLICATES_SQL}, r AS (SELECT occupancy, peptide_id, se, rank() OVER (PARTITION BY occupancy ORDER BY se)
      + (count(*) OVER (PARTITION BY occupancy, se) - 1) / 2.0 AS avg_rank FROM replicates)
    SELECT occupancy, peptide_id, se, avg_rank::DOUBLE AS avg_rank, count(*) AS n FROM r GROUP BY ALL""",
)
def average_rank(t):
    ranked = windows.average_rank(t.replicates().select("occupancy", "peptide_id", "se"), "se", ["occupancy"])
    return ranked.groupBy("occupancy", "peptide_id", "se", "avg_rank").agg(F.count("*").alias("n"))


@query(
    "w07_top_features",
    "SELECT p_partkey AS feature, p_retailprice AS importance FROM part ORDER BY importance DESC, feature LIMIT 20",
)
def top_features(t):
    return windows.top_features(t.part.select(F.col("p_partkey").alias("feature"), F.col("p_retailprice").alias("importance")))


@query("w08_sorted_ids", "SELECT regexp_replace(c_name, '0$', '') AS ident FROM customer ORDER BY 1")
def sorted_ids(t):
    return windows.sorted_ids(t.customer, "c_name", "0")


COUNTS_SQL = f"""{PREDICTIONS_SQL},
  at_score AS (SELECT p AS score, sum(y) AS pos, sum(1 - y) AS neg FROM predictions GROUP BY 1),
  cum AS (SELECT score, pos::BIGINT AS pos, neg::BIGINT AS neg, (sum(pos) OVER w)::BIGINT AS tp, (sum(neg) OVER w)::BIGINT AS fp,
    (sum(pos) OVER ())::BIGINT AS n_pos, (sum(neg) OVER ())::BIGINT AS n_neg FROM at_score
    WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("w09_cumulative_counts", f"WITH {COUNTS_SQL} SELECT {r6('score')} AS score, pos, neg, tp, fp, n_pos, n_neg FROM cum")
def cumulative_counts(t):
    return windows.cumulative_counts(t.predictions()).withColumn("score", round6("score"))


@query(
    "w10_uncertain_topk",
    f"""WITH {PREDICTIONS_SQL}, u AS (SELECT peptide_id, round(abs(p - 0.5), 12) AS uncertainty FROM predictions),
    r AS (SELECT *, percent_rank() OVER (ORDER BY uncertainty) AS pr FROM u)
    SELECT peptide_id, {r6('uncertainty')} AS uncertainty FROM r WHERE pr <= 0.1""",
)
def uncertain_topk(t):
    return windows.uncertain_topk(t.predictions()).select("peptide_id", round6("uncertainty").alias("uncertainty"))
