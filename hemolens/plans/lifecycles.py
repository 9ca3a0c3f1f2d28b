"""The three whole flows: feature dataset, structure selection, free-energy study."""

from __future__ import annotations

from pyspark.sql import functions as F

from hemolens.functions import scalars, sequence
from hemolens.operators import aggregates, gates, joins, sets, windows
from hemolens.plans.binding import RESIDUES_SQL, r6, residues, round6
from hemolens.plans.catalog import query
from hemolens.sources import text


@query(
    "lifecycle_c_feature_dataset",
    f"""WITH f AS (SELECT doc_id AS amp_id, lang, {RESIDUES_SQL} AS sequence FROM documents WHERE lang = 'en'
      UNION ALL SELECT doc_id, lang, {RESIDUES_SQL} FROM documents WHERE lang <> 'en'),
    j AS (SELECT f.*, l.toxic, 150.0 - 100 * l.toxic + 0.001 * f.amp_id AS hc50_um FROM f JOIN labels l ON f.amp_id = l.doc_id)
    SELECT lang, CAST(hc50_um <= 100 AS INTEGER) AS is_toxic, count(*) AS n, {r6('avg(ln(1 + length(sequence)))')} AS mean_log_length,
      {r6("avg((length(sequence) - length(replace(sequence, 'K', '')))::DOUBLE / nullif(length(sequence), 0))")} AS mean_lysine
    FROM j GROUP BY 1, 2""",
)
def feature_dataset(t):
    """Sequence features of every source, concatenated, joined to labels, classed, summarised."""
    seq = F.col("sequence")
    features = t.documents.select(F.col("doc_id").alias("amp_id"), "lang", residues(F.col("text")).alias("sequence")).select(
        "amp_id", "lang", sequence.seq_length(seq).alias("seq_length"), sequence.residue_fraction(seq, "K").alias("frac_K")
    )
    all_features = sets.concat_features([features.filter("lang = 'en'"), features.filter("lang <> 'en'")])
    labels = t.labels.select(
        F.col("doc_id").alias("amp_id"), (150.0 - 100 * F.col("toxic") + 0.001 * F.col("doc_id")).alias("hc50_um")
    )
    dataset = joins.join_labels(all_features, labels).withColumn("is_toxic", scalars.is_toxic(F.col("hc50_um")))
    return dataset.groupBy("lang", "is_toxic").agg(
        F.count("*").alias("n"), round6(F.avg(F.log1p("seq_length"))).alias("mean_log_length"),
        round6(F.avg("frac_K")).alias("mean_lysine"),
    )


@query(
    "lifecycle_b_structure_selection",
    """WITH s AS (SELECT user_id AS run_name, printf('%03d', event_id % 25 + 1) AS rank, event_type || '_model_' || (event_id % 5) AS model,
      (value + CAST(props->>'$.k' AS DOUBLE)) / 2 AS mean_plddt FROM events),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY run_name ORDER BY mean_plddt DESC, rank, model) = 1),
    f AS (SELECT user_id AS run_name, 'pep_unrelaxed_rank_' || printf('%03d', event_id % 25 + 1) || '_' || event_type || '.pdb' AS file FROM events)
    SELECT b.run_name, b.rank, b.model, round(b.mean_plddt, 6) AS mean_plddt, min(f.file) AS best_file FROM b JOIN f
      ON b.run_name = f.run_name AND contains(f.file, 'rank_' || b.rank) WHERE b.mean_plddt >= 80 GROUP BY ALL""",
)
def structure_selection(t):
    """Score files -> mean per model -> best per run -> gate -> matching structure file."""
    rank = F.format_string("%03d", F.col("event_id") % 25 + 1)
    files = t.events.select(
        F.col("user_id").alias("run_name"),
        F.format_string(
            "/pep_scores_rank_%03d_%s_model_%d.json", F.col("event_id") % 25 + 1, F.col("event_type"), F.col("event_id") % 5
        ).alias("file"),
        F.concat(
            F.lit('{"plddt": ['), F.get_json_object("props", "$.k"), F.lit(", "), F.col("value").cast("string"), F.lit("]}")
        ).alias("text"),
    )
    scores = text.parse_score_records(files).withColumn("mean_plddt", aggregates.mean_plddt("plddt"))
    best = windows.select_best_model(scores.select("run_name", "rank", "model", "mean_plddt"))
    passed = gates.gate_plddt(best, 80.0, "mean_plddt")
    structures = t.events.select(
        F.col("user_id").alias("run_name"),
        F.concat(F.lit("pep_unrelaxed_rank_"), rank, F.lit("_"), "event_type", F.lit(".pdb")).alias("file"),
    )
    return joins.match_best_file(passed, structures).withColumn("mean_plddt", F.round("mean_plddt", 6))
