"""Aggregations (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hemolens.functions import scalars
from hemolens.operators import aggregates, gates
from hemolens.plans.binding import ASSAYS_SQL, ATOMS_SQL, PEPTIDES_SQL, REPLICATES_SQL, r6, round6
from hemolens.plans.catalog import query
from hemolens.plans.gates import NAMED_SQL, named_atoms
from hemolens.plans.projections import BAND_SQL


def rounded(df, *cols):
    return df.withColumns({c: round6(F.col(c)) for c in cols})


@query(
    "a01_mean_plddt",
    f"SELECT vec_id, {r6('CASE WHEN label = 3 THEN 0 ELSE list_sum(list_transform(embedding, lambda v: v::DOUBLE)) / len(embedding) END')} AS mean_plddt FROM embeddings",
)
def mean_plddt(t):
    """Label 3 stands for score files without values."""
    scores = F.when(F.col("label") != 3, F.col("embedding"))
    return t.embeddings.select("vec_id", round6(aggregates.mean_plddt(scores)).alias("mean_plddt"))


@query(
    "a02_sum_composition",
    "SELECT l_orderkey AS file, l_returnflag AS molecule, sum(l_quantity) AS n FROM lineitem GROUP BY 1, 2",
)
def sum_composition(t):
    comp = t.lineitem.select(F.col("l_orderkey").alias("file"), F.col("l_returnflag").alias("molecule"), F.col("l_quantity").alias("n"))
    return aggregates.sum_composition(comp)


@query(
    "a03_bounding_box",
    f"WITH {ATOMS_SQL} SELECT molecule, " + ", ".join(
        f"{r6(f'max({a}) - min({a})')} AS d{a}, {r6(f'avg({a})')} AS c{a}" for a in "xyz") + " FROM atoms GROUP BY 1",
)
def bounding_box(t):
    box = aggregates.bounding_box(t.atoms(), ["molecule"])
    return rounded(box, *[f"{p}{a}" for p in "dc" for a in "xyz"])


@query(
    "a04_membrane_top",
    f"""WITH {NAMED_SQL} SELECT molecule, {r6("coalesce(avg(CASE WHEN resname IN ('POPC','PSM') AND atom = 'PO4' AND z > 0.05 THEN z END), 8.5)")} AS top_z
    FROM named GROUP BY 1""",
)
def membrane_top(t):
    top = aggregates.membrane_top(named_atoms(t), ["molecule"], gates.is_head_bead(zmin=0.05))
    return rounded(top, "top_z")


@query(
    "a05_aggregate_replicates",
    f"WITH {REPLICATES_SQL} SELECT peptide_id, " + ", ".join(
        f"{r6(f'''avg(CASE WHEN occupancy = '{o}' THEN value END)''')} AS {o}_mean, {r6(f'''stddev_samp(CASE WHEN occupancy = '{o}' THEN value END)''')} AS {o}_sd"
        for o in "ANR") + " FROM replicates GROUP BY 1",
)
def aggregate_replicates(t):
    wide = aggregates.aggregate_replicates(t.replicates(), ("A", "N", "R"))
    return rounded(wide, *[c for c in wide.columns if c != "peptide_id"])


@query(
    "a06_ivw_pool",
    f"""WITH {REPLICATES_SQL} SELECT peptide_id, occupancy, {r6('sum(value / (se * se)) / sum(1 / (se * se))')} AS pooled,
      {r6('sqrt(1 / sum(1 / (se * se)))')} AS pooled_se FROM replicates WHERE se > 0 GROUP BY 1, 2""",
)
def ivw_pool(t):
    return rounded(aggregates.ivw_pool(t.replicates(), ["peptide_id", "occupancy"]), "pooled", "pooled_se")


@query(
    "a07_median_pool",
    f"WITH {REPLICATES_SQL} SELECT peptide_id, occupancy, {r6('median(value)')} AS median FROM replicates GROUP BY 1, 2",
)
def median_pool(t):
    return rounded(aggregates.median_pool(t.replicates(), ["peptide_id", "occupancy"]), "median")


@query(
    "a08_completeness",
    f"""SELECT {r6('count(d.doc_id) / count(*)::DOUBLE')} AS doc_id, {r6('count(d.lang) / count(*)::DOUBLE')} AS lang,
      {r6('count(l.toxic) / count(*)::DOUBLE')} AS toxic, {r6('count(l.quality) / count(*)::DOUBLE')} AS quality
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def completeness(t):
    joined = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left").select("doc_id", "lang", "toxic", "quality")
    done = aggregates.completeness(joined)
    return rounded(done, *done.columns)


@query(
    "a09_zscore_outliers",
    f"""WITH z AS (SELECT event_id, event_type, value, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS zscore FROM events
      WINDOW w AS (PARTITION BY event_type))
    SELECT event_id, event_type, value, {r6('zscore')} AS zscore FROM z WHERE abs(zscore) > 3""",
)
def zscore_outliers(t):
    rows = t.events.select("event_id", "event_type", "value")
    return rounded(aggregates.zscore_outliers(rows, ["event_type"]), "zscore")


@query(
    "a10_disparate_impact",
    f"""WITH r AS (SELECT d.lang, avg((l.toxic = 0)::INTEGER) AS rate FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1)
    SELECT {r6('min(rate) / max(rate)')} AS ratio, abs(1 - min(rate) / max(rate)) > 0.1 AS flagged FROM r""",
)
def disparate_impact(t):
    rows = t.documents.select("doc_id", "lang").join(t.labels, "doc_id")
    return rounded(aggregates.disparate_impact(rows, "lang", F.col("toxic") == 0), "ratio")


def _smd_sql(c):
    a, b = f"CASE WHEN band = 'toxic' THEN {c} END", f"CASE WHEN band = 'nontoxic' THEN {c} END"
    smd = f"(avg({a}) - avg({b})) / sqrt((var_samp({a}) + var_samp({b})) / 2)"
    return f"SELECT '{c}' AS covariate, {r6(smd)} AS smd, abs({smd}) <= 1 AS balanced FROM x"


@query(
    "a11_group_balance",
    f"WITH {ASSAYS_SQL}, x AS (SELECT *, {BAND_SQL} AS band FROM assays) " + " UNION ALL ".join(
        _smd_sql(c) for c in ("peptide_id", "assay_id", "hc50_um")),
)
def group_balance(t):
    banded = t.assays().withColumn("band", scalars.hc50_band(F.col("hc50_um")))
    out = aggregates.group_balance(banded, "band", "toxic", "nontoxic", ("peptide_id", "assay_id", "hc50_um"))
    return rounded(out, "smd")


@query(
    "a12_class_weights",
    f"""WITH c AS (SELECT toxic, count(*) AS n_class FROM labels GROUP BY 1)
    SELECT toxic, n_class, {r6('sum(n_class) OVER () / (count(*) OVER () * n_class)::DOUBLE')} AS weight FROM c""",
)
def class_weights(t):
    return rounded(aggregates.class_weights(t.labels, "toxic"), "weight")


@query(
    "a13_next_run_number",
    """SELECT l_suppkey AS peptide_id, l_returnflag AS occupancy,
      coalesce(max(CASE WHEN l_linenumber > 3 THEN l_linenumber END), 0) + 1 AS next_run FROM lineitem GROUP BY 1, 2""",
)
def next_run_number(t):
    """Names up to number 3 carry a suffix that is no number."""
    name = F.when(F.col("l_linenumber") > 3, F.concat(F.lit("p_run_"), F.col("l_linenumber").cast("string"))).otherwise("p_run_x")
    runs = t.lineitem.select(
        F.col("l_suppkey").alias("peptide_id"), F.col("l_returnflag").alias("occupancy"), scalars.parse_run_name(name).alias("number")
    )
    return aggregates.next_run_number(runs, ["peptide_id", "occupancy"], "number")


@query(
    "a14_peptide_lipid_ratio",
    f"""WITH s AS (SELECT l_suppkey AS file, sum(CASE WHEN l_returnflag <> 'N' THEN l_quantity ELSE 0 END) AS lipids FROM lineitem GROUP BY 1)
    SELECT file, level, n_peptides, lipids, {r6('lipids / n_peptides')} AS ratio FROM s,
      (VALUES ('low', 8), ('medium', 12), ('high', 16)) v(level, n_peptides)""",
)
def peptide_lipid_ratio(t):
    comp = t.lineitem.select(F.col("l_suppkey").alias("file"), F.col("l_returnflag").alias("molecule"), F.col("l_quantity").alias("n"))
    out = aggregates.peptide_lipid_ratio(comp, {"low": 8, "medium": 12, "high": 16}, exclude=("N",))
    return rounded(out, "ratio")


@query(
    "a15_status_counts",
    """SELECT o_custkey AS peptide_id, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'F') AS F,
      count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1""",
)
def status_counts(t):
    rows = t.orders.select(F.col("o_custkey").alias("peptide_id"), F.col("o_orderstatus").alias("status"))
    return aggregates.status_counts(rows, "peptide_id", ("O", "F", "P"))


@query(
    "a16_dedupe_sequences",
    f"""WITH {PEPTIDES_SQL} SELECT min(peptide_id) AS peptide_id, count(*) AS copies,
      array_to_string(list_sort(list(DISTINCT name)), ',') AS sources, sha256(sequence) AS seq_hash FROM peptides GROUP BY sequence""",
)
def dedupe_sequences(t):
    rows = t.peptides().select("peptide_id", "sequence", F.col("name").alias("source"))
    out = aggregates.dedupe_sequences(rows)
    return out.select("peptide_id", "copies", F.array_join("sources", ",").alias("sources"), "seq_hash")


@query(
    "a17_fold_stability",
    f"""WITH {REPLICATES_SQL}, m AS (SELECT occupancy, replicate AS fold, avg(value) AS metric FROM replicates GROUP BY 1, 2)
    SELECT occupancy, {r6('avg(metric)')} AS mean, {r6('stddev_samp(metric)')} AS sd, {r6('stddev_samp(metric) / avg(metric)')} AS cv FROM m GROUP BY 1""",
)
def fold_stability(t):
    folds = t.replicates().groupBy("occupancy", F.col("replicate").alias("fold")).agg(F.avg("value").alias("metric"))
    return rounded(aggregates.fold_stability(folds, ["occupancy"], "metric"), "mean", "sd", "cv")
