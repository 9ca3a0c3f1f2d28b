"""System layout (Y)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hemolens.functions import scalars
from hemolens.operators import layout
from hemolens.plans.binding import r6, round6
from hemolens.plans.catalog import query


def systems(t):
    return t.part.select(
        F.col("p_partkey").alias("system"), F.col("p_brand").alias("peptide_id"), F.col("p_size").alias("n"),
        F.lit(10.0).alias("lx"), (F.lit(8.0) + F.col("p_size") % 5).alias("ly"), F.lit("low").alias("label"),
        (F.col("p_partkey") % 3 + 1).alias("replicate"), F.lit("random").alias("orientation"),
    )


@query(
    "y01_grid_positions",
    f"""WITH s AS (SELECT p_partkey AS system, p_size AS n, 10.0::DOUBLE AS lx, 8.0::DOUBLE + p_size % 5 AS ly,
      CASE WHEN p_size IN (12, 16) THEN 4 ELSE CAST(ceil(sqrt(p_size)) AS INTEGER) END AS g, unnest(range(p_size)) AS k FROM part)
    SELECT system, CAST(k AS INTEGER) AS k,
      {r6('''CASE n WHEN 1 THEN lx / 2 WHEN 8 THEN [2.5, 5.0, 7.5, 3.5, 6.5, 2.5, 5.0, 7.5][k + 1] WHEN 12 THEN 2.0 + 2 * (k % 4)
        WHEN 16 THEN 1.5 + (k % 4) * 7.0 / 3 ELSE 1.5 + (k % g) * (greatest(1.6, lx - 1.5) - 1.5) / (g - 1) END::DOUBLE''')} AS x,
      {r6('''CASE n WHEN 1 THEN ly / 2 WHEN 8 THEN [2.5, 2.5, 2.5, 5.0, 5.0, 7.5, 7.5, 7.5][k + 1] WHEN 12 THEN 2.0 + 2 * (k // 4)
        WHEN 16 THEN 1.5 + (k // 4) * 7.0 / 3 ELSE 1.5 + (k // g) * (greatest(1.6, ly - 1.5) - 1.5) / (g - 1) END::DOUBLE''')} AS y
    FROM s""",
)
def grid_positions(t):
    placed = layout.grid_positions(systems(t))
    return placed.select("system", "k", round6("x").alias("x"), round6("y").alias("y"))


@query("y02_poisson_positions")
def poisson_positions(t):
    """Dart throwing with the seed of each system; numpy's generator has no SQL form."""
    seed = scalars.placement_seed(F.col("peptide_id"), F.col("n"), F.col("label"), F.col("replicate"))
    placed = layout.poisson_positions(systems(t).select("system", "n", "lx", "ly", "orientation", seed.alias("seed")))
    return placed.select("system", "k", "tilt", "fallback", round6("x").alias("x"), round6("y").alias("y"))


@query("p14_system_tilt")
def system_tilt(t):
    """Tilt of every system on its grid: named, or the first choice of the system's generator."""
    named = F.when(F.col("system") % 4 == 0, "parallel").when(F.col("system") % 4 == 1, "tilt45").otherwise("random")
    placed = layout.with_placement(systems(t).withColumn("orientation", named), "peptide_id", "n", "label", "replicate", "orientation")
    return placed.select("system", "seed", "orientation", "tilt")


@query(
    "y03_occupancy_counts",
    """WITH e AS (SELECT event_id, CASE WHEN event_type = 'click' THEN 'low' WHEN event_type = 'view' THEN 'medium' ELSE 'high' END AS level,
      CASE WHEN event_type = 'error' THEN user_id ELSE 0 END AS o, event_id % 3 + 1 AS reps FROM events)
    SELECT event_id, CASE WHEN o > 0 THEN o ELSE CASE level WHEN 'low' THEN 8 WHEN 'medium' THEN 12 ELSE 16 END END AS n_peptides,
      (CASE WHEN o > 0 THEN 'n' || o ELSE level END) || CASE WHEN reps > 1 THEN '_rep' || reps ELSE '' END AS tag FROM e""",
)
def occupancy_counts(t):
    rows = t.events.select(
        "event_id",
        F.when(F.col("event_type") == "click", "low").when(F.col("event_type") == "view", "medium").otherwise("high").alias("level"),
        F.when(F.col("event_type") == "error", F.col("user_id")).otherwise(0).alias("override"),
        (F.col("event_id") % 3 + 1).alias("reps"),
    )
    level, override, reps = F.col("level"), F.col("override"), F.col("reps")
    return rows.select(
        "event_id",
        scalars.occupancy_count(level, override).alias("n_peptides"),
        scalars.replicate_tag(scalars.occupancy_label(level, override), reps, reps).alias("tag"),
    )


@query(
    "y04_system_molecules",
    """SELECT l_orderkey AS file, l_linenumber AS line_no, l_returnflag AS molecule, l_quantity AS n, false AS is_peptide FROM lineitem
    UNION ALL SELECT l_orderkey, 0, 'PEP', count(*)::DOUBLE, true FROM lineitem GROUP BY 1""",
)
def system_molecules(t):
    comp = t.lineitem.select(
        F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line_no"), F.col("l_returnflag").alias("molecule"),
        F.col("l_quantity").alias("n"),
    )
    counts = comp.groupBy("file").agg(F.lit("PEP").alias("molecule"), F.count("*").cast("double").alias("n"))
    return layout.system_molecules(comp, counts)
