"""Trajectory features (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hemolens.operators import trajectory as traj
from hemolens.plans.binding import ATOMS_SQL, BEADS_SQL, EPOCH, r6, round6
from hemolens.plans.catalog import query

DAYS_SQL = f"f AS (SELECT user_id AS run, date_diff('microsecond', TIMESTAMP '{EPOCH}', ts) // 86400000000 AS frame, event_type AS bead, value / 25 AS z FROM events)"


def day_frames(t):
    """Events as one frame per run and day; value/25 as z."""
    day = F.floor(F.col("t_us") / 86400000000).cast("long")
    return t.frames().select("run", day.alias("frame"), "bead", (F.col("value") / 25).alias("z"))


@query(
    "g01_insertion_depth",
    f"""WITH {DAYS_SQL}, d AS (SELECT run, frame, avg(CASE WHEN bead = 'click' THEN z END) - avg(CASE WHEN bead <> 'click' THEN z END) AS d FROM f GROUP BY 1, 2)
    SELECT run, frame, {r6('d')} AS depth, d > 2 AS deep FROM d""",
)
def insertion_depth(t):
    out = traj.insertion_depth(day_frames(t), ["run", "frame"], F.col("bead") == "click", F.col("bead") != "click")
    return out.withColumn("depth", round6("depth"))


@query(
    "g02_tilt_angle",
    f"""WITH {BEADS_SQL}, e AS (SELECT a.run, a.mol, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM beads a JOIN beads b
      ON a.mol = b.mol AND a.bead = 0 AND b.bead = 20)
    SELECT run, mol, {r6('degrees(acos(dz / sqrt(dx*dx + dy*dy + dz*dz)))')} AS tilt_deg FROM e""",
)
def tilt_angle(t):
    return traj.tilt_angle(t.beads(), ["run", "mol"]).withColumn("tilt_deg", round6("tilt_deg"))


@query(
    "g03_lipid_contacts",
    f"""WITH {BEADS_SQL}, b AS (SELECT *, mol * 100 + bead AS id, mol % 4 AS frame FROM beads)
    SELECT p.frame, l.run AS kind, count(*) AS contacts FROM b p JOIN b l ON p.frame = l.frame AND p.run = 0 AND l.run <> 0
      AND sqrt((p.x-l.x)*(p.x-l.x) + (p.y-l.y)*(p.y-l.y) + (p.z-l.z)*(p.z-l.z)) <= 0.08 GROUP BY 1, 2""",
)
def lipid_contacts(t):
    """Chains of label 0 as peptides, all others as lipid types."""
    beads = t.beads().select(
        (F.col("mol") * 100 + F.col("bead")).alias("atom_id"), (F.col("mol") % 4).alias("frame"), F.col("run").alias("kind"), "x", "y", "z"
    )
    return traj.lipid_contacts(beads.filter("kind = 0"), beads.filter("kind <> 0"), ["frame"], "kind", 0.08)


@query(
    "g04_peptide_clusters",
    f"""WITH RECURSIVE {BEADS_SQL}, c AS (SELECT run, mol, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM beads GROUP BY 1, 2),
    e AS (SELECT a.run, a.mol AS src, b.mol AS dst FROM c a JOIN c b ON a.run = b.run AND a.mol <> b.mol
      AND sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) <= 0.028),
    core AS (SELECT run, src AS mol FROM e GROUP BY 1, 2 HAVING count(*) + 1 >= 3),
    ce AS (SELECT e.* FROM e JOIN core a ON a.run = e.run AND a.mol = e.src JOIN core b ON b.run = e.run AND b.mol = e.dst),
    reach AS (SELECT run, mol AS src, mol AS dst FROM core UNION SELECT r.run, r.src, ce.dst FROM reach r JOIN ce ON r.run = ce.run AND r.dst = ce.src),
    lab AS (SELECT run, src AS mol, min(dst) AS label FROM reach GROUP BY 1, 2),
    bor AS (SELECT e.run, e.src AS mol, min(l.label) AS label FROM e JOIN lab l ON l.run = e.run AND l.mol = e.dst GROUP BY 1, 2),
    m AS (SELECT c.run, c.mol, coalesce(lab.label, bor.label) AS cluster FROM c LEFT JOIN lab USING (run, mol) LEFT JOIN bor USING (run, mol)),
    s AS (SELECT run, cluster, count(*) AS size FROM m GROUP BY 1, 2)
    SELECT run, count(cluster) AS n_clusters, max(CASE WHEN cluster IS NOT NULL THEN size END) AS max_size,
      {r6('avg(CASE WHEN cluster IS NOT NULL THEN size END)')} AS mean_size, coalesce(sum(CASE WHEN cluster IS NULL THEN size END), 0)::BIGINT AS noise FROM s GROUP BY 1""",
)
def peptide_clusters(t):
    coms = traj.center_of_mass(t.beads(), ["run", "mol"])
    out = traj.peptide_clusters(coms, ["run"], 0.028, 3)
    return out.withColumn("mean_size", round6("mean_size"))


@query(
    "g05_cluster_stability",
    f"""WITH {DAYS_SQL}, p AS (SELECT DISTINCT run, bead, frame FROM f)
    SELECT a.run, a.bead, count(*) AS frames, {r6('count(b.run) / count(*)::DOUBLE')} AS stay_share FROM p a LEFT JOIN p b
      ON a.run = b.run AND a.bead = b.bead AND b.frame = a.frame + 1 GROUP BY 1, 2""",
)
def cluster_stability(t):
    pairs = day_frames(t).select("run", "bead", "frame").distinct()
    return traj.cluster_stability(pairs, ["run", "bead"]).withColumn("stay_share", round6("stay_share"))


THICK_SQL = f"""{ATOMS_SQL}, cells AS (SELECT molecule, floor(x / 0.1) AS cx, floor(y / 0.1) AS cy,
  avg(CASE WHEN z > 0 THEN z END) - avg(CASE WHEN NOT z > 0 THEN z END) AS th FROM atoms GROUP BY ALL)"""


@query(
    "g06_membrane_thickness",
    f"""WITH {ATOMS_SQL} SELECT molecule, {r6('avg(CASE WHEN z > 0 THEN z END) - avg(CASE WHEN NOT z > 0 THEN z END)')} AS thickness
    FROM atoms GROUP BY 1""",
)
def membrane_thickness(t):
    out = traj.membrane_thickness(t.atoms(), ["molecule"], F.col("z") > 0)
    return out.withColumn("thickness", round6("thickness"))


@query(
    "g06_thickness_contrast",
    f"""WITH {THICK_SQL}, p AS (SELECT molecule, avg(x) AS px, avg(y) AS py FROM atoms GROUP BY 1),
    j AS (SELECT c.molecule, th, (pow((cx + 0.5) * 0.1 - px, 2) + pow((cy + 0.5) * 0.1 - py, 2)) <= 0.15 * 0.15 AS near
      FROM cells c JOIN p ON c.molecule = p.molecule WHERE th IS NOT NULL)
    SELECT molecule, {r6('avg(CASE WHEN near THEN th END)')} AS local, {r6('avg(CASE WHEN NOT near THEN th END)')} AS far,
      {r6('avg(CASE WHEN near THEN th END) - avg(CASE WHEN NOT near THEN th END)')} AS delta FROM j GROUP BY 1""",
)
def thickness_contrast(t):
    cells = traj.thickness_map(t.atoms(), ["molecule"], F.col("z") > 0, 0.1)
    peptide = traj.center_of_mass(t.atoms(), ["molecule"])
    out = traj.thickness_contrast(cells, peptide, ["molecule"], 0.1, 0.15)
    return out.withColumns({c: round6(c) for c in ("local", "far", "delta")})


@query(
    "g07_midplane_water",
    f"""WITH {DAYS_SQL}, m AS (SELECT run, frame, avg(z) AS mid FROM f WHERE bead <> 'view' GROUP BY 1, 2)
    SELECT f.run, f.frame, count(*) FILTER (WHERE bead = 'view' AND abs(z - mid) <= 1) AS waters FROM f
      JOIN m ON f.run = m.run AND f.frame = m.frame GROUP BY 1, 2""",
)
def midplane_water(t):
    return traj.midplane_water(day_frames(t), ["run", "frame"], F.col("bead") == "view", F.col("bead") != "view", 1.0)


@query(
    "g08_tail_order",
    f"""WITH {BEADS_SQL}, s AS (SELECT run, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy, lead(z) OVER w - z AS dz FROM beads
      WINDOW w AS (PARTITION BY mol ORDER BY bead))
    SELECT run, {r6('avg((3 * dz*dz / (dx*dx + dy*dy + dz*dz) - 1) / 2)')} AS order_parameter FROM s GROUP BY 1""",
)
def tail_order(t):
    return traj.tail_order(t.beads(), ["run"]).withColumn("order_parameter", round6("order_parameter"))


@query(
    "g09_density_defects",
    f"""WITH {ATOMS_SQL}, g AS (SELECT molecule, cx, cy FROM (SELECT DISTINCT molecule FROM atoms), (SELECT unnest(range(10)) AS cx), (SELECT unnest(range(10)) AS cy))
    SELECT molecule, CAST(cx AS INTEGER) AS cx, CAST(cy AS INTEGER) AS cy FROM g
    WHERE (molecule, cx, cy) NOT IN (SELECT molecule, CAST(floor((x + 0.5) / 0.1) AS BIGINT), CAST(floor((y + 0.5) / 0.1) AS BIGINT) FROM atoms)""",
)
def density_defects(t):
    return traj.density_defects(t.atoms(), ["molecule"], 0.1, (-0.5, -0.5), (0.5, 0.5))


@query(
    "g10_thickness_gate",
    f"""WITH {DAYS_SQL}, th AS (SELECT run, frame, avg(CASE WHEN bead IN ('click','view') THEN z END) - avg(CASE WHEN bead NOT IN ('click','view') THEN z END) AS t
      FROM f GROUP BY 1, 2) SELECT run, frame, {r6('t')} AS thickness FROM th WHERE t BETWEEN 0.5 AND 1.5""",
)
def thickness_gate(t):
    upper = F.col("bead").isin("click", "view")
    thick = traj.membrane_thickness(day_frames(t), ["run", "frame"], upper)
    return traj.thickness_gate(thick, 0.5, 1.5).withColumn("thickness", round6("thickness"))
