"""Projections and scalar functions (P)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from hemolens.functions import geometry, scalars, sequence
from hemolens.operators import aggregates
from hemolens.plans.binding import (
    ASSAYS_SQL, ATOMS_SQL, CANONICAL_SQL, PEPTIDES_SQL, REPLICATES_SQL, draw_sql, r6, round6,
)
from hemolens.plans.catalog import query


@query("p01_run_name", "SELECT c_custkey, lower(c_name) || '_run_' || c_nationkey AS run_name FROM customer")
def run_name(t):
    return t.customer.select("c_custkey", scalars.run_name(F.col("c_name"), F.col("c_nationkey")).alias("run_name"))


@query(
    "p02_parse_run_name",
    """SELECT c_custkey, TRY_CAST(string_split(c_name, '#')[-1] AS INTEGER) AS run_number,
      TRY_CAST(string_split(c_mktsegment, '_')[-1] AS INTEGER) AS no_number FROM customer""",
)
def parse_run_name(t):
    return t.customer.select(
        "c_custkey",
        scalars.parse_run_name(F.col("c_name"), "#").alias("run_number"),
        scalars.parse_run_name(F.col("c_mktsegment")).alias("no_number"),
    )


@query(
    "p03_log_hc50",
    f"WITH {ASSAYS_SQL} SELECT peptide_id, {r6('log10(hc50_um)')} AS log_hc50, {r6('-log10(hc50_um)')} AS p_hc50 FROM assays",
)
def log_hc50(t):
    log = scalars.log_hc50(F.col("hc50_um"))
    return t.assays().select("peptide_id", round6(log).alias("log_hc50"), round6(-log).alias("p_hc50"))


@query("p04_idp_flag", "SELECT event_id, value < 70 AS disordered FROM events")
def idp_flag(t):
    return t.events.select("event_id", scalars.idp_flag(F.col("value")).alias("disordered"))


@query("p05_is_toxic", f"WITH {ASSAYS_SQL} SELECT peptide_id, CAST(hc50_um <= 100 AS INTEGER) AS is_toxic FROM assays")
def is_toxic(t):
    return t.assays().select("peptide_id", scalars.is_toxic(F.col("hc50_um")).alias("is_toxic"))


BAND_SQL = "CASE WHEN hc50_um <= 50 THEN 'toxic' WHEN hc50_um >= 250 THEN 'nontoxic' ELSE 'borderline' END"


@query("p06_hc50_band", f"WITH {ASSAYS_SQL} SELECT peptide_id, {BAND_SQL} AS band FROM assays")
def hc50_band(t):
    return t.assays().select("peptide_id", scalars.hc50_band(F.col("hc50_um")).alias("band"))


@query("p07_flag_high_toxicity", f"WITH {ASSAYS_SQL} SELECT peptide_id, hc50_um < 10 AS high_toxicity FROM assays")
def flag_high_toxicity(t):
    return t.assays().select("peptide_id", scalars.flag_high_toxicity(F.col("hc50_um")).alias("high_toxicity"))


@query(
    "p08_rbc_critical",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, count(*) AS n FROM lineitem
    WHERE -l_quantity < -8 AND (l_tax * 100 - 6 <= -3 OR l_discount * 200 < 12) GROUP BY ALL""",
)
def rbc_critical(t):
    hit = scalars.rbc_critical(-F.col("l_quantity"), F.col("l_tax") * 100 - 6, F.col("l_discount") * 200)
    keys = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return t.lineitem.filter(hit).groupBy(*keys).agg(F.count("*").alias("n"))


@query(
    "p09_n_steps",
    f"""WITH {REPLICATES_SQL}
    SELECT CAST(trunc(value / (discount + 0.02)) AS BIGINT) AS steps, CAST(trunc(se * 1000 / (tax + 0.02)) AS BIGINT) AS steps_ns,
      count(*) AS n FROM replicates GROUP BY ALL""",
)
def n_steps(t):
    df = t.replicates().select(
        scalars.n_steps(F.col("value"), F.col("discount") + 0.02).alias("steps"),
        scalars.n_steps_ns(F.col("se"), F.col("tax") + 0.02).alias("steps_ns"),
    )
    return df.groupBy("steps", "steps_ns").agg(F.count("*").alias("n"))


def crc_sql(text: str) -> str:
    """The checksum bit by bit: each character is taken in, then shifted out in eight steps (single-byte characters)."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN o >= 0 THEN xor(c, o) ELSE xor(c >> 1, 3988292384 * (c & 1)) END"
    return f"(4294967295 - list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, o: {step}))"


@query(
    "p10_crc_seed",
    f"""SELECT doc_id, {crc_sql("source || '|8|' || lang || '|rep' || doc_id")} AS placement_seed,
      {crc_sql("source || '_rep' || doc_id || '_umbrella' || n_chars")} AS umbrella_seed FROM documents""",
)
def crc_seed(t):
    """Placement and umbrella seeds."""
    return t.documents.select(
        "doc_id",
        scalars.placement_seed(F.col("source"), F.lit(8), F.col("lang"), F.col("doc_id")).alias("placement_seed"),
        scalars.umbrella_seed(F.col("source"), F.col("doc_id"), F.col("n_chars")).alias("umbrella_seed"),
    )


@query(
    "p11_center",
    f"""WITH {ATOMS_SQL}
    SELECT atom_id, molecule, {r6('x - avg(x) OVER w')} AS x, {r6('y - avg(y) OVER w')} AS y, {r6('z - avg(z) OVER w')} AS z
    FROM atoms WINDOW w AS (PARTITION BY molecule)""",
)
def center(t):
    moved = geometry.center(t.atoms(), "molecule")
    return moved.select("atom_id", "molecule", *[round6(F.col(a)).alias(a) for a in "xyz"])


@query(
    "p12_rotate",
    f"""WITH {ATOMS_SQL}, a AS (SELECT *, radians(atom_id % 360) AS t FROM atoms)
    SELECT atom_id, 'x' AS axis, {r6('x')} AS x, {r6('y*cos(t) - z*sin(t)')} AS y, {r6('y*sin(t) + z*cos(t)')} AS z FROM a
    UNION ALL SELECT atom_id, 'y', {r6('x*cos(t) + z*sin(t)')}, {r6('y')}, {r6('-x*sin(t) + z*cos(t)')} FROM a
    UNION ALL SELECT atom_id, 'other', {r6('x*cos(t) - y*sin(t)')}, {r6('x*sin(t) + y*cos(t)')}, {r6('z')} FROM a""",
)
def rotate(t):
    angle = F.col("atom_id") % 360
    parts = [
        geometry.rotate(t.atoms(), angle, axis).select("atom_id", F.lit(axis).alias("axis"), "x", "y", "z")
        for axis in ("x", "y", "other")
    ]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.select("atom_id", "axis", *[round6(F.col(a)).alias(a) for a in "xyz"])


@query(
    "p13_translate",
    f"WITH {ATOMS_SQL} SELECT atom_id, {r6('x + 1.5')} AS x, {r6('y - 2.5')} AS y, {r6('z + molecule')} AS z FROM atoms",
)
def translate(t):
    moved = geometry.translate(t.atoms(), 1.5, -2.5, F.col("molecule"))
    return moved.select("atom_id", *[round6(F.col(a)).alias(a) for a in "xyz"])


@query(
    "p14_orientation_angle",
    f"""SELECT event_id, CASE event_type WHEN 'click' THEN 0.0 WHEN 'error' THEN 45.0 WHEN 'purchase' THEN 90.0
      ELSE {draw_sql("user_id || '|tilt'")} % 3 * 45.0 END::DOUBLE AS tilt FROM events""",
)
def orientation_angle(t):
    named = (
        F.when(F.col("event_type") == "click", "Parallel")
        .when(F.col("event_type") == "error", "tilt_45")
        .when(F.col("event_type") == "purchase", "orthogonal")
        .when(F.col("event_type") == "signup", "random")
    )
    return t.events.select("event_id", scalars.orientation_angle(named, F.col("user_id")).alias("tilt"))


@query(
    "p15_pct_composition",
    f"""WITH c AS (SELECT user_id AS file, event_type AS molecule, count(*) AS n FROM events GROUP BY ALL)
    SELECT file, molecule, n, CASE WHEN molecule NOT IN ('click', 'error') THEN
      {r6("100.0 * n / sum(CASE WHEN molecule NOT IN ('click','error') THEN n END) OVER (PARTITION BY file)")} END AS pct
    FROM c""",
)
def pct_composition(t):
    comp = t.events.groupBy(F.col("user_id").alias("file"), F.col("event_type").alias("molecule")).agg(F.count("*").alias("n"))
    return aggregates.pct_composition(comp, exclude=("click", "error")).select("file", "molecule", "n", round6("pct").alias("pct"))


FRACTIONS_SQL = ", ".join(
    r6(f"(length(sequence) - length(replace(sequence, '{r}', '')))::DOUBLE / nullif(length(sequence), 0)") + f" AS frac_{r}"
    for r in sequence.RESIDUES
)


@query(
    "p16_residue_composition",
    f"WITH {PEPTIDES_SQL} SELECT peptide_id, CAST(length(sequence) AS INTEGER) AS seq_length, {FRACTIONS_SQL} FROM peptides",
)
def residue_composition(t):
    seq = F.col("sequence")
    parts = [round6(c).alias(n) for n, c in sequence.residue_fractions(seq).items()]
    return t.peptides().select("peptide_id", sequence.seq_length(seq).alias("seq_length"), *parts)


def _weighted_counts(weights):
    return " + ".join(f"(length(sequence) - length(replace(sequence, '{r}', ''))) * ({w!r}::DOUBLE)" for r, w in weights.items())


@query(
    "p17_net_charge_ph",
    f"""WITH {CANONICAL_SQL} SELECT peptide_id, {r6('1.0::DOUBLE + ' + _weighted_counts(sequence.charge_factors(7.0)))} AS charge_ph7,
      {r6('1.0::DOUBLE + ' + _weighted_counts(sequence.charge_factors(5.5)))} AS charge_ph5 FROM canonical""",
)
def net_charge_ph(t):
    seq = F.col("sequence")
    return t.canonical().select(
        "peptide_id",
        round6(sequence.net_charge_ph(seq)).alias("charge_ph7"),
        round6(sequence.net_charge_ph(seq, 5.5)).alias("charge_ph5"),
    )


@query(
    "p18_gravy",
    f"WITH {CANONICAL_SQL} SELECT peptide_id, {r6('(' + _weighted_counts(sequence.KYTE_DOOLITTLE) + ') / length(sequence)')} AS gravy FROM canonical",
)
def gravy(t):
    return t.canonical().select("peptide_id", round6(sequence.gravy(F.col("sequence"))).alias("gravy"))


_SCALE_SQL = "[" + ", ".join(f"{sequence.EISENBERG[r]!r}::DOUBLE" for r in sequence.RESIDUES) + "]"
_STEP = repr(math.radians(100.0))


@query(
    "p19_hydrophobic_moment",
    f"""WITH {CANONICAL_SQL}, r AS (
      SELECT peptide_id, length(sequence) AS n, unnest(range(length(sequence))) AS i, unnest(string_split(sequence, '')) AS c FROM canonical),
    s AS (SELECT peptide_id, n, sum({_SCALE_SQL}[instr('{sequence.RESIDUES}', c)] * cos(i * {_STEP})) AS a,
      sum({_SCALE_SQL}[instr('{sequence.RESIDUES}', c)] * sin(i * {_STEP})) AS b FROM r GROUP BY peptide_id, n)
    SELECT peptide_id, {r6('sqrt(a*a + b*b) / n')} AS moment FROM s""",
)
def hydrophobic_moment(t):
    return t.canonical().select("peptide_id", round6(sequence.hydrophobic_moment(F.col("sequence"))).alias("moment"))


@query("p20_seq_hash", f"WITH {PEPTIDES_SQL} SELECT peptide_id, sha256(upper(trim(sequence))) AS seq_hash FROM peptides")
def seq_hash(t):
    return t.peptides().select("peptide_id", sequence.seq_hash(F.col("sequence")).alias("seq_hash"))


@query(
    "p21_canonical_residues",
    f"""WITH {PEPTIDES_SQL}
    SELECT peptide_id, regexp_matches(sequence, '^[{sequence.RESIDUES}]+$') AS is_canonical,
      md5(regexp_replace(translate(sequence, 'BZJ', 'NQL'), '[^{sequence.RESIDUES}]', '', 'g')) AS mapped_md5 FROM peptides""",
)
def canonical_residues(t):
    seq = F.col("sequence")
    return t.peptides().select(
        "peptide_id",
        sequence.is_canonical(seq).alias("is_canonical"),
        F.md5(sequence.map_residues(seq, {"B": "N", "Z": "Q", "J": "L"})).alias("mapped_md5"),
    )


@query(
    "p22_normalize_assay",
    f"""WITH {ASSAYS_SQL}, f AS (SELECT c_mktsegment AS seg, avg(c_acctbal) / 5000 AS factor FROM customer
      WHERE c_mktsegment <> 'BUILDING' GROUP BY 1)
    SELECT a.peptide_id, {r6('a.hc50_um * coalesce(f.factor, 1)')} AS hc50_norm FROM assays a
    LEFT JOIN customer c ON a.assay_id = c.c_custkey LEFT JOIN f ON c.c_mktsegment = f.seg""",
)
def normalize_assay(t):
    factors = (
        t.customer.filter("c_mktsegment <> 'BUILDING'")
        .groupBy(F.col("c_mktsegment").alias("segment"))
        .agg((F.avg("c_acctbal") / 5000).alias("factor"))
    )
    meta = t.customer.select(F.col("c_custkey").alias("assay_id"), F.col("c_mktsegment").alias("segment"))
    tagged = t.assays().join(meta, "assay_id", "left")
    normal = aggregates.normalize_assay(tagged, factors, "segment")
    return normal.select("peptide_id", round6("hc50_norm").alias("hc50_norm"))


@query(
    "p23_normalize_patch",
    f"""WITH {REPLICATES_SQL} SELECT peptide_id, replicate, occupancy, {r6('sum(value / nullif(se, 0))')} AS density
    FROM replicates GROUP BY ALL""",
)
def normalize_patch(t):
    density = scalars.normalize_patch(F.col("value"), F.col("se"))
    return t.replicates().groupBy("peptide_id", "replicate", "occupancy").agg(round6(F.sum(density)).alias("density"))
