"""Joins (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hemolens.operators import counting, joins, layout, neighbours
from hemolens.plans.binding import (
    ATOMS_SQL, BEADS_SQL, LETTERS_SQL, PEPTIDES_SQL, REPLICATES_SQL, letters, r6, round6,
)
from hemolens.plans.catalog import query


@query(
    "j01_join_labels",
    """SELECT d.doc_id AS amp_id, d.source AS tag_x, 'q' || l.quality AS tag_y, l.toxic FROM documents d
    JOIN labels l ON d.doc_id = l.doc_id""",
)
def join_labels(t):
    features = t.documents.select(F.col("doc_id").alias("amp_id"), F.col("source").alias("tag"))
    marked = F.concat(F.lit("q"), F.col("quality").cast("string"))
    labels = t.labels.select(F.col("doc_id").alias("amp_id"), marked.alias("tag"), "toxic")
    return joins.join_labels(features, labels).select("amp_id", "tag_x", "tag_y", "toxic")


@query(
    "j02_fuse_features",
    f"""SELECT l.l_partkey AS peptide_id, {r6('sum(l_extendedprice)')} AS md_total, p.p_size AS seq_length, p.p_brand AS name
    FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey AND p.p_size < 40 GROUP BY ALL""",
)
def fuse_features(t):
    md = t.lineitem.groupBy(F.col("l_partkey").alias("peptide_id")).agg(round6(F.sum("l_extendedprice")).alias("md_total"))
    seq = t.part.filter("p_size < 40").select(
        F.col("p_partkey").alias("peptide_id"), F.col("p_size").alias("seq_length"), F.col("p_brand").alias("name")
    )
    return joins.fuse_features(md, seq)


@query(
    "j03_expand_design",
    """SELECT c_custkey AS peptide_id, r AS run, o AS occupancy, p AS replicate, w AS window_id FROM customer,
      (SELECT unnest([1, 2]) AS r), (SELECT unnest(['low', 'medium', 'high']) AS o), (SELECT unnest([1, 2, 3]) AS p),
      (SELECT unnest([0, 1]) AS w)""",
)
def expand_design(t):
    peptides = t.customer.select(F.col("c_custkey").alias("peptide_id"))
    return joins.expand_design(peptides, (1, 2), ("low", "medium", "high"), (1, 2, 3), (0, 1))


@query(
    "j04_restrict_cohort",
    "SELECT doc_id AS peptide_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def restrict_cohort(t):
    cohort = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("peptide_id"))
    return joins.restrict_cohort(t.documents.select(F.col("doc_id").alias("peptide_id"), "lang"), cohort)


@query(
    "j05_pending_work",
    """SELECT o_orderkey AS run, o_orderstatus AS status FROM orders
    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')""",
)
def pending_work(t):
    design = t.orders.select(F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("status"))
    done = t.lineitem.filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("run"))
    return joins.pending_work(design, done, ["run"])


FILES_SQL = """files AS (SELECT user_id AS run_name, 'pep_' || CASE WHEN event_type IN ('click', 'error') THEN 'unrelaxed' ELSE 'relaxed' END
  || '_rank_' || printf('%03d', event_id % 25 + 1) || '_model_' || (event_id % 7) || CASE WHEN event_type = 'error' THEN '.json' ELSE '.pdb' END AS file FROM events),
 best AS (SELECT user_id AS run_name, printf('%03d', min(event_id) % 25 + 1) AS rank FROM events GROUP BY 1)"""


@query(
    "j06_match_best_file",
    f"""WITH {FILES_SQL}, m AS (SELECT b.run_name, b.rank, min(f.file) AS best_file FROM best b LEFT JOIN files f
      ON f.run_name = b.run_name AND f.file LIKE '%.pdb' AND contains(f.file, 'unrelaxed') AND contains(f.file, 'rank_' || b.rank)
      GROUP BY ALL) SELECT run_name, rank, coalesce(best_file, 'rejected') AS best_file FROM m""",
)
def match_best_file(t):
    kind = F.when(F.col("event_type").isin("click", "error"), "unrelaxed").otherwise("relaxed")
    ending = F.when(F.col("event_type") == "error", ".json").otherwise(".pdb")
    rank = F.format_string("%03d", F.col("event_id") % 25 + 1)
    file = F.concat(F.lit("pep_"), kind, F.lit("_rank_"), rank, F.lit("_model_"), (F.col("event_id") % 7).cast("string"), ending)
    files = t.events.select(F.col("user_id").alias("run_name"), file.alias("file"))
    best = t.events.groupBy(F.col("user_id").alias("run_name")).agg(
        F.format_string("%03d", F.min("event_id") % 25 + 1).alias("rank")
    )
    none = joins.match_best_file(best, files, unmatched=True).withColumn("best_file", F.lit("rejected"))
    return joins.match_best_file(best, files).unionByName(none)


@query(
    "j07_place_atoms",
    f"""WITH {BEADS_SQL}, c AS (SELECT *, x - avg(x) OVER w AS cx, y - avg(y) OVER w AS cy, z - avg(z) OVER w AS cz FROM beads
      WINDOW w AS (PARTITION BY mol)),
    s AS (SELECT p_partkey AS mol, p_size AS n, radians(p_size % 3 * 45) AS a, CASE WHEN p_size IN (12, 16) THEN 4 ELSE CAST(ceil(sqrt(p_size)) AS INTEGER) END AS g FROM part),
    pos AS (SELECT mol, a, k,
      CASE n WHEN 1 THEN 5.0 WHEN 8 THEN [2.5, 5.0, 7.5, 3.5, 6.5, 2.5, 5.0, 7.5][k + 1] WHEN 12 THEN 2.0 + 2 * (k % 4) ELSE 1.5 + (k % g) * 7.0 / (g - 1) END::DOUBLE AS px,
      CASE n WHEN 1 THEN 5.0 WHEN 8 THEN [2.5, 2.5, 2.5, 5.0, 5.0, 7.5, 7.5, 7.5][k + 1] WHEN 12 THEN 2.0 + 2 * (k // 4) ELSE 1.5 + (k // g) * 7.0 / (g - 1) END::DOUBLE AS py
      FROM (SELECT *, unnest(range(n)) AS k FROM s)),
    placed AS (SELECT mol, k, bead, cx + px AS x, cy * cos(a) - cz * sin(a) + py AS y, cy * sin(a) + cz * cos(a) + 11.5 AS z FROM c JOIN pos USING (mol))
    SELECT mol, CAST(k AS INTEGER) AS k, count(*) AS n, {r6('sum(x)')} AS sx, {r6('sum(y * bead)')} AS sy, {r6('sum(z * bead)')} AS sz FROM placed GROUP BY 1, 2""",
)
def place_atoms(t):
    """Each chain is the template of one system; the system's size comes from the part of the same key."""
    systems = t.part.select(
        F.col("p_partkey").alias("mol"), F.col("p_size").alias("n"), F.lit(10.0).alias("lx"), F.lit(10.0).alias("ly"),
        (F.col("p_size") % 3 * 45).alias("tilt"),
    )
    positions = layout.grid_positions(systems).select("mol", "k", F.col("x").alias("px"), F.col("y").alias("py"), "tilt")
    template = t.beads()
    tilts = systems.select("mol", "tilt")
    placed = joins.place_atoms(template.join(tilts.hint("merge"), "mol"), positions.drop("tilt"), "tilt", 8.5, 3.0, "mol")
    bead = F.col("bead")
    return placed.groupBy("mol", "k").agg(
        F.count("*").alias("n"), round6(F.sum("x")).alias("sx"),
        round6(F.sum(F.col("y") * bead)).alias("sy"), round6(F.sum(F.col("z") * bead)).alias("sz"),
    )


@query(
    "j08_contacts",
    f"""WITH {ATOMS_SQL} SELECT a.atom_id AS a_id, b.atom_id AS b_id,
      {r6('sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))')} AS dist
    FROM atoms a JOIN atoms b ON a.molecule = 0 AND b.molecule <> 0
      AND sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) <= 0.02""",
)
def contacts(t):
    """Beads of the peptides with label 0 against all others."""
    atoms = t.atoms()
    pairs = neighbours.contacts(atoms.filter("molecule = 0"), atoms.filter("molecule <> 0"), 0.02)
    return pairs.select("a_id", "b_id", round6("dist").alias("dist"))


def _pbc(a, length):
    return f"((a.{a}-b.{a}) - {length} * round_even((a.{a}-b.{a}) / {length}, 0))"


@query(
    "j08_contacts_periodic",
    f"""WITH {BEADS_SQL}, a AS (SELECT mol * 100 + bead AS id, mol % 5 AS frame, run, x, y, z FROM beads),
    p AS (SELECT a.frame, a.id AS a_id, b.id AS b_id, sqrt({_pbc('x', 0.7)}*{_pbc('x', 0.7)} + {_pbc('y', 0.7)}*{_pbc('y', 0.7)} + {_pbc('z', 0.7)}*{_pbc('z', 0.7)}) AS d
      FROM a JOIN a b ON a.frame = b.frame AND a.run = 0 AND b.run <> 0)
    SELECT frame, a_id, count(*) AS n, {r6('min(d)')} AS nearest FROM p WHERE d <= 0.12 GROUP BY 1, 2""",
)
def contacts_periodic(t):
    """Minimum-image contacts per frame in a 0.7 nm box, counted per peptide bead."""
    beads = t.beads().select((F.col("mol") * 100 + F.col("bead")).alias("atom_id"), (F.col("mol") % 5).alias("frame"), "run", "x", "y", "z")
    found = counting.count_contacts(
        beads.filter("run = 0"), beads.filter("run <> 0"), 0.12, ["frame"], box=(0.7, 0.7, 0.7)
    )
    return found.withColumn("nearest", round6("nearest"))


WINDOWS_SQL = """w AS (SELECT user_id AS peptide_id, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS window_id, avg(value) AS m FROM events GROUP BY ALL)"""


@query(
    "j09_neighbor_windows",
    f"""WITH {WINDOWS_SQL} SELECT a.peptide_id, a.window_id, {r6('a.m')} AS m, {r6('b.m')} AS next_m FROM w a
    JOIN w b ON a.peptide_id = b.peptide_id AND b.window_id = a.window_id + 1""",
)
def neighbor_windows(t):
    day = F.expr("timestampdiff(DAY, timestamp_ntz'1970-01-01 00:00:00', ts)")
    per_day = t.events.groupBy(F.col("user_id").alias("peptide_id"), day.alias("window_id")).agg(round6(F.avg("value")).alias("m"))
    return joins.neighbor_windows(per_day, ["peptide_id"], "window_id", ["m"])


REP_MEANS_SQL = f"{REPLICATES_SQL}, rm AS (SELECT peptide_id, occupancy, replicate, avg(value) / 1000 AS value FROM replicates GROUP BY ALL)"


def replicate_means(t):
    return t.replicates().groupBy("peptide_id", "occupancy", "replicate").agg((F.avg("value") / 1000).alias("value"))


@query(
    "j10_replicate_pairs",
    f"""WITH {REP_MEANS_SQL} SELECT a.peptide_id, a.occupancy, a.replicate AS rep1, b.replicate AS rep2,
      {r6('abs(a.value - b.value)')} AS abs_diff, abs(a.value - b.value) <= 2 AS consistent FROM rm a JOIN rm b
    ON a.peptide_id = b.peptide_id AND a.occupancy = b.occupancy AND a.replicate < b.replicate""",
)
def replicate_pairs(t):
    pairs = joins.replicate_pairs(replicate_means(t), ["peptide_id", "occupancy"])
    return pairs.withColumn("abs_diff", round6("abs_diff"))


@query(
    "j11_holdout_disjoint",
    f"""WITH {PEPTIDES_SQL}, test AS (SELECT sequence FROM peptides WHERE peptide_id NOT IN (SELECT doc_id FROM labels)
      UNION ALL SELECT {LETTERS_SQL} FROM benchmark)
    SELECT peptide_id, sequence IN (SELECT sequence FROM test) AS leaked FROM peptides WHERE peptide_id IN (SELECT doc_id FROM labels)""",
)
def holdout_disjoint(t):
    """Labelled documents against the unlabelled ones and the benchmark."""
    peptides = t.peptides().select("peptide_id", "sequence")
    labelled = t.labels.select(F.col("doc_id").alias("peptide_id"))
    train = peptides.join(labelled, "peptide_id", "left_semi")
    test = peptides.join(labelled, "peptide_id", "left_anti").select("sequence").unionByName(
        t.benchmark.select(letters(F.col("text")).alias("sequence"))
    )
    return joins.flag_leaks(train, test).select("peptide_id", "leaked")


@query(
    "j12_spacing_violations",
    f"""WITH {ATOMS_SQL} SELECT a.atom_id AS a_id, b.atom_id AS b_id,
      {r6('sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))')} AS dist
    FROM atoms a JOIN atoms b ON a.molecule = b.molecule AND a.atom_id < b.atom_id
      AND sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) < 0.02""",
)
def spacing_violations(t):
    pairs = neighbours.spacing_violations(t.atoms(), 0.02, ["molecule"])
    return pairs.select("a_id", "b_id", round6("dist").alias("dist"))


@query(
    "j13_paired_conditions",
    f"""WITH {REPLICATES_SQL}, a AS (SELECT peptide_id, avg(value) AS v FROM replicates WHERE discount < 0.05 GROUP BY 1),
    b AS (SELECT peptide_id, avg(value) AS v FROM replicates WHERE discount >= 0.05 GROUP BY 1)
    SELECT a.peptide_id, {r6('a.v')} AS value_a, {r6('b.v')} AS value_b FROM a JOIN b ON a.peptide_id = b.peptide_id""",
)
def paired_conditions(t):
    """Two settings that part all rows: discounts below and from 0.05 on."""
    rows = t.replicates()
    mean = lambda c: rows.filter(c).groupBy("peptide_id").agg(round6(F.avg("value")).alias("value"))
    return joins.paired_conditions(mean("discount < 0.05"), mean("discount >= 0.05"))
