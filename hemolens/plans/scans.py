"""Sources and sinks (S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hemolens.plans.binding import BEADS_SQL, LETTERS_SQL, PEPTIDES_SQL, REPLICATES_SQL, r6, round6
from hemolens.plans.catalog import query
from hemolens.session import scratch_path
from hemolens.sources import tables, text

WRAP = 60


@query(
    "s01_scan_fasta",
    f"""WITH {PEPTIDES_SQL}
    SELECT CAST(peptide_id AS VARCHAR) AS peptide_id, name, CAST(length(sequence) AS INTEGER) AS n, md5(sequence) AS seq_md5
    FROM peptides""",
)
def scan_fasta(t):
    """Write FASTA with wrapped sequence lines, read it back."""
    path = scratch_path(t.spark, "fasta")
    body = F.regexp_replace("sequence", f"(.{{{WRAP}}})", "$1\n")
    t.peptides().select(
        F.concat(F.lit(">"), F.col("peptide_id").cast("string"), F.lit("|"), "name", F.lit("\n"), body)
    ).write.text(path)
    return text.scan_fasta(t.spark, path).select(
        "peptide_id", "name", F.length("sequence").alias("n"), F.md5("sequence").alias("seq_md5")
    )


@query(
    "s02_scan_labels",
    f"""SELECT CAST(d.doc_id AS VARCHAR) AS peptide_id, CAST(l.quality + l.toxic * 99.5 AS DOUBLE) AS hc50_um,
      CAST(length({LETTERS_SQL}) AS INTEGER) AS sequence_length, d.source || ', "' || d.lang || '", x' AS name
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
def scan_labels(t):
    """Write a label CSV whose names hold commas and quotes, read it back."""
    path = scratch_path(t.spark, "labels")
    joined = t.peptides().join(t.labels, F.col("peptide_id") == F.col("doc_id"))
    joined.select(
        F.col("peptide_id").cast("string").alias("SOURCE_ID"),
        F.col("sequence").alias("SEQUENCE"),
        (F.col("quality") + F.col("toxic") * 99.5).alias("HC50_uM"),
        F.length("sequence").alias("sequence_length"),
        F.concat("name", F.lit(', "'), "lang", F.lit('", x')).alias("NAME"),
    ).write.option("escape", '"').csv(path, header=True)
    return text.scan_labels(t.spark, path).select("peptide_id", "hc50_um", "sequence_length", "name")


@query(
    "s03_scan_score_json",
    """SELECT event_id, printf('%03d', event_id % 25 + 1) AS rank,
      event_type || '_model_' || (event_id % 5) AS model,
      'rank_' || printf('%03d', event_id % 25 + 1) || '_' || event_type || '_model_' || (event_id % 5) AS score_key,
      [CAST(props->>'$.k' AS DOUBLE), value] AS plddt
    FROM events""",
)
def scan_score_json(t):
    """Score files as (file, JSON text) rows: rank and model from the name, list from the body."""
    files = t.events.select(
        "event_id",
        F.format_string(
            "/runs/%d/pep_%d_scores_rank_%03d_%s_model_%d.json",
            "user_id",
            "user_id",
            F.col("event_id") % 25 + 1,
            "event_type",
            F.col("event_id") % 5,
        ).alias("file"),
        F.concat(
            F.lit('{"plddt": ['), F.get_json_object("props", "$.k"), F.lit(", "), F.col("value").cast("string"), F.lit("]}")
        ).alias("text"),
    )
    return text.parse_score_records(files).select("event_id", "rank", "model", "score_key", "plddt")


@query(
    "s04_scan_flat_records",
    """SELECT p_partkey AS file, lower(p_name) AS run_name, p_brand AS config_version, p_size AS run_number,
      CAST(TIMESTAMP '2024-01-01 00:00:00' + to_days(p_size) AS DATE)::VARCHAR AS created FROM part""",
)
def scan_flat_records(t):
    """`key: value` records, with a quoted ISO stamp and a comment line."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size"))
    record = F.concat(
        F.lit("run_name: "), F.lower("p_name"), F.lit("\n# comment: no\nconfig_version: "), "p_brand",
        F.lit("\nrun_number: "), F.col("p_size").cast("string"),
        F.lit("\ncreated: '"), day.cast("string"), F.lit("T00:00:00'\n"),
    )
    parsed = text.parse_flat_records(t.part.select(F.col("p_partkey").alias("file"), record.alias("text")))
    return parsed.select(
        "file",
        F.col("record")["run_name"].alias("run_name"),
        F.col("record")["config_version"].alias("config_version"),
        F.col("record")["run_number"].cast("int").alias("run_number"),
        F.to_timestamp(F.col("record")["created"]).cast("date").cast("string").alias("created"),
    )


TOPOLOGY_SQL = """
  lines AS (
    SELECT file, i AS line_no, regexp_replace(arr[i], '^\\s+|\\s+$', '', 'g') AS line FROM (
      SELECT file, arr, unnest(range(1, len(arr) + 1)) AS i FROM (
        SELECT doc_id AS file, string_split('intro line' || chr(10) || '[ ' || source || ' ]' || chr(10) || '; note' || chr(10)
          || text || chr(10) || '[ ' || lang || ' ]' || chr(10) || replace(text, '. ', chr(10)), chr(10)) AS arr
        FROM documents))),
  marked AS (
    SELECT *, CASE WHEN regexp_matches(line, '^\\[[^\\]]*\\]') THEN
        regexp_extract(line, '^\\[\\s*([^\\]]*?)\\s*\\]', 1) END AS head FROM lines),
  filled AS (
    SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM marked)"""


@query(
    "s05_scan_sections",
    f"""WITH {TOPOLOGY_SQL}
    SELECT file, section, CAST(line_no AS INTEGER) AS line_no, regexp_split_to_array(line, '\\s+')[1] AS first_token,
      CAST(len(regexp_split_to_array(line, '\\s+')) AS INTEGER) AS n_tokens
    FROM filled WHERE head IS NULL AND section IS NOT NULL AND line <> '' AND line[1] <> ';'""",
)
def scan_sections(t):
    """Sectioned text from whole documents; parsed inside each row."""
    body = F.concat(
        F.lit("intro line\n[ "), "source", F.lit(" ]\n; note\n"), "text",
        F.lit("\n[ "), "lang", F.lit(" ]\n"), F.replace("text", F.lit(". "), F.lit("\n")),
    )
    parsed = text.parse_sections(t.documents.select(F.col("doc_id").alias("file"), body.alias("text")))
    return parsed.select(
        "file", "section", "line_no", F.col("tokens")[0].alias("first_token"), F.size("tokens").alias("n_tokens")
    )


BY_SOURCE_SQL = """byfile AS (SELECT source, string_split(string_agg('[ d' || doc_id || ' ]' || chr(10) || replace(coalesce(text, ''), '. ', chr(10)), chr(10) ORDER BY doc_id), chr(10)) AS arr
    FROM documents GROUP BY source),
  numbered AS (SELECT source, i AS line_no, regexp_replace(arr[i], '^\\s+|\\s+$', '', 'g') AS line FROM (SELECT source, arr, unnest(range(1, len(arr) + 1)) AS i FROM byfile))"""


def source_files(t, label: str) -> str:
    """One text file a source: its documents in order, each under a section of its own."""
    path, parts = scratch_path(t.spark, label), scratch_path(t.spark, f"{label}-parts")
    body = F.concat(F.lit("[ d"), F.col("doc_id").cast("string"), F.lit(" ]\n"), F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit("\n")))
    rows = t.documents.select("source", "doc_id", body.alias("body")).repartitionByRange("source", "doc_id").sortWithinPartitions("source", "doc_id")
    rows.select("source", "body").write.partitionBy("source").text(parts)
    tables.join_parts(t.spark, parts, path)
    return path


def folder_value(name: str):
    return F.regexp_extract("file", f"/{name}=([^/]*)/", 1)


@query(
    "s05_scan_sections_files",
    f"""WITH {BY_SOURCE_SQL},
    marked AS (SELECT *, CASE WHEN regexp_matches(line, '^\\[[^\\]]*\\]') THEN regexp_extract(line, '^\\[\\s*([^\\]]*?)\\s*\\]', 1) END AS head FROM numbered),
    filled AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY source ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM marked)
    SELECT source, section, CAST(line_no AS INTEGER) AS line_no, regexp_split_to_array(line, '\\s+')[1] AS first_token,
      CAST(len(regexp_split_to_array(line, '\\s+')) AS INTEGER) AS n_tokens
    FROM filled WHERE head IS NULL AND section IS NOT NULL AND line <> '' AND line[1] <> ';'""",
)
def scan_sections_files(t):
    """Write a file of sections for each source, read it back in byte ranges."""
    parsed = text.scan_sections(t.spark, source_files(t, "sections"))
    return parsed.select(folder_value("source").alias("source"), "section", "line_no", F.col("tokens")[0].alias("first_token"), F.size("tokens").alias("n_tokens"))


@query(
    "s08_scan_log_files",
    f"""WITH {BY_SOURCE_SQL},
    ahead AS (SELECT source, line_no, line, lead(line, 2) OVER (PARTITION BY source ORDER BY line_no) AS hit FROM numbered)
    SELECT source, CAST(max(line_no) + 2 AS INTEGER) AS line_no, arg_max(hit, line_no) AS value FROM ahead
    WHERE contains(line, 'en') AND hit <> '' AND hit[1] <> ';' GROUP BY source""",
)
def scan_log_files(t):
    """Write a log for each source, find what follows its last marker."""
    found = text.scan_log_after(t.spark, source_files(t, "logs"), "en")
    return found.select(folder_value("source").alias("source"), "line_no", "value")


@query(
    "s12_manifest_files",
    f"""WITH byfile AS (SELECT source, hex(encode(string_agg('[ d' || doc_id || ' ]' || chr(10) || replace(coalesce(text, ''), '. ', chr(10)), chr(10) ORDER BY doc_id) || chr(10))) AS h
      FROM documents GROUP BY source),
    leaves AS (SELECT source, i, sha256(unhex(substr(h, CAST(i * 20000 + 1 AS BIGINT), 20000))) AS leaf FROM (SELECT source, h, unnest(range((len(h) + 19999) // 20000)) AS i FROM byfile)),
    roots AS (SELECT source, sha256(unhex(string_agg(leaf, '' ORDER BY i))) AS sha256 FROM leaves GROUP BY 1)
    SELECT source, len(h) // 2 AS size, sha256 FROM byfile JOIN roots USING (source)""",
)
def manifest_files(t):
    """Write a file for each source; size and digest tree over ranges of 10,000 bytes."""
    listed = text.build_manifest(t.spark, source_files(t, "manifest"), leaf=10_000).filter(F.col("path").endswith(".txt"))
    return listed.select(F.regexp_extract("path", "/source=([^/]*)/", 1).alias("source"), "size", "sha256")


def gro_texts(t):
    """One GRO text per embedding, built inside its row."""
    e = F.col("embedding")

    def at(i, k):
        return F.get(e, i * 3 + k).cast("double")

    line = lambda i: text.gro_line(
        i + 1, F.lit("POPC"), F.concat(F.lit("B"), i.cast("string")), i + 1, at(i, 0), at(i, 1), at(i, 2)
    )
    lines = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(20)), line), "\n")
    whole = F.concat(
        F.lit("molecule "), F.col("label").cast("string"), F.lit("\n   21\n"), lines, F.lit("\n  10.000  10.000  14.000\n")
    )
    return t.embeddings.select(F.col("vec_id").alias("file"), whole.alias("text"))


@query(
    "s06_scan_gro",
    f"""WITH {BEADS_SQL}
    SELECT mol AS file, 'molecule ' || run AS title, 21 AS n_atoms, bead + 1 AS resid, 'POPC' AS resname,
      'B' || bead AS atom, CAST(bead + 1 AS BIGINT) AS atom_id, {r6("round(x, 3)")} AS x, {r6("round(y, 3)")} AS y,
      {r6("round(z, 3)")} AS z, 14.0::DOUBLE AS lz FROM beads""",
)
def scan_gro(t):
    """Fixed-width structures rendered and parsed back."""
    return text.parse_gro(gro_texts(t)).select(
        "file", "title", "n_atoms", "resid", "resname", "atom", "atom_id",
        *[round6(F.col(a)).alias(a) for a in "xyz"], F.col("box.lz").alias("lz"),
    )


@query(
    "s06_scan_gro_frames",
    f"""WITH {BEADS_SQL}, f AS (SELECT vec_id AS mol, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS frame FROM embeddings)
    SELECT CAST(run AS VARCHAR) AS run, frame, 'molecule ' || run AS title, 21 AS n_atoms, bead + 1 AS resid, 'B' || bead AS atom,
      {r6("round(x, 3)")} AS x, {r6("round(y, 3)")} AS y, {r6("round(z, 3)")} AS z, 14.0::DOUBLE AS lz FROM beads JOIN f USING (mol)""",
)
def scan_gro_frames(t):
    """Write one trajectory a label, a frame for each of its vectors, and read it back in byte ranges."""
    path = scratch_path(t.spark, "frames")
    texts = gro_texts(t).join(t.embeddings.select(F.col("vec_id").alias("file"), F.col("label").alias("run")), "file")
    body = F.regexp_replace("text", "\n$", "").alias("body")
    texts.repartition("run").sortWithinPartitions("run", "file").select("run", body).write.partitionBy("run").text(path)
    return text.scan_gro(t.spark, path).select(
        folder_value("run").alias("run"), "frame", "title", "n_atoms", "resid", "atom",
        *[round6(F.col(a)).alias(a) for a in "xyz"], F.col("box.lz").alias("lz"),
    )


def pdb_texts(t):
    """One PDB text per embedding: CA and N alternate, B-factor from the first coordinate."""
    e = F.col("embedding")

    def at(i, k):
        return F.get(e, i * 3 + k).cast("double")

    line = lambda i: F.format_string(
        "ATOM  %5d  %-3s %3s A%4d    %8.3f%8.3f%8.3f%6.2f%6.2f",
        i + 1, F.when(i % 2 == 0, "CA").otherwise("N"), F.lit("ALA"), i + 1,
        at(i, 0) * 10, at(i, 1) * 10, at(i, 2) * 10, F.lit(1.0), F.abs(at(i, 0)) * 100 + 50,
    )
    lines = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(20)), line), "\n")
    return t.embeddings.select(F.col("vec_id").alias("file"), F.concat(F.lit("HEADER\n"), lines, F.lit("\nEND\n")).alias("text"))


@query(
    "s06_scan_pdb",
    f"""WITH {BEADS_SQL}
    SELECT mol AS file, CAST(bead + 1 AS BIGINT) AS atom_id, CASE WHEN bead % 2 = 0 THEN 'CA' ELSE 'N' END AS atom,
      'ALA' AS resname, bead + 1 AS resid, {r6("round(x * 10, 3) / 10")} AS x, {r6("round(y * 10, 3) / 10")} AS y,
      {r6("round(z * 10, 3) / 10")} AS z FROM beads""",
)
def scan_pdb(t):
    """PDB records rendered and parsed back, Angstrom to nm."""
    return text.parse_pdb(pdb_texts(t)).select(
        "file", "atom_id", "atom", "resname", "resid", *[round6(F.col(a)).alias(a) for a in "xyz"]
    )


@query(
    "s07_scan_ca_plddt",
    f"""WITH {BEADS_SQL}
    SELECT mol AS file, CAST(count(*) AS INTEGER) AS n_ca, list(round(abs(x) * 100 + 50, 2) ORDER BY bead) AS scores,
      {r6("avg(round(abs(x) * 100 + 50, 2))")} AS mean_plddt
    FROM beads WHERE bead % 2 = 0 GROUP BY mol""",
)
def scan_ca_plddt(t):
    """Per-structure CA scores and their mean."""
    return text.parse_ca_plddt(pdb_texts(t)).select(
        "file", F.size("scores").alias("n_ca"), "scores", round6("mean_plddt").alias("mean_plddt")
    )


@query(
    "s08_scan_log_after",
    """WITH lines AS (
      SELECT file, i AS line_no, arr[i] AS line FROM (
        SELECT file, arr, unnest(range(1, len(arr) + 1)) AS i FROM (
          SELECT doc_id AS file, string_split(replace(text, '. ', chr(10)), chr(10)) AS arr FROM documents))),
    ahead AS (
      SELECT file, line_no, line, regexp_replace(lead(line, 2) OVER (PARTITION BY file ORDER BY line_no),
        '^\\s+|\\s+$', '', 'g') AS hit FROM lines)
    SELECT file, CAST(max(line_no) + 2 AS INTEGER) AS line_no, arg_max(hit, line_no) AS value FROM ahead
    WHERE contains(line, 'en') AND hit <> '' AND hit[1] <> ';' GROUP BY file""",
)
def scan_log_after(t):
    """Line two after the last marker, whole texts as logs."""
    logs = t.documents.select(F.col("doc_id").alias("file"), F.replace("text", F.lit(". "), F.lit("\n")).alias("text"))
    return text.parse_log_after(logs, "en")


@query(
    "s09_features_roundtrip",
    f"""WITH {REPLICATES_SQL}
    SELECT peptide_id, occupancy, replicate, count(*) AS n, {r6("sum(value)")} AS total FROM replicates
    WHERE occupancy = 'R' GROUP BY ALL""",
)
def features_roundtrip(t):
    """Write the partitioned feature layout, read one occupancy back (partition-pruned)."""
    path = scratch_path(t.spark, "features")
    tables.write_features(t.replicates().select("peptide_id", "occupancy", "replicate", "value"), path)
    back = tables.read_features(t.spark, path, F.col("occupancy") == "R")
    return back.groupBy("peptide_id", "occupancy", "replicate").agg(
        F.count("*").alias("n"), round6(F.sum("value")).alias("total")
    )


@query(
    "s10_report_tables",
    """SELECT CAST(doc_id AS VARCHAR) AS peptide_id, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS y
    FROM labels""",
)
def report_tables(t):
    """Predictions CSV, metrics JSON and the fixed-header table written; the CSV read back."""
    pred = t.labels.select(F.col("doc_id").alias("peptide_id"), "quality", F.col("toxic").alias("y"))
    metrics = pred.groupBy("y").count()
    zero = F.lit(0.0)
    pmf = tables.as_pmf_report(
        pred.select(
            "peptide_id", *[zero.alias(c) for c in ("dg_ads", "dg_ads_se", "dg_insert", "dg_insert_se", "dg_barrier",
                                                     "dg_barrier_se", "z_surf_min", "z_head_min", "hc50_um")]
        )
    )
    path = tables.write_report_tables(scratch_path(t.spark, "report"), pred, metrics, pmf)
    return t.spark.read.csv(f"{path}/predictions", header=True)


@query(
    "s11_format_fixed_lines",
    f"""WITH {BEADS_SQL}
    SELECT mol, bead, printf('%5d%s%s%5d%8.3f%8.3f%8.3f', bead + 1, 'POPC ', lpad('B' || bead, 5, ' '), bead + 1, x, y, z) AS line
    FROM beads""",
)
def format_fixed_lines(t):
    """Fixed-width atom lines."""
    named = t.beads().select(
        "mol", "bead", "x", "y", "z", (F.col("bead") + 1).alias("resid"), F.lit("POPC").alias("resname"),
        F.concat(F.lit("B"), F.col("bead").cast("string")).alias("atom"), (F.col("bead") + 1).alias("atom_id"),
    )
    return text.format_fixed_lines(named).select("mol", "bead", "line")


@query(
    "s12_manifest",
    "SELECT 'doc/' || doc_id AS path, octet_length(encode(text)) AS size, sha256(text) AS sha256 FROM documents",
)
def manifest(t):
    """Size and content hash of whole texts."""
    return text.manifest_rows(
        t.documents.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    )
