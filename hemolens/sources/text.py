"""Text sources. Each `scan_*` reads files; its `parse_*` works on any (file, text) table.

A `parse_*` works inside a text's row with array expressions and needs no shuffle; the `scan_*` of
sections, coordinates and logs read files of any size in byte ranges (`lines`).
"""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hemolens.functions import ordered
from hemolens.functions.scalars import whole_number
from hemolens.sources.lines import carried, frame_starts, framed, numbered_lines

LABEL_FIELDS = {"sequence": "string", "hc50_um": "double", "sequence_length": "int", "name": "string"}
LABEL_NAMES = ["peptide_id", *LABEL_FIELDS]
LABEL_SCHEMA = ", ".join(["peptide_id string", *[f"{n} {k}" for n, k in LABEL_FIELDS.items()]])


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(file, text), one row per file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")
    )


BLANKS = " \t\n\x0b\f\r"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def words(c: Column) -> Column:
    """Tokens between runs of blanks; plain character splits, no regular expression."""
    for blank in BLANKS[1:]:
        c = F.replace(c, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(c, " "), "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def scan_fasta(spark: SparkSession, path: str) -> DataFrame:
    """peptides(peptide_id, name, sequence, source_file); large files split between records.

    Fails if a file does not open with `>`.
    """
    records = spark.read.option("lineSep", "\n>").text(path).select(
        F.col("_metadata.file_path").alias("source_file"), "value"
    )
    opened = records.groupBy("source_file").agg(F.bool_or(F.col("value").startswith(">")).alias("ok"))
    bad = opened.filter(~F.col("ok")).agg(F.min("source_file").alias("bad")).scalar()
    lines = F.split(F.col("value"), "\r?\n")
    header = F.replace(lines[0], F.lit(">"), F.lit(""))
    cut = F.instr(header, "|")
    parsed = records.select(
        strip(F.when(cut > 0, F.substring(header, F.lit(1), cut - 1)).otherwise(header)).alias("peptide_id"),
        strip(F.when(cut > 0, F.substring(header, cut + 1, F.length(header)))).alias("name"),
        F.regexp_replace(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), ""), r"\s", "").alias(
            "sequence"
        ),
        F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("no FASTA header in "), bad)))
        .otherwise(F.col("source_file"))
        .cast("string")
        .alias("source_file"),
    )
    return parsed.filter(F.col("source_file").isNotNull())


def first_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, header): the first line of every file that has one."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"), "value",
    )
    return lines.groupBy("file").agg(F.min_by("value", F.struct("_block", "_line")).alias("header"))


def label_columns(header: str, ident: str | None = None) -> str:
    """Schema of a label file with this header line: `LABEL_FIELDS` by name, in any case and order.

    The id is the column named `ident`, or else the one column that is left over. Columns
    beyond those are read and dropped. Fails if a field is missing or the id is in doubt.
    """
    names = [n.strip().lower() for n in next(csv.reader([header.lstrip("\ufeff")]))]
    missing = [f for f in LABEL_FIELDS if names.count(f) != 1]
    if missing:
        raise ValueError(f"label header {header!r} must have {', '.join(missing)} once")
    others = [n for n in names if n not in LABEL_FIELDS]
    chosen = ident.lower() if ident else others[0] if len(others) == 1 else None
    if chosen is None or others.count(chosen) != 1:
        raise ValueError(f"label header {header!r} must have one id column besides {', '.join(LABEL_FIELDS)}, not {others}")
    kind = lambda i, n: f"`{n}` {LABEL_FIELDS[n]}" if n in LABEL_FIELDS else "peptide_id string" if n == chosen else f"`_other_{i}` string"
    return ", ".join(kind(i, n) for i, n in enumerate(names))


def scan_labels(spark: SparkSession, path: str, ident: str | None = None) -> DataFrame:
    """Label table (peptide_id, sequence, hc50_um, sequence_length, name), columns found by header name.

    Files may differ in the order and case of their headers and in the name of the id column
    (see `label_columns`); files with one header are one scan. Only distinct headers and, where
    there are several, file names reach the driver.
    """
    headers = first_lines(spark, path).groupBy("header").agg(F.count("*").alias("files")).collect()
    if not headers:
        return spark.createDataFrame([], LABEL_SCHEMA)
    read = lambda where, schema: spark.read.csv(where, header=True, schema=schema, quote='"', escape='"').select(*LABEL_NAMES)
    if len(headers) == 1:
        return read(path, label_columns(headers[0]["header"], ident))
    parts = []
    for row in headers:
        schema = label_columns(row["header"], ident)
        files = first_lines(spark, path).filter(F.col("header") == row["header"]).select("file").collect()
        parts.append(read([f["file"] for f in files], schema))
    return reduce(DataFrame.unionByName, parts)


def parse_score_records(df: DataFrame) -> DataFrame:
    """Score files named `.._scores_rank_<rank>_<model>.json` with a `plddt` list in the body."""
    parts = F.split(base_name(F.col("file")), "_")
    at = F.array_position(parts, "rank").cast("int")
    tail = F.slice(parts, at + 2, F.greatest(F.size(parts) - at - 1, F.lit(0)))
    model = F.replace(F.replace(F.array_join(tail, "_"), F.lit("_scores_"), F.lit("")), F.lit(".json"), F.lit(""))
    return df.filter(at > 0).select(
        *[c for c in df.columns if c not in ("file", "text")],
        "file",
        F.get(parts, at).alias("rank"),
        model.alias("model"),
        F.concat(F.lit("rank_"), F.get(parts, at), F.lit("_"), model).alias("score_key"),
        F.from_json("text", "plddt array<double>")["plddt"].alias("plddt"),
    )


def scan_score_json(spark: SparkSession, glob: str) -> DataFrame:
    return parse_score_records(read_whole(spark, glob))


def _pairs(text: Column) -> Column:
    rows = F.filter(F.split(text, "\r?\n"), lambda x: x.rlike(r"^[^\s#:][^:]*:"))
    entries = F.transform(
        rows,
        lambda x: F.struct(
            strip(F.substring_index(x, ":", 1)).alias("k"),
            F.regexp_replace(strip(F.regexp_replace(x, "^[^:]*:", "")), "^['\"]|['\"]$", "").alias("v"),
        ),
    )
    return F.map_from_entries(entries)


def parse_flat_records(df: DataFrame) -> DataFrame:
    """`key: value` text -> `record map<string,string>`, one row per file."""
    return df.withColumn("record", _pairs(F.col("text"))).drop("text")


def parse_nested_map(df: DataFrame, key: str, out: str) -> DataFrame:
    """The indented block under `key:` as map<string,double>."""
    block = F.regexp_extract("text", rf"(?m)^{key}:[ \t]*\r?\n((?:[ \t]+\S.*(?:\r?\n|$))+)", 1)
    return df.withColumn(
        out, F.transform_values(_pairs(F.regexp_replace(block, r"(?m)^[ \t]+", "")), lambda _, v: v.try_cast("double"))
    )


def scan_flat_records(spark: SparkSession, glob: str) -> DataFrame:
    return parse_flat_records(read_whole(spark, glob))


def parse_sections(df: DataFrame, section: str | None = None) -> DataFrame:
    """Topology text -> (file, section, line_no, tokens).

    `[ name ]` opens a section; blanks and `;` lines are skipped; lines before the first
    section belong to none and are left out. Line numbers count from 1.
    """
    pieces = F.split("text", r"(?m)^(?=[ \t]*\[)")
    starts = F.transform(
        pieces,
        lambda _, i: F.aggregate(
            F.slice(F.col("_p"), F.lit(1), i), F.lit(0), lambda acc, q: acc + F.size(F.split(q, "\n")) - 1
        ),
    )
    opened = (
        df.select("file", pieces.alias("_p"), "text")
        .select("file", F.explode(F.arrays_zip(F.col("_p").alias("p"), starts.alias("start"))).alias("s"))
        .select(
            "file",
            F.regexp_extract("s.p", r"^[ \t]*\[\s*([^\]]*?)\s*\]", 1).alias("section"),
            F.col("s.start").alias("start"),
            F.col("s.p").alias("p"),
        )
        .filter(F.col("p").rlike(r"^[ \t]*\[[^\]]*\]"))
    )
    if section is not None:
        opened = opened.filter(F.col("section") == section)
    return (
        opened.select("file", "section", "start", F.posexplode(F.split("p", "\n")).alias("pos", "line"))
        .filter((F.col("pos") > 0) & F.col("line").rlike(r"^\s*[^\s;]"))
        .select(
            "file",
            "section",
            (F.col("start") + F.col("pos") + 1).alias("line_no"),
            words(F.col("line")).alias("tokens"),
        )
    )


def scan_sections(spark: SparkSession, path: str, section: str | None = None) -> DataFrame:
    """`parse_sections` of files of any size, read in byte ranges; the open section is carried from range to range."""
    lines = numbered_lines(spark, path)
    head = F.regexp_extract("line", r"^\s*\[\s*([^\]]*?)\s*\]", 1)
    opens = F.col("line").rlike(r"^\s*\[[^\]]*\]")
    held = carried(lines, F.when(opens, head), "section").filter(F.col("section").isNotNull() & ~opens & F.col("line").rlike(r"^\s*[^\s;]"))
    if section is not None:
        held = held.filter(F.col("section") == section)
    return held.select("file", "section", F.col("line_no").cast("int").alias("line_no"), words(F.col("line")).alias("tokens"))


def molecule_counts(sections: DataFrame) -> DataFrame:
    """(file, line_no, molecule, n) from parsed `molecules` lines; lines without a count are skipped."""
    n = whole_number(F.get("tokens", F.lit(1)), "long")
    return sections.select("file", "line_no", F.col("tokens")[0].alias("molecule"), n.alias("n")).filter("n IS NOT NULL")


def _number(line: Column, start: int, width: int, kind: str = "double") -> Column:
    return F.trim(F.substring(line, start + 1, width)).try_cast(kind)


def _gro_fields(line: Column) -> list[Column]:
    return [
        _number(line, 0, 5, "int").alias("resid"),
        F.trim(F.substring(line, 6, 5)).alias("resname"),
        F.trim(F.substring(line, 11, 5)).alias("atom"),
        _number(line, 15, 5, "long").alias("atom_id"),
        _number(line, 20, 8).alias("x"),
        _number(line, 28, 8).alias("y"),
        _number(line, 36, 8).alias("z"),
    ]


def parse_gro(df: DataFrame) -> DataFrame:
    """Atoms of GRO texts with title, declared count and box; lines cut before the z field are skipped."""
    lines = F.split(F.regexp_replace("text", r"\n+$", ""), "\n")
    count = F.trim(F.col("_l")[1]).cast("int")
    box = words(F.element_at("_l", -1))
    return (
        df.select("file", lines.alias("_l"))
        .select(
            "file",
            F.col("_l")[0].alias("title"),
            count.alias("n_atoms"),
            F.named_struct(
                *[x for i, n in enumerate(("lx", "ly", "lz")) for x in (F.lit(n), box[i].cast("double"))]
            ).alias("box"),
            F.slice("_l", F.lit(3), count).alias("_l"),
        )
        .select("file", "title", "n_atoms", "box", F.explode("_l").alias("line"))
        .filter(F.length("line") >= 44)
        .select("file", "title", "n_atoms", "box", *_gro_fields(F.col("line")))
    )


def scan_gro(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of every frame of coordinate files of any size: `parse_gro` with `frame` from 0.

    Files are read in byte ranges. Titles and boxes are one row a frame, joined to its
    atoms; a last frame that is cut short has its atoms and no box.
    """
    lines = numbered_lines(spark, path)
    parts = framed(lines, frame_starts(lines))
    bare = F.regexp_replace("line", "\r$", "")
    box = words(bare)
    heads = parts.filter((F.col("offset") == 0) | (F.col("offset") == F.col("n") + 2)).groupBy("file", "frame").agg(
        F.max(F.when(F.col("offset") == 0, bare)).alias("title"),
        F.max(F.when(F.col("offset") > 0, F.struct(*[F.get(box, F.lit(i)).try_cast("double").alias(b) for i, b in enumerate(("lx", "ly", "lz"))]))).alias("box"),
    )
    atoms = parts.filter((F.col("offset") > 1) & (F.col("offset") < F.col("n") + 2) & (F.length(bare) >= 44))
    return atoms.join(heads, ["file", "frame"]).select(
        "file", "frame", "title", F.col("n").cast("int").alias("n_atoms"), "box", *_gro_fields(F.col("line"))
    )


def parse_pdb(df: DataFrame) -> DataFrame:
    """ATOM/HETATM records with coordinates in nm and the B-factor column."""
    line = F.col("line")
    return (
        df.select("file", F.explode(F.split("text", "\r?\n")).alias("line"))
        .filter(line.startswith("ATOM") | line.startswith("HETATM"))
        .select(
            "file",
            _number(line, 6, 5, "long").alias("atom_id"),
            F.trim(F.substring(line, 13, 4)).alias("atom"),
            F.trim(F.substring(line, 18, 3)).alias("resname"),
            _number(line, 22, 4, "int").alias("resid"),
            *[(_number(line, 30 + 8 * i, 8) / 10.0).alias(a) for i, a in enumerate("xyz")],
            _number(line, 60, 6).alias("b_factor"),
        )
    )


def scan_pdb(spark: SparkSession, path: str) -> DataFrame:
    """Line by line, so a large file splits."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return parse_pdb(lines)


def parse_ca_plddt(df: DataFrame) -> DataFrame:
    """Per structure: B-factors of its CA atoms in file order, and their mean; done inside the row."""
    hits = F.filter(
        F.split("text", "\r?\n"),
        lambda x: (x.startswith("ATOM") | x.startswith("HETATM")) & (F.trim(F.substring(x, 13, 4)) == "CA"),
    )
    scores = F.transform(hits, lambda x: F.trim(F.substring(x, 61, 6)).cast("double"))
    total = F.aggregate("scores", F.lit(0.0), lambda a, v: a + v)
    return df.select("file", scores.alias("scores")).withColumn(
        "mean_plddt", F.try_divide(total, F.size("scores").cast("double"))
    )


def scan_ca_plddt(spark: SparkSession, path: str) -> DataFrame:
    return parse_ca_plddt(read_whole(spark, path))


def parse_log_after(df: DataFrame, marker: str, offset: int = 2) -> DataFrame:
    """Line `offset` after the last marker whose line is neither empty nor a `;` comment."""
    lines = F.split("text", "\n")
    target = lambda i: strip(F.get(F.col("_l"), i + offset))
    hits = F.filter(
        F.sequence(F.lit(0), F.size("_l") - 1),
        lambda i: F.contains(F.get(F.col("_l"), i), F.lit(marker))
        & F.coalesce((target(i) != "") & ~target(i).startswith(";"), F.lit(False)),
    )
    return (
        df.select("file", lines.alias("_l"))
        .select("file", "_l", F.explode(F.slice(hits, -1, 1)).alias("_i"))
        .select("file", (F.col("_i") + offset + 1).alias("line_no"), target(F.col("_i")).alias("value"))
    )


def scan_log_after(spark: SparkSession, glob: str, marker: str, offset: int = 2) -> DataFrame:
    """`parse_log_after` of logs of any size, read in byte ranges: marker lines meet the lines they point to by number."""
    lines = numbered_lines(spark, glob)
    points = lines.filter(F.contains("line", F.lit(marker))).select("file", (F.col("line_no") + offset).alias("line_no"))
    value = strip(F.col("line"))
    hits = lines.join(points, ["file", "line_no"]).select("file", F.col("line_no").cast("int").alias("line_no"), value.alias("value"))
    valid = hits.filter((F.col("value") != "") & ~F.col("value").startswith(";"))
    return valid.groupBy("file").agg(F.max(F.struct("line_no", "value")).alias("_last")).select("file", "_last.line_no", "_last.value")


def gro_line(resid: Column, resname: Column, atom: Column, atom_id: Column, x: Column, y: Column, z: Column) -> Column:
    """One fixed-width GRO atom line."""
    return F.format_string(
        "%5d%s%s%5d%8.3f%8.3f%8.3f", resid, F.rpad(resname, 5, " "), F.lpad(atom, 5, " "), atom_id, x, y, z
    )


def format_fixed_lines(atoms: DataFrame, out: str = "line") -> DataFrame:
    return atoms.withColumn(out, gro_line(*[F.col(c) for c in ("resid", "resname", "atom", "atom_id", "x", "y", "z")]))


def manifest_rows(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, size, sha256) of binary or text content."""
    body = F.col(content).cast("binary")
    return df.withColumns({"size": F.octet_length(body).cast("long"), "sha256": F.sha2(body, 256)}).drop(content)


LEAF = 64 << 20


def _digests(ranges: DataFrame, schema: str) -> DataFrame:
    """Add `digest`, the SHA-256 of each (path, start, length) byte range, read in pieces where the file system is Arrow's."""

    def run(batches):
        import hashlib

        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            found = []
            for path, start, length in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "length"))):
                where, name = fs.FileSystem.from_uri(path)
                digest, left = hashlib.sha256(), length
                with where.open_input_file(name) as f:
                    f.seek(start)
                    while left > 0 and (piece := f.read(min(left, 1 << 20))):
                        digest.update(piece)
                        left -= len(piece)
                if left > 0:
                    raise OSError(f"{path} ended {left} bytes early")
                found.append(digest.digest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, "digest"])

    return ranges.mapInArrow(run, f"{schema}, digest binary")


def build_manifest(spark: SparkSession, path: str, leaf: int | None = LEAF) -> DataFrame:
    """(path, size, mtime, sha256) of every file below `path`; no file is held in a row.

    `sha256` is the root of a digest tree: the SHA-256 of the digests of the file's byte ranges of `leaf`
    bytes, one after the other, so that ranges of one file are read by different tasks. Empty files are
    not listed, as Spark's file sources pass them over. With `leaf=None` it is the plain SHA-256, streamed by one task a file.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")
    )
    if leaf is None:
        whole = files.select("path", "size", "mtime", F.lit(0).cast("long").alias("start"), F.col("size").alias("length"))
        one = _digests(ordered.spread(whole, "path"), "path string, size long, mtime timestamp, start long, length long")
        return one.select("path", "size", "mtime", F.lower(F.hex("digest")).alias("sha256"))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / leaf)))
    ranges = files.select("path", "size", starts.alias("_k"))
    ranges = ranges.select("path", (F.col("_k") * leaf).alias("start"), F.least(F.lit(leaf).cast("long"), F.col("size") - F.col("_k") * leaf).alias("length"))
    leaves = _digests(ordered.spread(ranges, "path", "start"), "path string, start long, length long")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "digest"))), lambda x: F.hex(x["digest"])), "")
    roots = leaves.groupBy("path").agg(F.sha2(F.unhex(joined), 256).alias("_root"))  # one digest a range
    return files.join(roots, "path").select("path", "size", "mtime", F.col("_root").alias("sha256"))
