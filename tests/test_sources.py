import pytest
from pyspark.sql import functions as F

from hemolens.sources import tables, text


def write(path, body):
    path.write_text(body)
    return str(path)


def test_fasta_records_and_header_rule(spark, tmp_path):
    write(tmp_path / "a.fasta", ">PEP_1|Dermaseptin S4 (1-16)[M4K]\nALWKTLLK\nKVLKAAAK\n>PEP_2\nGIGK\n")
    rows = {r.peptide_id: r for r in text.scan_fasta(spark, str(tmp_path)).collect()}
    assert rows["PEP_1"].sequence == "ALWKTLLKKVLKAAAK" and rows["PEP_1"].name == "Dermaseptin S4 (1-16)[M4K]"
    assert rows["PEP_2"].sequence == "GIGK" and rows["PEP_2"].name is None
    bad = tmp_path / "bad"
    bad.mkdir()
    write(bad / "b.fasta", "PEP_3\nAAA\n>PEP_4\nCCC\n")
    with pytest.raises(Exception, match="no FASTA header"):
        text.scan_fasta(spark, str(bad)).collect()


def test_labels_quoted_commas(spark, tmp_path):
    path = write(
        tmp_path / "l.csv",
        'ID,SEQUENCE,HC50_uM,sequence_length,NAME\nPEP_8,RVKRV,0.62,5,"Cathelicidin-1, CATH-1, Fowlicidin-1"\n',
    )
    row = text.scan_labels(spark, path).first()
    assert row.name == "Cathelicidin-1, CATH-1, Fowlicidin-1" and row.hc50_um == 0.62


def test_score_json_files(spark, tmp_path):
    write(tmp_path / "pep_scores_rank_001_alphafold2_ptm_model_3_seed_000.json", '{"plddt": [80.0, 90.0]}')
    write(tmp_path / "pep_scores_rank_002_alphafold2_ptm_model_1_seed_000.json", '{"max_pae": 3}')
    rows = {r["rank"]: r for r in text.scan_score_json(spark, f"{tmp_path}/*_scores_rank_*.json").collect()}
    assert rows["001"].score_key == "rank_001_alphafold2_ptm_model_3_seed_000" and rows["001"].plddt == [80.0, 90.0]
    assert rows["002"].plddt is None


def test_flat_and_nested_records(spark, tmp_path):
    body = "best_model: rank_001_m\nall_scores:\n  rank_001_m: 91.5\n  rank_002_m: 70\nbest_plddt: 91.5\ncreated: '2025-08-14T10:00:00'\n"
    write(tmp_path / "s.yaml", body)
    whole = text.read_whole(spark, str(tmp_path))
    row = text.parse_flat_records(text.parse_nested_map(whole, "all_scores", "scores")).first()
    assert row.record["best_model"] == "rank_001_m" and row.record["created"] == "2025-08-14T10:00:00"
    assert row.scores == {"rank_001_m": 91.5, "rank_002_m": 70.0}


def test_sections_golden_composition(spark, tmp_path):
    body = (
        "#include \"x.itp\"\n[ system ]\n; name\nMembrane\n\n[ molecules ]\n; name number\nPOPC 67\nPSM 25\nCHOL 76\n"
        "POPE 76\nPOPS 25\nCHOL 67\nW 8260\nNA 103\nCL 78\n"
    )
    write(tmp_path / "m.top", body)
    counts = text.molecule_counts(text.scan_sections(spark, str(tmp_path), "molecules"))
    total = {r.molecule: r.n for r in counts.groupBy("molecule").agg(F.sum("n").alias("n")).collect()}
    assert total == {"CHOL": 143, "CL": 78, "NA": 103, "POPC": 67, "POPE": 76, "POPS": 25, "PSM": 25, "W": 8260}
    assert counts.agg(F.min("line_no")).first()[0] == 8


def test_gro_pdb_and_plddt(spark, tmp_path):
    gro = "title\n    2\n    1ALA     BB    1   1.000   2.000   3.500\n    2LYS    SC1    2  -0.125   0.000  10.000\n  10.00000  10.00000  14.00000\n"
    write(tmp_path / "a.gro", gro)
    rows = text.scan_gro(spark, str(tmp_path / "a.gro")).orderBy("atom_id").collect()
    assert [(r.resname, r.atom, r.z) for r in rows] == [("ALA", "BB", 3.5), ("LYS", "SC1", 10.0)]
    assert rows[0].box.lz == 14.0 and rows[0].n_atoms == 2
    pdb = (
        "HEADER\nATOM      1  N   ALA A   1      10.000  20.000  30.000  1.00 55.00\n"
        "ATOM      2  CA  ALA A   1      11.000  20.000  30.000  1.00 91.00\n"
        "HETATM    3  CA  LYS A   2      12.000  20.000  30.000  1.00 81.00\nEND\n"
    )
    write(tmp_path / "a.pdb", pdb)
    atoms = text.scan_pdb(spark, str(tmp_path / "a.pdb")).orderBy("atom_id").collect()
    assert [a.x for a in atoms] == [1.0, 1.1, 1.2] and atoms[2].resid == 2
    scored = text.scan_ca_plddt(spark, str(tmp_path / "a.pdb")).first()
    assert scored.scores == [91.0, 81.0] and scored.mean_plddt == 86.0


def test_log_after_last_valid_hit_wins(spark, tmp_path):
    write(tmp_path / "x.log", "start\nSequence:\n-\nfirst\nSequence:\n-\nHHHC\nSequence:\n-\n; no\nSequence:\n-\n\n")
    row = text.scan_log_after(spark, str(tmp_path), "Sequence:").first()
    assert row.value == "HHHC" and row.line_no == 7


def test_features_layout_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, "low", 1, 0.5), (2, "low", 2, 0.25), (3, "high", 1, 1.0)], "peptide_id int, occupancy string, replicate int, v double")
    path = str(tmp_path / "f")
    tables.write_features(df, path)
    back = tables.read_features(spark, path, F.col("occupancy") == "low")
    assert {tuple(r) for r in back.select("peptide_id", "v").collect()} == {(1, 0.5), (2, 0.25)}
    assert "PartitionFilters: [isnotnull(occupancy" in back._jdf.queryExecution().executedPlan().toString()
    files = text.build_manifest(spark, path).filter("path LIKE '%.parquet'").collect()
    assert len(files) >= 2 and all(len(f.sha256) == 64 and f.size > 0 for f in files)
