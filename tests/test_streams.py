"""Files that arrive as a stream keep the rules of the batch sources."""

import pytest

from hemolens.sources import text
from hemolens.streaming import jobs


def test_fasta_files_in_several_batches(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"{k}.fasta").write_text(f">P{k}|name {k}\nKLK\nAAA\r\n>Q{k}\nGIG K\n>R{k}|\n")
    rows = jobs.drain(jobs.read_fasta_stream(spark, str(tmp_path), files_a_batch=2), None, "append").collect()
    batch = text.scan_fasta(spark, str(tmp_path)).collect()
    key = lambda r: (r.peptide_id, r.name, r.sequence, r.source_file.rsplit("/", 1)[-1])
    assert sorted(map(str, map(key, rows))) == sorted(map(str, map(key, batch))) and len(rows) == 15


def test_a_bad_file_stops_the_stream(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">P1\nKLK\n")
    (tmp_path / "b.fasta").write_text("P2\nKLK\n>P3\nAAA\n")
    with pytest.raises(Exception, match="no FASTA header in .*b.fasta"):
        jobs.drain(jobs.read_fasta_stream(spark, str(tmp_path), files_a_batch=1), None, "append")


def test_label_files_keep_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('X_ID,SEQUENCE,HC50_uM,sequence_length,NAME\nP1,KK,1.5,2,"one, ""two"""\nP2,RR,,2,\n')
    (tmp_path / "b.csv").write_text("name,hc50_um,amp_id,sequence,sequence_length\nthree,9,P3,LL,2\n")
    rows = jobs.drain(jobs.read_label_stream(spark, str(tmp_path), files_a_batch=1), None, "append").collect()
    assert sorted(tuple(r)[:5] for r in rows) == [("P1", "KK", 1.5, 2, 'one, "two"'), ("P2", "RR", None, 2, None), ("P3", "LL", 9.0, 2, "three")]
    (tmp_path / "c.csv").write_text("id,SEQUENCE,NAME\nP4,K,x\n")
    with pytest.raises(Exception, match="hc50_um"):
        jobs.drain(jobs.read_label_stream(spark, str(tmp_path), files_a_batch=1), None, "append")


def test_only_marks_of_fasta_records_go_to_the_state(spark, tmp_path, monkeypatch):
    seen, per_file = [], jobs._per_file
    monkeypatch.setattr(jobs, "_per_file", lambda lines, *rest: seen.append(lines.columns) or per_file(lines, *rest))
    (tmp_path / "a.fasta").write_text(">P|1|2>3\nKL K\n AA\n> Q \n>R")
    rows = jobs.drain(jobs.read_fasta_stream(spark, str(tmp_path)), None, "append").collect()
    assert sorted(tuple(r)[:3] for r in rows) == sorted([("P", "1|23", "KLKAA"), ("Q", None, ""), ("R", None, "")])
    assert seen == [["source_file", "arrived", "opens"]]
