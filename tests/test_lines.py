"""Files read in byte ranges: numbers, sections, frames and digests that span several ranges."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from hemolens.sources import lines, tables, text


@pytest.fixture
def ranges(spark):
    """Byte ranges of a few hundred bytes, so that small files are cut."""
    names = {"spark.sql.files.maxPartitionBytes": "400b", "spark.sql.files.openCostInBytes": "1b", "spark.sql.files.minPartitionNum": "1"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


def test_numbers_run_on_over_ranges(spark, tmp_path, ranges):
    body = {f"{c}.txt": [f"{c}{k} " + "x" * (k * 7 % 90) for k in range(n)] for c, n in (("a", 100), ("b", 1), ("c", 37))}
    for name, rows in body.items():
        (tmp_path / name).write_text("\n".join(rows) + ("\n" if name != "c.txt" else ""))
    (tmp_path / "empty.txt").write_text("")
    read = lines.numbered_lines(spark, str(tmp_path))
    assert read.rdd.getNumPartitions() > 3
    assert read.filter("file LIKE '%a.txt'").select("block").distinct().count() > 5
    got = {}
    for r in read.collect():
        got.setdefault(os.path.basename(r.file), {})[r.line_no] = r.line
    assert got == {name: dict(enumerate(rows, 1)) for name, rows in body.items()}


def test_sections_are_carried_over_ranges(spark, tmp_path, ranges):
    rows = ["lost line"]
    for k in range(30):
        rows += [f"[ s{k} ]", "; remark", *[f"  atom{j} {k}  {j}\r" for j in range(k % 4 * 30)], ""]
    (tmp_path / "t.top").write_text("\n".join(rows))
    whole = spark.createDataFrame([("t", "\n".join(rows))], "file string, text string")
    want = sorted((r.section, r.line_no, tuple(r.tokens)) for r in text.parse_sections(whole).collect())
    got = text.scan_sections(spark, str(tmp_path))
    assert sorted((r.section, r.line_no, tuple(r.tokens)) for r in got.collect()) == want and len(want) > 1000
    one = text.scan_sections(spark, str(tmp_path), "s3").collect()
    assert len(one) == 90 and {r.section for r in one} == {"s3"}


def gro(frames):
    out = []
    for f, n in enumerate(frames):
        out += [str(7 * f) if f % 3 == 0 else f"frame {f}", f"{n:5d}"]
        out += [f"{k + 1:5d}{'ALA':<5}{'BB':>5}{k + 1:5d}{0.1 * k:8.3f}{1.0 * f:8.3f}{-0.5:8.3f}" for k in range(n)]
        out.append(f"{10 + f:10.5f}{10.0:10.5f}{14.0:10.5f}")
    return "\n".join(out) + "\n"


@pytest.mark.parametrize("frames", [[4] * 60, [3, 1, 5, 0, 2] * 12, [2]])
def test_trajectories_are_read_by_several_tasks(spark, tmp_path, ranges, frames):
    (tmp_path / "x.gro").write_text(gro(frames))
    (tmp_path / "y.gro").write_text(gro([2, 2]))
    got = text.scan_gro(spark, str(tmp_path))
    if len(frames) > 1:
        assert lines.numbered_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 3
    rows = [r for r in got.collect() if r.file.endswith("x.gro")]
    want = {(f, k + 1): (str(7 * f) if f % 3 == 0 else f"frame {f}", n, 10.0 + f, round(0.1 * k, 3), float(f)) for f, n in enumerate(frames) for k in range(n)}
    assert {(r.frame, r.atom_id): (r.title, r.n_atoms, r.box.lx, r.x, r.y) for r in rows} == want and len(rows) == len(want)


def test_a_last_frame_that_is_cut_short(spark, tmp_path):
    whole = gro([3, 3]).splitlines()
    (tmp_path / "x.gro").write_text("\n".join(whole[:10]))
    rows = text.scan_gro(spark, str(tmp_path / "x.gro")).collect()
    assert sorted((r.frame, r.atom_id, r.box.lx) if r.box else (r.frame, r.atom_id, None) for r in rows) == [
        (0, 1, 10.0), (0, 2, 10.0), (0, 3, 10.0), (1, 1, None), (1, 2, None)
    ]


def test_logs_over_ranges(spark, tmp_path, ranges):
    rows = [f"noise {k}" for k in range(300)]
    for at, value in ((10, "AAA"), (150, "BBB"), (250, "; none"), (280, "  ")):
        rows[at], rows[at + 2] = "Following sequence:", value
    (tmp_path / "m.log").write_text("\n".join(rows))
    got = text.scan_log_after(spark, str(tmp_path / "*.log"), "sequence:").collect()
    assert [(r.line_no, r.value) for r in got] == [(153, "BBB")]
    assert text.scan_log_after(spark, str(tmp_path / "*.log"), "no such marker").count() == 0


def test_manifest_of_files(spark, tmp_path):
    bodies = {"a.bin": os.urandom(2500), "sub/b.bin": b"x" * 1000, "none.bin": b""}
    for name, body in bodies.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    digest = lambda b: hashlib.sha256(b)
    listed = text.build_manifest(spark, str(tmp_path), leaf=1000).withColumn("sec", F.unix_timestamp("mtime")).collect()
    assert len(listed) == 2  # Spark passes over empty files
    for r in listed:
        name = next(n for n in bodies if r.path.endswith("/" + n))
        body = bodies[name]
        leaves = b"".join(digest(body[k : k + 1000]).digest() for k in range(0, len(body), 1000))
        assert (r.size, r.sha256) == (len(body), digest(leaves).hexdigest())
        assert abs(r.sec - os.stat(tmp_path / name).st_mtime) < 2
    plain = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in text.build_manifest(spark, str(tmp_path), leaf=None).collect()}
    assert plain == {n.rsplit("/", 1)[-1]: digest(b).hexdigest() for n, b in bodies.items() if b}
    content = text.build_manifest(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "content#" not in content.split("Relation")[0]


def test_numbers_and_sections_cross_stretches_of_lines(spark, tmp_path, monkeypatch):
    """Four lines a stretch: no task needs a whole file, or a whole byte range of one."""
    monkeypatch.setattr(lines, "STRETCH_BITS", 2)
    (tmp_path / "a.txt").write_text("".join(f"[ s{i} ]\n" if i % 37 == 0 else f"row {i}\n" for i in range(300)))
    (tmp_path / "b.txt").write_text("[ only ]\n" + "x y\n" * 50)
    got = text.scan_sections(spark, str(tmp_path)).collect()
    want = [("a.txt", f"s{i // 37 * 37}", i + 1, "row") for i in range(300) if i % 37] + [("b.txt", "only", i + 2, "x") for i in range(50)]
    assert sorted((r.file.rsplit("/", 1)[1], r.section, r.line_no, r.tokens[0]) for r in got) == sorted(want)


def test_parts_are_joined_in_order(spark, tmp_path):
    rows = spark.range(3000).selectExpr("CASE WHEN id % 5 = 0 THEN 'a b:c' ELSE 'z' END AS source", "id").repartitionByRange(7, "source", "id")
    rows.sortWithinPartitions("source", "id").selectExpr("source", "string(id) AS line").write.partitionBy("source").text(str(tmp_path / "parts"))
    tables.join_parts(spark, str(tmp_path / "parts"), str(tmp_path / "whole"))
    got = {p.parent.name: [int(v) for v in p.read_text().split()] for p in (tmp_path / "whole").glob("source=*/[!.]*")}
    assert sorted(got.values()) == sorted([[i for i in range(3000) if i % 5 == 0], [i for i in range(3000) if i % 5]])
