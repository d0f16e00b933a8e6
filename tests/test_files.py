"""Readers, image checks, sinks and streams on small files."""

import gzip
import json
import struct
import zipfile

import numpy as np
from pyspark.sql import functions as F

from siftline.functions import routing
from siftline.operators import imaging
from siftline.sources import cohort, files, sinks
from siftline.streaming import ledger


def test_text_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# note\ngene_a,gene_b,combined_score\nA,B,900\nA,A,5\nB,C,x\n")
    assert [tuple(r) for r in files.edges(spark, str(tmp_path / "a.csv")).collect()] == [("A", "B", 900.0)]
    (tmp_path / "a.tsv").write_text("a\tb\n1\tx\n2\n")
    assert files.strict(spark, str(tmp_path / "a.tsv"), "a int, b string").where("b is not null").count() == 1
    (tmp_path / "s.csv").write_text("a,b\n1,\n")
    assert files.strings(spark, str(tmp_path / "s.csv")).first()["b"] == ""
    (tmp_path / "s.json").write_text(json.dumps({"scores": {"A": 1, "B": {"x": 2}}, "gene_sets": [{"id": "s", "name": "n", "genes": ["A", "B"]}]}))
    assert {tuple(r) for r in files.snapshot(spark, str(tmp_path / "s.json"), "scores").collect()} == {("A", "1"), ("B", '{"x":2}')}
    assert files.snapshot(spark, str(tmp_path / "s.json"), "none").count() == 0
    assert files.gene_sets(spark, str(tmp_path / "s.json")).count() == 2
    (tmp_path / "p.html").write_text('<script>x = {"data": [["<b>A</b>", "B"], ["1", "2"]]}</script>')
    assert [tuple(r) for r in files.html_table(spark, str(tmp_path / "p.html"), ["gene", "rank"]).collect()] == [("A", "1"), ("B", "2")]
    (tmp_path / "policy.md").write_text("---\nleast: 40\nname: x y\n---\ntext\nother: 1\n")
    assert files.front_matter(spark, str(tmp_path / "policy.md")) == {"least": "40", "name": "x y"}


def test_statistics_and_structures(spark, tmp_path):
    (tmp_path / "x.stats").write_text("# Measure BrainSeg, BrainSegVol, Brain, 1000.5, mm^3\n# Measure EstimatedTotalIntraCranialVol, eTIV, x, 1500, mm^3\n 1 17 10 120.5 Left-Hippocampus 1\n 2 53 10 130 Right-Hippocampus 1\n 3 4 9 7 Left-Lateral-Ventricle 1\n")
    assert tuple(files.segment_stats(spark, str(tmp_path / "x.stats")).first())[1:] == (1500.0, 1000.5, 250.5, 7.0)
    (tmp_path / "x.cif").write_text("loop_\n_atom_site.group_PDB\n_atom_site.label_atom_id\n_atom_site.B_iso_or_equiv\nATOM CA 90\nATOM CB 10\nATOM CA 70\nHETATM CA 1\n")
    assert tuple(files.structure_confidence(spark, str(tmp_path / "x.cif")).first())[1:] == (2, 80.0)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/one.xml", '<a xmlns="u"><imageUID>I1</imageUID><age>70</age></a>')
        z.writestr("d/two.xml", "<a><imageUID>I1</imageUID><age>71</age><site>S</site></a>")
        z.writestr("d/no.txt", "x")
    assert [tuple(r) for r in files.archive_fields(spark, str(tmp_path / "a.zip"), r"\.xml$", "imageUID", ["age", "site"]).collect()] == [("I1", "70", "S")]


def nifti(v, sform=1, flip=False, spacing=1.0):
    h = bytearray(352)
    struct.pack_into("<i", h, 0, 348)
    struct.pack_into("<8h", h, 40, v.ndim, *v.shape, *[1] * (7 - v.ndim))
    struct.pack_into("<h", h, 70, 16)
    struct.pack_into("<8f", h, 76, 1, spacing, spacing, spacing, 1, 1, 1, 1)
    struct.pack_into("<f", h, 108, 352)
    struct.pack_into("<2h", h, 252, 1, sform)
    struct.pack_into("<12f", h, 280, -spacing if flip else spacing, 0, 0, 0, 0, spacing, 0, 0, 0, 0, spacing, 0)
    return bytes(h) + v.astype("<f4").tobytes(order="F")


def test_volumes(spark, tmp_path):
    rng = np.random.default_rng(0)
    base = np.zeros((12, 12, 12))
    base[3:9, 3:9, 1:11] = 100 + rng.random((6, 6, 10))
    dead = base.copy()
    dead[:, :, 6] = 0
    for site, name, content in (("s1", "a.nii", nifti(base)), ("s1", "b.nii.gz", gzip.compress(nifti(base, flip=True))), ("s2", "c.nii", nifti(dead * 3)), ("s2", "d.nii", b"no"), ("s2", "e.nii", nifti(base[:, :, :4], sform=0, spacing=9.0))):
        (tmp_path / site).mkdir(exist_ok=True)
        (tmp_path / site / name).write_bytes(content)
    v = files.volumes(spark, str(tmp_path / "*" / "*"))
    a = v.where("path like '%a.nii'").first()
    assert a["dims"] == [12, 12, 12] and a["axes"] == "RAS" and a["lo"] == [3, 3, 1] and a["hi"] == [8, 8, 10] and a["site"] == "s1" and np.allclose(a["centroid"], [5.5, 5.5, 5.5])
    flags = {(r["path"].rpartition("/")[2] if r["path"] else None, r["check"]) for r in imaging.run(v).collect()}
    assert flags == {("b.nii.gz", "orientation"), ("c.nii", "sanity"), ("d.nii", "readable"), ("e.nii", "sanity"), ("e.nii", "orientation"), (None, "intensity")}
    m = spark.createDataFrame([([1, 2], [2, 3]), ([], [])], "a array<int>, b array<int>")
    assert [r[0] for r in m.select(imaging.overlap(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(7, "x"), (3, "y"), (7, "z"), (None, "n")], "rid int, v string")
    out, cross = sinks.deidentify(df, "rid")
    assert {tuple(r) for r in cross.collect()} == {(3, "AR0001"), (7, "AR0002")} and "rid" not in out.columns and out.count() == 4
    tests = spark.createDataFrame([("a", "pass", 1.0)], "key string, result string, value double")
    sinks.write_card(tests, spark.createDataFrame([(80, "good")], "score int, verdict string"), str(tmp_path / "card"))
    assert spark.read.json(str(tmp_path / "card")).first()["tests"][0]["key"] == "a"
    sinks.append_ledger(df, str(tmp_path / "led"))
    sinks.append_ledger(df, str(tmp_path / "led"))
    assert spark.read.parquet(str(tmp_path / "led")).count() == 8
    c = spark.createDataFrame([("s1", "a"), ("s2", None)], "subject_id string, site string")
    sinks.write_contract(c, str(tmp_path / "con"))
    sinks.write_report(c, str(tmp_path / "rep"))
    assert spark.read.parquet(str(tmp_path / "con")).count() == 2


def test_stream_as_batch(spark, tmp_path):
    rows = [("a", True, 1.0), ("a", False, 2.0), ("b", True, 0.1), ("a", True, 9.0)]
    for i in range(2):
        spark.createDataFrame(rows[2 * i : 2 * i + 2], "arm string, success boolean, effect double").write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("arm string, success boolean, effect double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ledger.running_beliefs(s).writeStream.outputMode("complete").format("memory").queryName("beliefs").start()
    q.processAllAvailable()
    q.stop()
    from siftline.operators.ledger import posterior

    assert {tuple(r) for r in spark.table("beliefs").collect()} == {tuple(r) for r in posterior(spark.read.parquet(str(tmp_path / "in"))).collect()}


def test_feeders(spark, small):
    assert cohort.load(spark, small, "adni:3T").df.count() < cohort.load(spark, small, "adni").df.count()
    df = spark.createDataFrame([("3.0",), ("1.5",), ("Trio",), (None,)], "s string")
    assert [r[0] for r in df.select(cohort.field_strength(F.col("s"))).collect()] == ["3T", "1.5T", "Trio", None]
    assert [r[0] for r in spark.createDataFrame([(0.0,), (0.5,), (0.25,), (None,)], "c double").select(cohort.cdr_band(F.col("c"))).collect()] == ["CN", "MCI", "AD", None]
    m = spark.createDataFrame([("1.0",), (" dementia",), ("9",)], "x string").select(cohort.map_values(F.col("x"), {"1": "CN", "Dementia": "AD"}))
    assert [r[0] for r in m.collect()] == ["CN", "AD", None]
    bad = spark.createDataFrame([("a", "XX", "M"), ("a", "CN", None), (None, None, "F")], "subject_id string, dx string, sex string")
    got = {r["problem"]: r["n"] for r in cohort.validate(bad).collect()}
    assert got["repeated keys"] == 1 and got["null keys"] == 1 and got["dx outside its domain"] == 1 and got["no column age"] == 1


def test_routing(spark):
    t = spark.createDataFrame([("Does the LEFT  hippocampus predict conversion?",), ("find subtypes at each site",), ("this proves it",), (None,)], "t string")
    r = t.select(routing.target(F.col("t")), routing.mode(F.col("t")), routing.region(F.col("t")), routing.overclaims(F.col("t"))).collect()
    assert [tuple(x) for x in r] == [("conversion", "supervised", "hippocampus", False), ("site", "unsupervised", None, False), (None, "supervised", None, True), (None, "supervised", None, False)]
