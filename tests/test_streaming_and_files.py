import pytest
from pyspark.sql import functions as F

from loopweave.sources import files, sinks
from loopweave.sources.genbank import parse_location
from loopweave.streaming.tracks import label_counts

GENBANK = """LOCUS       AB000001                  24 bp    DNA     circular VRL 01-JAN-2000
DEFINITION  Some virus, complete genome.
ACCESSION   AB000001
VERSION     AB000001.2
SOURCE      Some virus
  ORGANISM  Some virus
            Viruses; Others.
FEATURES             Location/Qualifiers
     source          1..24
                     /organism="Some virus"
     CDS             complement(join(20..24,1..4))
                     /product="polyprotein
                     of two lines"
                     /translation="MKV
                     AA"
ORIGIN
        1 acgtacgtac gtacgtacgt acgt
//
"""


def test_sequences(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x one\nACG\nTT\n\n>y two words\nGG GG\n")
    (tmp_path / "b.fasta").write_text(">x again\nCC\n")
    (tmp_path / "c.gb").write_text(GENBANK)
    got = {(r["name"], r["seq"]) for r in files.load_genomes(spark, str(tmp_path)).collect()}
    assert got == {("x", "ACGTT"), ("y", "GGGG"), ("x__dup1", "CC"), ("AB000001", "ACGT" * 6)}
    assert files.load_genomes(spark, str(tmp_path), "first").count() == 3
    with pytest.raises(Exception, match="different sequences"):
        files.load_genomes(spark, str(tmp_path), "same").collect()
    assert {(r["name"], r["header"], r["seq"]) for r in files.read_fasta(spark, str(tmp_path / "a.fa")).collect()} == {("x", "x one", "ACGTT"), ("y", "y two words", "GGGG")}
    assert {r["id"] for r in files.read_headers(spark, str(tmp_path / "a.fa")).collect()} == {"x", "y"}


def test_annotated_records(spark, tmp_path):
    (tmp_path / "c.gb").write_text(GENBANK)
    r = files.read_genbank(spark, str(tmp_path)).first()
    assert (r["id"], r["name"], r["topology"], r["organism"], r["description"]) == ("AB000001.2", "AB000001", "circular", "Some virus", "Some virus, complete genome")
    cds = r["features"][1]
    assert cds["strand"] == -1 and [tuple(p) for p in cds["parts"]] == [(19, 24), (0, 4)]
    assert cds["qualifiers"] == {"product": ["polyprotein of two lines"], "translation": ["MKVAA"]}
    assert parse_location("<3..>7") == (1, [{"start": 2, "end": 7}])


def test_tolerant_reading_aliases_and_staging(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x one\nACG\n")
    (tmp_path / "c.gb").write_text(GENBANK + GENBANK.replace("AB000001", "AB000002"))
    (tmp_path / "d.txt").write_text(GENBANK.replace("AB000001", "AB000003"))
    (tmp_path / "combined_all.gb").write_text(GENBANK.replace("AB000001", "AB000009"))
    (tmp_path / "notes.txt").write_text("neither of both")
    path = str(tmp_path)
    with pytest.raises(Exception, match="neither GenBank nor FASTA"):
        files.load_genomes(spark, path).collect()
    assert {r["name"] for r in files.load_genomes(spark, path, tolerant=True).collect()} == {"x", "AB000001", "AB000002", "AB000003", "AB000009"}
    index = files.annotated_index(files.read_genbank(spark, path, glob="*.gb"))
    assert {r["alias"]: r["name"] for r in index.collect()} == {"AB000001.2": "AB000001", "AB000001": "AB000001", "c": "AB000001", "AB000002.2": "AB000002", "AB000002": "AB000002"}
    wanted = spark.createDataFrame([("AB000001.2",), ("AB000002.7",), ("Q.1",)], "accession string")
    mine = spark.createDataFrame([("AB000001.2", "here")], "alias string, path string")
    got = {r["accession"]: (r["place"], r["path"]) for r in files.staged(wanted, mine, index.select("alias", F.lit("there").alias("path"))).collect()}
    assert got == {"AB000001.2": (0, "here"), "AB000002.7": (1, "there"), "Q.1": (None, None)}


def test_loose_tables(spark, tmp_path):
    (tmp_path / "named.csv").write_text(",a,b\na,0,x\nb,,0\n")
    (tmp_path / "bare.csv").write_text("a,b\n0,0.5\nnan,0\n")
    one = lambda f: {(r["a"], r["b"]): r["dist"] for r in files.read_loose_matrix(spark, str(tmp_path / f)).collect()}
    assert one("named.csv") == {("a", "a"): 0.0, ("a", "b"): None, ("b", "a"): None, ("b", "b"): 0.0}
    assert one("bare.csv") == {("a", "a"): 0.0, ("a", "b"): 0.5, ("b", "a"): None, ("b", "b"): 0.0}
    (tmp_path / "w.csv").write_text("Genome,Start,assigned_cluster,end\n g1 ,x,3,9\ng2,50,oops,9\n")
    assert [tuple(r) for r in files.read_windows(spark, str(tmp_path / "w.csv"), strict=False).collect()] == [("g1", 0, 3), ("g2", 50, 0)]
    with pytest.raises(Exception, match="no label"):
        files.read_windows(spark, str(tmp_path / "w.csv")).collect()


def test_tables_and_sinks(spark, tmp_path):
    (tmp_path / "m.csv").write_text(",a,b\na,0,0.5\nb,oops,0\n")
    got = {(r["a"], r["b"]): r["dist"] for r in files.read_matrix(spark, str(tmp_path / "m.csv")).collect()}
    assert got == {("a", "a"): 0.0, ("a", "b"): 0.5, ("b", "a"): None, ("b", "b"): 0.0}
    (tmp_path / "acc.txt").write_text("# list\nA1 # one\n\nA2\n")
    assert {r[0] for r in files.read_accessions(spark, str(tmp_path / "acc.txt")).collect()} == {"A1", "A2"}
    (tmp_path / "twice.txt").write_text("A1\nA1\n")
    with pytest.raises(Exception, match="twice"):
        files.read_accessions(spark, str(tmp_path / "twice.txt")).collect()
    df = spark.createDataFrame([("x", "ACGT" * 20)], "name string, seq string")
    sinks.write_fasta(df, str(tmp_path / "out"))
    assert files.read_fasta(spark, str(tmp_path / "out")).first()["seq"] == "ACGT" * 20
    assert sinks.markdown(spark.createDataFrame([(1, 0.123456, None)], "a int, b double, c string"), 5).endswith("| 1 | 0.1235 |  |")


def test_stream(spark, tmp_path):
    rows = spark.sql("SELECT 'u' AS name, timestamp'2024-01-01 00:10:00' AS ts, 'a' AS label UNION ALL SELECT 'u', timestamp'2024-01-01 00:20:00', 'a' UNION ALL SELECT 'u', timestamp'2024-01-01 01:20:00', 'b'")
    rows.write.parquet(str(tmp_path / "in"))
    stream = label_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {(r["label"], r["n"]) for r in spark.table("counts").collect()} == {("a", 2), ("b", 1)}
