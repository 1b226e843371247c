"""Sequence, matrix and table files as DataFrames.

Readers are Spark's own text sources, so files may lie wherever Spark reads,
and gzip is undone on the way.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StringType, StructField, StructType

from loopweave.operators.lookups import alias_index, by_alias
from loopweave.operators.matrix import long
from loopweave.schemas import WINDOW_ALIASES, resolve_columns

#: Suffixes of sequence files (fixed values).
ANNOTATED, PLAIN = "*.{gb,gbk,genbank}", "*.{fa,fasta,fna,fas,txt}"

#: Fields of annotated records.
RECORD = """struct<id:string,name:string,description:string,organism:string,topology:string,accessions:array<string>,seq:string,
    features:array<struct<type:string,strand:int,parts:array<struct<start:int,end:int>>,qualifiers:map<string,array<string>>>>>"""


def read_fasta(spark: SparkSession, path: str, clean: bool = False, glob: str = "*", recursive: bool = False) -> DataFrame:
    """``(name, header, seq, source_file, rec, starts)`` of FASTA files, plain or gzipped; ``rec`` rises along a file.

    A record is what stands between ``>`` at line starts; ``name`` is the
    header's first token, and blank lines and spaces in sequences are dropped,
    with ``clean`` all that isn't a letter.  ``starts`` holds for a file's first
    record, if the file is FASTA.
    """
    text = spark.read.option("lineSep", "\n>").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).text(path)
    rows = text.select(
        F.regexp_replace("value", r"^\s*>", "").alias("body"), F.col("_metadata.file_path").alias("source_file"), F.monotonically_increasing_id().alias("rec"), F.ltrim("value").startswith(">").alias("starts")
    )
    header = F.trim(F.regexp_replace(F.substring_index("body", "\n", 1), "\r", ""))
    rest = F.when(F.contains("body", F.lit("\n")), F.expr("substring(body, instr(body, '\n') + 1)")).otherwise("")
    seq = F.regexp_replace(F.upper(rest), "[^A-Z]" if clean else r"\s", "")
    return rows.select(F.get(F.split(header, r"\s+"), F.lit(0)).alias("name"), header.alias("header"), seq.alias("seq"), "source_file", "rec", "starts").where("header <> ''")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """``(id, header)`` of FASTA files: their header lines only."""
    lines = spark.read.text(path).where(F.col("value").startswith(">"))
    header = F.trim(F.expr("substring(value, 2)"))
    return lines.select(F.get(F.split(header, r"\s+"), F.lit(0)).alias("id"), header.alias("header")).where("id <> ''")


def read_genbank(spark: SparkSession, path: str, tolerant: bool = False, glob: str = "*") -> DataFrame:
    """Annotated records of GenBank files: RECORD's fields, ``source_file`` and ``rec``, which rises along a file.

    A record is what stands before a line ``//``, so files may be of any size.
    One that can't be parsed fails the job, or, if ``tolerant``, is left out.
    """
    from loopweave.sources.genbank import parse_records

    schema = spark.createDataFrame([], f"r {RECORD}").schema["r"].dataType
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches):
        for batch in batches:
            rows, of = [], []
            for i, text in enumerate(batch.column(0)):
                try:
                    found = parse_records(text.as_py())
                except Exception:
                    if not tolerant:
                        raise
                    found = []
                rows += found
                of += [i] * len(found)
            for r in rows:
                for f in r["features"]:
                    f["qualifiers"] = list(f["qualifiers"].items())
            columns = [pa.array([r[f.name] for r in rows], k) for f, k in zip(schema.fields, kinds, strict=True)]
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1).take(at), batch.column(2).take(at)], [*schema.names, "source_file", "rec"])

    text = spark.read.option("lineSep", "\n//").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
    rows = text.select("value", F.col("_metadata.file_path").alias("source_file"), F.monotonically_increasing_id().alias("rec"))
    out = StructType([*schema.fields, StructField("source_file", StringType()), StructField("rec", LongType())])
    return rows.mapInArrow(run, out)


def annotated_index(records: DataFrame) -> DataFrame:
    """Annotated records under all their names, column ``alias``: id, name, file's stem and accessions, with and without version.

    A name that several records have goes to the first by file and place in it;
    files called ``combined_...`` are passed over.
    """
    base = F.regexp_extract("source_file", "([^/]+)$", 1)
    names = F.concat(F.array("id", "name", F.regexp_replace(base, r"\.[^.]*$", "")), F.coalesce("accessions", F.array().cast("array<string>")))
    return alias_index(records.where(~F.lower(base).startswith("combined_")), names, ["source_file", "rec"])


def read_sequences(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """``(name, fmt, source_file, seq, rec, nth)`` of a folder of FASTA and GenBank files, ``nth`` telling apart what has one name.

    GenBank records are named by their LOCUS, FASTA records by their id.  Files
    are told apart by suffix, those called ``.txt`` by what they start with.  A
    file that is neither is an error, or, if ``tolerant``, is left out.  Records,
    not files, are what tasks hold.
    """
    kind = F.col("_metadata.file_path").alias("source_file")
    heads = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").text(path).where("value rlike '\\\\S'")
    starts = heads.select(kind, F.col("value").startswith("LOCUS").alias("gb")).groupBy("source_file").agg(F.max("gb").alias("gb"))
    marked = starts.where("gb").select(F.col("source_file").alias("_gb"))
    some = read_genbank(spark, path, tolerant, "*.txt")
    annotated = read_genbank(spark, path, tolerant, ANNOTATED).unionByName(some.join(marked, F.col("source_file") == F.col("_gb")).drop("_gb"))
    plain = read_fasta(spark, path, glob=PLAIN, recursive=True)
    plain = plain.join(marked, F.col("source_file") == F.col("_gb"), "left_anti")
    first = plain.groupBy("source_file").agg(F.max("starts").alias("fasta")).where("not fasta").select(F.col("source_file").alias("_bad"))
    met = plain.join(first, F.col("source_file") == F.col("_bad"), "left")
    if tolerant:
        met = met.where("_bad IS NULL")
    name = F.when(F.col("_bad").isNotNull(), F.raise_error(F.concat(F.lit("neither GenBank nor FASTA: "), "source_file"))).otherwise(F.col("name"))
    rows = annotated.select("name", F.lit("genbank").alias("fmt"), "source_file", F.upper("seq").alias("seq"), "rec").unionByName(met.select(name.alias("name"), F.lit("fasta").alias("fmt"), "source_file", "seq", "rec"))
    return rows.withColumn("nth", F.row_number().over(W.Window.partitionBy("name").orderBy("source_file", "rec")))


def load_genomes(spark: SparkSession, path: str, duplicates: str = "suffix", tolerant: bool = False) -> DataFrame:
    """Sequences of a folder, with a policy for names that occur again.

    ``suffix`` adds ``__dupN`` to later ones, ``first`` drops them, ``last``
    keeps only the last, ``same`` allows them if the sequences are equal and
    fails otherwise, ``keep`` leaves all.  Files that can't be read fail the job,
    or, if ``tolerant``, are left out.
    """
    rows = read_sequences(spark, path, tolerant)
    cells = ["name", "fmt", "source_file", "seq"]
    if duplicates == "suffix":
        name = F.when(F.col("nth") > 1, F.concat("name", F.lit("__dup"), F.col("nth") - 1)).otherwise(F.col("name"))
        return rows.withColumn("name", name).select(cells)
    if duplicates == "first":
        return rows.where("nth = 1").select(cells)
    if duplicates == "last":
        last = F.max("nth").over(W.Window.partitionBy("name"))
        return rows.withColumn("last", last).where("nth = last").select(cells)
    if duplicates == "same":
        kinds = F.size(F.collect_set("seq").over(W.Window.partitionBy("name")))
        seq = F.when(kinds > 1, F.raise_error(F.concat(F.lit("different sequences are called "), "name"))).otherwise(F.col("seq"))
        return rows.withColumn("seq", seq).where("nth = 1").select(cells)
    if duplicates == "keep":
        return rows.select(cells)
    raise ValueError(f"no policy is called {duplicates}")


def read_matrix(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A square table with labels in its first row and column, as ``(a, b, dist)``; what isn't a number is null."""
    return long(spark.read.option("header", "true").option("sep", sep).csv(path))


def read_loose_matrix(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A square table of one file, with or without labels in its rows, as ``(a, b, dist)``; blanks and texts are null.

    Labels of rows lack where the first row starts with a number and has no
    more cells than there are labels; rows then have the columns' labels in order.
    """
    rows = spark.read.option("sep", sep).option("header", "false").csv(path).withColumn("_at", F.monotonically_increasing_id())
    cells = [c for c in rows.columns if c != "_at"]
    head, first = (rows.orderBy("_at").limit(2).collect() + [None, None])[:2]
    if first is None:
        raise ValueError(f"no rows in {path}")
    filled = [v.strip() for v in (head[c] for c in cells) if v is not None and v.strip()]
    bare = len(filled) == len(cells)
    labels = filled if bare else [(head[c] or "").strip() for c in cells[1:]]
    body = rows.where(F.col("_at") > head["_at"])
    if bare:
        nth = F.row_number().over(W.Window.orderBy("_at"))  # a row for each label
        body = body.withColumn("_a", F.get(F.array(*map(F.lit, labels)), nth - 1))
    else:
        body = body.withColumn("_a", F.trim(F.col(cells[0])))
    values = cells if bare else cells[1:]
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, labels)).alias("b"), F.array(*(F.trim(c).try_cast("double") for c in values)).alias("dist")))
    return body.select(F.col("_a").alias("a"), each.alias("x")).select("a", F.col("x.b").alias("b"), F.when(~F.isnan("x.dist"), F.col("x.dist")).alias("dist"))


def read_windows(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``(name, start, label)`` of a table of windows, whichever of the usual names its columns have.

    A ``start`` that is no number is 0; so is a label, unless ``strict``, when it
    is an error.
    """
    table = spark.read.option("header", "true").csv(path)
    table = resolve_columns(table.select(*(F.col(f"`{c}`").alias(c.strip().lower()) for c in table.columns)), WINDOW_ALIASES)
    number = lambda c: F.col(c).try_cast("double").cast("int")
    label = F.coalesce(number("label"), F.raise_error(F.concat(F.lit("no label of a window: "), F.coalesce("label", F.lit("")))) if strict else F.lit(0))
    return table.select(F.trim("name").alias("name"), F.coalesce(number("start"), F.lit(0)).alias("start"), label.alias("label"))


def staged(accessions: DataFrame, *places: DataFrame) -> DataFrame:
    """``(accession, place, path)``: for each accession the file of the first of ``places`` that has it; nulls where none has.

    Each place is an index ``(alias, path)``, the one to be preferred first;
    accessions are also looked up without version.
    """
    found = None
    for k, place in enumerate(places):
        one = by_alias(accessions.select("accession"), "accession", place, ["path"]).where("path IS NOT NULL").select("accession", F.lit(k).alias("place"), "path")
        found = one if found is None else found.unionByName(one)
    best = found.groupBy("accession").agg(F.min(F.struct("place", "path")).alias("x"))
    return accessions.select("accession").join(best, "accession", "left").select("accession", "x.place", "x.path")


def read_accessions(spark: SparkSession, path: str) -> DataFrame:
    """``(accession)``, a line each; ``#`` starts a comment, and an accession that occurs again is an error."""
    rows = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("accession")).where("accession <> ''")
    n = F.count("*").over(W.Window.partitionBy("accession"))
    checked = F.when(n > 1, F.raise_error(F.concat(F.lit("twice: "), "accession"))).otherwise(F.col("accession"))
    return rows.select(checked.alias("accession"))


def read_table(spark: SparkSession, path: str, key: str, sep: str = "\t", keep: str = "first") -> DataFrame:
    """A delimited table of texts with one row for each ``key``: the first or last; rows without one are dropped."""
    rows = spark.read.option("header", "true").option("sep", sep).csv(path).withColumn("_at", F.monotonically_increasing_id())
    rows = rows.where(F.coalesce(F.trim(F.col(key)), F.lit("")) != "")
    at = F.col("_at").asc() if keep == "first" else F.col("_at").desc()
    return rows.withColumn("_n", F.row_number().over(W.Window.partitionBy(key).orderBy(at))).where("_n = 1").drop("_n", "_at")


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """``(name, seq)`` of an aligned FASTA file; sequences of different lengths are an error."""
    from loopweave.operators.alignment import check_aligned

    return check_aligned(read_fasta(spark, path).select("name", "seq"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length)`` of all files below a folder; none is opened."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").orderBy("path")
