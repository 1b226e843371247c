import pytest
from pyspark.sql import functions as F

from loopweave.functions import headers as H
from loopweave.functions import sequences as S
from loopweave.schemas import require, resolve_columns


def one(spark, column, **values):
    kinds = {str: "string", int: "int", bool: "boolean"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (0,)], schema).select(column.alias("v")).first()["v"]


def test_entropy_and_complements(spark):
    assert one(spark, F.round(S.base_entropy(F.col("s")), 6), s="ACGT") == 2.0
    assert one(spark, S.base_entropy(F.col("s")), s="NNNN") is None
    assert one(spark, S.reverse_complement(F.col("s")), s="ACGTNR") == "RNACGT"
    assert one(spark, S.reverse_complement_full(F.col("s")), s="ACGTR") == "YACGT"


def test_translate(spark):
    assert one(spark, S.translate_dna(F.col("s")), s="ATGTGGTAA") == "MW"
    assert one(spark, S.translate_dna(F.col("s")), s="ATGTAATGGA") == "M*W"
    assert one(spark, S.translate_dna(F.col("s")), s="ATGNNN") == "MX"
    assert one(spark, S.translate_dna(F.col("s")), s="AT") == ""


def test_windows_longer_than_the_sequence(spark):
    for start, width in ((0, 20), (5, 15)):
        assert len(one(spark, S.circular_fragment(F.col("s"), F.lit(start), 25), s="ACGTACGTAC")) == 25
        assert len(one(spark, S.circular_extension(F.col("s"), F.lit(start), 25), s="ACGTACGTAC")) == width
    assert one(spark, S.circular_fragment(F.col("s"), F.lit(3), 25), s="") == ""


def test_slices(spark):
    assert one(spark, S.slice_circular(F.col("s"), F.lit(4), F.lit(2), F.lit(True)), s="ABCDEF") == "EFAB"
    assert one(spark, S.slice_circular(F.col("s"), F.lit(1), F.lit(3), F.lit(False)), s="ABCDEF") == "BC"
    assert one(spark, S.slice_circular(F.col("s"), F.lit(3), F.lit(3), F.lit(False)), s="ABCDEF") == ""


def test_header_levels(spark):
    level = lambda h: one(spark, H.header_score(F.col("h")), h=h)["level"]
    assert level("AJ534983.1 Cacao swollen shoot virus isolate N1A complete") == "strong"
    assert level("AJ534983 one") == "some"
    assert level("x1") == "id_only"


def test_places_and_tags(spark):
    assert one(spark, H.country(F.col("t")), t="isolate GH67 Ghana") == "Ghana"
    assert one(spark, H.isolate_tags(F.col("t")), t="isolate GH67 Ghana") == "GH67;Ghana"
    assert one(spark, H.country(F.col("t")), t="Côte d'Ivoire") == "Cote d'Ivoire"
    assert one(spark, H.country(F.col("t")), t="") == ""


def test_candidates_fields_and_flags(spark):
    assert one(spark, H.id_candidates(F.col("t")), t=" a|b c|a ") == ["a|b c|a", "a|b", "a", "b c"]
    assert one(spark, H.id_candidates(F.col("t")), t="  ") == []
    assert one(spark, H.parse_header_fields(F.col("t")), t="x|k=1|l=2|k=3") == {"l": "2", "k": "3"}
    assert [one(spark, H.strand_sign(F.col("t")), t=t) for t in ("+", "-1", "2", "x")] == [1, -1, 1, None]
    assert one(spark, H.truthy(F.col("t")), t=" Yes") is True
    assert one(spark, H.tip_to_accession(F.col("t")), t="AB1__dup2|orf") == "AB1"


def test_columns(spark):
    df = spark.createDataFrame([("a", 1, 2)], "genome string, start int, cluster int")
    from loopweave.schemas import WINDOW_ALIASES

    assert resolve_columns(df, WINDOW_ALIASES).columns == ["name", "start", "label"]
    with pytest.raises(ValueError, match="label"):
        resolve_columns(df.drop("cluster"), WINDOW_ALIASES)
    with pytest.raises(ValueError, match="end"):
        require(df, ["end"])
