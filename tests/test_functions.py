"""Facts of the sequence functions, by row."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import sequence as S


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


@pytest.mark.parametrize(("seq", "want"), [("AACG", "CGTT"), ("NNGC", "GCNN"), ("", ""), ("aacg", "CGTT"), ("RYKMBVDHUX", "NADHBVKMRY")])
def test_reverse_complement(spark, seq, want):
    assert one(spark, S.reverse_complement(F.lit(seq))) == want


def test_upper_is_ascii_only(spark):
    assert one(spark, S.upper(F.lit("acgtè"))) == "ACGTè"


@pytest.mark.parametrize(("codon", "want"), [("ATG", "M"), ("TAA", "*"), ("CTN", "L"), ("ggx", "G"), ("AT", "X"), ("ANG", "X"), ("TTT", "F"), ("AGA", "R")])
def test_codons_with_free_third_base(spark, codon, want):
    assert one(spark, S.amino(F.lit(codon))) == want


def test_strict_codons_differ(spark):
    assert one(spark, S.amino_strict(F.lit("CTN"))) == "X"
    assert one(spark, S.amino_strict(F.lit("CT"))) == ""


def test_translation_drops_partial_codons(spark):
    assert one(spark, S.translate(F.lit("ATGGCATAA"))) == "MA*"
    assert one(spark, S.translate(F.lit("ATGG"))) == "M"
    assert one(spark, S.translate(F.lit("ATGGCATAA"), 1)) == "WH"
    assert one(spark, S.translate(F.lit("A"))) == ""


def test_overlapping_offsets(spark):
    assert one(spark, S.offsets(F.lit("AAAA"), F.lit("AA"))) == [0, 1, 2]
    assert one(spark, S.count(F.lit("AC"), F.lit("ACG"))) == 0
    assert one(spark, S.find(F.lit("ACG"), F.lit("CG"))) == 1
    assert one(spark, S.find(F.lit("ACG"), F.lit("T"))) is None


@pytest.mark.parametrize(("seq", "want"), [("AAAAAA", True), ("ACACACAC", True), ("ACGTTGCAAC", False), ("AAAAA", False), ("", False)])
def test_tandem(spark, seq, want):
    assert one(spark, S.tandem(F.lit(seq))) is want


def test_names(spark):
    assert one(spark, S.chromosome(F.lit("chm13#chr6:31825251-31908851"))) == "chr6"
    assert one(spark, S.region_start(F.lit("chm13#chr6:31825251-31908851"))) == 31825251
    assert one(spark, S.region_start(F.lit("chr6"))) == 0
    assert one(spark, S.region_start(F.lit("chr6:x-3"))) == 0
    assert one(spark, S.sample(F.lit("HG00438#1#JAHB"))) == "HG00438#1"
    assert one(spark, S.commas(F.lit(-1234567))) == "-1,234,567"


@pytest.mark.parametrize(("n", "bits"), [(1, 1), (2, 1), (4, 2), (5, 3), (16, 4), (0, 1)])
def test_bits_for(spark, n, bits):
    assert one(spark, S.bits_for(F.lit(n))) == bits


@pytest.mark.parametrize(("v", "z"), [(0, 0), (-1, 1), (1, 2), (-2, 3), (2**40, 2**41)])
def test_zigzag(spark, v, z):
    assert one(spark, S.zigzag(F.lit(v))) == z


@pytest.mark.parametrize(("ref", "target"), [("ACGTACGT", "ACGAACGT"), ("ACGT", "ACGGGGT"), ("ACGTAA", "ACG"), ("", "AC"), ("AC", ""), ("AC", "AC"), ("AAAA", "AA")])
def test_edit_scripts_rebuild_the_target(spark, ref, target):
    r, t = F.lit(ref), F.lit(target)
    assert one(spark, S.edit_apply(r, S.edit_script(r, t))) == target


def test_twobit_and_varint(spark):
    assert one(spark, S.twobit_bits(F.lit("ACGT"))) == 8
    assert one(spark, S.twobit_bits(F.lit("ACGTN"))) == 16
    assert one(spark, S.varint_length(F.lit(127))) == 1
    assert one(spark, S.varint_length(F.lit(128))) == 2


def test_registered_in_sql(spark):
    S.register(spark)
    assert spark.sql("SELECT seq_revcomp('AACG'), seq_zigzag(-2), seq_twobit('ACN')").first() == ("CGTT", 3, 12)


def test_sql_is_as_columns(spark):
    S.register(spark)
    texts = ["", "-", "+x", "ACGT", "acgtNNACgtRYé", "AAAAAAAAAAAA", "ATGGCATAACTNGGX" * 3, "chm13#chr6:31825251-31908851", "HG1#1#c:x", "Pathogenic/benign", "risk factor", "ACACACACACACACACACACACACACACAC"]
    df = spark.createDataFrame([(t,) for t in texts], "s STRING")
    both = [
        ("seq_upper(s)", S.upper("s")), ("seq_complement(s)", S.complement("s")), ("seq_revcomp(s)", S.reverse_complement("s")), ("seq_flip(s)", S.flip("s")), ("seq_sign(s)", S.sign("s")),
        ("seq_translate(s, 1)", S.translate("s", 1)), ("seq_translate_strict(s, 0)", S.translate_strict("s")), ("seq_codons(s, 2)", S.codons("s", 2)), ("seq_amino_class(left(s, 1))", S.amino_class(F.left("s", F.lit(1)))),
        ("seq_find(s, 'AC')", S.find("s", F.lit("AC"))), ("seq_offsets(s, 'AA')", S.offsets("s", F.lit("AA"))), ("seq_count(s, 'A')", S.count("s", F.lit("A"))), ("seq_tandem(s)", S.tandem("s")),
        ("seq_kind(s, s = '-')", S.kind("s", F.col("s") == "-")), ("seq_preview(s)", S.preview("s")), ("seq_chromosome(s)", S.chromosome("s")), ("seq_region_start(s)", S.region_start("s")), ("seq_sample(s)", S.sample("s")),
        ("seq_significance(s)", S.significance("s")), ("seq_query_text(s)", S.query_text("s")), ("seq_twobit(s)", S.twobit_bits("s")), ("seq_commas(length(s) * 1000)", S.commas(F.char_length("s") * 1000)),
        ("seq_zigzag(3 - length(s))", S.zigzag(F.lit(3) - F.char_length("s"))), ("seq_varint_length(length(s) * 100L)", S.varint_length(F.char_length("s") * 100)), ("seq_bits_for(length(s))", S.bits_for(F.char_length("s"))),
        ("seq_effective_order(16, length(s))", S.effective_order(F.lit(16), F.char_length("s"))),
    ]
    rows = df.select(*(c.alias(f"{k}{i}") for i, (sql, own) in enumerate(both) for k, c in (("a", F.expr(sql)), ("b", own)))).collect()
    for i, (sql, _) in enumerate(both):
        assert [r[f"a{i}"] for r in rows] == [r[f"b{i}"] for r in rows], sql


def test_amino_tables_agree_with_single_codons(spark):
    letters = "TCAGNaé"
    codons = [a + b + c for a in letters for b in letters for c in letters]
    df = spark.createDataFrame([(c,) for c in codons], "c STRING")
    for r in df.select("c", S.amino("c").alias("a"), S.translate("c").alias("b"), S.amino_strict("c").alias("x"), S.translate_strict("c").alias("y")).collect():
        assert (r["a"], r["x"]) == (r["b"], r["y"]), r["c"]
