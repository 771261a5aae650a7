"""Queries that look at the whole of their input."""

import lzma
import re

from pyspark.sql import functions as F

from loomgraph.plans import registry


def _parts(spark, d):
    n = [1, 1200, 1201, 5000, 90_000]
    rows = [(k, f"acGT{k} part", "TTA box", "Brand#C", 1 + i) for i, k in enumerate(n)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string, p_size int").write.mode("overwrite").parquet(f"{d}/part.parquet")
    return n


def test_overview_has_every_part(spark, tmp_path):
    n = _parts(spark, tmp_path)
    out = registry.queries()["q9_overview"](spark, str(tmp_path))
    assert {"kind", "seq"} <= set(out.columns)
    assert sorted(r["node_id"] for r in out.collect()) == n
    assert out.filter(F.col("x") > 60_000).count() == 3


def test_codons_of_whole_texts(spark, tmp_path):
    texts = {1: "atg" * 20 + "🙂\nTAA" * 5 + "GCNNNAC", 2: "AT", 3: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {q: {(r["doc_id"], r["aa"]): r["n"] for r in registry.queries()[q](spark, str(tmp_path)).collect()} for q in ("f5_codon", "f8_strict_codon", "f21_amino_class")}
    t = texts[1].upper()
    codons = [t[i : i + 3] for i in range(0, len(t) - 2, 3)]
    strict = [{"ATG": "M", "TAA": "*", "AGC": "S"}.get(c, "X") for c in codons]
    assert strict.count("M") == 20 and strict.count("*") >= 1
    loose = ["A" if c[:2] == "GC" else a for c, a in zip(codons, strict)]
    assert got["f8_strict_codon"] == {(1, a): strict.count(a) for a in set(strict)}
    assert got["f5_codon"] == {(1, a): loose.count(a) for a in set(loose)} == got["f21_amino_class"]
    kinds = {r["aa"]: r["kind"] for r in registry.queries()["f21_amino_class"](spark, str(tmp_path)).collect()}
    assert kinds["M"] == "hydrophobic" and kinds["X"] == "other"


def test_all_baselines_and_results(spark, tmp_path):
    _parts(spark, tmp_path)
    steps = [(1, 1, 1, 7, "N"), (1, 2, 1200, 7, "R"), (2, 1, 5000, 7, "N")]
    spark.createDataFrame(steps, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, f"N{i}") for i in range(25)], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    # Of each part's name the letters ACGT; the last part of order 1 is reversed and complemented.
    seq = re.sub("[^ACGT]", "", "ACGT1 PARTTTA BOXBRAND#C")
    back = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    cohort = [seq + back, seq]
    got = {r["name"]: r["bits"] for r in registry.queries()["m12_baselines_whole"](spark, str(tmp_path)).collect()}
    assert len(got) == 4 and any(n.startswith("order") and n.endswith("_concat_nograph") for n in got)
    assert got["2bit_percopy"] == 2 * sum(map(len, cohort))
    assert got["percopy_xz"] == sum(8 * len(lzma.compress(c.encode(), preset=9)) for c in cohort)
    coders = {(r["section"], r["coder"]) for r in registry.queries()["m8_results"](spark, str(tmp_path)).collect()}
    assert ("repeats", "dict-factored") in coders and ("walks", "raw") in coders
