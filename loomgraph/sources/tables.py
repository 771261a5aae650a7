"""Small tabular sources and sinks: dataset manifests, annotations and the ledger."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(key, url, notes) of a tab-separated list with # comments."""
    return spark.read.schema("key STRING, url STRING, notes STRING").csv(path, sep="\t", comment="#").filter("key <> 'key'")


def significant(variants: DataFrame) -> DataFrame:
    """variants (pos, id, sig array, consequence): (pos, id, sig, cons) of those that mean something, by position.

    A variant without significance, or whose only one is benign, is left out.
    """
    lone = (F.size("sig") == 1) & F.lower(F.get("sig", F.lit(0))).isin("benign", "likely benign")
    kept = variants.filter((F.size("sig") > 0) & ~lone)
    return kept.select("pos", "id", F.array_join("sig", ", ").alias("sig"), F.replace("consequence", F.lit("_"), F.lit(" ")).alias("cons")).orderBy("pos", "id")


def ledger_record(bests: DataFrame, results: DataFrame, baselines: DataFrame, totals: DataFrame, provenance: dict[str, str]) -> DataFrame:
    """(json): one ledger record."""
    coders = results.groupBy("section_ord", "section", "bases").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("coder_ord", "coder", "bits"))), lambda x: F.struct(x["coder"], x["bits"]))).alias("coders"))
    joined = coders.join(bests, "section")
    sections = joined.select(
        "section_ord", F.to_json(F.struct(F.col("section").alias("name"), "bases", "best_coder", "best_bits", "coders")).alias("j")
    ).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_ord", "j"))), lambda x: x["j"]), ",").alias("sections"))
    base = baselines.agg(F.to_json(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name", "bits"))), lambda x: F.struct(x["name"], x["bits"])))).alias("baselines"),
                         F.min_by("bits", F.when(F.contains("name", F.lit("2bit_percopy")), F.col("ord"))).alias("two"), F.min_by("bits", F.when(F.contains("name", F.lit("concat_nograph")), F.col("ord"))).alias("flat"))
    one = totals.crossJoin(sections).crossJoin(base)
    ratio = lambda c: F.when((F.col("total_bits") > 0) & F.col(c).isNotNull(), F.format_string("%.4f", F.col(c) / F.col("total_bits")))
    note = F.to_json(F.create_map(*(F.lit(x) for kv in provenance.items() for x in kv))) if provenance else F.lit("{}")
    return one.select(F.concat(
        F.lit('{"total_bases":'), F.col("total_bases").cast("string"), F.lit(',"total_bits":'), F.col("total_bits").cast("string"), F.lit(',"bits_per_char":'), F.format_string("%.6f", "bits_per_char"),
        F.coalesce(F.concat(F.lit(',"reduction_vs_2bit":'), ratio("two")), F.lit("")), F.coalesce(F.concat(F.lit(',"reduction_vs_nograph":'), ratio("flat")), F.lit("")),
        F.lit(',"sections":['), "sections", F.lit('],"baselines":'), "baselines", F.lit(',"provenance":'), note, F.lit("}"),
    ).alias("json"))


def append_ledger(record: DataFrame, path: str) -> None:
    record.select(F.col("json").alias("value")).coalesce(1).write.mode("append").text(path)


def stamped(dataset: str, source: str) -> dict[str, str]:
    return {"dataset": dataset, "input": source, "unixtime": str(int(time.time()))}


def report(sections: list[tuple[str, int, int]], baselines: list[tuple[str, int]], total_bases: int) -> str:
    """A table of (section, bases, bits) and baselines for people to read."""
    total = sum(x[2] for x in sections)
    per = lambda bits, n: bits / n if n else 0.0
    lines = [f"bases described {total_bases:>16,}", f"total bits      {total:>16,}  ({per(total, total_bases):.4f} bits/char)"]
    lines += [f"{name:<24}{bits:>16,} bits  {per(bits, total):.2f} x the total" for name, bits in baselines]
    lines += ["", f"{'section':<22} {'bases':>14} {'bits':>14} {'bits/char':>10}"]
    lines += [f"{name:<22} {n:>14,} {bits:>14,} {per(bits, n):>10.4f}" for name, n, bits in sections]
    lines += ["-" * 63, f"{'TOTAL':<22} {total_bases:>14,} {total:>14,} {per(total, total_bases):>10.4f}"]
    return "\n".join(lines) + "\n"
