"""Command line: synth, import, measure, verify, stats, report and tile."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .bundle import Bundle, differences
from .operators import layout, measure, walks, windows
from .shipping import ship
from .sources import container, gfa, synth, tables
from .workspace import fresh_folder


def session() -> SparkSession:
    spark = SparkSession.builder.appName("loomgraph").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    return spark


def load(spark: SparkSession, path: str) -> Bundle:
    """A Parquet bundle if the path is a folder of one, else a container."""
    return container.read(spark, path) if path.endswith(".bin") or "." in path.rsplit("/", 1)[-1] else Bundle.load(spark, path)


def save(b: Bundle, path: str) -> None:
    container.write(b, path) if "." in path.rsplit("/", 1)[-1] else b.save(path)


def _int(text: str | None, default: int) -> int:
    try:
        return int(text) if text is not None else default
    except ValueError:
        return default


def cmd_synth(spark: SparkSession, a: argparse.Namespace) -> str:
    p = synth.Parameters(haplotypes=_int(a.haplotypes, 8), blocks=_int(a.blocks, 60), block_len=_int(a.block_len, 400), seed=_int(a.seed, 42))
    b = synth.generate(spark, p)
    save(b, a.out)
    if a.gfa:
        gfa.write(b, a.gfa)
    return f"{b.segments.count()} segments, {b.walks.count()} walks written to {a.out}"


def cmd_import(spark: SparkSession, a: argparse.Namespace) -> str:
    b = gfa.read(spark, a.gfa)
    if b.segments.isEmpty():
        raise SystemExit(f"{a.gfa} has no segments")
    save(b, a.out)
    return f"{b.segments.count()} segments, {b.walks.count()} walks written to {a.out}"


def _measured(b: Bundle, external: bool, provenance: dict[str, str]) -> tuple[str, object]:
    results = measure.results(b, external=external).cache()
    best, base = measure.best(results).cache(), measure.baselines(b, external=external).cache()
    cohort = walks.walk_lengths(b).agg(F.coalesce(F.sum("bases"), F.lit(0)).alias("total_bases"))
    record = tables.ledger_record(best, results, base, measure.totals(best, cohort), provenance)
    sections = results.select("section_ord", "section", "bases").distinct().join(best, "section").orderBy("section_ord").collect()
    text = tables.report([(r["section"], r["bases"], r["best_bits"]) for r in sections], [(r["name"], r["bits"]) for r in base.orderBy("ord").collect()], cohort.first()[0])
    return text, record


def cmd_measure(spark: SparkSession, a: argparse.Namespace) -> str:
    text, record = _measured(load(spark, a.input), not a.no_external, {})
    if a.json:
        with open(a.json, "w") as f:
            f.write(record.first()[0])
    return text


def cmd_report(spark: SparkSession, a: argparse.Namespace) -> str:
    text, record = _measured(load(spark, a.input), not a.no_external, tables.stamped(a.dataset, a.input))
    tables.append_ledger(record, a.ledger)
    return text


def cmd_verify(spark: SparkSession, a: argparse.Namespace) -> str:
    b, path = load(spark, a.input), fresh_folder(spark, "verify")
    b.save(f"{path}/again")
    if bad := differences(b, Bundle.load(spark, f"{path}/again")).first():
        raise SystemExit(f"the graph does not survive being written and read: {bad['table']} {bad['row']}")
    if bad := walks.unspellable(b).first():
        raise SystemExit(f"walk {bad['walk_idx']} names a missing segment")
    if a.gfa and (bad := walks.mismatches(b, gfa.read(spark, a.gfa)).first()):
        raise SystemExit(f"walk {bad['name']} differs from the source")
    return "verified"


def cmd_stats(spark: SparkSession, a: argparse.Namespace) -> str:
    row = walks.stats(load(spark, a.input)).first().asDict()
    return "\n".join(f"{k:<18}{v:>16,}" for k, v in row.items())


def cmd_tile(spark: SparkSession, a: argparse.Namespace) -> str:
    b = load(spark, a.input)
    at = layout.region(b).first()
    windows.write_tiles(layout.lanes(layout.positions(b)), b.segments, b.edges, walks.span(b).first()[0], at["chrom"], at["start"], a.out)
    return f"tiles written to {a.out}"


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomgraph", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name, options in {
        "synth": ["out", "gfa?", "haplotypes?", "blocks?", "block-len?", "seed?"], "import": ["gfa", "out"], "measure": ["in", "json?", "no-external!"],
        "verify": ["in", "gfa?"], "stats": ["in"], "report": ["in", "ledger=results/metrics/ledger", "dataset=unnamed", "no-external!"], "tile": ["in", "out"],
    }.items():
        p = sub.add_parser(name)
        for o in options:
            flag, _, default = o.rstrip("?!").partition("=")
            kind = {"action": "store_true"} if o.endswith("!") else {"default": default or None, "required": not (o.endswith("?") or default)}
            p.add_argument(f"--{flag}", dest="input" if flag == "in" else flag.replace("-", "_"), **kind)
    a = parser.parse_args(argv)
    print(globals()[f"cmd_{a.command}"](session(), a))
    return 0


if __name__ == "__main__":
    sys.exit(main())
