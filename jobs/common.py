"""What the jobs share: their command line, their log, and a folder for a query's run."""

from __future__ import annotations

import argparse
import json
import logging
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("jobs")


def arguments(what: str, config: str, paths: list[str], argv: list[str] | None = None) -> dict:
    """The config file's values, those of the command line over them."""
    parser = argparse.ArgumentParser(description=what)
    parser.add_argument("--config", default=config)
    for name in paths:
        parser.add_argument(f"--{name}")
    given = vars(parser.parse_args(argv))
    with open(given.pop("config")) as f:
        values = json.load(f)
    values.update({k: v for k, v in given.items() if v is not None})
    missing = [p for p in paths if not values.get(p)]
    if missing:
        parser.error(f"no path given for: {', '.join(missing)}")
    return values


def launch(name: str, run, values: dict) -> None:
    """Runs the job's function in a session of its own."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, **values).show(20, False)
    finally:
        spark.stop()


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{path}/{name}.parquet")
    log.info("reads %s/%s.parquet: %d rows of %s", path, name, rows.count(), ", ".join(rows.columns))
    return rows


def told(rows: DataFrame, path: str, by: str) -> None:
    """Logs what a path holds now, in rows by the value of a column."""
    for r in rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(by).collect():
        log.info("wrote %s: %s=%s, %d rows", path, by, r[by], r["n"])


def run_folder(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder; the files stay."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "file:///tmp/loomgraph"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
