"""Jobs from a command line: python -m ledgerloom query NAME TABLES OUT, and python -m ledgerloom ingest FOLDER OUT."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ledgerloom.sources import ingest, sinks


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="ledgerloom", description="Runs a query of the catalog, or reads a folder of documents; both write Parquet.")
    jobs = out.add_subparsers(dest="job", required=True)
    query = jobs.add_parser("query", help="a query of the catalog over a folder of tables")
    query.add_argument("name")
    query.add_argument("tables")
    read = jobs.add_parser("ingest", help="all documents of a folder")
    read.add_argument("folder")
    read.add_argument("--mode", choices=("summary", "raw"), default="summary", help="how sheets become text")
    read.add_argument("--tag", help="a tag behind every text")
    read.add_argument("--skip", help="leave out files with this in their path")
    for job in (query, read):
        job.add_argument("out")
        job.add_argument("--policy", choices=tuple(sinks.POLICIES), default="overwrite", help="what to do where out is there already")
    return out


def main(arguments: list[str] | None = None) -> None:
    given = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("ledgerloom").getOrCreate()
    if given.job == "query":
        from ledgerloom.plans import catalog

        found = catalog.queries()[given.name](spark, given.tables)
    else:
        found = ingest.loaded(spark, given.folder, given.mode, given.tag, given.skip)
    sinks.write(found, given.out, given.policy)


if __name__ == "__main__":
    main()
