"""Command line: python -m tidemark -c config.yaml."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from .config import load_config
from .log import set_up
from .model import Mode
from .operators.ledger import Ledger
from .operators.sync import SyncEngine
from .sources import open_catalog


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description="Copy whole tables from one database to another")
    p.add_argument("-c", "--config", default="config.yaml", help="configuration file")
    p.add_argument("-v", "--verbose", action="store_true", help="log details")
    p.add_argument("--log-file", help="log to this file too")
    mode = p.add_mutually_exclusive_group()
    mode.add_argument("--resume", action="store_true", help="keep what is committed and go on from there")
    mode.add_argument("--restart", action="store_true", help="forget all progress and copy everything anew")
    mode.add_argument("--verify", action="store_true", help="compare the targets with their sources; copy nothing")
    p.add_argument("--reset-table", metavar="TABLE", help="forget one table's progress; copy nothing")
    p.add_argument("--reset-all", action="store_true", help="forget all progress; copy nothing")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if all went well, 1 if any table failed, or differs."""
    p = parser()
    args = p.parse_args(argv)
    if args.reset_table is not None and not args.reset_table.strip():
        p.error("--reset-table needs a table's name")
    set_up(logging.DEBUG if args.verbose else logging.INFO, args.log_file)
    config = load_config(args.config)
    spark = spark or SparkSession.builder.appName("tidemark").getOrCreate()
    if args.reset_all or args.reset_table is not None:
        Ledger(open_catalog(spark, config.target, config.sync)).reset(None if args.reset_all else args.reset_table)
        return 0
    if args.verify:
        return int(any(isinstance(c, Exception) or not c.same for c in SyncEngine.of(spark, config).verify().values()))
    mode = Mode.RESUME if args.resume else Mode.RESTART if args.restart else Mode.FULL
    return int(any(r.error is not None for r in SyncEngine.of(spark, config).run(mode)))
