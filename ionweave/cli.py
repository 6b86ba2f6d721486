"""Command line: ``python -m ionweave.cli peaks.mgf clusters --precursor_tol 20 ppm``."""

from __future__ import annotations

import logging
import sys

from pyspark.sql import SparkSession

from . import __version__
from .config import described, parse
from .plans.pipeline import run


def main(args: list[str] | str | None = None) -> int:
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    settings = parse(args)
    log = logging.getLogger("ionweave")
    log.info("ionweave %s", __version__)
    for line in described(settings):
        log.debug(line)
    spark = SparkSession.builder.appName("ionweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return run(spark, settings)


if __name__ == "__main__":
    sys.exit(main())
