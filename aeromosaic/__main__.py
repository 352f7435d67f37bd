"""Mosaic a directory of images: ``spark-submit`` this file, or ``python -m aeromosaic``."""

import argparse

from pyspark.sql import SparkSession

from aeromosaic import ship
from aeromosaic.functions.ordering import clear_shared
from aeromosaic.operators.mosaic import mosaic_summary
from aeromosaic.plans.orthomosaic import mosaic_directory


def main():
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--input_dir", required=True, help="directory all executors can read")
    parser.add_argument("--output", required=True, help="parquet folder for the picture variants")
    parser.add_argument("--min_matches", type=int, default=10)
    parser.add_argument("--ratio", type=float, default=0.6)
    parser.add_argument("--window", type=int, default=3, help="how far a chain may skip ahead")
    parser.add_argument("--first_strip", action="store_true", help="only the strip of the first frame")
    parser.add_argument("--box", help="width,height to fit frames into, or by_count; full size without")
    options = vars(parser.parse_args())
    spark = ship(SparkSession.builder.appName("aeromosaic").getOrCreate())
    directory, output = options.pop("input_dir"), options.pop("output")
    options["every_strip"] = not options.pop("first_strip")
    if options["box"] and options["box"] != "by_count":
        options["box"] = tuple(map(int, options["box"].split(",")))
    tables = mosaic_directory(spark, directory, output, **options)
    mosaic_summary(tables["cropped"]).show(truncate=False)
    tables["log"].report().show(50, truncate=False)
    tables["counts"].show()
    tables["status"].where("status <> 'ok'").show(truncate=False)
    tables["failures"].show(truncate=False)
    clear_shared(spark)
    spark.stop()


if __name__ == "__main__":
    main()
