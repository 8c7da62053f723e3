"""``python -m quiremill PATH -o FOLDER [--layout flow|lineseg]``: packages to HTML files."""

import argparse

from pyspark.sql import SparkSession

from quiremill.plans import office


def main() -> None:
    args = argparse.ArgumentParser(prog="quiremill", description="Convert packages to HTML.")
    args.add_argument("path", help="a package or a folder of packages")
    args.add_argument("-o", "--output", required=True, help="folder for the HTML files")
    args.add_argument("--layout", choices=("flow", "lineseg"), default="flow")
    given = args.parse_args()
    spark = SparkSession.builder.appName("quiremill").getOrCreate()
    for row in office.convert(spark, given.path, given.output, given.layout == "lineseg").toLocalIterator():
        print(row.path)
    spark.stop()


if __name__ == "__main__":
    main()
