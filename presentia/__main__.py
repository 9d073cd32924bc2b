"""python -m presentia MANIFEST MARKERS OUTPUT [--strategy S] [--ordered]"""

import argparse

from pyspark.sql import SparkSession

from presentia import api


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="presentia", description="Which markers occur in which genomes.")
    parser.add_argument("genomes", help="manifest of genome files, one path a line")
    parser.add_argument("markers", help="CSV of id and sequence, no header")
    parser.add_argument("output", help='folder for "name bits" lines')
    parser.add_argument("--strategy", default="auto", choices=["auto", "nested", "seeded", "sampled", "shuffled", "by_length"])
    parser.add_argument("--ordered", action="store_true", help="keep the manifest's order")
    a = parser.parse_args(args)
    api.run(SparkSession.builder.appName("presentia").getOrCreate(), a.genomes, a.markers, a.output, a.strategy, a.ordered)


if __name__ == "__main__":
    main()
