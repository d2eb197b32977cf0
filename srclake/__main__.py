"""python -m srclake PATH: index a repository, then answer questions; "deps: file" lists what depends on a file."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from srclake.plans.engine import Engine
from srclake.plans.lineage import scratch
from srclake.shipping import ship


def main(args: list[str]) -> int:
    if len(args) != 1:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("srclake").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate()
    ship(spark)
    engine = Engine(spark, scratch(spark, "store"))
    print(engine.ingest("repo", args[0]))
    for line in sys.stdin:
        line = line.strip()
        if line in ("exit", "quit"):
            break
        if line.startswith("deps:"):
            print("\n".join(engine.blast_radius("repo", line[5:].strip())) or "nothing depends on it")
        elif line:
            for r in engine.retrieve("repo", line):
                print(f"{r['file_path']} :: {r['name']} ({r['start_line']}-{r['end_line']}) {r['score']:.3f}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
