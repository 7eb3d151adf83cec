"""``python -m quillon scan URI [--out FORMAT://PATH]``, ``diff A B``, ``typos STATS``, ``deps EDGES NAME``, ``info``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillon", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan")
    s.add_argument("uri")
    s.add_argument("--out", default="text")
    s.add_argument("--min-score", type=int, default=None)
    s.add_argument("--tags", default=None)
    s.add_argument("--rules", default=None, help="a file of more rules, in JSON or YAML")
    s.add_argument("-v", "--verbose", action="count", default=0)
    d = sub.add_parser("diff")
    d.add_argument("left")
    d.add_argument("right")
    d.add_argument("--out", default="text", help="text, or json://, parquet:// or sqlite:// and a path")
    t = sub.add_parser("typos")
    t.add_argument("stats")
    t.add_argument("--threshold", type=int, default=10000)
    t.add_argument("--limit", type=int, default=100)
    r = sub.add_parser("deps")
    r.add_argument("edges")
    r.add_argument("name")
    sub.add_parser("info")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("quillon").getOrCreate()
    from quillon import registry

    registry.ship(spark)
    if a.command == "scan":
        from quillon.plans.scan import scan
        from quillon.sinks import formats

        from quillon.plans.scan import settings_of

        found = scan(spark, a.uri, settings=settings_of(a.rules) if a.rules else None)
        formats.write(found, a.out, min_score=a.min_score, tags=a.tags, verbosity=a.verbose + 1)
    elif a.command == "diff":
        from quillon.operators import diff
        from quillon.sources import readers

        from quillon.sinks import formats

        formats.write_changes(diff.snapshots(*readers.read_pair(spark, a.left, a.right)), a.out)
    elif a.command == "typos":
        from quillon.operators import packages as pk
        from quillon.sources import readers

        stats = readers.download_stats(spark, a.stats)
        pk.lookalikes(stats.select("name"), pk.popular(stats, a.threshold).select("name")).orderBy("name", "popular").show(a.limit, truncate=False)
    elif a.command == "deps":
        from quillon.operators import packages as pk
        from quillon.sources import readers

        found = pk.dependents(readers.reverse_dependencies(spark, a.edges), spark.createDataFrame([(a.name,)], "name string")).orderBy("depth", "name")
        for row in found.toLocalIterator():
            print(row.depth, row.name)
    else:
        from quillon.plans import scan as plan

        print("analyzers:", *plan._analyzers)
        print("queries:", *registry.queries())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
