"""``python -m murmurate``: the registered queries, and the questions of a corpus, from a command line.

    list                                         names of all queries
    run NAME SF_DIR [--to FOLDER]                a query's rows, printed or written as Parquet
    sql NAME                                     the SQL it agrees with
    sweep FROM INTO CHECKPOINT                   copies that have arrived since, into a table of newest copies
    count SNAPSHOT READINGS FOLDER [--as-of T]   a capture's figures again from its readings, as files for people
    ingest LABELS NEW INTO --key K [K ...]       handed-in labels (JSON lines) over those that are there
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from murmurate import registry
from murmurate.session import local_session


def _parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="murmurate")
    sub = out.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    for name, args in (("run", ("name", "sf_dir")), ("sql", ("name",)), ("sweep", ("source", "into", "checkpoint")), ("count", ("snapshot", "readings", "folder")), ("ingest", ("labels", "new", "into"))):
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a)
    sub.choices["run"].add_argument("--to")
    sub.choices["count"].add_argument("--as-of", type=int)
    sub.choices["ingest"].add_argument("--key", nargs="+", required=True)
    return out


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    registry.load()
    if args.command in ("list", "sql"):
        print("\n".join(sorted(registry.QUERIES)) if args.command == "list" else registry.SQL.get(args.name, "none"))
        return 0
    spark = spark or local_session()
    if args.command == "run":
        df = registry.QUERIES[args.name](spark, args.sf_dir)
        df.write.mode("overwrite").parquet(args.to) if args.to else df.show(50, truncate=False)
    elif args.command == "sweep":
        from murmurate.streaming import sweeps

        sweeps.sweep_into(sweeps.arriving(spark, args.source), args.into, args.checkpoint).awaitTermination()
    elif args.command == "count":
        from murmurate.corpus import Corpus

        Corpus.from_capture(spark, args.snapshot, args.readings, as_of=args.as_of).export(args.folder)
    else:
        from murmurate.operators.labels import merged

        old, new = spark.read.json(args.labels), spark.read.json(args.new)
        merged(old, new.select(old.columns), args.key, [c for c in old.columns if c not in args.key]).write.mode("errorifexists").json(args.into)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
