"""Command line: list, run or explain catalog queries, print their SQL, audit a folder of rules.

python -m tracewarden list | sql NAME | explain NAME --data DIR | run NAME --data DIR [--out PATH] [--format parquet] | rules DIR
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from tracewarden.plans import catalog
from tracewarden.session import local_session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tracewarden", description=__doc__.splitlines()[0])
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of all queries")
    sub.add_parser("sql", help="a query's SQL").add_argument("name")
    for command in ("run", "explain"):
        c = sub.add_parser(command)
        c.add_argument("name")
        c.add_argument("--data", required=True, help="folder of Parquet tables")
        if command == "run":
            c.add_argument("--out", help="write the whole result there instead of showing its first rows")
            c.add_argument("--format", default="parquet", choices=("parquet", "csv", "json"))
            c.add_argument("--rows", type=int, default=20, help="rows to show")
    sub.add_parser("rules", help="how many rules of a folder can be evaluated, by reason").add_argument("folder")
    a = p.parse_args(argv)
    queries = catalog.queries()
    if a.command == "list":
        print("\n".join(sorted(queries)))
        return 0
    if a.command != "rules" and a.name not in queries:
        print(f"no query named {a.name}", file=sys.stderr)
        return 2
    if a.command == "sql":
        sql = catalog.oracle_sql().get(a.name)
        print(sql or f"{a.name} has no SQL")
        return 0 if sql else 1
    spark = local_session()
    if a.command == "rules":
        from tracewarden.sources.knowledge import yaml_rules

        yaml_rules(spark, a.folder).groupBy("reason").agg(F.count("*").alias("rules")).orderBy("reason").show(100, False)
        return 0
    d = queries[a.name](spark, a.data)
    if a.command == "explain":
        d.explain("formatted")
    elif a.out:
        d.write.mode("errorifexists").format(a.format).save(a.out)
    else:
        d.show(a.rows, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
