"""Command line: `python -m loomgraph list`, `run NAME DIR [--limit N] [--out PATH]`, `sizes DIR`."""

from __future__ import annotations

import argparse
from pathlib import Path

from loomgraph.plans import catalog
from loomgraph.session import local_session
from loomgraph.sources.files import markdown_table, write_rows


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="loomgraph", description=__doc__)
    sub = p.add_subparsers(dest="do", required=True)
    sub.add_parser("list", help="the names of all queries")
    run = sub.add_parser("run", help="one query over a folder of Parquet tables")
    run.add_argument("name", choices=sorted(catalog.QUERIES))
    run.add_argument("folder")
    run.add_argument("--limit", type=int, default=20, help="rows shown")
    run.add_argument("--out", help="write all rows as JSON lines below this path")
    sizes = sub.add_parser("sizes", help="rows of each table of a folder")
    sizes.add_argument("folder")
    a = p.parse_args(argv)
    if a.do == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return
    spark = local_session()
    if a.do == "sizes":
        rows = [(f.stem, spark.read.parquet(str(f)).count()) for f in sorted(Path(a.folder).glob("*.parquet"))]
        print(markdown_table(spark.createDataFrame(rows, "name string, n_rows bigint").orderBy("name")))
        return
    df = catalog.QUERIES[a.name](spark, a.folder)
    if a.out:
        write_rows(df, a.out)
    else:
        print(markdown_table(df.limit(a.limit)))


if __name__ == "__main__":
    main()
