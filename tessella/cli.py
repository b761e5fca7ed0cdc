"""The command line: ``python -m tessella.cli demo | ingest | query | console``."""

from __future__ import annotations

import argparse
import logging
import os
import sys
import time

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from tessella.executor import QueryExecutor, ResultSet
from tessella.plans.parser import ParseError
from tessella.session import local_session
from tessella.sources.datasets import ALIASES, DATASETS, dataset
from tessella.table import Table

SHOWN, PAGE = 1000, 50
log = logging.getLogger("tessella")


def render(result: ResultSet, most: int = SHOWN) -> str:
    """A result as aligned text, with a note where rows are left out."""
    rows = [[str(v) for v in row] for row in result.results[:most]]
    widths = [max(map(len, column)) for column in zip(result.columns, *rows)]
    line = lambda cells: "  ".join(c.ljust(w) for c, w in zip(cells, widths)).rstrip()
    shown = [line(result.columns), line(["-" * w for w in widths]), *map(line, rows)]
    if len(result) > most:
        shown.append(f"... {len(result) - most} more rows")
    return "\n".join(shown)


def explain_error(error: Exception) -> str:
    """One line for each class of error a statement can meet."""
    if isinstance(error, ParseError):
        return f"Cannot read the statement: {error}"
    if isinstance(error, NotImplementedError):
        return f"Not supported: {error}"
    if isinstance(error, ValueError):
        return f"Error: {error}"
    if isinstance(error, PySparkException):
        return f"Failed: {error.getCondition() or str(error).splitlines()[0]}"
    return f"{type(error).__name__}: {error}"


def _page(text: str) -> None:
    lines = text.splitlines()
    for at in range(0, len(lines), PAGE):
        print("\n".join(lines[at : at + PAGE]))
        if at + PAGE < len(lines) and sys.stdin.isatty() and input("-- more (q ends) -- ").strip().lower() == "q":
            return


def console(executor: QueryExecutor, read=input) -> None:
    """Statements from the keyboard until ``exit``, ``quit`` or the end of input."""
    try:
        import readline

        words = [*executor.table.column_names(), "SELECT", "FROM", "WHERE", "GROUP BY", "ORDER BY", "LIMIT", "COUNT", "SUM", "AVG", "DISTINCT"]
        readline.set_completer(lambda text, k: [*(w for w in words if w.lower().startswith(text.lower())), None][k])
        readline.parse_and_bind("tab: complete")
    except ImportError:
        pass
    while True:
        try:
            statement = read("tessella> ").strip()
        except EOFError:
            return
        except KeyboardInterrupt:
            print()
            continue
        if statement.lower().rstrip(";") in ("exit", "quit"):
            return
        if not statement:
            continue
        began = time.perf_counter()
        try:
            result = executor.execute(statement)
        except Exception as error:  # noqa: BLE001
            print(explain_error(error))
            continue
        _page(render(result))
        print(f"{len(result)} rows, {time.perf_counter() - began:.2f} s")


def _stats(table: Table) -> str:
    return ", ".join(f"{n} {what}" for what, n in table.stats().items())


def _demo(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.name is None:
        print("\n".join([*sorted(DATASETS), *(f"{a} = {n}" for a, n in sorted(ALIASES.items()))]))
        return
    name = ALIASES.get(args.name, args.name)
    path = os.path.join(args.dir, name)
    if args.force or not os.path.isdir(path):
        table = Table.write(dataset(spark, args.source, name), path, args.segments)
    else:
        table = Table.from_data_dir(spark, path)
    print(f"{path}: {_stats(table)}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessella", description="Queries over segmented tables.")
    commands = parser.add_subparsers(dest="command", required=True)
    demo = commands.add_parser("demo", help="build a table from a named dataset; without a name, list them")
    demo.add_argument("name", nargs="?")
    demo.add_argument("-d", "--dir", default="tables")
    demo.add_argument("--source", default=".", help="folder of the datasets' Parquet tables")
    demo.add_argument("--segments", type=int, default=1)
    demo.add_argument("--force", action="store_true", help="build again where there is one")
    ingest = commands.add_parser("ingest", help="read a file into a table")
    ingest.add_argument("-d", "--dir", required=True)
    ingest.add_argument("-s", "--source", required=True)
    ingest.add_argument("--segments", type=int, default=1)
    query = commands.add_parser("query", help="run one statement")
    query.add_argument("-d", "--dir", required=True)
    query.add_argument("sql")
    shell = commands.add_parser("console", help="run statements from the keyboard")
    shell.add_argument("-d", "--dir", required=True)
    for command in (demo, ingest, query, shell):
        command.add_argument("-v", "--verbose", action="count", default=0)
    args = parser.parse_args(argv)
    logging.basicConfig(level=[logging.WARNING, logging.INFO, logging.DEBUG][min(2, args.verbose)])
    spark = spark or local_session()
    try:
        if args.command == "demo":
            _demo(spark, args)
        elif args.command == "ingest":
            table = Table.from_ingest_source(spark, args.dir, args.source, args.segments)
            print(f"{args.dir}: {_stats(table)}")
        elif args.command == "query":
            began = time.perf_counter()
            print(render(QueryExecutor.from_data_dir(spark, args.dir).execute(args.sql)))
            log.info("%.2f s", time.perf_counter() - began)
        else:
            console(QueryExecutor.from_data_dir(spark, args.dir))
    except (ValueError, NotImplementedError, PySparkException) as error:
        print(explain_error(error), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
