"""A prompt for a database: python -m marlstone.repl PATH [--planner basic|heuristic]."""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable

from marlstone.errors import EngineError
from marlstone.plans.explain import text
from marlstone.session import Connection, Engine, ResultSet
from marlstone.types import Kind

HELP = "\n".join(
    f"{names:<24}{what}"
    for names, what in [
        (":h :help", "list the commands"),
        (":t :table NAME", "columns of a table and their indexes"),
        (":v :view NAME", "text of a view"),
        (":e :explain SELECT ...", "plan of a query with its costs"),
        (":q :quit :exit", "leave"),
    ]
)


def shown(result: ResultSet, out: Callable[[str], None]) -> int:
    columns = result.metadata.schema.columns
    cell = lambda c, v: f"{v!s:<{c.display_size}}" if c.kind in (Kind.VARCHAR, Kind.BOOL, Kind.DATE) else f"{v!s:>{c.display_size}}"
    out(" ".join(cell(c, c.name) for c in columns))
    out("-" * sum(c.display_size + 1 for c in columns))
    n = 0
    while result.next():
        out(" ".join(cell(c, str(v).lower() if isinstance(v := result.get(c.name), bool) else v) for c in columns))
        n += 1
    result.close()
    return n


def meta(connection: Connection, line: str, out: Callable[[str], None]) -> bool:
    """Runs a command that starts with a colon. False ends the program."""
    command, _, rest = line.partition(" ")
    command, rest = command.lower(), rest.strip()
    if command in (":h", ":help"):
        out(HELP)
    elif command in (":q", ":quit", ":exit"):
        connection.close()
        out("closed")
        return False
    elif command in (":t", ":table"):
        if not rest:
            out("which table? SELECT tblname FROM tblcat; lists them")
        else:
            indexes = connection.index_info(rest)
            for c in connection.table_schema(rest).columns:
                kind = f"VARCHAR({c.length})" if c.kind is Kind.VARCHAR else c.spark or c.kind.name
                out(f"{c.name:<20} {kind:<15} {indexes.get(c.name, '')}".rstrip())
    elif command in (":v", ":view"):
        if not rest:
            out("which view? SELECT viewname FROM viewcat; lists them")
        else:
            out("{}: {}".format(*connection.view_definition(rest)))
    elif command in (":e", ":explain"):
        if rest.split(" ")[0].lower() == "select":
            out(text(connection.create_statement(rest).explain_plan()))
        else:
            out("only queries have plans")
    else:
        out(f"no command {command}; :help lists them")
    return True


def run(connection: Connection, line: str, out: Callable[[str], None] = print) -> bool:
    """One line of input. False ends the program."""
    line = line.strip()
    began = time.monotonic()
    try:
        if line.startswith(":"):
            return meta(connection, line, out)
        if line.split(" ")[0].lower() == "select":
            n = shown(connection.create_statement(line).execute_query(), out)
            out(f"Rows {n} ({time.monotonic() - began:.3f}s)")
        elif line:
            n = connection.update(line)
            out(f"Affected {n} ({time.monotonic() - began:.3f}s)")
    except EngineError as e:
        out(f"{type(e).__name__}: {e}")
    return True


def main() -> None:
    from pyspark.sql import SparkSession

    options = argparse.ArgumentParser()
    options.add_argument("path")
    options.add_argument("--planner", choices=["basic", "heuristic"], default="heuristic")
    given = options.parse_args()
    connection = Engine(SparkSession.builder.getOrCreate()).connect(given.path, given.planner)
    while True:
        try:
            if not run(connection, input("> ")):
                return
        except EOFError:
            return


if __name__ == "__main__":
    main()
