"""Command line: init, run, exec, repl, help and version."""

from __future__ import annotations

import argparse
import glob
import sys
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession

from ruzi.database import Database, Outcome
from ruzi.errors import EngineError
from ruzi.printing import table_text
from ruzi.sources import store

VERSION = "0.1.0"
PROMPT, MORE = "ruzi> ", "...> "


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ruzi", description="Runs statements over Spark.")
    commands = top.add_subparsers(dest="command")
    commands.add_parser("init", help="create a database").add_argument("path", nargs="?", default="database.db")
    for name, what, many in (("run", "run a script's file", None), ("exec", "run statements", "*"), ("repl", "read statements line by line", None)):
        sub = commands.add_parser(name, help=what)
        if name != "repl":
            sub.add_argument("text", nargs=many)
        sub.add_argument("--db", help="the database's path; in memory without one")
        sub.add_argument("--create", dest="create", action="store_true", default=True)
        sub.add_argument("--no-create", dest="create", action="store_false")
    commands.add_parser("help", help="print this")
    commands.add_parser("version", help="print the version")
    return top


def opened(spark: SparkSession, path: str | None, create: bool) -> Database:
    return Database.open(spark, path, create) if path else Database.memory(spark)


def seed(database: Database) -> None:
    """A database without tables takes those of the script beside it, which has its name and a longer suffix in db."""
    path = database.path
    if path and path.lower().endswith(".db") and not database.collections():
        beside = sorted(Path(path).parent.glob(f"{glob.escape(Path(path).stem)}.?*db"))
        script = next((p for p in beside if p.is_file()), None)
        if script is not None:
            database.execute(script.read_text("utf-8"))


def printed(outcome: Outcome) -> str:
    return "".join(table_text(rows) for rows in outcome.rows)


@dataclass(frozen=True)
class Step:
    prompt: str
    output: str = ""
    error: str = ""
    exit: bool = False


class Repl:
    """Collects lines until they make whole statements."""

    def __init__(self, database: Database):
        self.database, self.lines = database, []

    def push(self, line: str) -> Step:
        if not self.lines and line.strip() == ".exit":
            return Step(PROMPT, exit=True)
        self.lines.append(line)
        source = "\n".join(self.lines)
        if not source.strip():
            self.lines.clear()
            return Step(PROMPT)
        try:
            step = Step(PROMPT, printed(self.database.execute(source)))
        except EngineError as error:
            if error.incomplete:
                return Step(MORE)
            step = Step(PROMPT, error=f"{error}\n")
        self.lines.clear()
        return step


def session() -> SparkSession:
    spark = SparkSession.builder.appName("ruzi").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def repl(database: Database) -> None:
    loop, prompt = Repl(database), PROMPT
    while True:
        try:
            line = input(prompt)
        except EOFError:
            return
        step = loop.push(line)
        sys.stdout.write(step.output)
        sys.stderr.write(step.error)
        if step.exit:
            return
        prompt = step.prompt


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    flags = parser().parse_args(argv)
    if flags.command in (None, "help"):
        parser().print_help()
        return 0
    if flags.command == "version":
        print(VERSION)
        return 0
    try:
        spark = spark or session()
        if flags.command == "init":
            if store.exists(flags.path) or Path(flags.path).exists():
                raise EngineError("E_IO", f"{flags.path} is already there")
            Database.open(spark, flags.path, create=True)
            print(f"Created {flags.path}")
            return 0
        if flags.command == "run":
            try:
                source = Path(flags.text).read_text("utf-8")
            except OSError as error:
                raise EngineError("E_IO", f"{flags.text} can't be read: {error}") from error
            sys.stdout.write(printed(opened(spark, flags.db, flags.create).execute(source)))
            return 0
        database = opened(spark, flags.db, flags.create)
        seed(database)
        if flags.command == "exec":
            if not (source := " ".join(flags.text)).strip():
                raise EngineError("E_MISSING_PARAM", "exec needs statements")
            sys.stdout.write(printed(database.execute(source)))
        else:
            repl(database)
    except EngineError as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
