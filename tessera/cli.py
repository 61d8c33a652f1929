"""Console: convert text to heap files, print heap files, run SQL.

    python -m tessera.cli convert data.txt OUT "int,string,int" [SEP]
    python -m tessera.cli print data.dat N_INT_COLUMNS
    python -m tessera.cli parser SCHEMA_FILE [-explain] [-f QUERIES] [-d DATABASE_FOLDER]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from .errors import TesseraError
from .session import Engine, lines
from .plans.sqlparse import split_statements, take_statements
from .sources.heap import convert, read_heap
from .types import schema_of


def _spark() -> SparkSession:
    return SparkSession.builder.appName("tessera").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _statement(engine: Engine, text: str, explain: bool) -> None:
    began = time.time()
    try:
        if explain and text.lstrip().lower().startswith("select"):
            print(engine.explain(text))
        for line in lines(engine.sql(text)):
            print(line)
        print(f"{time.time() - began:.2f} seconds")
    except TesseraError as e:
        print(f"{type(e).__name__}: {e}")


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__)
        return 1
    command, rest = args[0], args[1:]
    if command == "convert":
        kinds = rest[2].split(",")
        n = convert(_spark(), rest[0], rest[1], schema_of([(f"f{k}", x.strip()) for k, x in enumerate(kinds)]), rest[3] if len(rest) > 3 else ",")
        print(f"{n} rows")
    elif command == "print":
        df = read_heap(_spark(), rest[0], schema_of([(f"f{k}", "int") for k in range(int(rest[1]))]))
        for line in lines(df):
            print(line)
    elif command == "parser":
        explain = "-explain" in rest
        option = lambda name: rest[rest.index(name) + 1] if name in rest else None
        engine = Engine(_spark(), option("-d"))
        engine.load_schema(Path(rest[0]).read_text(), str(Path(rest[0]).resolve().parent))
        engine.analyze()
        if option("-f"):
            for s in split_statements(Path(option("-f")).read_text()):
                _statement(engine, s, explain)
            return 0
        held = ""
        for line in sys.stdin:
            statements, held = take_statements(held + line)
            for text in statements:
                if text.lower() in ("quit", "exit"):
                    return 0
                _statement(engine, text, explain)
    else:
        print(__doc__)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
