"""A prompt: statements end in a semicolon; \\d, \\d table and \\di list; exit leaves. `python -m quillon.cli FOLDER`."""

from __future__ import annotations

import sys
from collections.abc import Iterable
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine, Session
from .errors import EngineError
from .plans.lexer import statements
from .types import kind_of, type_name


#: Rows that the prompt shows at most.
SHOWN = 10_000


def formatted(df: DataFrame) -> str:
    """Rows as an aligned table, numbers to the right, and their count. Of more than SHOWN rows it says that there are more."""
    found = df.limit(SHOWN + 1).collect()
    rows = [[str(v).lower() if isinstance(v, bool) else str(v) for v in r] for r in found[:SHOWN]]
    widths = [max(map(len, [name, *(r[i] for r in rows)])) for i, name in enumerate(df.columns)]
    right = [kind_of(f.dataType) in ("int", "long") for f in df.schema]

    def line(cells: Iterable[str]) -> str:
        return "|".join(f" {c.rjust(w) if r else c.ljust(w)} " for c, w, r in zip(cells, widths, right, strict=True)).rstrip()

    rule = "+".join("-" * (w + 2) for w in widths)
    count = f"({len(rows)} row{'s' * (len(rows) != 1)})" if len(found) <= SHOWN else f"(the first {SHOWN} rows; there are more)"
    return "\n".join([line(df.columns), rule, *map(line, rows), count])


class Prompt:
    def __init__(self, engine: Engine, out: TextIO):
        self.engine, self.out, self.session = engine, out, Session(engine)

    def say(self, text: str) -> None:
        print(text, file=self.out)

    def meta(self, line: str) -> None:
        words = line.split()
        if words[0] == "\\di":
            self.say(formatted(self.engine.indices()))
        elif words[0] == "\\d" and len(words) == 1:
            self.say(formatted(self.engine.tables()))
        elif words[0] == "\\d":
            with self.engine.begin() as t:
                self.say("\n".join(f"{f.name} {type_name(f)}" for f in t.schema(words[1])))
        else:
            self.say(f"unknown command {words[0]}")

    def statement(self, text: str) -> None:
        found = self.session.statement(text)
        self.say(formatted(found) if isinstance(found, DataFrame) else found if found is not None else text.split()[0].upper())

    def run(self, lines: Iterable[str]) -> None:
        held = ""
        for line in lines:
            if not held and line.strip() in ("exit", "\\q"):
                break
            try:
                if not held and line.startswith("\\"):
                    self.meta(line.strip())
                    continue
                held += line if line.endswith("\n") else line + "\n"
                if held.count("'") % 2 == 0 and held.rstrip().endswith(";"):
                    text, held = held, ""
                    for s in statements(text):
                        self.statement(s)
            except EngineError as e:
                held = ""
                self.say(f"error: {e}")
        self.session.close()


def main() -> None:
    spark = SparkSession.builder.appName("quillon").getOrCreate()
    Prompt(Engine(spark, sys.argv[1]), sys.stdout).run(sys.stdin)


if __name__ == "__main__":
    main()
