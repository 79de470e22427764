"""A line-based client: python -m tessera.repl FOLDER."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .display import render_frame
from .errors import TesseraError
from .session import Session

HELP = "\\help  this text\n\\d [table]  tables, or how one was made\n\\tpcc  make the TPC-C dataset\n\\q  leave\nStatements end with a semicolon."


def command(session: Session, line: str) -> str | None:
    """What a backslash command says; None to leave."""
    word, *rest = line.split()
    if word == "\\q":
        return None
    if word == "\\d":
        return render_frame(session.execute(f"SHOW CREATE TABLE {rest[0]}" if rest else "SHOW TABLES"))
    if word == "\\tpcc":
        return render_frame(session.execute("CREATE DATASET IF NOT EXISTS tpcc"))
    return HELP


def main(root: str) -> None:
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    session, text = Session(spark, root), ""
    for line in sys.stdin:
        try:
            if not text.strip() and line.startswith("\\"):
                if (said := command(session, line)) is None:
                    return
                print(said)
                continue
            text += line
            if text.rstrip().endswith(";"):
                sql, text = text, ""
                for df in session.execute_script(sql):
                    print(render_frame(df))
        except TesseraError as e:
            print(f"{type(e).__name__}: {e}")
            text = ""


if __name__ == "__main__":
    main(sys.argv[1])
