"""``python -m tallyread [explain] FILE``: what a reading of a file decides."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession

from .operators.table import read_table
from .plans.explain import ExplainOptions, explain_documents, recurring_cut
from .sources.documents import UnreadableDocument, open_one

HELP = """tallyread - see what a reading of your document decides

  python -m tallyread <file>            the cut, the columns, and what is not vouched for
  python -m tallyread explain <file>    the same

  Any file it can open: a PDF, a CSV, a paste saved to disk.
"""


def run(arguments: list[str], engine=None) -> int:
    files = [a for a in arguments if a != "explain"]
    if len(files) != 1 or files[0] in ("--help", "-h"):
        sys.stdout.write(HELP)
        return 0 if len(files) == 1 else 1
    path = files[0]
    try:
        with open(path, "rb") as file:
            data = file.read()
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
        mime = "application/pdf" if path.lower().endswith(".pdf") else "text/plain"
        document = open_one(spark, os.path.basename(path), data, mime, engine=engine).cache()
        text = explain_documents(document, ExplainOptions(boundaries_of=recurring_cut))
        sys.stdout.write("".join(f"{t}\n" for t in text.values()))
        warnings = read_table(document).first()["warnings"]
        if warnings:
            sys.stdout.write("\nwhat this reading cannot vouch for:\n")
            sys.stdout.write("".join(f"  - {w}\n" for w in warnings))
        else:
            sys.stdout.write("\nnothing looked wrong from the shape of this page.\n")
            sys.stdout.write('that is not the same as "this reading is right".\n')
        return 0
    except UnreadableDocument as refused:
        sys.stderr.write(f"{refused} ({refused.reason})\n")
    except OSError as error:
        sys.stderr.write(f"could not read that file: {error}\n")
    return 1


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
