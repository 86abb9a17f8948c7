"""Command line over a saved index: one JSON document on standard output, an exit code by what went wrong."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from lodestar.engine import ANSWERERS, MODES, SELECTORS, Engine
from lodestar.operators.answers import ERRORS
from lodestar.operators.routing import BACKENDS


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestar", description="Evidence retrieval over a saved index.")
    top.add_argument("--index", required=True, help="folder of a saved index")
    commands = top.add_subparsers(dest="command", required=True)
    ask = commands.add_parser("query", help="answer a question")
    ask.add_argument("question")
    ask.add_argument("--mode", choices=MODES, default="evidence")
    ask.add_argument("--backend", choices=BACKENDS, default="auto")
    ask.add_argument("--selector", choices=SELECTORS, default="auto")
    ask.add_argument("--answerer", choices=ANSWERERS, default="auto")
    ask.add_argument("--report-id")
    ask.add_argument("--limit", type=int)
    commands.add_parser("reports", help="list documents")
    commands.add_parser("topics", help="list navigator topics")
    commands.add_parser("chunk", help="show a chunk").add_argument("chunk_id")
    return top


def failed(code: str, message: str) -> tuple[dict, int]:
    return {"ok": False, "error": {"code": code, "message": message}}, ERRORS[code]


def answer(spark: SparkSession, arguments: argparse.Namespace) -> tuple[dict, int]:
    """The document to print and the exit code."""
    backend = arguments.backend if arguments.command == "query" else "auto"
    gone = Engine.missing(spark, arguments.index, backend)
    if gone:
        return failed("missing_index", f"The index at {arguments.index} lacks {', '.join(gone)}.")
    engine = Engine(spark, spark.read.parquet(f"{arguments.index}/chunks")).load(arguments.index)
    if arguments.command == "query":
        result = engine.query(arguments.question, arguments.mode, arguments.backend, arguments.limit, arguments.selector, arguments.report_id, arguments.answerer)
    else:
        result = {"reports": engine.reports, "topics": engine.topics}[arguments.command]() if arguments.command != "chunk" else engine.chunk(arguments.chunk_id)
    rows = [json.loads(line) for line in result.toJSON().collect()]  # one question's evidence, or a list of documents or topics
    bad = next((r for r in rows if r.get("ok") is False), None)
    if bad:
        return failed(bad["code"], bad["message"])
    return {"ok": True, "rows": rows}, 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    arguments = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        said, code = answer(spark, arguments)
    except Exception as fault:  # the command's boundary: every fault has a code
        said, code = failed("runtime_failure", f"{type(fault).__name__}: {fault}")
    print(json.dumps(said, ensure_ascii=False))
    return code


if __name__ == "__main__":
    sys.exit(main())
