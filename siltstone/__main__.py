"""``python -m siltstone --config FILE --root FOLDER COMMAND``: the batch steps, search, questions and evaluation."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siltstone import schemas
from siltstone.config import Config
from siltstone.logs import log_to
from siltstone.operators.answer import http_generator, stub_generator
from siltstone.operators.evaluate import evaluation_lines
from siltstone.operators.ledger import read_ledger, report_lines
from siltstone.plans import pipeline
from siltstone.sources.store import read_json

STEPS = {"extract": pipeline.run_extract, "transform": pipeline.run_transform, "chunk": pipeline.run_chunk, "load": pipeline.run_load}


def _questions(spark: SparkSession, texts: Iterable[str]):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id bigint, query string")


def _asked(given: list[str]) -> Iterable[str]:
    """The texts on the command line, or else lines of the input up to an empty one or ``exit``."""
    if given:
        yield from given
        return
    for line in sys.stdin:
        if line.strip().lower() in ("", "exit", "quit"):
            return
        yield line.strip()


def main(arguments: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="siltstone", description=__doc__)
    p.add_argument("--config", help="YAML or JSON settings")
    p.add_argument("--root", required=True, help="folder of the tables, on a store that all executors reach")
    p.add_argument("--log", help="log file of the driver")
    p.add_argument("--model-server", help="address of a model server; without one, answers are stubs")
    p.add_argument("command", choices=[*STEPS, *(f"import-{k}" for k in pipeline.IMPORTS), *(f"export-{k}" for k in pipeline.IMPORTS if k != "html"), "run", "search", "ask", "evaluate", "report"])
    p.add_argument("texts", nargs="*", help="questions, the JSON file of an evaluation set, or the folder of an import or export")
    o = p.parse_args(arguments)
    log = log_to(o.log)
    spark = SparkSession.builder.getOrCreate()
    config = Config.load(o.config) if o.config else Config()
    generator = (lambda: http_generator(o.model_server, config.generate)) if o.model_server else stub_generator
    if o.command in STEPS:
        STEPS[o.command](spark, config, o.root)
    elif o.command.startswith(("import-", "export-")):
        what, kind = o.command.split("-")
        (pipeline.run_import if what == "import" else pipeline.run_export)(spark, o.root, kind, o.texts[0])
    elif o.command == "run":
        print("\n".join(pipeline.run_pipeline(spark, config, o.root)))
    elif o.command == "report":
        print("\n".join(report_lines(*read_ledger(spark, f"{o.root}/ledger"))))
    elif o.command == "evaluate":
        print("\n".join(evaluation_lines(pipeline.evaluate_questions(spark, read_json(spark, o.texts[0], schemas.EVALUATION), o.root, config), config.search.top_k)))
    else:
        for text in _asked(o.texts):
            one = _questions(spark, [text])
            if o.command == "search":
                for r in pipeline.search_questions(spark, one, o.root, config).orderBy("rank").collect():
                    print(f"{r['rank']}. {r['score']:.4f} {r['source']}: {r['text'][:200]}")
            else:
                row = pipeline.ask_and_log(spark, one, o.root, config, generator).select("answer", F.array_join("sources", ", ").alias("sources")).first()
                print(row["answer"], f"[{row['sources']}]" if row["sources"] else "", sep="\n")
    log.info("%s done", o.command)
    return 0


if __name__ == "__main__":
    sys.exit(main())
