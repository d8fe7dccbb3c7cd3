"""``python -m plumbline``: list queries, run one, or build an index.

    python -m plumbline list
    python -m plumbline run bm25_topk /data/sf1 --out /tables/hits
    python -m plumbline build-index /data/sf1 /tables/index
    python -m plumbline build-engine /data/sf1 /tables/engine      # parts that are there already are kept
    python -m plumbline review /tables/engine /data/questions.parquet --out /tables/answers
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .engine import Engine
from .operators.lexical import LexicalIndex
from .plans import registry
from .plans.loop import Session, named_documents, review
from .plans.shared import documents
from .session import ship


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="plumbline")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    run.add_argument("query")
    run.add_argument("data")
    run.add_argument("--out", help="write Parquet here; without it 20 rows are shown")
    build = commands.add_parser("build-index")
    build.add_argument("data")
    build.add_argument("target")
    engine = commands.add_parser("build-engine")
    engine.add_argument("data")
    engine.add_argument("target")
    asks = commands.add_parser("review")
    asks.add_argument("engine")
    asks.add_argument("questions", help="Parquet of query_id, query and, if there is one, jurisdiction")
    asks.add_argument("--out", help="write Parquet here; without it 20 rows are shown")
    asks.add_argument("--no-memory", action="store_true")
    given = parser.parse_args(args)
    if given.command == "list":
        print("\n".join(sorted(registry.queries())))
        return
    spark = ship(SparkSession.builder.appName("plumbline").getOrCreate())
    if given.command == "build-index":
        LexicalIndex.build(documents(spark, given.data)).save(given.target)
        return
    if given.command == "build-engine":
        Engine.build(named_documents(documents(spark, given.data)), given.target)
        return
    if given.command == "review":
        session = Session(Engine.load(spark, given.engine), use_memory=not given.no_memory)
        found = review(spark.read.parquet(given.questions), session)
    else:
        found = registry.queries()[given.query](spark, given.data)
    if given.out:
        found.write.mode("overwrite").parquet(given.out)
    else:
        found.show(20, truncate=80)


if __name__ == "__main__":
    main()
