"""python -m sourcelens [--root DIR] QUERY: prints the context pack of a query over a directory tree."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from .plans.context import Engine
from .plans.indexed import IndexedEngine
from .plans.stored_index import StoredIndex
from .sources import corpora, files


def main() -> None:
    args = argparse.ArgumentParser(prog="sourcelens", description=__doc__)
    args.add_argument("query")
    args.add_argument("--root", help="the tree to search; by default the project around the current directory")
    args.add_argument("--allow-broad-root", action="store_true")
    args.add_argument("--session")
    args.add_argument("--agent")
    args.add_argument("--seconds", type=float, help="the time within which there must be an answer")
    args.add_argument("--index", help="a folder for the index, which queries grow and answer from; without it the whole tree is read")
    given = args.parse_args()
    root = os.path.realpath(given.root) if given.root else files.project_root(os.getcwd())
    if files.is_broad(root, os.path.realpath(os.path.expanduser("~"))) and not given.allow_broad_root:
        args.error(f"{root} is too broad; --allow-broad-root searches it all the same")
    conf = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8"}
    spark = SparkSession.builder.master("local[*]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if given.index:
        engine = IndexedEngine(spark, corpora.Tree(spark, root), StoredIndex(spark, f"file://{os.path.realpath(given.index)}"))
    else:
        corpus, cut = files.load_capped(spark, root)
        engine = Engine(spark, corpus.cache(), truncated=cut)
    print(engine.context(given.query, given.session, given.agent, seconds=given.seconds).text)
    spark.stop()


if __name__ == "__main__":
    main()
