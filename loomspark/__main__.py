"""python -m loomspark ingest|query|evaluate|health|explain|version: the engine from a shell."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .operators import decisions, evaluation
from .sources import files

VERSION = "0.1.0"


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("loomspark")
    parser.add_argument("--store", default="store", help="folder of the built tables")
    sub = parser.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("path")
    a.add_argument("--glob", default="*")
    a = sub.add_parser("query")
    a.add_argument("text")
    a.add_argument("--user", default="anonymous")
    a.add_argument("--role", default="user", choices=["admin", "user", "restricted", "guest"])
    a = sub.add_parser("evaluate")
    a.add_argument("gold")
    a.add_argument("--baseline")
    a.add_argument("--save-baseline", action="store_true")
    a = sub.add_parser("explain")
    a.add_argument("trace_id")
    sub.add_parser("health")
    sub.add_parser("version")
    args = parser.parse_args(argv)
    if args.command == "version":
        print(VERSION)
        return 0
    spark = SparkSession.builder.appName("loomspark").getOrCreate()
    engine = Engine(spark, args.store)
    if args.command == "ingest":
        print(engine.ingest(args.path, args.glob))
        return 0
    engine.load()
    if args.command == "query":
        asked = spark.createDataFrame([("1", args.text, args.user, args.role)], "query_id string, text string, user_id string, role string")
        out = engine.query(asked)
        print(out.select(decisions.display(out)).first()[0])
    elif args.command == "evaluate":
        gold = files.read_gold(spark, args.gold).select(F.sha2("query", 256).alias("query_id"), F.col("query").alias("text"), "gold_source_ids")
        means = evaluation.metric_means(engine.evaluate(gold), ["precision_at_k", "recall_at_k", "mrr", "ndcg_at_k", "hit_rate"])
        means.show(truncate=False)
        if args.baseline and args.save_baseline:
            files.save_baseline(means, args.baseline)
        elif args.baseline:
            compared = evaluation.regression_gate(files.read_baseline(spark, args.baseline), means)
            compared.show(truncate=False)
            return int(not compared.where("failed").isEmpty())
    elif args.command == "explain":
        engine.explain(args.trace_id).show(truncate=False)
    else:
        print(engine.health())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
