"""python -m lodestar --path FOLDER ingest|search|retrieve|stats|list|embed ...: the engine from the command line."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from lodestar.operators import embed, search
from lodestar.plans.engine import Engine
from lodestar.schema import EngineConfig


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestar")
    top.add_argument("--path", default="data")
    top.add_argument("--dim", type=int, default=384)
    top.add_argument("--collection", default="default")
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("ingest")
    one.add_argument("--text", required=True)
    one.add_argument("--meta", default="{}")
    one.add_argument("--show-id", action="store_true")
    for name in ("search", "retrieve"):
        one = commands.add_parser(name)
        one.add_argument("--query", required=True)
        one.add_argument("--limit", type=int, default=5)
        one.add_argument("--hybrid", action="store_true")
    commands.add_parser("stats")
    commands.add_parser("list")
    commands.add_parser("embed").add_argument("--text", required=True)
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    """The lines that a command prints."""
    engine = Engine(spark, args.path, EngineConfig(dim=args.dim))
    if args.command == "ingest":
        try:
            json.loads(args.meta)
        except ValueError:
            print("metadata is not JSON; {} is stored", file=sys.stderr)
        rows = spark.sql("SELECT uuid() AS id, :t AS text, :m AS metadata, :c AS collection", args={"t": args.text, "m": args.meta, "c": args.collection}).collect()
        engine.ingest(spark.createDataFrame(rows))
        return [rows[0]["id"]] if args.show_id else ["ingested"]
    if args.command in ("search", "retrieve"):
        find = engine.search if args.command == "search" else engine.retrieve
        found = find(args.query, args.limit, args.collection, hybrid=args.hybrid)
        return [r["line"] for r in search.formatted(found).orderBy("rank").collect()]
    if args.command == "stats":
        return [json.dumps(r.asDict()) for r in engine.stats(args.collection).collect()]
    if args.command == "list":
        return sorted(r[0] for r in engine.list_collections().collect())
    v = spark.createDataFrame([(0, engine.embed_query(args.text))], "id long, embedding array<float>")
    r = embed.preview(v).first()
    return [f"dim {r['dim']}, first 8 {[round(x, 4) for x in r['head']]}, norm {r['norm']:.4f}"]


def main() -> None:
    args = parser().parse_args()
    spark = SparkSession.builder.appName("lodestar").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    print("\n".join(run(spark, args)))


if __name__ == "__main__":
    main()
