"""Command line: build graphs, evaluate findings, export subgraphs.

    python -m narrata build  --input DIR --output DIR [--movie-ids A B] [--max-scenes N] [--renames CSV] [--skip-normalization]
    python -m narrata eval   (--manifest FILE | --input DIR [--annotations GLOB]) --output DIR [--story-id A] [--match-threshold X]
                             [--reuse-existing-graphs DIR] [--verify-existing-proposals DIR] [--skip-graph-method] [--skip-llm-judge]
    python -m narrata subgraph --graphs PATH --output DIR

``--input`` holds a folder per story, or is the folder of one.  Providers other
than the built-in stub and replay are given as module:function; ``--language``
goes into every prompt's first line.
"""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from narrata.operators import graph
from narrata.plans import lifecycle, providers
from narrata.shipping import ship
from narrata.sources import stories


def provider_of(name: str) -> providers.Provider:
    """stub, replay:FILE (a JSON object of keys and responses), or module:function."""
    kind, _, rest = name.partition(":")
    if kind == "stub":
        return providers.StubProvider()
    if kind == "replay":
        with open(rest, encoding="utf-8") as f:
            return providers.ReplayProvider(json.load(f))
    return providers.CallableProvider(getattr(importlib.import_module(kind), rest), name)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="narrata")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("build", "eval", "subgraph"):
        c = commands.add_parser(name)
        c.add_argument("--output", required=True)
        if name == "subgraph":
            c.add_argument("--graphs", required=True, help="what build wrote, or a glob of scene graph files")
            continue
        c.add_argument("--input", "--movie-dir", help="folder of stories, or of one story")
        c.add_argument("--movie-ids", "--story-id", nargs="*")
        c.add_argument("--max-scenes", type=int)
        c.add_argument("--provider", default="stub")
        c.add_argument("--language", help="language of the prompts' answers")
        c.add_argument("--renames", help="CSV of story_id, src, dst")
        c.add_argument("--skip-normalization", action="store_true")
        if name == "eval":
            c.add_argument("--manifest")
            c.add_argument("--annotations", help="glob of gold files")
            c.add_argument("--match-threshold", type=float, default=0.35)
            c.add_argument("--reuse-existing-graphs", help="graphs that build wrote")
            c.add_argument("--verify-existing-proposals", help="proposals that eval wrote; only they are verified again")
            c.add_argument("--skip-graph-method", action="store_true")
            c.add_argument("--skip-llm-judge", action="store_true")
    return out


def _inputs(spark, args):
    """Scenes and gold findings."""
    if getattr(args, "manifest", None):
        scenes, gold = stories.read_cases(spark, args.manifest)
        if args.movie_ids:
            scenes = scenes.filter(F.col("story_id").isin(*args.movie_ids))
    else:
        scenes, gold = stories.read_corpus(spark, args.input, args.movie_ids), None
    if args.command == "eval" and (gold is None or args.annotations):
        gold = stories.read_findings(spark, args.annotations or [f"{args.input}/*/annotations.json"])
        gold = gold if args.annotations or not gold.isEmpty() else stories.read_findings(spark, f"{args.input}/annotations.json")
    return (stories.limit_scenes(scenes, args.max_scenes) if args.max_scenes else scenes), gold


def _graphs(spark, args, content, provider):
    if getattr(args, "reuse_existing_graphs", None):
        return stories.read_graphs(spark, args.reuse_existing_graphs)
    renames = spark.read.schema("story_id string, src string, dst string").csv(args.renames, header=True) if args.renames else None
    return lifecycle.assemble(*lifecycle.extract(content, provider, show=not isinstance(provider, providers.StubProvider)), renames, None if args.skip_normalization else provider)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("narrata").getOrCreate()
    ship(spark)
    if args.command == "subgraph":
        nodes, edges = stories.read_graphs(spark, args.graphs)
        stories.graph_pages(nodes, edges).write.mode("overwrite").partitionBy("story_id", "scene_no").text(f"{args.output}/pages")
        stories.graph_index(nodes, edges).write.mode("overwrite").partitionBy("story_id").text(f"{args.output}/index")
        return
    scenes, gold = _inputs(spark, args)
    provider = provider_of(args.provider)
    if args.language:
        provider = providers.InLanguage(provider, args.language)
    content = lifecycle.contents(scenes)
    if args.command == "build":
        nodes, edges = _graphs(spark, args, content, provider)
        stories.write_graphs(nodes, edges, f"{args.output}/scene_graphs")
        nodes, edges = stories.read_graphs(spark, f"{args.output}/scene_graphs")
        stories.write_json(graph.statistics(nodes, edges.select("source", "relation", "target", "evidence", "confidence")), f"{args.output}/stats")
        stories.write_csv(stories.segmentation(scenes), f"{args.output}/segmentation")
        return
    whole = scenes.select("story_id", "scene_no", "content")
    found = {}
    if not args.skip_graph_method:
        if args.verify_existing_proposals:
            proposals = spark.read.schema(lifecycle.PROPOSALS).json(args.verify_existing_proposals)
        else:
            nodes, edges = _graphs(spark, args, content, provider)
            proposals = lifecycle.propose_by_provider(nodes, edges, lifecycle.attribute_profiles(whole, provider), provider)
            stories.write_json(proposals, f"{args.output}/proposals")
            proposals = spark.read.schema(lifecycle.PROPOSALS).json(f"{args.output}/proposals")
        found["graph"] = lifecycle.detect(whole, provider, proposals)
    if not args.skip_llm_judge:
        found["judge"] = lifecycle.judge(whole, provider)
    for method, df in found.items():
        stories.write_json(df, f"{args.output}/{method}_findings")
    stories.write_csv(lifecycle.evaluate(gold, found, args.match_threshold).orderBy(F.col("method"), F.col("story_id")), f"{args.output}/comparison_metrics")


if __name__ == "__main__":
    main()
