import json

from narrata import __main__ as cli


def test_build_eval_subgraph(spark, tmp_path):
    story = tmp_path / "stories" / "one"
    story.mkdir(parents=True)
    scenes = ["Ada has coats 2. Bob ran.", "Ada has coats 2.", "Ada has coats 5."]
    (story / "script.json").write_text(json.dumps([{"_id": i, "title": "INT. HALL", "content": c} for i, c in enumerate(scenes)]))
    gold = "In scene 2, Ada having coats 2 was established, yet in scene 3, Ada having coats 5 happens"
    (story / "annotations.json").write_text(json.dumps([{"id": 1, "hallucination": gold}]))
    out = str(tmp_path / "out")
    cli.main(["build", "--input", str(tmp_path / "stories"), "--output", out])
    stats = {(r.metric, r.key): r.value for r in spark.read.json(f"{out}/stats").collect()}
    # Each scene is a graph: Ada in all three, Bob in the first; four sentences, each performed by one of them.
    assert stats[("nodes_by_type", "Character")] == 4 and stats[("nodes_by_type", "Event")] == 4
    assert stats[("edges_by_relation", "performs")] == 4 and stats[("schema_violations", "all")] == 0 and stats[("avg_degree", "nodes")] == 1.0
    cli.main(["subgraph", "--graphs", f"{out}/scene_graphs", "--output", f"{out}/drawn"])
    pages = [r.value for r in spark.read.text(f"{out}/drawn/pages").collect()]
    assert len(pages) == 3 and all('"relation":"performs"' in p for p in pages)
    assert [r.value.count("<li>") for r in spark.read.text(f"{out}/drawn/index").collect()] == [3]
    cli.main(["eval", "--input", str(tmp_path / "stories"), "--output", out])
    rows = {(r.method, r.story_id): (r.tp, r.fp, r.fn) for r in spark.read.csv(f"{out}/comparison_metrics", header=True).collect()}
    assert rows[("graph", "AGGREGATE")] == ("1", "0", "0") and rows[("judge", "one")] == ("0", "0", "1")
    # A manifest names the case and its gold; graphs that are there are read, proposals that are there are verified again.
    (tmp_path / "cases.json").write_text(json.dumps([{"story_id": "case 1", "movie_dir": "stories/one", "annotations": "stories/one/annotations.json"}]))
    cli.main(["eval", "--manifest", str(tmp_path / "cases.json"), "--output", f"{out}/again", "--skip-llm-judge", "--skip-normalization"])
    cli.main(["eval", "--manifest", str(tmp_path / "cases.json"), "--output", f"{out}/third", "--skip-llm-judge", "--verify-existing-proposals", f"{out}/again/proposals"])
    for place in ("again", "third"):
        rows = {(r.method, r.story_id): (r.tp, r.fp, r.fn) for r in spark.read.csv(f"{out}/{place}/comparison_metrics", header=True).collect()}
        assert rows == {("graph", "case 1"): ("1", "0", "0"), ("graph", "AGGREGATE"): ("1", "0", "0")}
    graphs = tmp_path / "g" / "one" / "scene_graphs" / "scene_001"
    graphs.mkdir(parents=True)
    (graphs / "final_graph.json").write_text(json.dumps({"nodes": [{"id": "a", "type": "Character", "name": "Ada"}], "edges": [{"id": "e", "source": "a", "relation": "performs", "target": "b", "confidence": 0.5}]}))
    cli.main(["subgraph", "--graphs", f"{tmp_path}/g/*/scene_graphs/scene_*/final_graph.json", "--output", f"{out}/pages"])
    assert spark.read.text(f"{out}/pages/pages").filter("value like '%performs%'").count() == 1
