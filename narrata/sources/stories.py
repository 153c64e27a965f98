"""Sources and sinks of stories, scenes, graphs, findings and texts.

All reads go through Spark's readers with given schemas, so any store that
Spark reaches will do; a path may be a glob over many stories.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = "struct<id: string, content: string, source_doc_id: string, start_pos: int, end_pos: int>"
SCRIPT = "_id int, title string, subtitle string, content string"
PART = f"struct<document_metadata: struct<scene_category: string, region: string, main_location: string, sub_location: string, summary: string, source_doc_id: string>, chunks: array<{CHUNK}>>"
FINDING = "id int, hallucination string"
MANIFEST = "story_id string, movie_dir string, annotations string"
GRAPH = (
    "nodes array<struct<id: string, type: string, name: string, aliases: array<string>, description: string, scene_refs: array<string>, evidence: array<string>>>, "
    "edges array<struct<id: string, source: string, relation: string, target: string, scene_refs: array<string>, evidence: array<string>, confidence: double>>")
#: Up to this many characters a scene with several chunks becomes one chunk.
SHORT_SCENE = 1200


def story_of(path) -> "F.Column":
    """The name of the folder that a file lies in."""
    return F.element_at(F.split(path, "/"), -2)


def plain_path(path) -> "F.Column":
    """A path without scheme, escapes and empty or dot steps, so that a file's name and a manifest's meet."""
    bare = F.regexp_replace(F.regexp_replace(path, r"^\w+:(//[^/]*)?", ""), r"/(\./|/)+", "/")
    return F.regexp_replace(bare, "/$", "")


def _of_cases(rows: DataFrame, cases: DataFrame | None, column: str) -> DataFrame:
    """Rows(file, ...) with the story_id of their case, by the folder (movie_dir) or the file (annotations) that the case names; else of their folder."""
    if cases is None:
        return rows.withColumn("story_id", story_of("file"))
    file = plain_path(F.url_decode("file"))
    key = F.regexp_replace(file, "/[^/]*$", "") if column == "movie_dir" else file
    named = cases.select("story_id", plain_path(F.col(column)).alias("place")).distinct()
    return rows.withColumn("place", key).join(named, "place").drop("place")


def read_scripts(spark: SparkSession, path, cases: DataFrame | None = None) -> DataFrame:
    """(story_id, scene_no, ord, title, subtitle, content, category) of script files: JSON arrays, a folder per story.

    Scene numbers are 1-based; the category comes from INT. or EXT. in the title.
    """
    rows = _of_cases(spark.read.schema(SCRIPT).option("multiLine", True).json(path).select("*", F.col("_metadata.file_path").alias("file")), cases, "movie_dir")
    upper = F.upper(F.coalesce("title", F.lit("")))
    kind = F.when(upper.contains("INT."), "INT").when(upper.contains("EXT."), "EXT").otherwise("UNKNOWN")
    return rows.filter("_id is not null").select("story_id", (F.col("_id") + 1).alias("scene_no"), F.col("_id").alias("ord"), "title", "subtitle", F.coalesce("content", F.lit("")).alias("content"), kind.alias("category"))


def read_chunks(spark: SparkSession, path, cases: DataFrame | None = None) -> DataFrame:
    """(story_id, scene_no, part, meta, chunks) of chunk files: maps from scene_<n>_part_<k> to metadata and chunks."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", f"map<string, {PART}>").alias("m"))
    text = _of_cases(files, cases, "movie_dir")
    rows = text.select("story_id", F.explode("m").alias("k", "v"))
    number = [F.regexp_extract("k", r"^scene_(\d+)_part_(\d+)$", i).try_cast("int") for i in (1, 2)]
    return rows.select("story_id", number[0].alias("scene_no"), number[1].alias("part"), F.col("v.document_metadata").alias("meta"), F.col("v.chunks").alias("chunks")).filter("scene_no is not null")


def assemble(scripts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Scenes with their chunks: parts 1..k up to the first gap, joined on the scene; the first part's metadata counts."""
    w = Window.partitionBy("story_id", "scene_no").orderBy("part")
    whole = chunks.withColumn("n", F.row_number().over(w)).filter("n = part")
    parts = whole.groupBy("story_id", "scene_no").agg(F.array_sort(F.collect_list(F.struct("part", "chunks"))).alias("p"), F.min_by("meta", "part").alias("meta"))
    parts = parts.select("story_id", "scene_no", "meta", F.flatten(F.transform("p", lambda x: F.coalesce(x["chunks"], F.array()))).alias("chunks"))
    return collapse_short(scripts.join(parts, ["story_id", "scene_no"], "left"))


def collapse_short(scenes: DataFrame, most: int = SHORT_SCENE) -> DataFrame:
    """One chunk of the whole content for scenes without chunks, and for short scenes with several; blank scenes keep theirs."""
    bare = F.trim("content")
    one = F.array(F.struct(F.concat_ws("_", F.lit("scene"), "scene_no", F.lit("full")).alias("id"), F.col("content").alias("content"), F.lit(None).cast("string").alias("source_doc_id"), F.lit(0).alias("start_pos"), F.length("content").alias("end_pos")))
    none = F.col("chunks").isNull() | (F.size("chunks") == 0)
    return scenes.withColumn("chunks", F.when(none, one).when((bare != "") & (F.length(bare) <= most) & (F.size("chunks") > 1), one).otherwise(F.col("chunks")))


def limit_scenes(scenes: DataFrame, most: int) -> DataFrame:
    """The first ``most`` scenes of each story (a feature of the command line)."""
    return scenes.filter(F.col("ord") < most)


def _chunks_or_none(spark: SparkSession, path, cases: DataFrame | None = None) -> DataFrame:
    try:
        return read_chunks(spark, path, cases)
    except Exception as error:  # no story has chunks
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], f"story_id string, scene_no int, part int, meta struct<scene_category: string>, chunks array<{CHUNK}>")


def read_corpus(spark: SparkSession, root: str, ids: list[str] | None = None, titles: str | None = None) -> DataFrame:
    """Scenes of all stories under ``root`` (or of the one story that ``root`` itself holds); ``ids`` filters, ``titles`` is a CSV of story_id and title."""
    try:
        scripts, chunks = read_scripts(spark, f"{root}/*/script.json"), f"{root}/*/doc2chunks.json"
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        scripts, chunks = read_scripts(spark, f"{root}/script.json"), f"{root}/doc2chunks.json"
    if ids:
        scripts = scripts.filter(F.col("story_id").isin(*ids))
    out = assemble(scripts, _chunks_or_none(spark, chunks))
    if titles:
        names = spark.read.csv(titles, header=True).select("story_id", F.col("title").alias("story_title"))
        out = out.join(names, "story_id", "left")
    return out


def read_cases(spark: SparkSession, manifest: str) -> tuple[DataFrame, DataFrame]:
    """Scenes and gold findings of a manifest's cases, under the cases' names."""
    cases = read_manifest(spark, manifest)
    named = cases.collect()  # the cases of one run
    scripts = read_scripts(spark, [f"{r.movie_dir}/script.json" for r in named], cases)
    at_hand = [r.movie_dir for r in named if not _missing(spark, f"{r.movie_dir}/doc2chunks.json")]
    chunks = _chunks_or_none(spark, [f"{d}/doc2chunks.json" for d in at_hand] or f"{named[0].movie_dir}/doc2chunks.json", cases)
    gold = read_findings(spark, [r.annotations for r in named if r.annotations], cases)
    return assemble(scripts, chunks), gold


def _missing(spark: SparkSession, name: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Cases; relative folders are taken from the manifest's folder.  Anything but an array of cases raises."""
    text = spark.read.text(path, wholetext=True).first()
    if text is None or not text[0].lstrip().startswith("["):
        raise ValueError(f"{path} is not a list of cases")
    base = path.rsplit("/", 1)[0] if "/" in path else "."
    rows = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    if rows.isEmpty():
        raise ValueError(f"{path} has no cases")
    full = {c: F.when(F.col(c).rlike(r"^(/|\w+:)"), F.col(c)).otherwise(F.concat(F.lit(base + "/"), F.col(c))) for c in ("movie_dir", "annotations")}
    return rows.withColumns(full)


def read_findings(spark: SparkSession, path, cases: DataFrame | None = None) -> DataFrame:
    """(story_id, pos, id, hallucination) of finding files, gold or predicted; none where no file is."""
    none = spark.createDataFrame([], "story_id string, pos int, id int, hallucination string")
    if not path:
        return none
    try:
        rows = spark.read.text(path, wholetext=True)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return none
    lists = rows.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "array<struct<id: int, hallucination: string>>").alias("l"))
    return _of_cases(lists, cases, "annotations").select("story_id", F.posexplode("l").alias("pos", "f")).select("story_id", "pos", "f.id", "f.hallucination")


def read_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of scene graphs, with story_id, scene_no and pos: what ``write_graphs`` wrote, or
    files .../<story>/scene_graphs/scene_<n>/final_graph.json.
    """
    file = F.url_decode(F.col("_metadata.file_path"))
    rows = spark.read.schema(GRAPH).option("multiLine", True).option("recursiveFileLookup", True).json(path).select(file.alias("file"), "nodes", "edges")
    story = F.coalesce(*[F.nullif(F.regexp_extract("file", p, 1), F.lit("")) for p in (r"/story_id=([^/]+)/", r"/([^/]+)/scene_graphs/scene_\d+/")])
    scene = F.coalesce(*[F.regexp_extract("file", p, 1).try_cast("int") for p in (r"/scene_no=(\d+)/", r"/scene_(\d+)/[^/]*$")])
    rows = rows.withColumn("story_id", story).withColumn("scene_no", scene).filter("scene_no is not null")
    nodes, edges = (rows.select("story_id", "scene_no", F.posexplode(c).alias("pos", "x")).select("story_id", "scene_no", "pos", "x.*") for c in ("nodes", "edges"))
    return nodes, edges


def write_graphs(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Scene graphs as one table partitioned by story and scene, nodes and edges in arrays."""
    keys = ["story_id", "scene_no"]

    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[c for c in sorted(df.columns) if c not in keys]))).alias(name))

    packed(nodes, "nodes").join(packed(edges, "edges"), keys, "full").write.mode("overwrite").partitionBy(*keys).json(path)


def incomplete(scenes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(story_id, expected, found): stories with fewer scene graphs than scenes."""
    want = scenes.groupBy("story_id").agg(F.count_distinct("scene_no").alias("expected"))
    have = nodes.groupBy("story_id").agg(F.count_distinct("scene_no").alias("found"))
    return want.join(have, "story_id", "left").withColumn("found", F.coalesce("found", F.lit(0))).filter("found < expected")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(story_id, text) of whole-text files such as */*/*/source.txt."""
    return spark.read.text(path, wholetext=True).select(story_of(F.col("_metadata.file_path")).alias("story_id"), F.col("value").alias("text"))


def segmentation(scenes: DataFrame) -> DataFrame:
    """The summary sink's columns: each scene with its content length and number of chunks."""
    return scenes.select("story_id", "scene_no", "ord", "title", "category", F.length("content").alias("content_length"), F.size("chunks").alias("num_chunks"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


#: A colour per node type.
COLOURS = {"Character": "#4e79a7", "Event": "#f28e2b", "Location": "#59a14f", "TimePoint": "#b07aa1", "Object": "#9c755f", "Vehicle": "#76b7b2", "Concept": "#edc948"}

_DRAW = """
const draw=(n,e)=>{const s=document.querySelector('svg'),c=document.querySelector('#legend'),at={},deg={},types=[...new Set(n.map(x=>x.type))];
e.forEach(x=>{deg[x.source]=(deg[x.source]||0)+1;deg[x.target]=(deg[x.target]||0)+1});
n.forEach((x,i)=>{const a=2*Math.PI*i/n.length;at[x.id]=[500+400*Math.cos(a),450+400*Math.sin(a)]});
const put=(tag,attrs,text)=>{const el=document.createElementNS('http://www.w3.org/2000/svg',tag);for(const k in attrs)el.setAttribute(k,attrs[k]);if(text)el.textContent=text;s.append(el);return el};
e.forEach(x=>{const a=at[x.source],b=at[x.target];if(a&&b){put('line',{x1:a[0],y1:a[1],x2:b[0],y2:b[1],stroke:'#bbb'});put('text',{x:(a[0]+b[0])/2,y:(a[1]+b[1])/2,'font-size':9,fill:'#777'},x.relation)}});
n.forEach(x=>{const p=at[x.id];put('circle',{cx:p[0],cy:p[1],r:5+2*Math.sqrt(deg[x.id]||0),fill:colours[x.type]||'#999'});put('text',{x:p[0]+8,y:p[1],'font-size':11},x.name)});
types.forEach(t=>{const li=document.createElement('li');li.textContent=t;li.style.color=colours[t]||'#999';c.append(li)})};
draw(nodes,edges)
"""


def graph_pages(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(story_id, scene_no, html): a page per scene that draws its graph: nodes by type and degree, edges with their relations, a legend."""
    keys = ["story_id", "scene_no"]
    n = nodes.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "type", "name")))).alias("n"))
    e = edges.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(F.struct("source", "relation", "target")))).alias("e"))
    safe = [F.replace(F.coalesce(c, F.lit("[]")), F.lit("<"), F.lit("\\u003c")) for c in ("n", "e")]
    title = F.replace(F.replace(F.concat_ws(" ", "story_id", F.col("scene_no").cast("string")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(F.lit("<!doctype html><meta charset=utf-8><title>"), title, F.lit("</title><ul id=legend></ul><svg viewBox='0 0 1000 900'></svg><script>const colours="),
                    F.lit(json.dumps(COLOURS)), F.lit(",nodes="), safe[0], F.lit(",edges="), safe[1], F.lit(";" + _DRAW.replace("\n", "") + "</script>"))
    return n.join(e, keys, "left").select(*keys, page.alias("html"))


def graph_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(story_id, html): a page per story that lists its scenes, which sort as strings, with their counts."""
    keys = ["story_id", "scene_no"]
    n, e = (df.groupBy(*keys).agg(F.count("*").alias(c)) for df, c in ((nodes, "n"), (edges, "e")))
    scene = F.col("scene_no").cast("string")
    line = F.concat(F.lit("<li><a href='scene_no="), scene, F.lit("/'>scene "), scene, F.lit("</a>: "), F.col("n").cast("string"), F.lit(" nodes, "), F.coalesce("e", F.lit(0)).cast("string"), F.lit(" edges</li>"))
    items = n.join(e, keys, "left").groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct(scene.alias("s"), line.alias("line")))).alias("l"))
    return items.select("story_id", F.concat(F.lit("<!doctype html><meta charset=utf-8><ul>"), F.array_join(F.transform("l", lambda x: x["line"]), ""), F.lit("</ul>")).alias("html"))
